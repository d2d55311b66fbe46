"""Trees of move sequences: one row per sequence, the parent is the sequence without its last move."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import parent_sequence, prefixes
from wardline.session import attach_small, cut_lineage


def sequence_depth(df: DataFrame, half_depth: str = "depth", mover: str = "made_move") -> DataFrame:
    """Ply from the half-move depth and a flag for the first side."""
    return df.withColumns({half_depth: (F.col(half_depth) * 2).cast("int"), mover: F.col(mover) == "w"})


def link_parents(nodes: DataFrame, seq: str, key: str, name: str = "parent_id") -> DataFrame:
    from wardline.operators.matching import attach_parent_by_prefix
    return attach_parent_by_prefix(nodes, seq, key, name)


def tree_nodes(sequences: DataFrame, seq: str, max_depth: int | None = None) -> DataFrame:
    """All distinct prefixes, up to a depth if one is given, with the number of sequences through each."""
    top = F.least(F.size(seq), F.lit(max_depth)) if max_depth else F.size(seq)
    # a row for each length, cut afterwards: the prefixes of a long sequence never stand in one row
    lengths = sequences.filter(F.size(seq) > 0).select(F.col(seq).alias("_seq"), F.explode(F.sequence(F.lit(1), top)).alias("_n"))
    return lengths.select(F.slice("_seq", F.lit(1), F.col("_n")).alias("play")).groupBy("play").agg(
        F.count("*").alias("games")).withColumn("depth", F.size("play"))


def label_by_prefix(df: DataFrame, seq: str, key: list[str], book: DataFrame, book_seq: str, label: str,
                    early: int = 4, late: int = 24) -> DataFrame:
    """Longest known prefix as the label; early and later labels are kept apart.

    ``early_label`` is the longest match of at most ``early`` moves, ``late_label`` the longest
    match of more than that, up to ``late`` moves.
    """
    names = book.groupBy(F.col(book_seq).alias("_prefix")).agg(F.min(label).alias("_name"))
    tried = df.select(*key, F.explode(prefixes(seq, late)).alias("_prefix"))
    # a common first move is a hot key
    found = attach_small(tried, names, ["_prefix"], key).withColumn("_len", F.size("_prefix"))
    # each sequence has at most ``late`` prefixes, so this group stays small
    best = found.groupBy(*key).agg(
        F.max_by("_name", F.when(F.col("_len") <= early, F.col("_len"))).alias("early_label"),
        F.max_by("_name", F.when(F.col("_len") > early, F.col("_len"))).alias("late_label"))
    return df.join(best, key, "left")


def explode_labels(df: DataFrame, labels: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode_outer(labels)).drop(labels)


def carry_forward_label(nodes: DataFrame, seq: str, label: str, name: str = "carried") -> DataFrame:
    """A node's own label, else that of its nearest labelled ancestor."""
    named = nodes.filter(F.col(label).isNotNull()).select(F.col(seq).alias("_prefix"), F.col(label).alias("_name"))
    bare = nodes.filter(F.col(label).isNull())
    tried = bare.select(seq, F.explode(prefixes(seq)).alias("_prefix"))
    best = attach_small(tried, named, ["_prefix"], [seq]).groupBy(seq).agg(F.max_by("_name", F.size("_prefix")).alias("_near"))
    return nodes.join(best, seq, "left").withColumn(name, F.coalesce(label, "_near")).drop("_near")


def rollup_tree(nodes: DataFrame, seq: str, value: str, max_depth: int) -> DataFrame:
    """Roll values up from the leaves, level by level.

    A node without children carries its own value (spread 0). Any other node takes the largest
    maximum, the smallest minimum, the mean and the population deviation of its children's means.
    A mean of child means is not a mean over leaves, so no level can be skipped. Each level reads
    only the one below, which is checkpointed, so the work is one pass over the nodes in all.
    """
    cols = ["max_value", "min_value", "avg_value", "sd_value"]
    own = cut_lineage(nodes.filter(F.size(seq).between(1, max_depth)).withColumn("_own", F.col(value).cast("double")))
    below, done = None, []
    for depth in range(max_depth, 0, -1):
        here = own.filter(F.size(seq) == depth)
        if below is None:
            level = here.withColumns({c: F.col("_own") for c in cols[:3]}).withColumn("sd_value", F.lit(0.0))
        else:
            up = below.groupBy(parent_sequence(seq).alias(seq)).agg(
                F.max("max_value").alias("_max"), F.min("min_value").alias("_min"), F.avg("avg_value").alias("_avg"),
                F.stddev_pop("avg_value").alias("_sd"))
            carried = [F.coalesce(u, F.col("_own")).alias(c) for u, c in zip(("_max", "_min", "_avg"), cols)]
            level = here.join(up, seq, "left").select(*here.columns, *carried, F.coalesce("_sd", F.lit(0.0)).alias("sd_value"))
        below = cut_lineage(level)
        done.append(below)
    return reduce(lambda a, b: a.unionByName(b), done).drop("_own")


def risk_score(mean: str = "avg_value", sd: str = "sd_value") -> Column:
    return F.col(mean) - F.col(sd)


def uniform_from_hash(seed: int, *cols: str) -> Column:
    """Uniform number in (0, 1) from the first 8 hex digits of an md5; the same in every engine."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return (F.conv(F.substring(text, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def weighted_choice_per(df: DataFrame, keys: list[str], item: str, weight: str, seed: int = 0) -> DataFrame:
    """One item per key, drawn with probability in proportion to its weight."""
    race = -F.log(uniform_from_hash(seed, *keys, item)) / F.col(weight)
    drawn = df.filter(F.col(weight) > 0).groupBy(*keys).agg(F.min_by(item, F.struct(race, F.col(item))).alias(item))
    return drawn
