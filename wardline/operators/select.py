"""Filters, projections and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.ranking import first_per
from wardline.session import cut_lineage, small_table


def require_complete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``cols`` (default: any column)."""
    return df.dropna(subset=cols)


def eligible(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that meet every rule; a rule that is null excludes the row."""
    return df.filter(reduce(lambda a, b: a & b, rules.values()))


def exclusion_flow(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows left after each rule in turn, from one pass: (step, rule, n)."""
    met, kept = [F.count("*").alias("start")], F.lit(True)
    for name, rule in rules.items():
        kept = kept & rule
        met.append(F.count_if(kept).alias(name))
    counts = df.agg(*met)
    names = ["start", *rules]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(n).alias("n"))
                               for i, n in enumerate(names)]))
    return counts.select(rows.alias("r")).select("r.*")


def score_threshold(df: DataFrame, col: str, k: float) -> DataFrame:
    return df.filter(F.col(col) >= k)


def split_by_site(df: DataFrame, col: str, train_values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training sites and all other sites (rows without a site go to the second)."""
    inside = F.coalesce(F.col(col).isin(train_values), F.lit(False))
    return df.filter(inside), df.filter(~inside)


def select_except(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def recode(col: str | Column, mapping: dict[str, str | None]) -> Column:
    """Merge category values; a target of None means null, unlisted values stay."""
    source = F.col(col) if isinstance(col, str) else col
    out = source
    for old, new in mapping.items():
        out = F.when(source == old, F.lit(new)).otherwise(out)
    return out


def binary_encode(col: str | Column, true_value) -> Column:
    source = F.col(col) if isinstance(col, str) else col
    return F.coalesce((source == true_value).cast("int"), F.lit(0))


def pick_outcome(df: DataFrame, selection: str, choices: dict[str, str] | None = None) -> DataFrame:
    """Set ``outcome`` to one of several outcome columns."""
    choices = choices or {"severe": "severe", "icu": "icu", "death": "died"}
    return df.withColumn("outcome", F.col(choices[selection]))


def trim_outliers(df: DataFrame, col: str, upper: float) -> DataFrame:
    """Drop values at or above a cut; rows without a value stay."""
    return df.filter(F.col(col).isNull() | (F.col(col) < upper))


# --- set operations ------------------------------------------------------------

def union_sites(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column one site lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_measures(frames: dict[str, DataFrame], name: str = "measure") -> DataFrame:
    """Stack one frame per measure into a long table with the measure's name."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn(name, F.lit(m)) for m, f in frames.items()])


def union_intervals(sources: dict[str, tuple[DataFrame, str, str, str]], entity: str) -> DataFrame:
    """Interval tables as one timeline: {source: (df, start, stop, label)}."""
    parts = [df.select(entity, F.col(start).alias("starttime"), F.col(stop).alias("stoptime"),
                       F.col(label).cast("string").alias("label"), F.lit(source).alias("source"))
             for source, (df, start, stop, label) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in a stated order (not just any row)."""
    return first_per(df, keys, order)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def column_set_difference(a: list[str], b: list[str]) -> list[str]:
    other = set(b)
    return [c for c in a if c not in other]


def add_missing_levels(df: DataFrame, col: str, levels: list[str], fill: dict[str, object] | None = None,
                       within: list[str] | None = None) -> DataFrame:
    """Pad so every level appears (once per group of ``within``); padded cells take ``fill``."""
    all_levels = F.explode(F.array(*[F.lit(v) for v in levels])).alias(col)
    if within:
        grid = df.select(*within).distinct().select(*within, all_levels)
    else:
        grid = df.sparkSession.range(1).select(all_levels)
    out = grid.join(df, [*(within or []), col], "left")
    return out.fillna(fill) if fill else out


def order_by_level(df: DataFrame, col: str, levels: list[str], then: list[str] | None = None) -> DataFrame:
    """Sort by category order; values outside the list come last."""
    place = F.map_from_arrays(F.array(*[F.lit(v) for v in levels]), F.array(*[F.lit(i) for i in range(len(levels))]))
    return df.withColumn("level", F.coalesce(F.try_element_at(place, F.col(col)), F.lit(len(levels)))).orderBy("level", *(then or []))


def sample_entities(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct entities, the same ones on every run (hash order)."""
    from wardline.scale import hash_key
    return df.select(key).distinct().orderBy(hash_key(seed, key), key).limit(n)


def restrict_to_keys(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Semi join. A proven small key list is broadcast, any other is joined by exchange."""
    cols = [key] if isinstance(key, str) else key
    wanted = keys.select(*cols)
    local = small_table(wanted)
    return df.join(F.broadcast(local) if local is not None else wanted, cols, "left_semi")


def extract_cohort_subset(tables: dict[str, DataFrame], cohort: DataFrame, grain: dict[str, str],
                          parents: dict[str, tuple[str, str]] | None = None,
                          copied: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Subset of a whole database.

    ``cohort`` holds the key columns of the chosen entities. ``grain`` maps a table to the key
    it is cut by, ``parents`` maps a detail table to (parent table, key) and follows the parent's
    subset, ``copied`` names tables taken whole. The cohort is worked out once, into a written table.
    """
    cohort = cut_lineage(cohort)
    needed = sorted({k for k in grain.values()})
    keyed = {k: cohort.select(k).filter(F.col(k).isNotNull()).distinct() for k in needed}
    local = {k: small_table(v) for k, v in keyed.items()}

    def cut(df: DataFrame, key: str) -> DataFrame:
        keys = F.broadcast(local[key]) if local[key] is not None else keyed[key]
        return df.join(keys, key, "left_semi")

    out = {t: cut(tables[t], k) for t, k in grain.items()}
    for table, (parent, key) in (parents or {}).items():
        out[table] = tables[table].join(out[parent].select(key), key, "left_semi")
    return out | {t: tables[t] for t in copied}
