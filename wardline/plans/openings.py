"""Statistics over trees of move sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import last_move, move_text, parent_sequence
from wardline.operators import aggregates, ranking, tree


def node_table(sequences: DataFrame, seq: str, value: str, max_depth: int) -> DataFrame:
    """One row per distinct prefix: play, depth, games, mean value, move, side to move, text and parent text."""
    from wardline.functions.scalars import prefixes
    spread = sequences.select(F.explode(prefixes(seq, max_depth)).alias("play"), F.col(value).alias("_v"))
    nodes = spread.groupBy("play").agg(F.count("*").alias("games"), F.avg("_v").alias("value"))
    return nodes.select("play", F.size("play").alias("depth"), "games", "value", last_move("play").alias("move"),
                        F.when(F.size("play").bitwiseAND(F.lit(1)) == 1, "w").otherwise("b").alias("made_move"),
                        move_text("play").alias("pgn"), move_text(parent_sequence("play")).alias("parent_pgn"))


def scored_tree(nodes: DataFrame, max_depth: int) -> DataFrame:
    """Nodes with values rolled up from the leaves and the risk score (mean less deviation)."""
    rolled = tree.rollup_tree(nodes, "play", "value", max_depth)
    return rolled.withColumn("score", tree.risk_score())


def opening_profile(labelled: DataFrame, label: str, value: str) -> DataFrame:
    """Win-rate profile per opening, most played first; nodes without a label are counted as such."""
    named = labelled.withColumn("opening", F.coalesce(F.col(label), F.lit("No opening identified")))
    return aggregates.group_profile(named, ["opening"], value).orderBy(F.col("n").desc(), "opening")


def best_moves(scored: DataFrame) -> DataFrame:
    """Child with the best score per parent."""
    children = scored.withColumn("parent", F.array_join(parent_sequence("play"), ","))
    return ranking.argmax_per(children, ["parent"], "score", ["move"], ["move", "score"])


def drawn_moves(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """One child per parent, drawn in proportion to the games through it."""
    children = nodes.withColumn("parent", F.array_join(parent_sequence("play"), ","))
    return tree.weighted_choice_per(children, ["parent"], "move", "games", seed)
