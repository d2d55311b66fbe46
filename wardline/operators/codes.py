"""Code sets to flags, flags to scores.

A condition is a list of tokens per code version: ``410`` matches codes that start with it,
``4254-4259`` a range of equally long prefixes (both ends in), ``=A021`` the exact code.
"""

from __future__ import annotations

import csv
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import small_table

RULES = Path(__file__).resolve().parent.parent / "rules"

Conditions = dict[str, dict[int, list[str]]]


def load_conditions(path: str | Path) -> Conditions:
    """Rule file with columns condition, version, codes (tokens separated by spaces)."""
    out: Conditions = {}
    with open(path, newline="") as fh:
        for row in csv.DictReader(line for line in fh if not line.startswith("#")):
            out.setdefault(row["condition"], {}).setdefault(int(row["version"]), []).extend(row["codes"].split())
    return out


def code_hits(rows: DataFrame, conditions: Conditions) -> DataFrame:
    """Bits of the conditions each row's ``_code`` meets, one row per hit (``_bit``).

    A code is held against the rule table by its prefixes of the widths the rules use, so the
    work per code does not grow with the number of rules. The rule tables hold one row per token.
    """
    prefixes, ranges = [], []
    for bit, by_version in enumerate(conditions.values()):
        for version, tokens in by_version.items():
            for t in tokens:
                if t.startswith("="):
                    prefixes.append((version, 0, t[1:], 1 << bit))
                elif "-" in t:
                    lo, hi = t.split("-")
                    ranges.append((version, len(lo), lo, hi, 1 << bit))
                else:
                    prefixes.append((version, len(t), t, 1 << bit))
    widths = sorted({w for _, w, *_ in prefixes + ranges if w})
    cuts = [F.struct(F.lit(0).alias("_width"), F.col("_code").alias("_prefix"))]
    cuts += [F.struct(F.lit(w).alias("_width"), F.substring("_code", 1, w).alias("_prefix")) for w in widths]
    cut = rows.withColumn("_cut", F.explode(F.array(*cuts))).select(*rows.columns, "_cut.*")
    spark = rows.sparkSession
    listed = spark.createDataFrame(prefixes, "_version int, _width int, _prefix string, _bit bigint").groupBy(
        "_version", "_width", "_prefix").agg(F.bit_or("_bit").alias("_bit"))
    hits = cut.join(F.broadcast(listed), ["_version", "_width", "_prefix"])
    if not ranges:
        return hits.select(*rows.columns, "_bit")
    spans = spark.createDataFrame(ranges, "_version int, _width int, _lo string, _hi string, _bit bigint")
    inside = cut.join(F.broadcast(spans), ["_version", "_width"]).filter(F.col("_prefix").between(F.col("_lo"), F.col("_hi")))
    return hits.select(*rows.columns, "_bit").unionByName(inside.select(*rows.columns, "_bit"))


def any_code_flag(codes: DataFrame, entity: str, version: str, code: str, conditions: Conditions,
                  trim: bool = False, max_codes: int = 200_000) -> DataFrame:
    """0/1 flag per entity and condition; both code versions and all conditions in one exchange.

    The rules are tested once per distinct code, not once per row: the codes that meet any rule
    make a table of proven size, which is broadcast. If there are too many of them the rows
    themselves are held against the rule table. Flags travel as bits of one number.
    """
    text = F.trim(F.col(code)) if trim else F.col(code)
    rows = codes.select(F.col(entity), F.col(version).cast("int").alias("_version"), text.alias("_code"))
    listed = code_hits(rows.select("_version", "_code").distinct(), conditions).groupBy("_version", "_code").agg(F.bit_or("_bit").alias("_bit"))
    local = small_table(listed, max_codes)
    if local is not None:
        masked = rows.join(F.broadcast(local), ["_version", "_code"], "left").select(entity, "_bit")
    else:
        none = rows.select(entity).withColumn("_bit", F.lit(0).cast("bigint"))
        masked = code_hits(rows, conditions).select(entity, "_bit").unionByName(none)
    met = masked.groupBy(entity).agg(F.coalesce(F.bit_or("_bit"), F.lit(0).cast("bigint")).alias("_met"))
    return met.select(entity, *[F.shiftright(F.col("_met"), bit).bitwiseAND(F.lit(1)).cast("int").alias(name)
                                for bit, name in enumerate(conditions)])


def with_all_entities(flags: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Keep entities that have no code at all, with every flag 0."""
    names = [c for c in flags.columns if c != entity]
    return entities.join(flags, entity, "left").fillna(0, subset=names)


def rollup_flags(df: DataFrame, entity: str, flags: list[str]) -> DataFrame:
    return df.groupBy(entity).agg(*[F.bool_or(F.col(f) == 1).alias(f) for f in flags])


def combine_versions(a: DataFrame, b: DataFrame, entity: str, flags: list[str]) -> DataFrame:
    """Greater of two flag tables; an absent entity counts as 0."""
    left = a.select(entity, *[F.col(f).alias(f"_a_{f}") for f in flags])
    right = b.select(entity, *[F.col(f).alias(f"_b_{f}") for f in flags])
    joined = left.join(right, entity, "full")
    zero = F.lit(0)
    return joined.select(entity, *[F.greatest(F.coalesce(F.col(f"_a_{f}"), zero), F.coalesce(F.col(f"_b_{f}"), zero)).alias(f)
                                   for f in flags])


def age_band_score(age: str, limits: list[int]) -> Column:
    """0 up to the first limit, 1 up to the second, and so on; a null age takes the top score."""
    out = F.lit(len(limits))
    for score, limit in reversed(list(enumerate(limits))):
        out = F.when(F.col(age) <= limit, F.lit(score)).otherwise(out)
    return out


def weighted_index(weights: dict[str, int], max_groups: list[list[str]]) -> Column:
    """Weighted sum of flags; of the flags in one group only the greatest term counts."""
    grouped = {f for g in max_groups for f in g}
    term = lambda f: F.col(f) * F.lit(weights[f])
    terms = [F.greatest(*[term(f) for f in g]) for g in max_groups] + [term(f) for f in weights if f not in grouped]
    return reduce(lambda a, b: a + b, terms)


def decision_flag(cases: list[Column]) -> Column:
    """1 if any case holds, tested in order."""
    out = F.lit(0)
    for case in reversed(cases):
        out = F.when(case, F.lit(1)).otherwise(out)
    return out
