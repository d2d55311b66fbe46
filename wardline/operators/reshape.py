"""Melting, rescaling, profiling, dummy columns and time-to-event tables."""

from __future__ import annotations

import csv
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalars import days_between, elapsed_days
from wardline.scale import exact_quantiles
from wardline.session import attach_small

RULES = Path(__file__).resolve().parent.parent / "rules"


def _ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """Minimum and maximum per column: one pass, one row to the driver."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def _scaled(col: Column, lo, hi) -> Column:
    # a constant column has no scale: null
    return F.try_divide(col - F.lit(lo), F.lit(hi) - F.lit(lo)).cast("double")


def normalise_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min-max each numeric column in place."""
    limits = _ranges(df, cols)
    return df.withColumns({c: _scaled(F.col(c).cast("double"), *limits[c]) for c in cols})


def melt_normalised(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """Min-max each column, then long form (ids, variable, value) without nulls."""
    scaled = normalise_columns(df.select(*ids, *cols), cols)
    return scaled.unpivot(ids, cols, "variable", "value").filter(F.col("value").isNotNull())


def load_transforms(path: str | Path = RULES / "transforms.csv") -> dict[str, tuple[str, float | None]]:
    with open(path, newline="") as fh:
        rows = csv.DictReader(line for line in fh if not line.startswith("#"))
        return {r["measure"]: (r["transform"], float(r["upper"]) if r["upper"] else None) for r in rows}


SHAPES = {"log10": F.log10, "cbrt": F.cbrt, "sqrt": F.sqrt, "none": lambda c: c}


def transform_measure(df: DataFrame, measure: str, value: str, spec: dict[str, tuple[str, float | None]]) -> DataFrame:
    """Shape transform by measure; values at or over a measure's cut are dropped.

    The log of zero is null, so later rescaling stays finite.
    """
    out, keep = F.col(value), F.lit(True)
    for m, (shape, upper) in spec.items():
        out = F.when(F.col(measure) == m, SHAPES[shape](F.col(value))).otherwise(out)
        if upper is not None:
            keep = keep & F.coalesce(~((F.col(measure) == m) & (F.col(value) >= upper)), F.lit(True))
    return df.filter(keep).withColumn(value, out)


def rescale01(df: DataFrame, by: str, value: str, spread: list[str]) -> DataFrame:
    """(x - min) / (max - min) per measure.

    The limits are aggregated and joined back, since a window would sort a whole measure in one task.
    """
    limits = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = attach_small(df, limits, [by], spread)
    return joined.withColumn(value, F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population skewness and raw kurtosis (3 for a normal shape)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"),
                               (F.kurtosis(value) + 3).alias("kurtosis"))


def histogram(df: DataFrame, col: str, width: float, by: list[str] = ()) -> DataFrame:
    bin_ = F.floor(F.col(col) / F.lit(width)).cast("bigint")
    return df.filter(F.col(col).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))


# --- dummy columns ----------------------------------------------------------------

def dummy_columns(df: DataFrame, levels: dict[str, list[str]], reference: dict[str, str] | None = None,
                  missing: str | None = "NA") -> DataFrame:
    """0/1 column per level, minus the reference level. Levels are fixed, never read off the data."""
    out = {}
    for col, names in levels.items():
        for level in names:
            if (reference or {}).get(col) == level:
                continue
            hit = F.col(col).isNull() if missing is not None and level == missing else F.col(col) == level
            out[f"{col}_{level}"] = F.coalesce(hit, F.lit(False)).cast("int")
    return df.withColumns(out)


def one_hot(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    return dummy_columns(df, {col: levels}, missing=None).drop(col)


def binarise_levels(df: DataFrame, prefix: str, levels: list[str], name: str) -> DataFrame:
    """Several level columns (mild, moderate, severe) to one abnormal flag."""
    return df.withColumn(name, F.greatest(*[F.coalesce(F.col(f"{prefix}_{l}"), F.lit(0)) for l in levels]))


# --- missing values -----------------------------------------------------------------

def _absent(col: str, labels: tuple[str, ...]) -> Column:
    null = F.col(col).isNull()
    return null | F.coalesce(F.col(col).cast("string").isin(list(labels)), F.lit(False)) if labels else null


def missingness(df: DataFrame, cols: list[str], labels: tuple[str, ...] = ("NA", "Test not taken")) -> DataFrame:
    """Share missing per column, from one pass."""
    shares = df.agg(F.count("*").alias("_n"), *[F.count_if(_absent(c, labels)).alias(c) for c in cols])
    long = shares.unpivot("_n", cols, "variable", "missing")
    return long.select("variable", "missing", F.col("_n").alias("n"), F.try_divide("missing", F.col("_n").cast("double")).alias("share"))


def drop_sparse_columns(df: DataFrame, cols: list[str], max_missing: float = 0.7, labels: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns whose missing share is over the limit, before anything is fitted."""
    shares = df.agg(*[F.avg(_absent(c, labels).cast("int")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if (shares[c] or 0.0) > max_missing])


def missing_pattern(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per pattern of missing columns, e.g. ``0|1|0``."""
    pattern = F.concat_ws("|", *[F.col(c).isNull().cast("int").cast("string") for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


# --- time to event --------------------------------------------------------------------

def relative_days(df: DataFrame, anchors: DataFrame, entity: str, date: str, anchor: str, name: str,
                  spread: list[str]) -> DataFrame:
    """Days since each entity's anchor date, per row."""
    joined = attach_small(df, anchors.select(entity, F.col(anchor).alias("_anchor")), [entity], spread)
    return joined.withColumn(name, days_between(date, "_anchor")).drop("_anchor")


def key_events(df: DataFrame, entity: str, dates: list[str], anchor: str) -> DataFrame:
    """Wide outcome dates to (entity, event, day, offset); offset counts from the entity's first event."""
    days = df.select(entity, *[days_between(d, anchor).alias(d) for d in dates])
    earliest = F.least(*[F.col(d) for d in dates])
    return days.withColumn("_first", earliest).unpivot([entity, "_first"], dates, "event", "day").filter(
        F.col("day").isNotNull()).select(entity, "event", "day", (F.col("day") - F.col("_first")).alias("offset"))


def timeline(intervals: DataFrame, entity: str, lane: str) -> DataFrame:
    """Intervals with their lane, colour label and length in days."""
    return intervals.select(entity, F.col(lane).alias("lane"), "label", "starttime", "stoptime",
                            elapsed_days("stoptime", "starttime").alias("days"))


def entity_card(tables: dict[str, tuple[DataFrame, list[str]]], entity: str, value) -> DataFrame:
    """All facts of one entity as (section, field, shown) rows; the filter reaches every scan."""
    parts = []
    for section, (df, cols) in tables.items():
        own = df.filter(F.col(entity) == value).select(*[F.col(c).cast("string").alias(c) for c in cols])
        parts.append(own.unpivot([], cols, "field", "shown").withColumn("section", F.lit(section)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("section", "field", "shown")


def time_to_first_reading(readings: DataFrame, anchors: DataFrame, entity: str, measure: str, ts: str, anchor: str,
                          direction: str = "after") -> DataFrame:
    """Smallest day gap and reading count per entity and measure.

    ``after`` takes readings on or after the anchor day, ``before`` those on or before it.
    """
    daily = readings.groupBy(entity, measure, F.col(ts).cast("date").alias("_day")).agg(F.count("*").alias("_n"))
    gap = days_between("_day", "_anchor") if direction == "after" else days_between("_anchor", "_day")
    joined = daily.join(anchors.select(entity, F.col(anchor).alias("_anchor")), entity)
    kept = joined.withColumn("_gap", gap).filter(F.col("_gap") >= 0)
    return kept.groupBy(entity, measure).agg(F.min("_gap").alias("gap_days"), F.sum("_n").alias("n"))


def late_first_readings(gaps: DataFrame, days: int = 10) -> DataFrame:
    return gaps.filter(F.col("gap_days") > days)


def reading_coverage(gaps: DataFrame, measure: str, days: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """First readings within and over each number of days, per measure."""
    aggs = [a for d in days for a in (F.count_if(F.col("gap_days") <= d).alias(f"within_{d}"),
                                      F.count_if(F.col("gap_days") > d).alias(f"over_{d}"))]
    return gaps.groupBy(measure).agg(F.count("*").alias("n"), *aggs)


def anchor_gap(df: DataFrame, admitted: str, positive: str, name: str = "gap_days") -> DataFrame:
    return df.withColumn(name, days_between(admitted, positive))


# --- plot-ready tables --------------------------------------------------------------------

def label_coverage(df: DataFrame, label: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(label).isNotNull().cast("int")).alias("labelled_share"))


def series_by(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Mean and quartiles of y per group and x."""
    means = df.groupBy(group, x).agg(F.count(y).alias("n"), F.avg(y).alias("mean_value"))
    return means.join(exact_quantiles(df, [group, x], y, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), [group, x], "left")
