"""Many timed readings to one banded value per entity and measure."""

from __future__ import annotations

import csv
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import days_between

RULES = Path(__file__).resolve().parent.parent / "rules"

WORST, FIRST, MEAN = "worst", "first", "mean"


def daily_readings(readings: DataFrame, entity: str, measure: str, ts: str, value: str, tie: str,
                   extra: list[str] = ()) -> DataFrame:
    """Mergeable day summaries per entity and measure.

    Windows are whole days, so nothing finer is needed. Combining happens before the exchange,
    and an entity with very many readings shrinks to one row per measure and day.
    """
    return readings.filter(F.col(value).isNotNull()).groupBy(
        entity, measure, F.col(ts).cast("date").alias("day"), *extra).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("total"), F.count(value).alias("n"),
        F.min(F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value"))).alias("first"))


def anchored_reading(readings: DataFrame, anchors: DataFrame, entity: str, measure: str, ts: str, value: str, tie: str,
                     anchor: str, days: int, keep: list[str] = ()) -> DataFrame:
    """Readings with anchor day <= day < anchor day + days, reduced per entity and measure.

    Gives lo, hi, mean, n and first (the earliest, ties by ``tie``), so every reading option is
    a choice of column. ``anchors`` has one row per entity; its ``keep`` columns are carried.
    Each reading is held against its own date.
    """
    daily = daily_readings(readings, entity, measure, ts, value, tie)
    slim = anchors.select(entity, F.col(anchor).cast("date").alias("_anchor"), *keep)
    inside = daily.join(slim, entity).filter(
        (F.col("day") >= F.col("_anchor")) & (F.col("day") < F.date_add("_anchor", days)))
    return inside.groupBy(entity, measure, *keep).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.sum("n").alias("n"), F.min("first").getField("value").alias("first"))


def reading_value(reading: str, worst: str = "max") -> Column:
    """Column for one reading option; ``worst`` says which extreme is the bad one."""
    if reading == MEAN:
        return F.col("mean")
    if reading == FIRST:
        return F.col("first")
    return F.col("lo") if worst == "min" else F.col("hi")


# --- bands -------------------------------------------------------------------------

def load_bands(path: str | Path = RULES / "bands.csv") -> dict[str, list[dict]]:
    """Band rules per measure, in test order.

    Columns: measure, worst (min, max or either), level, lower, lower_in, upper, upper_in, sex,
    age_over, age_to. Empty limits are open; ``sex`` is M, not M or empty.
    """
    out: dict[str, list[dict]] = {}
    with open(path, newline="") as fh:
        for row in csv.DictReader(line for line in fh if not line.startswith("#")):
            out.setdefault(row["measure"], []).append(row)
    return out


def _holds(value: Column, row: dict, sex: Column, age: Column) -> Column:
    tests = []
    if row["lower"]:
        lim = F.lit(float(row["lower"]))
        tests.append(value >= lim if row["lower_in"] == "1" else value > lim)
    if row["upper"]:
        lim = F.lit(float(row["upper"]))
        tests.append(value <= lim if row["upper_in"] == "1" else value < lim)
    if row["sex"]:
        tests.append(sex == "M" if row["sex"] == "M" else F.coalesce(sex != "M", F.lit(True)))
    if row["age_from"]:
        tests.append(age >= F.lit(float(row["age_from"])))
    if row["age_over"]:
        tests.append(age > F.lit(float(row["age_over"])))
    if row["age_to"]:
        tests.append(age <= F.lit(float(row["age_to"])))
    if row["age_under"]:
        tests.append(age < F.lit(float(row["age_under"])))
    return reduce(lambda a, b: a & b, tests, value.isNotNull())


def band(value: Column, rules: list[dict], sex: Column | None = None, age: Column | None = None,
         default: str = "Normal") -> Column:
    """Level of a value: the first rule that holds, else ``default``; null stays null.

    Without ``sex`` or ``age`` these count as unknown: only rules open to that can hold.
    """
    sex = F.lit(None).cast("string") if sex is None else sex
    age = F.lit(None).cast("double") if age is None else age
    out = F.when(value.isNotNull(), F.lit(default))
    for row in reversed(rules):
        out = F.when(_holds(value, row, sex, age), F.lit(row["level"])).otherwise(out)
    return out


def band_reading(rules: list[dict], reading: str, sex: Column | None = None, age: Column | None = None) -> Column:
    """Band of an anchored reading. Two-sided measures test both extremes in worst mode."""
    worst = rules[0]["worst"]
    if reading != WORST or worst != "either":
        return band(reading_value(reading, worst), rules, sex, age)
    low, high = band(F.col("lo"), rules, sex, age), band(F.col("hi"), rules, sex, age)
    return F.when(low != "Normal", low).otherwise(high)


def band_all(df: DataFrame, measure: str, rules: dict[str, list[dict]], reading: str, name: str = "band",
             sex: Column | None = None, age: Column | None = None) -> DataFrame:
    """Band every row by its own measure's rules; measures without rules get null."""
    out = F.lit(None).cast("string")
    for m, rows in rules.items():
        out = F.when(F.col(measure) == m, band_reading(rows, reading, sex, age)).otherwise(out)
    return df.withColumn(name, out)


# --- flags in a window ----------------------------------------------------------------

def any_in_window(events: DataFrame, anchors: DataFrame, entity: str, ts: str, positive: Column, anchor: str, days: int,
                  name: str, universe: DataFrame | None = None) -> DataFrame:
    """True if any positive event lies in the window.

    Entities in ``universe`` (default: those with any event) get true or false, other anchored
    entities null.
    """
    daily = events.groupBy(entity, F.col(ts).cast("date").alias("_day")).agg(F.bool_or(positive).alias("_pos"))
    slim = anchors.select(entity, F.col(anchor).cast("date").alias("_anchor"))
    inside = F.col("_pos") & (F.col("_day") >= F.col("_anchor")) & (F.col("_day") < F.date_add("_anchor", days))
    hit = daily.join(slim, entity).groupBy(entity).agg(F.bool_or(F.coalesce(inside, F.lit(False))).alias(name))
    if universe is not None:
        known = universe.select(entity).distinct()
        hit = known.join(hit, entity, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return anchors.select(entity).join(hit, entity, "left")


# --- anchor date --------------------------------------------------------------------

def critical_date(df: DataFrame, admitted: str, discharged: str, positive: str) -> DataFrame:
    """Anchor date, hospital-acquired flag and case type from three dates; the first case wins."""
    d1, d2 = days_between(positive, admitted), days_between(positive, discharged)
    cases = [((d1 == 0) & (d2 != 0), admitted, 0), ((d1 >= 0) & (d2 < 0), positive, 1), ((d1 < 0) & (d2 < 0), admitted, 0),
             ((d1 == 0) & (d2 == 0), admitted, 1)]
    when, acquired, kind = F.col(positive), F.lit(1), F.lit(5)
    for number, (test, date, flag) in reversed(list(enumerate(cases, start=1))):
        when = F.when(test, F.col(date)).otherwise(when)
        acquired = F.when(test, F.lit(flag)).otherwise(acquired)
        kind = F.when(test, F.lit(number)).otherwise(kind)
    return df.withColumns({"critical_date": when, "hospital_acquired": acquired, "case_type": kind})
