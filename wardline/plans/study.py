"""The lab-test study: one row per entity, and the tables behind its pictures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import readings as rd
from wardline.operators import reshape, select
from wardline.operators.aggregates import any_of, derive_outcomes, fill_not_taken
from wardline.operators.ranking import first_event_date, keep_first_admission


def study_cohort(admissions: DataFrame, positives: DataFrame, entity: str, min_age: int = 18) -> DataFrame:
    """Eligible first admissions with outcomes and critical date.

    ``admissions`` has the entity, admissionDate, dischargeDate, ITU_Start, deathDate and Age;
    ``positives`` the entity and date of each positive test.
    """
    dated = first_event_date(positives, entity, "date", "positiveDate")
    joined = admissions.join(dated, entity)
    kept = select.eligible(joined, cohort_rules(min_age))
    first = keep_first_admission(kept, entity, "admissionDate", ["dischargeDate"])
    return rd.critical_date(derive_outcomes(first, "deathDate", "ITU_Start"), "admissionDate", "dischargeDate", "positiveDate")


def cohort_rules(min_age: int = 18) -> dict[str, Column]:
    return {"admitted": F.col("admissionDate").isNotNull(), "discharged": F.col("dischargeDate").isNotNull(),
            "adult": F.col("Age") >= min_age, "positive": F.col("positiveDate").isNotNull()}


def banded_long(readings: DataFrame, cohort: DataFrame, entity: str, measure: str, ts: str, value: str, tie: str, days: int,
                reading: str, rules: dict[str, list[dict]], anchor: str = "critical_date", sex: str | None = None,
                age: str | None = None) -> DataFrame:
    """(entity, measure, lo, hi, mean, n, first, band) inside the window."""
    keep = [c for c in (sex, age) if c]
    values = rd.anchored_reading(readings, cohort, entity, measure, ts, value, tie, anchor, days, keep)
    return rd.band_all(values, measure, rules, reading, "band", F.col(sex) if sex else None, F.col(age) if age else None)


def one_row_per_entity(cohort: DataFrame, banded: DataFrame, entity: str, measure: str, measures: list[str],
                       flags: list[DataFrame], imputable: list[str] = (), label: str = "Test not taken") -> DataFrame:
    """Cohort with one column per measure's band and per window flag.

    All measures are folded in by one exchange; measures that may be imputed keep null.
    """
    cells = [F.max(F.when(F.col(measure) == m, F.col("band"))).alias(m) for m in measures]
    wide = cohort.join(banded.groupBy(entity).agg(*cells), entity, "left")
    wide = reduce(lambda df, f: df.join(f, entity, "left"), flags, wide)
    names = [c for f in flags for c in f.columns if c != entity]
    if names:
        wide = wide.withColumn("coinfection", any_of(names))
    return fill_not_taken(wide, [m for m in measures if m not in imputable], label)


def heat_map(readings: DataFrame, measure: str, value: str, spec: dict, spread: list[str]) -> DataFrame:
    """Readings after each measure's shape transform, rescaled to 0..1."""
    return reshape.rescale01(reshape.transform_measure(readings, measure, value, spec), measure, value, spread)


def entity_timeline(intervals: DataFrame, entity: str) -> DataFrame:
    return reshape.timeline(intervals, entity, "source")


def grid_design(readings: DataFrame, cohort: DataFrame, entity: str, measure: str, ts: str, value: str, tie: str, anchor: str,
                rules: dict[str, list[dict]], days: list[int], options: list[str], outcomes: list[str], normal: str = "Normal",
                sex: str | None = None, age: str | None = None) -> tuple[DataFrame, dict[int, dict[str, object]], list[str]]:
    """0/1 abnormal and not-taken columns per measure for every window and reading option.

    One pass over the day summaries serves all windows. Returns (rows with ``case``, settings of
    each case, feature names).
    """
    cases = {i: {"days": d, "reading": o} for i, (d, o) in enumerate((d, o) for d in days for o in options)}
    keep = [c for c in (sex, age) if c]
    daily = rd.daily_readings(readings, entity, measure, ts, value, tie)
    inside = daily.join(cohort.select(entity, F.col(anchor).cast("date").alias("_anchor"), *keep), entity)
    gap = F.datediff("day", "_anchor")
    inside = inside.filter((gap >= 0) & (gap < max(days))).withColumn("_days", F.explode(F.filter(F.array(*[F.lit(d) for d in days]), lambda d: gap < d)))
    values = inside.groupBy(entity, measure, "_days", *keep).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("first").getField("value").alias("first"))
    for o in options:
        values = rd.band_all(values, measure, rules, o, f"_band_{o}", F.col(sex) if sex else None, F.col(age) if age else None)
    long = values.unpivot([entity, measure, "_days"], [f"_band_{o}" for o in options], "_option", "band")
    number = F.lit(None).cast("int")
    for i, c in cases.items():
        number = F.when((F.col("_days") == c["days"]) & (F.col("_option") == f"_band_{c['reading']}"), i).otherwise(number)
    flags, names = [], []
    for m in rules:
        here = F.col(measure) == m
        flags += [F.max(F.when(here, (F.col("band") != normal).cast("int"))).alias(f"{m}_abnormal")]
        names += [f"{m}_abnormal", f"{m}_not_taken"]
    wide = long.withColumn("case", number).groupBy(entity, "case").agg(*flags)
    grid = cohort.select(entity, *outcomes, F.explode(F.array(*[F.lit(i) for i in cases])).alias("case")).join(wide, [entity, "case"], "left")
    taken = {f"{m}_not_taken": F.col(f"{m}_abnormal").isNull().cast("int") for m in rules}
    return grid.withColumns(taken).fillna(0, subset=[f"{m}_abnormal" for m in rules]), cases, names
