"""Grouped summaries, counts, shares and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.ranking import first_per
from wardline.scale import exact_quantiles, ranged, running


def derive_outcomes(df: DataFrame, death: str, icu: str) -> DataFrame:
    """died, went_to_icu and severe (either) from the presence of the two dates."""
    died, unit = F.col(death).isNotNull(), F.col(icu).isNotNull()
    return df.withColumns({"died": died, "went_to_icu": unit, "severe": died | unit})


def summary_by_key(df: DataFrame, keys: list[str], means: list[str], maxima: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_avg") for c in means], *[F.max(c).alias(f"{c}_max") for c in maxima])


def max_by_key(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return summary_by_key(df, keys, [], cols)


def weighted_mean_by_key(df: DataFrame, keys: list[str], weight: str, cols: list[str]) -> DataFrame:
    """Mean of each column with row weights, as if each row stood there ``weight`` times."""
    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight))).cast("double"))
    return df.groupBy(*keys).agg(*[mean(c).alias(f"{c}_avg") for c in cols])


def collapse_duplicates(df: DataFrame, key: str, cols: list[str], organism: str, flag: str = "positive") -> DataFrame:
    """One row per specimen: the maximum of each column and whether any organism is named."""
    named = F.col(organism).isNotNull() & (F.col(organism) != "")
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in cols], F.max(F.when(named, 1).otherwise(0)).alias(flag))


def modal_value(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Most frequent value per key; ties go to the alphabetically first."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("n"))
    return first_per(counts, keys, [F.col("n").desc(), F.col(col).asc()])


def group_profile(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """min, max, mean, sample deviation and count per group."""
    return df.groupBy(*keys).agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"),
                                 F.avg(col).alias("mean_value"), F.stddev_samp(col).alias("sd_value"),
                                 F.count(col).alias("n"))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count and share of the total per value; the total is a scalar subquery."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())


def weighted_group_mean(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Group mean times the group's share of all rows."""
    grouped = df.groupBy(*keys).agg(F.avg(col).alias("mean_value"), F.count("*").alias("n"))
    shared = grouped.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())
    return shared.withColumn("weighted_mean", F.col("mean_value") * F.col("share"))


QUARTILES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}


def group_median_order(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Box-plot numbers per group and the place of each group by its median."""
    boxes = exact_quantiles(df, keys, col, QUARTILES)
    order = [F.col("q50"), *[F.col(k) for k in keys]]
    return running(ranged(boxes, order), [], "_bucket", order, {"place": F.lit(1)}).drop("_bucket")


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in cols])


def site_summary(df: DataFrame, site: str, tested: Column, icu: Column, died: Column) -> DataFrame:
    """Rows, tested, unit stay, death and both, per site."""
    return df.groupBy(site).agg(F.count("*").alias("n"), F.count_if(tested).alias("tested"), F.count_if(icu).alias("icu"),
                                F.count_if(died).alias("died"), F.count_if(icu & died).alias("both"))


def marker_summary(df: DataFrame, markers: list[str], tested: Column, icu: Column, died: Column,
                   missing: tuple[str, ...] = ("Test not taken", "NA")) -> DataFrame:
    """The same counts per marker, over rows in which the marker has a reading; one pass."""
    slim = df.select(*[F.col(m).cast("string").alias(m) for m in markers], tested.alias("_t"), icu.alias("_i"), died.alias("_d"))
    long = slim.unpivot(["_t", "_i", "_d"], markers, "marker", "level").filter(
        F.col("level").isNotNull() & ~F.col("level").isin(list(missing)))
    return long.groupBy("marker").agg(F.count("*").alias("n"), F.count_if("_t").alias("tested"), F.count_if("_i").alias("icu"),
                                      F.count_if("_d").alias("died"), F.count_if(F.col("_i") & F.col("_d")).alias("both"))


def contingency_counts(df: DataFrame, flags: list[str], outcome: str) -> DataFrame:
    """Outcome by presence counts per 0/1 flag; rows where the flag is missing are left out."""
    y = F.col("_y")
    slim = df.select(F.col(outcome).cast("int").alias("_y"), *[F.col(f).cast("int").alias(f) for f in flags])
    long = slim.unpivot("_y", flags, "flag", "present").filter(F.col("present").isNotNull())
    p = F.col("present")
    return long.groupBy("flag").agg(
        F.count_if((y == 0) & (p == 0)).alias("negative_absent"), F.count_if((y == 0) & (p == 1)).alias("negative_present"),
        F.count_if((y == 1) & (p == 0)).alias("positive_absent"), F.count_if((y == 1) & (p == 1)).alias("positive_present"),
        F.count("*").alias("samples"), F.count_if(p == 1).alias("observations"),
        (F.count_if(p == 1) / F.count("*")).alias("observed_share"))


def cohort_summary(df: DataFrame, split: str, age: str, female: Column, outcome: Column) -> DataFrame:
    """Age, share female and outcome share for all rows and for each split, from one scan."""
    slim = df.select(F.col(split), F.col(age).alias("_a"), female.cast("int").alias("_f"), outcome.cast("int").alias("_y"))
    per = slim.rollup(split).agg(F.grouping(split).alias("all_rows"), F.count("*").alias("n"), F.avg("_a").alias("mean_age"),
                                 F.stddev_samp("_a").alias("sd_age"), F.avg("_f").alias("share_female"),
                                 F.avg("_y").alias("outcome_share"))
    return per.withColumn(split, F.when(F.col("all_rows") == 1, F.lit("all")).otherwise(F.col(split))).drop("all_rows")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sd, min, quartiles and max of numeric columns, one row each."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    base = long.groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean_value"),
                                        F.stddev_samp("value").alias("sd_value"))
    return base.join(exact_quantiles(long, ["variable"], "value", QUARTILES), "variable", "left")


def column_types(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "variable string, dtype string")


def any_of(cols: list[str]) -> Column:
    """True if any flag is true; a null flag counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in cols])


def fill_not_taken(df: DataFrame, cols: list[str], label: str = "Test not taken") -> DataFrame:
    return df.fillna({c: label for c in cols})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
