"""First, last, n-th and best rows; sequence numbers; running shares; top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.scale import HOUR, null_safe_join, numbered, ranged, running, time_bucket
from wardline.session import cut_lineage

HOT_ROWS = 200_000  # rows of one key that a task ranks at once
HASH_PARTS = 1 << 16


def _ranked(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    # a filter on row_number becomes a per-partition limit before the exchange, so a hot key
    # sends at most n rows per input partition
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by_key)).filter(F.col("_rn") == n).drop("_rn")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. End ``order`` with a unique column so that ties cannot vary."""
    return _ranked(df, keys, order, 1)


def last_per(df: DataFrame, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    return _ranked(df, keys, [F.col(ts).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie]], 1)


def nth_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n-th row per key, counted from 0; keys with fewer rows give none."""
    return _ranked(df, keys, order, n + 1)


def first_nonnull_per(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """First non-null value of each column per key; a result row may mix input rows."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in cols])


def sequence_id(df: DataFrame, keys: list[str], ts: str, order: list[Column], name: str, grain: int = HOUR) -> DataFrame:
    """Running number per key; ``order`` starts with ``ts`` ascending, nulls last."""
    return numbered(df, keys, time_bucket(ts, grain), order, name)


def _hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more than ``HOT_ROWS`` rows, None if there are none.

    Rows are counted by a hash of their key first; only keys of a hash with too many rows are counted themselves.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(HASH_PARTS))
    full = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT_ROWS).collect()
    if not full:
        return None
    counts = df.filter(part.isin([r["_part"] for r in full])).groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = cut_lineage(counts.filter(F.col("_rows") > HOT_ROWS).select(*keys))
    return None if hot.isEmpty() else hot


def dense_sequence(df: DataFrame, keys: list[str], ts: str, name: str, grain: int = HOUR) -> DataFrame:
    """Dense rank of a time per key.

    Rows move once, by their key. Only those of a key too large for one task go by (key, bucket). ``df`` is
    read for counts of rows as well, so hand over a scan, a grouped table or a checkpoint.
    """
    hot = _hot_keys(df, keys)
    whole = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_last())).cast("bigint")
    if hot is None:
        return df.withColumn(name, whole)
    others = null_safe_join(df, hot, keys, "left_anti").withColumn(name, whole)
    return others.unionByName(_dense_by_bucket(null_safe_join(df, hot, keys, "left_semi"), keys, ts, name, grain))


def _dense_by_bucket(df: DataFrame, keys: list[str], ts: str, name: str, grain: int) -> DataFrame:
    """The rank inside a time's bucket plus the distinct times of earlier buckets."""
    cut = df.withColumn("_bucket", time_bucket(ts, grain))
    inside = cut.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys, "_bucket").orderBy(F.col(ts).asc_nulls_last())))
    sizes = cut.select(*keys, "_bucket", ts).distinct().groupBy(*keys, "_bucket").agg(F.count("*").alias("_times"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_times").over(before), F.lit(0)).alias("_before"))
    joined = null_safe_join(inside, offsets, [*keys, "_bucket"])
    return joined.withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_bucket", "_before")


def stay_sequence(stays: DataFrame, patient: str, admission: str, admitted: str, entered: str) -> DataFrame:
    """Order of hospital stays per patient and of unit stays per admission, with first-stay flags."""
    ranked = dense_sequence(stays, [patient], admitted, "hospstay_seq")
    ranked = dense_sequence(ranked, [admission], entered, "icustay_seq")
    return ranked.withColumns({"first_hosp_stay": F.col("hospstay_seq") == 1, "first_icu_stay": F.col("icustay_seq") == 1})


def first_stay_by_min(df: DataFrame, keys: list[str], sequences: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.min(s).alias(s) for s in sequences])


def keep_first_admission(df: DataFrame, patient: str, admitted: str, tie: list[str]) -> DataFrame:
    return first_per(df, [patient], [F.col(admitted).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]])


def first_event_date(df: DataFrame, entity: str, date: str, name: str) -> DataFrame:
    return df.groupBy(entity).agg(F.min(date).alias(name))


def argmax_per(df: DataFrame, keys: list[str], score: str, tie: list[str], cols: list[str]) -> DataFrame:
    """Row with the best score per key; ties go to the smallest ``tie``."""
    # one order for min: the negated score first, so a plain aggregate combines before the exchange
    place = F.struct((-F.col(score)).alias("s"), *tie)
    return df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(*cols), place).alias("_row")).select(*keys, "_row.*")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def cumulative_share(counts: DataFrame, value: str, tie: list[str], name: str = "share",
                     running_name: str = "cumulative_share") -> DataFrame:
    """Share of the total and its running sum, largest value first."""
    total = counts.agg(F.sum(value)).scalar()
    order = [F.col(value).desc_nulls_last(), *[F.col(t) for t in tie]]
    summed = running(ranged(counts, order), [], "_bucket", order, {running_name: F.col(value)})
    return summed.withColumns({name: F.col(value) / total, running_name: F.col(running_name) / total}).drop("_bucket")
