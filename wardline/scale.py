"""Ordered computations that do not put a whole key into one task.

A window over a key sorts all rows of that key in one task. The helpers here work in two
levels instead: rows are grouped by (key, bucket), where buckets cut the order axis into
consecutive pieces, and only one summary row per bucket is carried along the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut_lineage

HOUR = 3600
LAST_BUCKET = 2**62


def epoch(ts: str | Column) -> Column:
    """Microseconds since 1970 of a date or timestamp."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def time_bucket(ts: str | Column, grain: int = HOUR) -> Column:
    """Consecutive buckets of ``grain`` seconds; rows without a time come last."""
    return F.coalesce(F.floor(epoch(ts) / F.lit(grain * 1_000_000)), F.lit(LAST_BUCKET))


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """A written copy of ``df`` with its rows in consecutive ranges of ``order``, numbered by ``_bucket``.

    Spark samples the order and sends rows to ranges of about equal size; equal rows share one. Their number is
    the session's (small neighbours are put together at run time) or ``ranges``. Written, as numbers
    drawn again could differ.
    """
    dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
    return cut_lineage(dealt.withColumn("_bucket", F.spark_partition_id()))


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the right copies are dropped."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in cols])


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, Column],
            totals: dict[str, str] | None = None) -> DataFrame:
    """Running sums per key, exact, over (key, bucket) groups.

    ``bucket`` must not decrease along ``order``. ``sums`` maps result names to row values;
    ``totals`` maps a sum's name to a column for the whole-key total. ``df`` is read twice (rows
    and bucket sizes), so hand over a scan, a grouped table or a checkpoint.
    """
    totals = totals or {}
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({name: F.sum(value).over(inside) for name, value in sums.items()})
    sizes = df.groupBy(*keys, bucket).agg(*[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_o_{p}": F.coalesce(F.sum(f"_t_{p}").over(before), F.lit(0)) for p in sums}
    whole = {c: F.sum(f"_t_{p}").over(Window.partitionBy(*keys)) for p, c in totals.items()}
    offsets = sizes.select(*keys, bucket, *[v.alias(k) for k, v in {**carried, **whole}.items()])
    joined = null_safe_join(out, offsets, keys + [bucket])
    return joined.withColumns({p: F.col(p) + F.col(f"_o_{p}") for p in sums}).drop(*carried)


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``row_number`` per key over buckets; ``order`` must be total."""
    ranked = running(df.withColumn("_bucket", bucket), keys, "_bucket", order, {name: F.lit(1).cast("bigint")})
    return ranked.drop("_bucket")


def hash_key(seed: int | str, *cols: str | Column) -> Column:
    """Plain md5 text of seed and columns: the same in every engine, so splits can be checked."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def hash_numbered(df: DataFrame, keys: list[str], hashed: str, tie: list[str], name: str,
                  total: str | None = None, width: int = 3) -> DataFrame:
    """``row_number`` by a hash column. The first hex digits are even buckets along the hash."""
    cut = df.withColumn("_bucket", F.substring(hashed, 1, width))
    out = running(cut, keys, "_bucket", [F.col(hashed), *[F.col(t) for t in tie]], {name: F.lit(1).cast("bigint")},
                  totals={name: total} if total else None)
    return out.drop("_bucket")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str],
         name: str = "match", forward: bool = False, inclusive: bool = True, tie: list[str] | None = None,
         grain: int = HOUR) -> DataFrame:
    """Nearest earlier (or later) row of ``right`` for every row of ``left``, as struct ``name``.

    One exchange by (key, time bucket) for the rows, one small exchange for the bucket
    summaries. No pairs are formed, so many rows near each other cost nothing extra.
    Among right rows at the same time the last by ``tie`` wins (the first when ``forward``).
    """
    tie = tie or []
    packed_ties = [F.col(t) for t in tie]
    found_type = F.struct(*payload)
    l_rows = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1 if inclusive else 0).alias("_side"),
                         F.struct(*left.columns).alias("_left"))
    r_rows = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(0 if inclusive else 1).alias("_side"),
        F.struct(F.col(right_ts).alias("_at"), *[t.alias(f"_tie{i}") for i, t in enumerate(packed_ties)]).alias("_ord"),
        found_type.alias("_right"))
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn("_bucket", time_bucket("_ts", grain))

    def direct(c: Column) -> Column:
        return c.desc() if forward else c.asc()

    near = Window.partitionBy(*keys, "_bucket").orderBy(direct(F.col("_ts")), F.col("_side"), direct(F.col("_ord")))
    near = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.min_by if forward else F.max_by
    edges = rows.groupBy(*keys, "_bucket").agg(pick("_right", "_ord").alias("_edge"))
    far = Window.partitionBy(*keys).orderBy(direct(F.col("_bucket"))).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, "_bucket", F.last("_edge", ignorenulls=True).over(far).alias("_carried"))
    seen = rows.withColumn("_near", F.last("_right", ignorenulls=True).over(near)).filter(F.col("_left").isNotNull())
    both = null_safe_join(seen, carried, keys + ["_bucket"], "left")
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys] + [F.col("_ts").isNotNull()])
    return both.select("_left.*", F.when(usable, F.coalesce("_near", "_carried")).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float], ranges: int | None = None) -> DataFrame:
    """Interpolated quantiles per key (the usual type 7), exact, without one task per key.

    Equal values are counted before the exchange; the counts are put in ranges of (key, value) and ranks come
    from running counts over these.
    """
    counted = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    rows = ranged(counted, [*[F.col(k) for k in keys], F.col("_value")], ranges)
    ranked = running(rows, keys, "_bucket", [F.col("_value")], {"_upto": F.col("_n")}, totals={"_upto": "_all"})
    picks, final = [], {}
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_all") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)
            picks.append(F.max(F.when(holds, F.col("_value"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        # between equal values nothing is interpolated, infinite ones included
        final[name] = F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)
    table = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks)
    return table.select(*keys, *[v.alias(k) for k, v in final.items()])
