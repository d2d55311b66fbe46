"""Joins on keys, in time windows, to the latest reading, and on prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.scale import HOUR, asof, time_bucket


def attach(df: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner equi-join. Spark broadcasts a dimension it knows to be small and splits hot keys."""
    return df.join(dim, key, "inner")


def left_attach(df: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(dim, key, "left")


def join_many_features(base: DataFrame, features: dict[str, DataFrame], key: str, value: str = "value") -> DataFrame:
    """Fold one-row-per-entity tables onto the base with one exchange instead of one per table.

    ``features`` maps the new column's name to a (key, value) frame; all values share a type.
    """
    tagged = [f.select(key, F.lit(n).alias("_name"), F.col(value).alias("_value")) for n, f in features.items()]
    long = reduce(lambda a, b: a.unionByName(b), tagged)
    wide = long.groupBy(key).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in features])
    return base.join(wide, key, "left")


def natural_merge(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared columns, null matching null; ``how`` is inner, left or full."""
    shared = [c for c in a.columns if c in b.columns]
    renamed = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in shared])
    joined = a.withColumn("_in_a", F.lit(True)).join(renamed, cond, how)
    if how == "full":
        joined = joined.withColumns({c: F.when(F.col("_in_a"), F.col(c)).otherwise(F.col(f"_b_{c}")) for c in shared})
    return joined.drop("_in_a", *[f"_b_{c}" for c in shared])


# --- time windows ----------------------------------------------------------------

def _moved(ts: str, hours: float) -> Column:
    return F.col(ts) + F.expr(f"INTERVAL '{int(round(hours * 3600))}' SECOND")


def _grain(seconds: float, pieces: int) -> int:
    return max(60, int(-(-seconds // pieces)))


def _first_in_range(probes: DataFrame, right: DataFrame, keys: list[str], right_ts: str, payload: list[str], tie: list[str],
                    hours: float, pieces: int) -> DataFrame:
    """Earliest right row with ``_lo`` <= time <= ``_hi`` for every probe, as struct ``_found`` (at, tie, payload).

    The time axis is cut into buckets of 1/``pieces`` of the longest range. The answer lies in the
    bucket of ``_lo``, found by one ordered pass over (key, bucket), or in one of the next
    ``pieces`` buckets, found by a table that holds the first right row of those per bucket. So a
    key with very many rows is spread over its buckets, no pairs are formed, and the probes are
    exchanged once.
    """
    grain = _grain(hours * 3600.0, pieces)
    ahead = int(hours * 3600.0 // grain) + 1
    at = F.struct(F.col(right_ts).alias("at"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie)], *[F.col(c).alias(f"p_{c}") for c in dict.fromkeys(payload)])
    rights = right.filter(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_ts"), at.alias("_right"))
    rights = rights.withColumn("_bucket", time_bucket("_ts", grain))
    first = rights.groupBy(*keys, "_bucket").agg(F.min("_right").alias("_head"))
    later = first.withColumn("_bucket", F.explode(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda i: F.col("_bucket") - i)))
    later = later.groupBy(*keys, "_bucket").agg(F.min("_head").alias("_next"))
    carried = F.struct(*[c for c in probes.columns])
    rows = probes.select(*keys, F.col("_lo").alias("_ts"), time_bucket("_lo", grain).alias("_bucket"), carried.alias("_probe")).unionByName(
        rights, allowMissingColumns=True)
    # read from the end: the last right row seen is the first at or after the probe
    backward = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_ts").desc(), F.col("_right").desc_nulls_last())
    backward = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_near", F.last("_right", ignorenulls=True).over(backward)).filter(F.col("_probe").isNotNull())
    found = seen.join(later, [*keys, "_bucket"], "left").withColumn("_found", F.coalesce("_near", "_next"))
    keyed = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    inside = keyed & (F.col("_found.at") <= F.col("_probe._hi"))
    return found.select("_probe.*", F.when(inside, F.col("_found")).alias("_found"))


MICRO = "INTERVAL '0.000001' SECOND"


def window_match(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                 hours_before: float, hours_after: float, payload: list[str], name: str = "match",
                 lower_inclusive: bool = True, upper_inclusive: bool = True, tie: list[str] | None = None,
                 pieces: int = 8) -> DataFrame:
    """Every left row with the earliest right row in [ts - before, ts + after], or null.

    This is the interval join as its users need it: each row with its first match (ties by
    ``tie``). ``hours_before`` may be negative for windows after the row.
    """
    lo, hi = _moved(left_ts, -hours_before), _moved(left_ts, hours_after)
    lo = lo if lower_inclusive else lo + F.expr(MICRO)
    hi = hi if upper_inclusive else hi - F.expr(MICRO)
    probes = left.withColumns({"_lo": lo, "_hi": hi})
    found = _first_in_range(probes, right, keys, right_ts, payload, tie or [], hours_before + hours_after, pieces)
    kept = F.struct(*[F.col(f"_found.p_{c}").alias(c) for c in dict.fromkeys(payload)])
    return found.withColumn(name, F.when(F.col("_found").isNotNull(), kept)).drop("_lo", "_hi", "_found")


def window_match_many(left: DataFrame, row_key: list[str], keys: list[str], probes: dict[str, tuple[str, Column, Column]],
                      series: dict[str, tuple[DataFrame, str]], payload: list[str], tie: list[str], hours: float,
                      pieces: int = 8) -> DataFrame:
    """Several first matches per left row in one pass.

    ``probes`` maps a result name to (series, lowest time, highest time), both ends in; ``series``
    maps a name to (right rows, their time column). Every result is a struct (time, payload...).
    ``row_key`` identifies a left row; ``hours`` bounds the length of any range.
    """
    number = {s: i for i, s in enumerate(series)}
    asked = F.array(*[F.struct(F.lit(i).alias("_probe"), F.lit(number[s]).alias("_series"), lo.alias("_lo"), hi.alias("_hi"))
                      for i, (s, lo, hi) in enumerate(probes.values())])
    whole = F.struct(*left.columns)
    rows = left.select(*dict.fromkeys([*keys, *row_key]), whole.alias("_whole"), F.explode(asked).alias("_a"))
    # the left row itself travels with its first probe only
    rows = rows.select(*dict.fromkeys([*keys, *row_key]), "_a.*", F.when(F.col("_a._probe") == 0, F.col("_whole")).alias("_whole"))
    fields = list(dict.fromkeys([*payload, *tie]))
    rights = reduce(lambda x, y: x.unionByName(y), [
        df.select(*keys, F.lit(number[s]).alias("_series"), F.col(ts).cast("timestamp_ntz").alias("_time"), *fields) for s, (df, ts) in series.items()])
    found = _first_in_range(rows, rights, [*keys, "_series"], "_time", payload, tie, hours, pieces)
    kept = F.when(F.col("_found").isNotNull(), F.struct(F.col("_found.at").alias("time"), *[F.col(f"_found.p_{c}").alias(c) for c in dict.fromkeys(payload)]))
    results = [F.first(F.when(F.col("_probe") == i, kept), ignorenulls=True).alias(n) for i, n in enumerate(probes)]
    gathered = found.groupBy(*row_key).agg(F.first("_whole", ignorenulls=True).alias("_whole"), *results)
    return gathered.select("_whole.*", *probes)


def window_sums(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                hours_before: float, hours_after: float, sums: dict[str, Column], pieces: int = 8) -> DataFrame:
    """Sums over the right rows in [ts - before, ts + after] (both ends in), per left row.

    A sweep: each right row adds its value where its reach starts and takes it away where it
    ends, a left row reads the running sum. Reaches that cross a bucket border are added to the
    bucket's start, so the sweep runs per (key, bucket) and its cost does not depend on how many
    rows match.
    """
    grain = _grain((hours_before + hours_after) * 3600.0, pieces)
    reach = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, _moved(right_ts, -hours_after).alias("_from"), _moved(right_ts, hours_before).alias("_to"),
        *[v.cast("double").alias(f"_v_{n}") for n, v in sums.items()])
    values = [f"_v_{n}" for n in sums]
    starts = reach.select(*keys, F.col("_from").alias("_ts"), F.lit(0).alias("_step"), *values)
    ends = reach.select(*keys, F.col("_to").alias("_ts"), F.lit(2).alias("_step"), *[(-F.col(v)).alias(v) for v in values])
    lefts = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_step"), F.struct(*left.columns).alias("_left"))
    rows = lefts.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    rows = rows.withColumn("_bucket", time_bucket("_ts", grain))
    covered = F.sequence(time_bucket("_from", grain) + 1, time_bucket("_to", grain))
    crossing = reach.filter(time_bucket("_from", grain) < time_bucket("_to", grain)).withColumn("_bucket", F.explode(covered))
    offsets = crossing.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_o{v}") for v in values])
    sweep = Window.partitionBy(*keys, "_bucket").orderBy("_ts", "_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumns({f"_s{v}": F.coalesce(F.sum(v).over(sweep), F.lit(0.0)) for v in values}).filter(F.col("_left").isNotNull())
    joined = swept.join(offsets, [*keys, "_bucket"], "left")
    # a row without a key or time matches nothing
    usable = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, "_ts"]])
    total = {n: F.col(f"_s_v_{n}") + F.coalesce(f"_o_v_{n}", F.lit(0.0)) for n in sums}
    return joined.select("_left.*", *[F.when(usable, v).otherwise(0.0).alias(n) for n, v in total.items()])


def window_match_precision(left: DataFrame, right: DataFrame, row_key: list[str], keys: list[str], left_ts: str, right_ts: str,
                           right_date: str, reach: dict[str, tuple[str, int, int]], payload: list[str], tie: list[str],
                           pieces: int = 8) -> DataFrame:
    """Earliest right row around each left row, by time where known, else by date.

    ``reach`` maps a result name to (side, hours, days). Side ``earlier``: the right row comes
    first, in [ts - hours, ts) or, without a time, on a day in [day - days, day]. Side ``later``:
    in (ts, ts + hours] or on a day in [day, day + days]. The earliest by (date, time, no time
    last) is kept as a struct (time, payload...).
    """
    timed = right.filter(F.col(right_ts).isNotNull())
    dated = right.filter(F.col(right_ts).isNull() & F.col(right_date).isNotNull())
    ts, day, micro = F.col(left_ts), F.col(left_ts).cast("date").cast("timestamp_ntz"), F.expr(MICRO)
    probes = {}
    for name, (side, hours, days) in reach.items():
        if side == "earlier":
            probes[f"_timed_{name}"] = ("timed", _moved(left_ts, -hours), ts - micro)
            probes[f"_dated_{name}"] = ("dated", day - F.expr(f"INTERVAL '{days}' DAY"), day)
        else:
            probes[f"_timed_{name}"] = ("timed", ts + micro, _moved(left_ts, hours))
            probes[f"_dated_{name}"] = ("dated", day, day + F.expr(f"INTERVAL '{days}' DAY"))
    longest = max(max(h, 24 * d) for _, h, d in reach.values())
    out = window_match_many(left, row_key, keys, probes, {"timed": (timed, right_ts), "dated": (dated, right_date)}, payload, tie, longest, pieces)
    for name in reach:
        by_time, by_date = F.col(f"_timed_{name}"), F.col(f"_dated_{name}")
        # a row with a time ranks before a row without one on the same day
        first = by_date.isNull() | (by_time["time"].cast("date") <= by_date["time"].cast("date"))
        out = out.withColumn(name, F.when(by_time.isNotNull() & first, by_time).otherwise(by_date))
    return out.drop(*probes)


def asof_latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                       payload: list[str], name: str = "latest", tie: list[str] | None = None,
                       grain: int = HOUR) -> DataFrame:
    """Every left row with the latest right row at or before it."""
    return asof(left, right, keys, left_ts, right_ts, payload, name, tie=tie, grain=grain)


# --- sequences -------------------------------------------------------------------

def attach_parent_by_prefix(nodes: DataFrame, seq: str, key: str, name: str = "parent_id") -> DataFrame:
    """Parent of each node: the node whose sequence is this one without its last element."""
    from wardline.functions.scalars import parent_sequence
    parents = nodes.select(F.col(key).alias(name), F.col(seq).alias("_parent"))
    return nodes.withColumn("_parent", parent_sequence(seq)).join(parents, "_parent", "left").drop("_parent")


def merge_on_text_key(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on an array column directly."""
    return a.join(b, key, how)
