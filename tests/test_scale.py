"""Two-level helpers against plain windows, with many small buckets and one hot key."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline import scale, session
from wardline.operators import matching, ranking


@pytest.fixture(scope="module")
def timed(spark):
    """One key holds most rows; times repeat and some are missing."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = 1 if i % 3 else rng.choice([2, 3, 4, None])
        ts = None if rng.random() < 0.05 else start + dt.timedelta(minutes=30 * rng.randrange(400))
        rows.append((i, key, ts, float(rng.randrange(50))))
    return spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp_ntz, v double").cache()


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_sequence_id_equals_row_number(timed):
    got = ranking.sequence_id(timed, ["k"], "ts", [F.col("ts").asc_nulls_last(), F.col("id")], "n")
    want = timed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_last(), "id")))
    assert as_dict(got, "id", "n") == as_dict(want, "id", "n")


def test_dense_sequence_equals_dense_rank(timed):
    got = ranking.dense_sequence(timed, ["k"], "ts", "n")
    want = timed.withColumn("n", F.dense_rank().over(Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_last())))
    assert as_dict(got, "id", "n") == as_dict(want, "id", "n")


def brute(timed, pick):
    rows = [r.asDict() for r in timed.collect()]
    return {a["id"]: pick(a, [b for b in rows if b["k"] == a["k"] and b["ts"] is not None] if a["k"] is not None and a["ts"] is not None else [])
            for a in rows}


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_asof(timed, forward, inclusive):
    right = timed.select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    got = as_dict(scale.asof(timed, right, ["k"], "ts", "rts", ["rid"], "m", forward, inclusive, ["rid"], grain=7200), "id", "m")

    def pick(a, cand):
        if forward:
            ok = [b for b in cand if b["ts"] > a["ts"] or (inclusive and b["ts"] == a["ts"])]
            best = min(ok, key=lambda b: (b["ts"], b["id"]), default=None)
        else:
            ok = [b for b in cand if b["ts"] < a["ts"] or (inclusive and b["ts"] == a["ts"])]
            best = max(ok, key=lambda b: (b["ts"], b["id"]), default=None)
        return best and best["id"]

    assert {i: m and m["rid"] for i, m in got.items()} == brute(timed, pick)


@pytest.mark.parametrize("before,after,lower,upper", [(48, 24, True, True), (24, 0, True, False), (0, 24, False, True), (1, 0.5, True, True)])
def test_window_match_is_the_first_pair(timed, before, after, lower, upper):
    right = timed.select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    got = as_dict(matching.window_match(timed, right, ["k"], "ts", "rts", before, after, ["rid"], "m", lower, upper, ["rid"]), "id", "m")

    def pick(a, cand):
        lo, hi = a["ts"] and a["ts"] - dt.timedelta(hours=before), a["ts"] and a["ts"] + dt.timedelta(hours=after)
        ok = [b for b in cand if (b["ts"] > lo or (lower and b["ts"] == lo)) and (b["ts"] < hi or (upper and b["ts"] == hi))]
        best = min(ok, key=lambda b: (b["ts"], b["id"]), default=None)
        return best and best["id"]

    assert {i: m and m["rid"] for i, m in got.items()} == brute(timed, pick)


def test_window_sums_equal_pair_sums(timed):
    right = timed.select("k", F.col("ts").alias("rts"), F.col("v").alias("w"))
    got = as_dict(matching.window_sums(timed, right, ["k"], "ts", "rts", 48, 6, {"s": F.col("w"), "n": F.lit(1)}), "id", "s")

    def pick(a, cand):
        return sum(b["v"] for b in cand if a["ts"] - dt.timedelta(hours=48) <= b["ts"] <= a["ts"] + dt.timedelta(hours=6))

    assert got == {i: float(v) for i, v in brute(timed, pick).items()}


@pytest.mark.parametrize("ranges", [1, 40, None])
def test_exact_quantiles(spark, ranges):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 500, p=[0.8, 0.15, 0.05]), "x": np.round(rng.exponential(20, 500), 1)})
    pdf.loc[0, "x"] = 1e9
    df = spark.createDataFrame(pdf)
    got = scale.exact_quantiles(df, ["g"], "x", {"q25": 0.25, "q50": 0.5, "q975": 0.975}, ranges).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q975", 0.975)):
            assert got.loc[g, name] == pytest.approx(np.quantile(part.x, p))


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert scale.exact_quantiles(df, [], "x", {"m": 0.5}, 3).first()["m"] == 5.0


def test_quantiles_between_infinite_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (float("inf"),), (float("inf"),)], "x double")
    got = scale.exact_quantiles(df, [], "x", {"low": 0.0, "mid": 0.5, "top": 1.0}, 3).first()
    assert got.asDict() == {"low": float("-inf"), "mid": float("inf"), "top": float("inf")}


def test_more_ranges_than_the_old_limit(spark):
    """One key, 6,000 distinct values, as many ranges as Spark finds cuts for: the same ranks as one window."""
    df = spark.range(6000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("v"))
    rows = scale.ranged(df, [F.col("v"), F.col("id")], 3000)
    assert rows.select("_bucket").distinct().count() > 2048
    got = scale.running(rows, [], "_bucket", [F.col("v"), F.col("id")], {"n": F.lit(1).cast("bigint")})
    want = df.withColumn("n", F.row_number().over(Window.orderBy("v", "id")))
    assert as_dict(got, "id", "n") == as_dict(want, "id", "n")


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert scale.exact_quantiles(empty, ["g"], "x", {"m": 0.5}).collect() == []


@pytest.mark.parametrize("max_rows", [1, 100])
def test_attach_small_both_ways(spark, max_rows):
    big = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(90)], "id bigint, k string")
    small = spark.createDataFrame([("hot", 1.0), ("cold", 2.0), ("none", 3.0)], "k string, w double")
    out = session.attach_small(big, small, ["k"], ["id"], max_rows=max_rows)
    assert out.groupBy("w").count().orderBy("w").collect() == [(1.0, 60), (2.0, 30)]


def test_small_table_refuses_large(spark):
    assert session.small_table(spark.range(11), 10) is None
    assert session.small_table(spark.range(10), 10).count() == 10


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.checkpoint_dir(spark).replace("file:", "").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_first_per_limits_before_the_exchange(timed):
    plan = ranking.first_per(timed, ["k"], [F.col("ts"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dense_sequence_moves_rows_once_but_for_hot_keys(timed, monkeypatch):
    want = timed.withColumn("n", F.dense_rank().over(Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_last())))
    plain = ranking.dense_sequence(timed, ["k"], "ts", "n")
    assert exchanges(plain) == 1
    most = max(r["count"] for r in timed.groupBy("k").count().collect())
    for limit in (0, most // 2, most - 1):
        monkeypatch.setattr(ranking, "HOT_ROWS", limit)
        for parts in (1, 1 << 16):  # one hash for all keys: only those with too many rows are hot
            monkeypatch.setattr(ranking, "HASH_PARTS", parts)
            got = ranking.dense_sequence(timed, ["k"], "ts", "n")
            assert got.dtypes == plain.dtypes and exchanges(got) > 1
            assert as_dict(got, "id", "n") == as_dict(want, "id", "n")


def test_first_day_features_move_narrow_rows(spark):
    from wardline.plans import hospital

    day = "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, {}, {})"
    stays = spark.range(60).selectExpr("id div 3 AS hadm_id", "id AS stay_id", f"{day.format('id', 0)} AS intime", f"{day.format('id', 30)} AS outtime")
    admissions = spark.range(20).selectExpr("id % 7 AS subject_id", "id AS hadm_id", f"{day.format('id', 0)} AS admittime", f"{day.format('id + 9', 0)} AS dischtime",
                                            "'e' AS ethnicity", "1 AS hospital_expire_flag")
    patients = spark.range(6).selectExpr("id AS subject_id", "'F' AS gender", "50 AS anchor_age", "2019 AS anchor_year")
    cohort = spark.createDataFrame([(i % 40, "x" * (i % 5)) for i in range(0, 90, 2)], "stay_id bigint, note string")
    labs = spark.range(50).selectExpr("id AS stay_id", "id * 2 AS price_min")
    vitals = spark.range(60).selectExpr("id AS stay_id", "id * 3 AS quantity_min")
    marks = spark.range(40).selectExpr("id div 2 AS hadm_id", "id AS troponin_t").where("hadm_id < 9")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = hospital.first_day_features(cohort, hospital.stay_detail(stays, admissions, patients), labs, vitals, marks)
        got = hospital.first_day_features(cohort, lambda of: hospital.stay_detail(stays, admissions, patients, of), labs, vitals, marks)
        places = [[plan.index(f"Join Inner, ({k}") for k in ("hadm_id", "stay_id")] for plan in (d._jdf.queryExecution().optimizedPlan().toString() for d in (got, want))]
        assert want.columns == got.columns and want.count() > 30
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        # stays meet the cohort below the join with the admissions, so no detail is made or moved for other stays
        assert places[0][0] < places[0][1] and places[1][0] > places[1][1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
