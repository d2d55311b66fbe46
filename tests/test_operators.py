"""Hand-worked answers, one per trap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardline.functions import scalars as s
from wardline.operators import aggregates, codes, matching, ranking, readings, reshape, select, tree
from wardline.plans import hospital, study
from wardline.sources import readers, writers


def ts(text):
    return dt.datetime.fromisoformat(text)


def one(spark, **cols):
    """A one-row frame of literal columns."""
    return spark.range(1).select(*[(v if not isinstance(v, str) else F.expr(v)).alias(k) for k, v in cols.items()])


# --- scalars -------------------------------------------------------------------

def test_hours_count_boundaries_not_elapsed_time(spark):
    df = one(spark, a="timestamp_ntz'2024-01-01 01:01:00'", b="timestamp_ntz'2024-01-01 00:59:00'")
    row = df.select(s.hours_between("a", "b"), s.elapsed_hours("a", "b"), s.days_between("a", "b")).first()
    assert row[0] == 1 and row[1] == pytest.approx(2 / 60) and row[2] == 0


def test_age_adds_calendar_years(spark):
    df = one(spark, t="timestamp_ntz'2025-01-01 00:00:00'", y="2020", a="50")
    assert df.select(s.age_at("t", "y", "a")).first()[0] == 55


@pytest.mark.parametrize("text,want", [("20-21", 20.5), ("99 - 102", 100.5), ("47", 47.0), ("", None), ("a-b", None), ("1-2-3", None)])
def test_range_midpoint(spark, text, want):
    assert one(spark, t=F.lit(text)).select(s.parse_range_midpoint("t")).first()[0] == want


def test_censored_text(spark):
    df = spark.createDataFrame([(None, ">90"), (55.0, "55"), (None, "12.5"), (None, "bad")], "v double, t string")
    assert [r[0] for r in df.select(s.parse_censored("v", "t", {">90": 90.1})).collect()] == [90.1, 55.0, 12.5, None]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("03/02/2020", "10:30"), ("31/31/2020", "10:30"), (None, "10:30")], "d string, t string")
    assert [r[0] for r in df.select(s.combine_date_time("d", "t")).collect()] == [ts("2020-02-03 10:30"), None, None]


def test_move_text_and_parent(spark):
    df = one(spark, p="array('e4','e5','Nf3')", e="cast(array() as array<string>)")
    row = df.select(s.move_text("p"), s.parent_sequence("p"), s.parent_sequence("e"), s.last_move("e"), F.size(s.prefixes("p", 2))).first()
    assert list(row) == ["1. e4 e5 2. Nf3", ["e4", "e5"], None, None, 2]


# --- select ------------------------------------------------------------------------

def test_exclusion_flow_counts_null_rules_out(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (None, 9)], "a int, b int")
    flow = select.exclusion_flow(df, {"has_a": F.col("a").isNotNull(), "b_over_4": F.col("b") > 4}).orderBy("step").collect()
    assert [(r["rule"], r["n"]) for r in flow] == [("start", 3), ("has_a", 2), ("b_over_4", 1)]


def test_recode_to_null_and_binary(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    got = df.select(select.recode("c", {"x": None, "y": "z"}), select.binary_encode("c", "y")).collect()
    assert got == [(None, 0), ("z", 1), (None, 0)]


def test_trim_keeps_missing(spark):
    assert select.trim_outliers(spark.createDataFrame([(1.0,), (57.5,), (None,)], "v double"), "v", 57.5).count() == 2


def test_levels_are_padded(spark):
    df = spark.createDataFrame([("a", 2)], "l string, n int")
    got = select.add_missing_levels(df, "l", ["a", "b"], {"n": 0}).orderBy("l").collect()
    assert got == [("a", 2), ("b", 0)]


def test_order_by_level_puts_unknown_last(spark):
    df = spark.createDataFrame([("b",), ("zzz",), ("a",)], "l string")
    assert [r["l"] for r in select.order_by_level(df, "l", ["b", "a"]).collect()] == ["b", "a", "zzz"]


def test_column_set_difference_keeps_order():
    assert select.column_set_difference(["c", "a", "b"], ["a"]) == ["c", "b"]


def test_subset_follows_parent(spark):
    emar = spark.createDataFrame([(1, 10), (2, 20)], "emar_id int, hadm_id int")
    detail = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "emar_id int, d string")
    cohort = spark.createDataFrame([(10,)], "hadm_id int")
    out = select.extract_cohort_subset({"emar": emar, "detail": detail, "codes": detail}, cohort, {"emar": "hadm_id"},
                                       {"detail": ("emar", "emar_id")}, ("codes",))
    assert [r["d"] for r in out["detail"].collect()] == ["x"] and out["codes"].count() == 3


# --- matching -----------------------------------------------------------------------

def test_natural_merge_matches_null_with_null(spark):
    a = spark.createDataFrame([(1, None, "p"), (2, 5, "q")], "id int, d int, a string")
    b = spark.createDataFrame([(1, None, "r"), (3, 5, "t")], "id int, d int, b string")
    assert matching.natural_merge(a, b).select("id", "a", "b").collect() == [(1, "p", "r")]
    full = matching.natural_merge(a, b, "full").orderBy("id").select("id", "d", "a", "b").collect()
    assert full == [(1, None, "p", "r"), (2, 5, "q", None), (3, 5, None, "t")]


def test_features_fold_in_one_exchange(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    feats = {n: spark.createDataFrame([(1, float(i))], "id int, value double") for i, n in enumerate("abc")}
    out = matching.join_many_features(base, feats, "id")
    assert out.orderBy("id").collect() == [(1, 0.0, 1.0, 2.0), (2, None, None, None)]


CULTURE = "micro_specimen_id bigint, subject_id bigint, chartdate date, charttime timestamp_ntz, spec_type_desc string, org_name string"
ABX = "subject_id bigint, stay_id bigint, hadm_id bigint, antibiotic string, starttime timestamp_ntz, stoptime timestamp_ntz"


@pytest.mark.parametrize("culture,dated,expected", [
    ("2024-01-02 12:00", False, "before"),      # exactly 72 h before: in
    ("2024-01-02 11:59", False, None),          # a minute more: out
    ("2024-01-05 12:00", False, None),          # the same instant: neither before nor after
    ("2024-01-06 12:00", False, "after"),       # exactly 24 h after: in
    ("2024-01-06 12:01", False, None),
    ("2024-01-02 00:00", True, "before"),       # three days by date: in
    ("2024-01-01 00:00", True, None),
    ("2024-01-05 00:00", True, "before"),       # same day by date counts as before
    ("2024-01-06 00:00", True, "after"),
    ("2024-01-07 00:00", True, None),
])
def test_suspicion_window_ends(spark, culture, dated, expected):
    at = ts(culture)
    abx = spark.createDataFrame([(1, 1, 1, "drug", ts("2024-01-05 12:00"), None)], ABX)
    micro = spark.createDataFrame([(7, 1, at.date(), None if dated else at, "BLOOD", " x")], CULTURE)
    row = hospital.suspicion_of_infection(abx, micro).first()
    assert row["suspected_infection"] == (0 if expected is None else 1)
    assert row["suspected_infection_time"] == {None: None, "before": at, "after": ts("2024-01-05 12:00")}[expected]
    assert row["culture_time"] == (at if expected else None)


def test_suspicion_prefers_earlier_date_then_timed_culture(spark):
    abx = spark.createDataFrame([(1, 1, 1, "a", ts("2024-01-05 12:00"), None), (1, 1, 1, "b", ts("2024-01-05 12:00"), None)], ABX)
    micro = spark.createDataFrame([(1, 1, dt.date(2024, 1, 4), None, "URINE", ""), (2, 1, dt.date(2024, 1, 4), ts("2024-01-04 23:00"), "BLOOD", "x")], CULTURE)
    rows = hospital.suspicion_of_infection(abx, micro).orderBy("ab_id").collect()
    assert [(r["ab_id"], r["antibiotic"], r["specimen"], r["positive_culture"]) for r in rows] == [(1, "a", "BLOOD", 1), (2, "b", "BLOOD", 1)]


@pytest.mark.parametrize("end,score,found", [("2023-12-30 00:00", 2, True), ("2023-12-29 23:59", 2, False), ("2024-01-02 00:00", 2, True),
                                             ("2024-01-02 00:01", 2, False), ("2024-01-01 00:00", 1, False)])
def test_onset_window_is_closed_and_scored(spark, end, score, found):
    t0 = ts("2024-01-01 00:00")
    soi = spark.createDataFrame([(1, 5, 1, t0, t0, t0, 1)], "subject_id bigint, stay_id bigint, ab_id bigint, antibiotic_time timestamp_ntz, "
                                "culture_time timestamp_ntz, suspected_infection_time timestamp_ntz, suspected_infection int")
    sofa = spark.createDataFrame([(5, ts(end), score)], "stay_id bigint, endtime timestamp_ntz, sofa_score int")
    assert hospital.sepsis_onset(soi, sofa).count() == int(found)


# --- codes ---------------------------------------------------------------------------

@pytest.mark.parametrize("version,code,condition,want", [
    (9, "41001", "myocardial_infarct", 1), (10, "41001", "myocardial_infarct", 0), (9, "4253", "congestive_heart_failure", 0),
    (9, "4254", "congestive_heart_failure", 1), (9, "4259", "congestive_heart_failure", 1), (9, "4260", "congestive_heart_failure", 0),
    (10, "C26", "malignant_cancer", 1), (10, "C27", "malignant_cancer", 0), (10, "E101", "diabetes_without_cc", 1), (10, "I252X", "myocardial_infarct", 1)])
@pytest.mark.parametrize("max_codes", [0, 1000])
def test_code_rules(spark, version, code, condition, want, max_codes):
    df = spark.createDataFrame([(1, version, code)], "hadm_id int, icd_version int, icd_code string")
    rules = codes.load_conditions(codes.RULES / "charlson.csv")
    assert codes.any_code_flag(df, "hadm_id", "icd_version", "icd_code", rules, max_codes=max_codes).first()[condition] == want


def test_padded_codes_need_trim(spark):
    df = spark.createDataFrame([(1, 9, " 99592 "), (2, 10, "R6520"), (3, 10, "R65201")], "hadm_id int, icd_version int, icd_code string")
    adm = spark.createDataFrame([(9, 1), (9, 2), (9, 3), (8, 4)], "subject_id int, hadm_id int")
    none = df.filter("false")
    got = {r["hadm_id"]: r["angus_sepsis"] for r in hospital.claims_sepsis(adm, df, none).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_claims_test_the_published_infections_and_the_callers(spark):
    adm = spark.createDataFrame([(9, 1), (9, 2)], "subject_id int, hadm_id int")
    dx = spark.createDataFrame([(1, 10, "A000"), (1, 10, "N170"), (2, 10, "Q999"), (2, 10, "N170")], "hadm_id int, icd_version int, icd_code string")
    found = lambda **k: {r["hadm_id"]: r["angus_sepsis"] for r in hospital.claims_sepsis(adm, dx, dx, **k).collect()}
    assert found() == {1: 1, 2: 0}
    assert found(infection_10=["Q999"]) == {1: 1, 2: 1}


def test_registered_claims_know_the_published_infections(spark, monkeypatch):
    from catalog import hospital_queries as q

    listed = ["A000", "A09", "A1801", "A3950", "A35", "J020", "J441", "K5712", "K630", "K750", "K810", "M00019", "M4630", "M9089", "N390", "R7881", "T814XXA", "T880XXA"]
    seen = [*listed, " N390 ", "E119", "A00", "A0009"]
    adm = spark.createDataFrame([(9, i) for i in range(len(seen))], "subject_id int, hadm_id int")
    dx = spark.createDataFrame([(i, 10, c) for i, k in enumerate(seen) for c in (k, "N170")], "hadm_id int, icd_version int, icd_code string")
    for role, df in (("admissions", adm), ("diagnoses", dx), ("procedures", dx.filter("false"))):
        monkeypatch.setattr(q.r, role, lambda t, df=df: df)
    got = {r["hadm_id"]: r["angus_sepsis"] for r in q.claims(None).collect()}
    assert [got[i] for i in range(len(seen))] == [1] * (len(listed) + 1) + [0, 0, 0]


def test_index_pairs_and_missing_age(spark):
    adm = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "subject_id int, hadm_id int")
    dx = spark.createDataFrame([(1, 9, "5710"), (1, 9, "5722"), (1, 9, "1970"), (1, 9, "1500"), (2, 9, "2500")], "hadm_id int, icd_version int, icd_code string")
    ages = spark.createDataFrame([(1, 65), (2, None)], "hadm_id int, age int")
    got = {r["hadm_id"]: r["charlson_comorbidity_index"] for r in hospital.comorbidity_index(adm, dx, ages).collect()}
    assert got == {1: 3 + 3 + 6, 2: 4 + 1, 3: None}


# --- readings --------------------------------------------------------------------------

def limits(spark, measure, value, sex="M", age=50.0):
    df = spark.createDataFrame([(value, sex, age)], "v double, sex string, age double")
    return df.select(readings.band(F.col("v"), readings.load_bands()[measure], F.col("sex"), F.col("age"))).first()[0]


@pytest.mark.parametrize("measure,value,sex,age,want", [
    ("BE", 22.0, "M", 50, "Normal"), ("BE", 29.1, "M", 50, "Abnormal"), ("BNP", 100.0, "M", 69, "Abnormal"), ("BNP", 100.0, "F", 69, "Normal"),
    ("BNP", 299.0, "F", 70, "Normal"), ("BNP", 300.0, "M", 70, "Abnormal"), ("DDM", 500.0, "M", 60, "Abnormal"), ("DDM", 599.0, "M", 61, "Normal"),
    ("DDM", 900.0, "M", 91, "Abnormal"), ("eGFR", 90.0, "M", 50, "Abnormal"), ("eGFR", 90.1, "M", 50, "Normal"), ("FER", 489.0, "M", 50, "Normal"),
    ("FER", 445.0, "F", 44, "Mild"), ("FER", 469.0, "F", 45, "Normal"), ("FER", 470.0, "F", 45, "Mild"), ("FER", 735.0, "M", 50, "Moderate"),
    ("FER", 2450.0, "M", 50, "Severe"), ("HB", 125.0, "M", 50, "Mild"), ("HB", 125.0, "F", 50, "Normal"), ("HB", 79.0, "F", 50, "Severe"),
    ("LDH", 480.0, "M", 50, "Normal"), ("LDH", 1441.0, "M", 50, "Severe"), ("Lymphocytes", 4.5, "M", 50, "Severe"), ("Lymphocytes", 1.48, "M", 50, "Mild"),
    ("fib", 1.0, "M", 50, "Mild"), ("fib", 1.8, "M", 50, "Normal"), ("NLR", 18.0, "M", 50, "Severe"), ("poctpH", 7.35, "M", 50, "Normal"), ("WCC", 11.0, "M", 50, "Severe")])
def test_band_limits(spark, measure, value, sex, age, want):
    assert limits(spark, measure, value, sex, float(age)) == want


def test_band_is_null_only_for_null(spark):
    rules = readings.load_bands()
    assert len(rules) == 26
    df = spark.createDataFrame([(v, sex, age) for v in (-1.0, 0.0, 7.4, 1e6) for sex in ("M", "F", None) for age in (18.0, 100.0, None)], "v double, sex string, age double")
    for rows in rules.values():
        assert df.filter(readings.band(F.col("v"), rows, F.col("sex"), F.col("age")).isNull()).count() == 0
        assert one(spark, v="cast(null as double)").select(readings.band(F.col("v"), rows, F.lit("M"), F.lit(50.0))).first()[0] is None


def test_window_days_and_order(spark):
    data = [(1, "CRP", ts("2024-01-04 08:00"), 9.0, 3), (1, "CRP", ts("2024-01-02 10:00"), 1.0, 1), (1, "CRP", ts("2024-01-02 10:00"), 2.0, 2),
            (1, "CRP", ts("2024-01-05 00:00"), 100.0, 4), (1, "CRP", ts("2024-01-01 23:59"), 100.0, 0)]
    df = spark.createDataFrame(data, "id int, m string, ts timestamp_ntz, v double, tie int")
    anchors = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (2, dt.date(2024, 1, 2))], "id int, a date")
    row = readings.anchored_reading(df, anchors, "id", "m", "ts", "v", "tie", "a", 3).collect()
    assert [(r["lo"], r["hi"], r["mean"], r["n"], r["first"]) for r in row] == [(1.0, 9.0, 4.0, 3, 1.0)]


def test_two_sided_worst(spark):
    df = spark.createDataFrame([("BE", 21.0, 25.0, 23.0, 23.0), ("BE", 25.0, 30.0, 27.0, 25.0), ("BE", 23.0, 28.0, 25.0, 24.0)],
                               "m string, lo double, hi double, mean double, first double")
    got = readings.band_all(df, "m", readings.load_bands(), readings.WORST).collect()
    assert [r["band"] for r in got] == ["Abnormal", "Abnormal", "Normal"]


@pytest.mark.parametrize("admit,out,pos,date,acquired,kind", [
    (1, 9, 1, 1, 0, 1), (1, 9, 5, 5, 1, 2), (5, 9, 1, 5, 0, 3), (3, 3, 3, 3, 1, 4), (1, 3, 9, 9, 1, 5)])
def test_critical_date_cases(spark, admit, out, pos, date, acquired, kind):
    day = lambda d: dt.date(2024, 1, d)
    df = spark.createDataFrame([(day(admit), day(out), day(pos))], "a date, d date, p date")
    row = readings.critical_date(df, "a", "d", "p").first()
    assert (row["critical_date"], row["hospital_acquired"], row["case_type"]) == (day(date), acquired, kind)


def test_window_flag_universe(spark):
    events = spark.createDataFrame([(1, ts("2024-01-02 00:00"), True), (2, ts("2024-01-09 00:00"), True)], "id int, ts timestamp_ntz, pos boolean")
    anchors = spark.createDataFrame([(i, dt.date(2024, 1, 1)) for i in (1, 2, 3)], "id int, a date")
    get = lambda u: {r["id"]: r["f"] for r in readings.any_in_window(events, anchors, "id", "ts", F.col("pos"), "a", 3, "f", u).collect()}
    assert get(None) == {1: True, 2: False, 3: None}
    assert get(spark.createDataFrame([(1,), (3,)], "id int")) == {1: True, 2: None, 3: False}


# --- aggregates, ranking -------------------------------------------------------------------

def test_modal_value_tie_is_alphabetical(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, None)], "k int, v string")
    assert {r["k"]: r["v"] for r in aggregates.modal_value(df, ["k"], "v").collect()} == {1: "a", 2: "c"}


def test_first_nonnull_may_mix_rows_nth_does_not(spark):
    df = spark.createDataFrame([(1, 1, None, 5), (1, 2, 7, None)], "k int, o int, a int, b int")
    assert ranking.first_nonnull_per(df, ["k"], ["o"], ["a", "b"]).collect() == [(1, 7, 5)]
    assert ranking.nth_per(df, ["k"], [F.col("o")], 0).collect() == [(1, 1, None, 5)]
    assert ranking.nth_per(df, ["k"], [F.col("o")], 2).count() == 0


def test_argmax_tie(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", None)], "k int, m string, s double")
    assert ranking.argmax_per(df, ["k"], "s", ["m"], ["m"]).collect() == [(1, "a")]


def test_collapse_blank_organism(spark):
    df = spark.createDataFrame([(1, "x", ""), (1, "x", None), (2, "y", "ECOLI")], "id int, s string, org string")
    assert {r["id"]: r["positive"] for r in aggregates.collapse_duplicates(df, "id", ["s"], "org").collect()} == {1: 0, 2: 1}


def test_any_of_counts_null_as_false(spark):
    df = spark.createDataFrame([(None, True), (None, None), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(aggregates.any_of(["a", "b"])).collect()] == [True, False, False]


def test_column_types(spark):
    assert aggregates.column_types(spark.range(1)).collect() == [("id", "bigint")]


# --- reshape --------------------------------------------------------------------------------

def test_constant_measure_has_no_scale(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 3, 0.0), ("b", 4, 4.0)], "m string, id int, v double")
    got = {r["id"]: r["v"] for r in reshape.rescale01(df, "m", "v", ["id"]).collect()}
    assert got == {1: None, 2: None, 3: 0.0, 4: 1.0}


def test_log_of_zero_is_null(spark):
    df = spark.createDataFrame([("CRP", 8.0), ("PCT", 0.0), ("BE", 57.5), ("BE", 20.0), ("fib", 3.0)], "m string, v double")
    got = reshape.transform_measure(df, "m", "v", reshape.load_transforms()).collect()
    assert [(r["m"], r["v"]) for r in got] == [("CRP", 2.0), ("PCT", None), ("BE", 20.0), ("fib", 3.0)]


def test_dummies_ignore_unknown_levels(spark):
    df = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    got = reshape.dummy_columns(df, {"c": ["a", "b", "NA"]}, {"c": "b"}).select("c_a", "c_NA").collect()
    assert got == [(1, 0), (0, 0), (0, 1)]


def test_sparse_columns_go(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, None), (3, 5, 2)], "id int, a int, b int")
    assert reshape.drop_sparse_columns(df, ["a", "b"], 0.5).columns == ["id", "b"]


@pytest.mark.parametrize("direction,want", [("after", {("CRP", 2, 1)}), ("before", {("CRP", 1, 2)})])
def test_first_reading_direction(spark, direction, want):
    df = spark.createDataFrame([(1, "CRP", dt.date(2024, 1, d)) for d in (1, 4, 7)], "id int, m string, ts date")
    anchors = spark.createDataFrame([(1, dt.date(2024, 1, 5))], "id int, a date")
    got = reshape.time_to_first_reading(df, anchors, "id", "m", "ts", "a", direction).collect()
    assert {(r["m"], r["gap_days"], r["n"]) for r in got} == want


def test_moments_are_population_and_raw(spark):
    xs = [1.0, 2.0, 2.0, 9.0]
    row = reshape.moments(spark.createDataFrame([("g", x) for x in xs], "g string, v double"), ["g"], "v").first()
    mu = sum(xs) / 4
    m2, m3, m4 = (sum((x - mu) ** p for x in xs) / 4 for p in (2, 3, 4))
    assert row["skewness"] == pytest.approx(m3 / m2**1.5) and row["kurtosis"] == pytest.approx(m4 / m2**2)


# --- trees --------------------------------------------------------------------------------------

def test_rollup_takes_means_of_means(spark):
    nodes = spark.createDataFrame([(["a"], 0.0), (["a", "x"], 0.0), (["a", "y"], 10.0), (["a", "x", "1"], 2.0), (["a", "x", "2"], 4.0)], "play array<string>, v double")
    got = {",".join(r["play"]): r for r in tree.rollup_tree(nodes, "play", "v", 3).collect()}
    assert (got["a,x"]["avg_value"], got["a,x"]["sd_value"], got["a,x"]["max_value"]) == (3.0, 1.0, 4.0)
    assert (got["a,y"]["avg_value"], got["a,y"]["sd_value"]) == (10.0, 0.0)
    assert (got["a"]["avg_value"], got["a"]["min_value"], got["a"]["sd_value"]) == (6.5, 2.0, 3.5)


def test_labels_early_and_late(spark):
    games = spark.createDataFrame([(1, list("abcdefg")), (2, list("xyz"))], "id int, play array<string>")
    book = spark.createDataFrame([(list("a"), "A"), (list("abc"), "ABC"), (list("abcde"), "late"), (list("abcdefgh"), "longer")], "line array<string>, name string")
    got = {r["id"]: (r["early_label"], r["late_label"]) for r in tree.label_by_prefix(games, "play", ["id"], book, "line", "name").collect()}
    assert got == {1: ("ABC", "late"), 2: (None, None)}


def test_labels_carry_forward(spark):
    nodes = spark.createDataFrame([(["a"], "A"), (["a", "b"], None), (["a", "b", "c"], None), (["z"], None)], "play array<string>, l string")
    got = {",".join(r["play"]): r["carried"] for r in tree.carry_forward_label(nodes, "play", "l").collect()}
    assert got == {"a": "A", "a,b": "A", "a,b,c": "A", "z": None}


def test_weighted_choice_follows_weights(spark):
    df = spark.createDataFrame([(k, m, w) for k in range(2000) for m, w in (("a", 3.0), ("b", 1.0), ("c", 0.0))], "k int, m string, w double")
    got = {r["m"]: r["count"] for r in tree.weighted_choice_per(df, ["k"], "m", "w", 1).groupBy("m").count().collect()}
    assert set(got) == {"a", "b"} and 1400 < got["a"] < 1600


# --- sources ------------------------------------------------------------------------------------------

BOOK = '{ a book }\n\n[ECO "A00"]\n[Opening "Polish"]\n\n1. b4 *\n\n[ECO "B01"]\n[Opening "Scandinavian"]\n[Variation "Main line"]\n\n1. e4 d5 2. exd5 Qxd5\n3. Nc3 *\n'


def test_opening_book(spark, tmp_path):
    (tmp_path / "book.pgn").write_text(BOOK)
    rows = readers.read_opening_book(spark, str(tmp_path / "book.pgn")).orderBy("eco").collect()
    assert [tuple(r) for r in rows] == [("A00", "Polish", None, "1. b4", ["b4"]),
                                        ("B01", "Scandinavian", "Main line", "1. e4 d5 2. exd5 Qxd5 3. Nc3", ["e4", "d5", "exd5", "Qxd5", "Nc3"])]


def test_csv_spec(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ID,Date Booked In,Numeric Result\nu1,03/02/2020,5.5\nu2,NA,7\nu3,99/99/2020,1\nu4,04/02/2020,NA\n")
    spec = readers.SourceSpec({"ID": "string", "Date Booked In": "string", "Numeric Result": "double"},
                              {"Date Booked In": "date", "Numeric Result": "value"}, ("Date Booked In",), required=("date", "value"))
    assert [tuple(r) for r in readers.read_readings(spark, str(tmp_path / "r.csv"), spec).collect()] == [("u1", dt.date(2020, 2, 3), 5.5)]


def test_repeated_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    for n in (3, 5):
        writers.append_run_result(spark.range(n), path, {"day": 1, "reading": "worst"})
    writers.append_run_result(spark.range(2), path, {"day": 3, "reading": "worst"})
    assert {(str(r["day"]), r["count"]) for r in spark.read.parquet(path).groupBy("day").count().collect()} == {("1", 5), ("3", 2)}


def test_names_may_not_collide(spark):
    with pytest.raises(ValueError):
        readers.clean_names(spark.range(1).selectExpr("id a_1", "id a1"), {"_": ""})


def test_study_card_and_cohort(spark):
    adm = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 1, 9), None, dt.date(2024, 2, 1), 44), (1, dt.date(2024, 3, 1), dt.date(2024, 3, 2), None, None, 44),
                                 (2, dt.date(2024, 1, 1), dt.date(2024, 1, 2), None, None, 17)],
                                "id int, admissionDate date, dischargeDate date, ITU_Start date, deathDate date, Age int")
    pos = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 3)), (2, dt.date(2024, 1, 1))], "id int, date date")
    rows = study.study_cohort(adm, pos, "id").collect()
    assert [(r["id"], r["critical_date"], r["case_type"], r["died"], r["went_to_icu"], r["severe"]) for r in rows] == [(1, dt.date(2024, 1, 3), 2, True, False, True)]


def test_conversation_roles_keep_every_turn(spark):
    from types import SimpleNamespace

    from catalog import tree_queries as q

    rows = [(1, i, "user" if i % 2 else "assistant") for i in range(1, 31)] + [(2, 1, "user"), (2, 2, "system")]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn int, role string")
    got = {r["play"]: (r["games"], r["depth"]) for r in q.conversation_roles(SimpleNamespace(conversations=talk)).collect()}
    want = {",".join(r for _, _, r in rows[:n]): (1 if n > 1 else 2, n) for n in range(1, 31)}
    assert got == {**want, "user,system": (1, 2)}
