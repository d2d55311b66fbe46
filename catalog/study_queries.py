"""Anchored readings, cohort rules and the wide study table on the driver's events.

An entity is a user; measures are event types; the anchor is the user's first signup.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from wardline.functions import scalars
from wardline.operators import aggregates, matching, ranking, readings, reshape, select
from wardline.plans import study
from wardline.session import attach_small

MEASURES = ["click", "error", "purchase", "view"]
DAYS = 3

# bands of the four measures, written like the shipped rules
ROW = dict(lower="", lower_in="", upper="", upper_in="", sex="", age_from="", age_over="", age_to="", age_under="")
RULES = {
    "click": [ROW | dict(measure="click", worst="either", level="Abnormal", upper="5", upper_in="0"),
              ROW | dict(measure="click", worst="either", level="Abnormal", lower="120", lower_in="0")],
    "error": [ROW | dict(measure="error", worst="max", level="Severe", lower="150", lower_in="1"),
              ROW | dict(measure="error", worst="max", level="Moderate", lower="80", lower_in="1"),
              ROW | dict(measure="error", worst="max", level="Mild", lower="40", lower_in="1", sex="M"),
              ROW | dict(measure="error", worst="max", level="Mild", lower="30", lower_in="1", sex="notM", age_under="45"),
              ROW | dict(measure="error", worst="max", level="Mild", lower="35", lower_in="1", sex="notM", age_from="45")],
    "purchase": [ROW | dict(measure="purchase", worst="min", level="Severe", upper="2", upper_in="0"),
                 ROW | dict(measure="purchase", worst="min", level="Mild", upper="20", upper_in="1")],
    "view": [ROW | dict(measure="view", worst="max", level="Abnormal", lower="100", lower_in="1")],
}


def anchors(t):
    """First signup per user, with sex and age of the customer of that number."""
    first = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("anchor"))
    person = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "F").otherwise("M").alias("sex"),
                               (F.floor(F.abs("c_acctbal") / 150) + 18).cast("int").alias("age"))
    return first.join(person, "user_id", "left")


ANCHORS_SQL = """anchors AS (SELECT a.user_id, a.anchor, CASE WHEN c_mktsegment = 'BUILDING' THEN 'F' WHEN c_mktsegment IS NOT NULL THEN 'M' END AS sex,
  CAST(floor(abs(c_acctbal) / 150) + 18 AS INTEGER) AS age
  FROM (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'signup' GROUP BY user_id) a LEFT JOIN customer ON c_custkey = a.user_id)"""


def window_sql(days: int = DAYS) -> str:
    return f"""inside AS (SELECT e.user_id, e.event_type AS measure, e.ts, e.event_id, e.value, a.sex, a.age FROM events e JOIN anchors a ON e.user_id = a.user_id
  WHERE e.event_type <> 'signup' AND CAST(e.ts AS DATE) >= CAST(a.anchor AS DATE) AND CAST(e.ts AS DATE) < CAST(a.anchor AS DATE) + {days}),
vals AS (SELECT user_id, measure, sex, age, min(value) AS lo, max(value) AS hi, avg(value) AS mean, count(*) AS n,
  arg_min(value, (ts, event_id)) AS first FROM inside GROUP BY ALL)"""


def band_sql(v: str) -> str:
    return f"""CASE measure
  WHEN 'click' THEN CASE WHEN {v} < 5 OR {v} > 120 THEN 'Abnormal' ELSE 'Normal' END
  WHEN 'error' THEN CASE WHEN {v} >= 150 THEN 'Severe' WHEN {v} >= 80 THEN 'Moderate' WHEN sex = 'M' AND {v} >= 40 THEN 'Mild'
    WHEN coalesce(sex <> 'M', true) AND age < 45 AND {v} >= 30 THEN 'Mild' WHEN coalesce(sex <> 'M', true) AND age >= 45 AND {v} >= 35 THEN 'Mild' ELSE 'Normal' END
  WHEN 'purchase' THEN CASE WHEN {v} < 2 THEN 'Severe' WHEN {v} <= 20 THEN 'Mild' ELSE 'Normal' END
  WHEN 'view' THEN CASE WHEN {v} >= 100 THEN 'Abnormal' ELSE 'Normal' END END"""


WORST_SQL = f"""CASE WHEN measure = 'click' THEN CASE WHEN lo < 5 OR hi > 120 THEN 'Abnormal' ELSE 'Normal' END
  WHEN measure = 'purchase' THEN {band_sql('lo')} ELSE {band_sql('hi')} END"""


def banded(t, reading, days=DAYS):
    events = t.events.filter("event_type <> 'signup'")
    return study.banded_long(events, anchors(t), "user_id", "event_type", "ts", "value", "event_id", days, reading, RULES,
                             anchor="anchor", sex="sex", age="age").withColumnRenamed("event_type", "measure")


def reading_query(reading, value, shown, expr):
    @query(f"reading_{reading}", f"WITH {ANCHORS_SQL},\n{window_sql()}\nSELECT user_id, measure, n, {shown}, {expr} AS band FROM vals")
    def run(t):
        out = banded(t, reading).withColumn("mean", F.round("mean", 6))
        return out.select("user_id", "measure", "n", *value, "band")


reading_query("worst", ["lo", "hi"], "lo, hi", WORST_SQL)
reading_query("first", ["first"], "first", band_sql("first"))
reading_query("mean", ["mean"], "round(mean, 6) AS mean", band_sql("mean"))


POSITIVE = {"click": 150, "error": 120, "view": 100}


def flag(t, kind, universe=None):
    events = t.events.filter(F.col("event_type") == kind)
    return readings.any_in_window(events, anchors(t), "user_id", "ts", F.col("value") > POSITIVE[kind], "anchor", DAYS, f"{kind}_high", universe)


def flag_sql(kind: str) -> str:
    return f"""(SELECT user_id, bool_or(hit) AS {kind}_high FROM (SELECT e.user_id, e.value > {POSITIVE[kind]}
  AND CAST(e.ts AS DATE) >= CAST(a.anchor AS DATE) AND CAST(e.ts AS DATE) < CAST(a.anchor AS DATE) + {DAYS} AS hit
  FROM events e JOIN anchors a ON e.user_id = a.user_id WHERE e.event_type = '{kind}') x GROUP BY user_id)"""


@query("any_in_window", f"""WITH {ANCHORS_SQL}
SELECT a.user_id, error_high FROM anchors a LEFT JOIN {flag_sql('error')} f ON a.user_id = f.user_id""")
def any_in_window(t):
    return flag(t, "error")


@query("any_in_window_universe", f"""WITH {ANCHORS_SQL}, u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 60)
SELECT a.user_id, CASE WHEN u.user_id IS NOT NULL THEN coalesce(error_high, false) ELSE error_high END AS error_high
FROM anchors a LEFT JOIN u ON a.user_id = u.user_id LEFT JOIN (SELECT f.* FROM {flag_sql('error')} f WHERE user_id IN (SELECT user_id FROM u)) f ON a.user_id = f.user_id""")
def any_in_window_universe(t):
    return flag(t, "error", t.events.filter("event_type = 'view' AND value > 60").select("user_id"))


@query("combined_flag", f"""WITH {ANCHORS_SQL}
SELECT a.user_id, coalesce(click_high, false) OR coalesce(error_high, false) OR coalesce(view_high, false) AS coinfection FROM anchors a
LEFT JOIN {flag_sql('click')} c ON a.user_id = c.user_id LEFT JOIN {flag_sql('error')} e ON a.user_id = e.user_id
LEFT JOIN {flag_sql('view')} v ON a.user_id = v.user_id""")
def combined_flag(t):
    df = anchors(t).select("user_id")
    for kind in POSITIVE:
        df = df.join(flag(t, kind), "user_id", "left")
    return df.select("user_id", aggregates.any_of([f"{k}_high" for k in POSITIVE]).alias("coinfection"))


@query("fill_not_taken", """SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'Test not taken') AS quality, toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_not_taken(t):
    df = matching.left_attach(t.documents.select("doc_id"), t.labels, "doc_id").withColumn("quality", F.col("quality").cast("string"))
    return aggregates.fill_not_taken(df, ["quality"])


# --- cohort: one admission per user and week, positive test = large error ----------------------

def admissions(t):
    return t.events.groupBy("user_id", F.weekofyear("ts").alias("week")).agg(
        F.min(F.col("ts").cast("date")).alias("admissionDate"), F.max(F.col("ts").cast("date")).alias("_last"), F.count("*").alias("n"),
        F.max("value").alias("top"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts").cast("date"))).alias("_unit")).select(
        "user_id", "admissionDate", F.when(F.col("n") > 1, F.col("_last")).alias("dischargeDate"),
        F.when(F.col("top") > 90, F.col("_unit")).alias("ITU_Start"), F.when(F.col("top") > 180, F.col("_last")).alias("deathDate"),
        F.floor(F.col("top") / 4 + 10).cast("int").alias("Age"))


ADMISSIONS_SQL = """adm AS (SELECT user_id, min(CAST(ts AS DATE)) AS admissionDate, CASE WHEN count(*) > 1 THEN max(CAST(ts AS DATE)) END AS dischargeDate,
  CASE WHEN max(value) > 90 THEN min(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) END AS ITU_Start,
  CASE WHEN max(value) > 180 THEN max(CAST(ts AS DATE)) END AS deathDate, CAST(floor(max(value) / 4 + 10) AS INTEGER) AS Age
  FROM events GROUP BY user_id, weekofyear(ts)),
pos AS (SELECT user_id, min(CAST(ts AS DATE)) AS positiveDate FROM events WHERE event_type = 'error' AND value > 60 GROUP BY user_id)"""


def positives(t):
    return t.events.filter("event_type = 'error' AND value > 60").select("user_id", F.col("ts").cast("date").alias("date"))


COHORT_SQL = ADMISSIONS_SQL + """,
elig AS (SELECT a.*, positiveDate, row_number() OVER (PARTITION BY a.user_id ORDER BY admissionDate, dischargeDate) AS rn
  FROM adm a JOIN pos p ON a.user_id = p.user_id WHERE admissionDate IS NOT NULL AND dischargeDate IS NOT NULL AND Age >= 18 AND positiveDate IS NOT NULL),
co AS (SELECT user_id, positiveDate, admissionDate, dischargeDate, ITU_Start, deathDate, Age, deathDate IS NOT NULL AS died, ITU_Start IS NOT NULL AS went_to_icu,
  (deathDate IS NOT NULL OR ITU_Start IS NOT NULL) AS severe, positiveDate - admissionDate AS d1, positiveDate - dischargeDate AS d2 FROM elig WHERE rn = 1),
cohort AS (SELECT user_id, positiveDate, admissionDate, dischargeDate, ITU_Start, deathDate, Age, died, went_to_icu, severe,
  CASE WHEN d1 = 0 AND d2 <> 0 THEN admissionDate WHEN d1 >= 0 AND d2 < 0 THEN positiveDate WHEN d1 < 0 AND d2 < 0 THEN admissionDate
       WHEN d1 = 0 AND d2 = 0 THEN admissionDate ELSE positiveDate END AS critical_date,
  CASE WHEN d1 = 0 AND d2 <> 0 THEN 0 WHEN d1 >= 0 AND d2 < 0 THEN 1 WHEN d1 < 0 AND d2 < 0 THEN 0 ELSE 1 END AS hospital_acquired,
  CASE WHEN d1 = 0 AND d2 <> 0 THEN 1 WHEN d1 >= 0 AND d2 < 0 THEN 2 WHEN d1 < 0 AND d2 < 0 THEN 3 WHEN d1 = 0 AND d2 = 0 THEN 4 ELSE 5 END AS case_type FROM co)"""


@query("critical_date", f"WITH {COHORT_SQL}\nSELECT * FROM cohort")
def critical_date(t):
    return study.study_cohort(admissions(t), positives(t), "user_id")


@query("exclusion_flow", f"""WITH {ADMISSIONS_SQL}, j AS (SELECT a.*, positiveDate FROM adm a LEFT JOIN pos p ON a.user_id = p.user_id)
SELECT 0 AS step, 'start' AS rule, count(*) AS n FROM j
UNION ALL SELECT 1, 'admitted', count(*) FROM j WHERE admissionDate IS NOT NULL
UNION ALL SELECT 2, 'discharged', count(*) FROM j WHERE admissionDate IS NOT NULL AND dischargeDate IS NOT NULL
UNION ALL SELECT 3, 'adult', count(*) FROM j WHERE admissionDate IS NOT NULL AND dischargeDate IS NOT NULL AND Age >= 18
UNION ALL SELECT 4, 'positive', count(*) FROM j WHERE admissionDate IS NOT NULL AND dischargeDate IS NOT NULL AND Age >= 18 AND positiveDate IS NOT NULL""")
def exclusion_flow(t):
    dated = ranking.first_event_date(positives(t), "user_id", "date", "positiveDate")
    return select.exclusion_flow(admissions(t).join(dated, "user_id", "left"), study.cohort_rules())


@query("one_row_per_entity", f"""WITH {COHORT_SQL},
inside AS (SELECT e.user_id, e.event_type AS measure, e.value, c.Age FROM events e JOIN cohort c ON e.user_id = c.user_id
  WHERE e.event_type <> 'signup' AND CAST(e.ts AS DATE) >= c.critical_date AND CAST(e.ts AS DATE) < c.critical_date + 5),
v AS (SELECT user_id, measure, NULL AS sex, Age AS age, min(value) AS lo, max(value) AS hi FROM inside GROUP BY user_id, measure, Age),
b AS (SELECT user_id, measure, {WORST_SQL} AS band FROM v),
w AS (SELECT user_id, max(CASE WHEN measure = 'click' THEN band END) AS click, max(CASE WHEN measure = 'error' THEN band END) AS error,
  max(CASE WHEN measure = 'purchase' THEN band END) AS purchase, max(CASE WHEN measure = 'view' THEN band END) AS "view" FROM b GROUP BY user_id),
f AS (SELECT e.user_id, bool_or(value > 100 AND CAST(e.ts AS DATE) >= c.critical_date AND CAST(e.ts AS DATE) < c.critical_date + 5) AS view_high
  FROM events e JOIN cohort c ON e.user_id = c.user_id WHERE event_type = 'view' GROUP BY e.user_id)
SELECT c.*, coalesce(click, 'Test not taken') AS click, error, coalesce(purchase, 'Test not taken') AS purchase,
  coalesce("view", 'Test not taken') AS "view", view_high, coalesce(view_high, false) AS coinfection
FROM cohort c LEFT JOIN w ON c.user_id = w.user_id LEFT JOIN f ON c.user_id = f.user_id""")
def one_row_per_entity(t):
    cohort = study.study_cohort(admissions(t), positives(t), "user_id")
    long = study.banded_long(t.events.filter("event_type <> 'signup'"), cohort.withColumn("sex", F.lit(None).cast("string")), "user_id",
                             "event_type", "ts", "value", "event_id", 5, readings.WORST, RULES, sex="sex", age="Age")
    high = readings.any_in_window(t.events.filter("event_type = 'view'"), cohort, "user_id", "ts", F.col("value") > 100, "critical_date", 5, "view_high")
    return study.one_row_per_entity(cohort, long, "user_id", "event_type", MEASURES, [high], imputable=["error"])


@query("join_many_features", """SELECT u.user_id, c.v AS clicks, e.v AS errors, p.v AS purchases FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, count(*) AS v FROM events WHERE event_type = 'click' GROUP BY 1) c ON u.user_id = c.user_id
LEFT JOIN (SELECT user_id, count(*) AS v FROM events WHERE event_type = 'error' GROUP BY 1) e ON u.user_id = e.user_id
LEFT JOIN (SELECT user_id, count(*) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON u.user_id = p.user_id""")
def join_many_features(t):
    count = lambda kind: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("value"))
    return matching.join_many_features(t.events.select("user_id").distinct(),
                                       {"clicks": count("click"), "errors": count("error"), "purchases": count("purchase")}, "user_id")


@query("natural_merge", """WITH a AS (SELECT s_nationkey AS k, CASE WHEN s_acctbal < 3000 THEN NULL ELSE s_nationkey END AS part_key, s_suppkey FROM supplier),
b AS (SELECT DISTINCT k, part_key, 'seen' AS mark FROM a WHERE s_suppkey < 60 OR part_key IS NULL)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.s_suppkey IS NOT NULL THEN a.part_key ELSE b.part_key END AS part_key, s_suppkey, mark
FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.part_key IS NOT DISTINCT FROM b.part_key""")
def natural_merge(t):
    a = t.supplier.select(F.col("s_nationkey").alias("k"), F.when(F.col("s_acctbal") >= 3000, F.col("s_nationkey")).alias("part_key"), "s_suppkey")
    b = a.filter("s_suppkey < 60 OR part_key IS NULL").select("k", "part_key", F.lit("seen").alias("mark")).distinct()
    return matching.natural_merge(a, b, "full")


SPLIT_SUPPLIERS = """WITH a AS (SELECT s_nationkey AS k, CASE WHEN s_acctbal < 3000 THEN NULL ELSE s_nationkey END AS part_key, s_suppkey FROM supplier),
b AS (SELECT k, part_key, count(*) AS n FROM a WHERE s_suppkey % 3 = 0 OR part_key IS NULL GROUP BY 1, 2)
"""


def merged_suppliers(t, how: str):
    a = t.supplier.select(F.col("s_nationkey").alias("k"), F.when(F.col("s_acctbal") >= 3000, F.col("s_nationkey")).alias("part_key"), "s_suppkey")
    b = a.filter("s_suppkey % 3 = 0 OR part_key IS NULL").groupBy("k", "part_key").agg(F.count("*").alias("n"))
    return matching.natural_merge(a, b, how)


@query("natural_merge_inner", SPLIT_SUPPLIERS + """SELECT a.k, a.part_key, s_suppkey, n FROM a JOIN b
 ON a.k IS NOT DISTINCT FROM b.k AND a.part_key IS NOT DISTINCT FROM b.part_key""")
def natural_merge_inner(t):
    return merged_suppliers(t, "inner")


@query("natural_merge_left", SPLIT_SUPPLIERS + """SELECT a.k, a.part_key, s_suppkey, n FROM a LEFT JOIN b
 ON a.k IS NOT DISTINCT FROM b.k AND a.part_key IS NOT DISTINCT FROM b.part_key""")
def natural_merge_left(t):
    return merged_suppliers(t, "left")


@query("select_except", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def select_except(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return select.select_except(rows, ["o_orderdate", "o_orderpriority", "not_there"])


@query("column_set_difference", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def column_set_difference(t):
    """Columns an order has beyond those that describe its customer."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    people = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("status"), "c_acctbal")
    return orders.join(people.select("person"), "person", "left_semi").select(*select.column_set_difference(orders.columns, people.columns))


@query("union_sites", """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS site FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def union_sites(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("site"))
    b = t.supplier.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("site"))
    return select.union_sites([a, b])


@query("intersect_keys", "SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 150")
def intersect_keys(t):
    big = t.events.filter("value > 150")
    return select.intersect_keys(big.filter("event_type = 'purchase'"), big.filter("event_type = 'error'"), "user_id")


@query("restrict_to_keys", "SELECT event_id, user_id, ts, value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 250)")
def restrict_to_keys(t):
    keys = t.events.filter("value > 250").select("user_id").distinct()
    return select.restrict_to_keys(t.events.select("event_id", "user_id", "ts", "value"), keys, "user_id")


@query("derive_outcomes", f"""WITH {ADMISSIONS_SQL} SELECT user_id, admissionDate, deathDate IS NOT NULL AS died, ITU_Start IS NOT NULL AS went_to_icu,
(deathDate IS NOT NULL OR ITU_Start IS NOT NULL) AS severe, (deathDate IS NOT NULL) AS outcome FROM adm""")
def derive_outcomes(t):
    out = aggregates.derive_outcomes(admissions(t), "deathDate", "ITU_Start")
    return select.pick_outcome(out, "death").select("user_id", "admissionDate", "died", "went_to_icu", "severe", "outcome")


# --- time around the anchor -------------------------------------------------------------------

@query("relative_days", f"""WITH {ANCHORS_SQL}
SELECT e.event_id, e.user_id, e.event_type, date_diff('day', CAST(a.anchor AS DATE), CAST(e.ts AS DATE)) AS day FROM events e JOIN anchors a ON e.user_id = a.user_id""")
def relative_days(t):
    df = t.events.select("event_id", "user_id", "event_type", "ts")
    return reshape.relative_days(df, anchors(t), "user_id", "ts", "anchor", "day", ["event_id"]).drop("ts")


@query("elapsed_times", f"""WITH {ANCHORS_SQL}
SELECT e.event_id, date_diff('hour', a.anchor, e.ts) AS hours_crossed, CAST(floor(date_diff('microsecond', a.anchor, e.ts) / 3600000000.0) AS BIGINT) AS whole_hours,
round(date_diff('microsecond', a.anchor, e.ts) / 86400000000.0, 6) AS days, CAST(CAST(e.ts AS DATE) AS TIMESTAMP) AS day_start, e.ts + INTERVAL 36 HOUR AS later,
CAST(CAST(a.anchor AS DATE) + 14 AS DATE) AS planned_end FROM events e JOIN anchors a ON e.user_id = a.user_id""")
def elapsed_times(t):
    df = attach_small(t.events.select("event_id", "user_id", "ts"), anchors(t), ["user_id"], ["event_id"])
    return df.select("event_id", scalars.hours_between("ts", "anchor").alias("hours_crossed"),
                     F.floor(scalars.elapsed_hours("ts", "anchor")).alias("whole_hours"), F.round(scalars.elapsed_days("ts", "anchor"), 6).alias("days"),
                     scalars.start_of_day("ts").alias("day_start"), scalars.shifted("ts", hours=36).alias("later"),
                     scalars.discharge_from_length("anchor", F.lit(14)).alias("planned_end"))


OUTCOME_DATES = ["admissionDate", "dischargeDate", "ITU_Start", "deathDate"]


@query("key_events", f"""WITH {COHORT_SQL}, l AS (SELECT user_id, unnest(['admissionDate', 'dischargeDate', 'ITU_Start', 'deathDate']) AS event,
unnest([admissionDate - positiveDate, dischargeDate - positiveDate, ITU_Start - positiveDate, deathDate - positiveDate]) AS day FROM cohort)
SELECT user_id, event, day, day - min(day) OVER (PARTITION BY user_id) AS "offset" FROM l WHERE day IS NOT NULL""")
def key_events(t):
    cohort = study.study_cohort(admissions(t), positives(t), "user_id")
    return reshape.key_events(cohort, "user_id", OUTCOME_DATES, "positiveDate")


@query("entity_card", f"""WITH {COHORT_SQL}
SELECT 'outcome' AS section, field, shown FROM (SELECT unnest(['Age', 'died', 'critical_date']) AS field,
  unnest([CAST(Age AS VARCHAR), CAST(died AS VARCHAR), CAST(critical_date AS VARCHAR)]) AS shown FROM cohort WHERE user_id = 17)
UNION ALL SELECT 'events', field, shown FROM (SELECT unnest(['event_type', 'props']) AS field, unnest([event_type, props]) AS shown FROM events WHERE user_id = 17)""")
def entity_card(t):
    cohort = study.study_cohort(admissions(t), positives(t), "user_id")
    return reshape.entity_card({"outcome": (cohort, ["Age", "died", "critical_date"]), "events": (t.events, ["event_type", "props"])}, "user_id", 17)


def gaps(t, direction="after"):
    return reshape.time_to_first_reading(t.events.filter("event_type <> 'signup'"), anchors(t), "user_id", "event_type", "ts", "anchor", direction)


def gaps_sql(sign: str) -> str:
    gap = "CAST(e.ts AS DATE) - CAST(a.anchor AS DATE)" if sign == "after" else "CAST(a.anchor AS DATE) - CAST(e.ts AS DATE)"
    return f"""WITH {ANCHORS_SQL}, g AS (SELECT e.user_id, event_type, min({gap}) AS gap_days, count(*) AS n FROM events e JOIN anchors a ON e.user_id = a.user_id
WHERE event_type <> 'signup' AND {gap} >= 0 GROUP BY e.user_id, event_type)"""


@query("time_to_first", gaps_sql("after") + " SELECT * FROM g")
def time_to_first(t):
    return gaps(t)


@query("time_to_first_before", gaps_sql("before") + " SELECT * FROM g")
def time_to_first_before(t):
    return gaps(t, "before")


@query("late_first_readings", gaps_sql("after") + " SELECT * FROM g WHERE gap_days > 10")
def late_first_readings(t):
    return reshape.late_first_readings(gaps(t))


@query("reading_coverage", gaps_sql("after") + """ SELECT event_type, count(*) AS n, count(*) FILTER (gap_days <= 1) AS within_1, count(*) FILTER (gap_days > 1) AS over_1,
count(*) FILTER (gap_days <= 3) AS within_3, count(*) FILTER (gap_days > 3) AS over_3, count(*) FILTER (gap_days <= 5) AS within_5, count(*) FILTER (gap_days > 5) AS over_5
FROM g GROUP BY event_type""")
def reading_coverage(t):
    return reshape.reading_coverage(gaps(t), "event_type")


@query("anchor_gap", f"WITH {COHORT_SQL} SELECT user_id, admissionDate - positiveDate AS gap_days FROM cohort")
def anchor_gap(t):
    return reshape.anchor_gap(study.study_cohort(admissions(t), positives(t), "user_id"), "admissionDate", "positiveDate").select("user_id", "gap_days")


# --- timelines and heat map ----------------------------------------------------------------------

@query("union_intervals", """SELECT o_custkey, o_orderdate AS starttime, CAST(o_orderdate + INTERVAL 24 HOUR AS TIMESTAMP) AS stoptime, o_orderpriority AS label, 'order' AS source FROM orders
UNION ALL SELECT o_custkey, o_orderdate, l_shipdate, l_returnflag, 'shipment' FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def union_intervals(t):
    return intervals(t)


def intervals(t):
    orders = t.orders.withColumn("stop", scalars.shifted("o_orderdate", hours=24))
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return select.union_intervals({"order": (orders, "o_orderdate", "stop", "o_orderpriority"),
                                   "shipment": (lines, "o_orderdate", "l_shipdate", "l_returnflag")}, "o_custkey")


@query("timeline", """WITH i AS (SELECT o_custkey, o_orderdate AS starttime, CAST(o_orderdate + INTERVAL 24 HOUR AS TIMESTAMP) AS stoptime, o_orderpriority AS label, 'order' AS source FROM orders
UNION ALL SELECT o_custkey, o_orderdate, l_shipdate, l_returnflag, 'shipment' FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_custkey, source AS lane, label, starttime, stoptime, round(date_diff('second', starttime, stoptime) / 86400.0, 6) AS days FROM i""")
def timeline(t):
    return study.entity_timeline(intervals(t), "o_custkey").withColumn("days", F.round("days", 6))


SPEC = {"click": ("log10", None), "error": ("cbrt", None), "purchase": ("sqrt", None), "view": ("none", 200.0), "signup": ("none", None)}


@query("transform_rescale", """WITH x AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN CASE WHEN value > 0 THEN log10(value) END WHEN 'error' THEN cbrt(value)
 WHEN 'purchase' THEN sqrt(value) ELSE value END AS v FROM events WHERE NOT (event_type = 'view' AND value >= 200)),
m AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1)
SELECT event_id, x.event_type, round((v - lo) / nullif(hi - lo, 0), 6) AS value FROM x JOIN m ON x.event_type = m.event_type""")
def transform_rescale(t):
    out = study.heat_map(t.events.select("event_id", "event_type", "value"), "event_type", "value", SPEC, ["event_id"])
    return out.withColumn("value", F.round("value", 6))


@query("stack_measures", """SELECT l_orderkey, l_quantity AS value, 'quantity' AS measure FROM lineitem UNION ALL SELECT l_orderkey, l_extendedprice, 'price' FROM lineitem""")
def stack_measures(t):
    return select.stack_measures({"quantity": t.lineitem.select("l_orderkey", F.col("l_quantity").alias("value")),
                                  "price": t.lineitem.select("l_orderkey", F.col("l_extendedprice").alias("value"))})


@query("pad_levels", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1, 2),
g AS (SELECT DISTINCT c.p_brand, l.p_type FROM c, (VALUES ('ECONOMY'), ('LARGE'), ('MEDIUM'), ('PROMO'), ('SMALL'), ('STANDARD'), ('UNUSED')) l(p_type))
SELECT g.p_brand, g.p_type, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.p_brand = c.p_brand AND g.p_type = c.p_type""")
def pad_levels(t):
    counts = t.part.filter("p_size > 45").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return select.add_missing_levels(counts, "p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "UNUSED"], {"n": 0}, ["p_brand"])


# --- shipped rules -------------------------------------------------------------------------
# An event counts as a reading of the measure that its number picks, at one of three scales.

def scaled(t, names: list[str]):
    third = F.col("event_id") % 3
    return t.events.filter("event_type <> 'signup'").select(
        "user_id", "event_id", "ts", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int")).alias("measure"),
        F.when(third == 0, F.col("value") / 10).when(third == 1, F.col("value")).otherwise(F.col("value") * 10).alias("value"))


def scaled_sql(names: list[str]) -> str:
    return f"""scaled AS (SELECT user_id, event_id, ts, {names}[CAST(event_id % {len(names)} AS INTEGER) + 1] AS measure,
  CASE event_id % 3 WHEN 0 THEN value / 10 WHEN 1 THEN value ELSE value * 10 END AS value FROM events WHERE event_type <> 'signup')"""


BANDS = readings.load_bands()
LIMITS = ["lower", "lower_in", "upper", "upper_in"]
AGES = ["age_from", "age_over", "age_to", "age_under"]


def bands_sql() -> str:
    """The rules as a table; the first rule that holds, at the low end before the high one, gives the level."""
    number = lambda x: x or "CAST(NULL AS DOUBLE)"
    word = lambda x: f"'{x}'" if x else "CAST(NULL AS VARCHAR)"
    rules = [row for rows in BANDS.values() for row in rows]
    values = ",\n".join("({}, {}, {}, {}, {}, {})".format(i, word(r["measure"]), word(r["worst"]), word(r["level"]), word(r["sex"]),
                                                        ", ".join(number(r[c]) for c in LIMITS + AGES)) for i, r in enumerate(rules))
    return f"""WITH {ANCHORS_SQL}, {scaled_sql(sorted(BANDS))},
rules(place, measure, worst, level, for_sex, {", ".join(LIMITS + AGES)}) AS (VALUES {values}),
r AS (SELECT s.user_id, measure, sex, age, min(value) AS lo, max(value) AS hi FROM scaled s JOIN anchors a ON s.user_id = a.user_id
  WHERE CAST(ts AS DATE) >= CAST(anchor AS DATE) AND CAST(ts AS DATE) < CAST(anchor AS DATE) + 365 AND value IS NOT NULL GROUP BY ALL),
ends AS (SELECT *, 0 AS side, lo AS v FROM r UNION ALL SELECT *, 1, hi FROM r),
hits AS (SELECT e.user_id, e.measure, arg_min(level, side * 1000 + place) AS band FROM ends e JOIN rules x ON e.measure = x.measure
  AND (worst = 'either' OR (worst = 'min') = (side = 0))
  AND (lower IS NULL OR v > lower OR (v = lower AND lower_in = 1)) AND (upper IS NULL OR v < upper OR (v = upper AND upper_in = 1))
  AND (for_sex IS NULL OR (for_sex = 'M') = (sex IS NOT DISTINCT FROM 'M'))
  AND (age_from IS NULL OR age >= age_from) AND (age_over IS NULL OR age > age_over)
  AND (age_to IS NULL OR age <= age_to) AND (age_under IS NULL OR age < age_under) GROUP BY 1, 2)
SELECT r.user_id, r.measure, coalesce(band, 'Normal') AS band FROM r LEFT JOIN hits h ON h.user_id = r.user_id AND h.measure = r.measure"""


@query("shipped_bands", bands_sql())
def shipped_bands(t):
    values = readings.anchored_reading(scaled(t, sorted(BANDS)), anchors(t), "user_id", "measure", "ts", "value", "event_id", "anchor", 365, ["sex", "age"])
    out = readings.band_all(values, "measure", BANDS, readings.WORST, "band", F.col("sex"), F.col("age"))
    return out.select("user_id", "measure", "band")


SHAPED = ["BE", "BNP", "APTT", "PT", "CO2", "O2", "CRP", "DDM", "eGFR", "Lymphocytes", "Neutrophils", "NLR", "WCC", "FER", "fib", "Glucose", "HB",
          "HBA1c", "LDH", "PCT", "PLT", "poctLAC", "poctpH", "trig", "trop"]


@query("shipped_transforms", f"""WITH {scaled_sql(SHAPED)},
x AS (SELECT event_id, measure, CASE WHEN measure IN ('CRP', 'Neutrophils', 'WCC', 'HBA1c') THEN cbrt(value) WHEN measure = 'PLT' THEN sqrt(value)
  WHEN measure IN ('BE', 'eGFR', 'fib', 'HB', 'poctpH') THEN value ELSE CASE WHEN value > 0 THEN log10(value) END END AS v
  FROM scaled WHERE NOT (measure = 'BE' AND value >= 57.5)),
m AS (SELECT measure, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1)
SELECT event_id, x.measure, round((v - lo) / nullif(hi - lo, 0), 6) AS value FROM x JOIN m ON x.measure = m.measure""")
def shipped_transforms(t):
    out = study.heat_map(scaled(t, SHAPED).select("event_id", "measure", "value"), "measure", "value", reshape.load_transforms(), ["event_id"])
    return out.withColumn("value", F.round("value", 6))
