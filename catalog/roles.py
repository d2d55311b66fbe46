"""The driver's tables in the roles of hospital tables, as DataFrames and as SQL.

Each role is written twice: ``frame`` functions for Spark and ``*_SQL`` common table expressions
for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import Tables


def patients(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("subject_id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "F").otherwise("M").alias("gender"),
        (F.floor(F.abs("c_acctbal") / 150) + 18).cast("int").alias("anchor_age"),
        (F.col("c_nationkey") + 1970).cast("int").alias("anchor_year"))


PATIENTS_SQL = """patients AS (SELECT c_custkey AS subject_id,
  CASE WHEN c_mktsegment IN ('BUILDING','HOUSEHOLD') THEN 'F' ELSE 'M' END AS gender,
  CAST(floor(abs(c_acctbal) / 150) + 18 AS INTEGER) AS anchor_age, c_nationkey + 1970 AS anchor_year FROM customer)"""


def admissions(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    return t.orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").alias("admittime"),
        F.col("last_ship").alias("dischtime"), F.col("o_orderpriority").alias("ethnicity"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("hospital_expire_flag"))


ADMISSIONS_SQL = """admissions AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
  last_ship AS dischtime, o_orderpriority AS ethnicity, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hospital_expire_flag
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey)"""


def stays(t: Tables) -> DataFrame:
    """One stay per order and line number."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("intime"), F.max("l_shipdate").alias("_out"), F.sum("l_quantity").alias("_q"),
        F.min("l_returnflag").alias("first_careunit"), F.max("l_linestatus").alias("last_careunit")).select(
        F.col("l_orderkey").alias("hadm_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stay_id"), "intime",
        F.timestamp_add("MINUTE", (F.col("_q") * 37).cast("int"), F.col("_out")).cast("timestamp_ntz").alias("outtime"),
        "first_careunit", "last_careunit")


STAYS_SQL = """stays AS (SELECT l_orderkey AS hadm_id, l_orderkey * 10 + l_linenumber AS stay_id, min(l_shipdate) AS intime,
  max(l_shipdate) + to_minutes(CAST(sum(l_quantity) * 37 AS INTEGER)) AS outtime,
  min(l_returnflag) AS first_careunit, max(l_linestatus) AS last_careunit FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def diagnoses(t: Tables) -> DataFrame:
    """Codes spread over both versions: digits of the part key, or a letter and its digits."""
    digits = F.lpad(F.col("l_partkey").cast("string"), 5, "0")
    turned = F.reverse(digits)
    letter = F.expr("substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(floor(l_quantity / 2) as int) + 1, 1)")
    ten = F.col("l_returnflag") == "R"
    return t.lineitem.select(F.col("l_orderkey").alias("hadm_id"), F.when(ten, 10).otherwise(9).alias("icd_version"),
                             F.when(ten, F.concat(letter, F.substring(turned, 1, 3))).otherwise(turned).alias("icd_code"))


DIAGNOSES_SQL = """diagnoses AS (SELECT l_orderkey AS hadm_id, CASE WHEN l_returnflag = 'R' THEN 10 ELSE 9 END AS icd_version,
  CASE WHEN l_returnflag = 'R' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(floor(l_quantity / 2) AS INTEGER) + 1, 1)
    || substr(reverse(lpad(CAST(l_partkey AS VARCHAR), 5, '0')), 1, 3)
    ELSE reverse(lpad(CAST(l_partkey AS VARCHAR), 5, '0')) END AS icd_code FROM lineitem)"""


def procedures(t: Tables) -> DataFrame:
    code = F.concat(F.lit("967"), F.floor(F.col("l_discount") * 100).cast("string"), F.lit(" "))
    return t.lineitem.select(F.col("l_orderkey").alias("hadm_id"), F.lit(9).alias("icd_version"), code.alias("icd_code"))


PROCEDURES_SQL = """procedures AS (SELECT l_orderkey AS hadm_id, 9 AS icd_version,
  '967' || CAST(CAST(floor(l_discount * 100) AS BIGINT) AS VARCHAR) || ' ' AS icd_code FROM lineitem)"""


def antibiotics(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("stay_id"), (F.col("user_id") + 100000).alias("hadm_id"),
        F.concat(F.lit("drug "), F.col("event_id").cast("string")).alias("antibiotic"), F.col("ts").alias("starttime"),
        F.col("ts").alias("stoptime"))


ANTIBIOTICS_SQL = """antibiotics AS (SELECT user_id AS subject_id, user_id AS stay_id, user_id + 100000 AS hadm_id,
  'drug ' || CAST(event_id AS VARCHAR) AS antibiotic, ts AS starttime, ts AS stoptime FROM events WHERE event_type = 'purchase')"""


def cultures(t: Tables) -> DataFrame:
    """Views are cultures; those of a low value have only a date, very low ones no organism."""
    return t.events.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("micro_specimen_id"), F.col("user_id").alias("subject_id"),
        F.col("ts").cast("date").alias("chartdate"), F.when(F.col("value") >= 30, F.col("ts")).alias("charttime"),
        F.col("event_type").alias("spec_type_desc"), F.when(F.col("value") >= 10, F.col("props")).otherwise("").alias("org_name"))


CULTURES_SQL = """cultures AS (SELECT event_id AS micro_specimen_id, user_id AS subject_id, CAST(ts AS DATE) AS chartdate,
  CASE WHEN value >= 30 THEN ts END AS charttime, event_type AS spec_type_desc,
  CASE WHEN value >= 10 THEN props ELSE '' END AS org_name FROM events WHERE event_type = 'view')"""


def sofa(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("stay_id"), F.col("ts").alias("endtime"), F.floor(F.col("value") / 10).cast("int").alias("sofa_score"),
        F.col("value").alias("renal"), F.col("event_id").alias("score_id"))


SOFA_SQL = """sofa AS (SELECT user_id AS stay_id, ts AS endtime, CAST(floor(value / 10) AS INTEGER) AS sofa_score,
  value AS renal, event_id AS score_id FROM events WHERE event_type = 'error')"""


def vitals(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "click").select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"),
        F.col("value").alias("heart_rate"), (F.col("value") / 2).alias("sbp"), F.col("event_id").alias("vital_id"))


VITALS_SQL = """vitals AS (SELECT user_id AS subject_id, user_id AS stay_id, ts AS charttime, value AS heart_rate,
  value / 2 AS sbp, event_id AS vital_id FROM events WHERE event_type = 'click')"""


# A specimen explains a span of antibiotic times of each kind; a culture of which only the date is known, whole days.
SUSPICION_SQL = """courses AS (SELECT subject_id, unnest(given, recursive := true), unnest(range(1, len(given) + 1)) AS ab_id FROM (
    SELECT subject_id, list({'stay_id': stay_id, 'hadm_id': hadm_id, 'antibiotic': antibiotic, 'starttime': starttime}
      ORDER BY starttime, stoptime, antibiotic) AS given FROM antibiotics GROUP BY subject_id)),
specimens AS (SELECT micro_specimen_id AS id, max(subject_id) AS subject_id, max(chartdate) AS d, max(charttime) AS moment,
    {'t': coalesce(max(charttime), CAST(max(chartdate) AS TIMESTAMP)), 'specimen': max(spec_type_desc),
     'positive': CAST(coalesce(bool_or(org_name <> ''), false) AS INTEGER)} AS seen FROM cultures GROUP BY micro_specimen_id),
spans AS (SELECT *, 'past' AS kind, coalesce(moment + INTERVAL 1 MICROSECOND, d) AS lo,
    coalesce(moment + INTERVAL 72 HOUR + INTERVAL 1 MICROSECOND, d + INTERVAL 4 DAY) AS hi FROM specimens
  UNION ALL SELECT *, 'next', coalesce(moment, d) - INTERVAL 1 DAY, coalesce(moment, d + INTERVAL 1 DAY) FROM specimens),
explained AS (SELECT c.subject_id, ab_id, first(seen ORDER BY d, moment NULLS LAST, id) FILTER (WHERE kind = 'past') AS past,
    first(seen ORDER BY d, moment NULLS LAST, id) FILTER (WHERE kind = 'next') AS later
    FROM courses c JOIN spans s ON s.subject_id = c.subject_id AND c.starttime >= s.lo AND c.starttime < s.hi GROUP BY c.subject_id, ab_id),
suspicion AS (SELECT subject_id, stay_id, hadm_id, ab_id, antibiotic, starttime AS antibiotic_time,
    CAST(past IS NOT NULL OR later IS NOT NULL AS INTEGER) AS suspected_infection,
    CASE WHEN past IS NOT NULL THEN past.t WHEN later IS NOT NULL THEN starttime END AS suspected_infection_time,
    coalesce(past, later).t AS culture_time, coalesce(past, later).specimen AS specimen, coalesce(past, later).positive AS positive_culture
    FROM courses LEFT JOIN explained USING (subject_id, ab_id))"""

ONSET_SQL = """onset AS (SELECT stay_id, unnest(first({'subject_id': subject_id, 'antibiotic_time': antibiotic_time, 'culture_time': culture_time,
      'suspected_infection_time': suspected_infection_time, 'sofa_time': endtime, 'sofa_score': sofa_score, 'renal': renal,
      'sepsis3': suspected_infection = 1} ORDER BY suspected_infection_time, antibiotic_time, culture_time, endtime, ab_id, score_id))
    FROM suspicion JOIN sofa USING (stay_id)
    WHERE sofa_score >= 2 AND epoch_us(endtime) - epoch_us(suspected_infection_time) BETWEEN -48 * 3600000000 AND 24 * 3600000000 GROUP BY stay_id)"""

# The place of a time is its position among the sorted distinct times.
DETAIL_SQL = """visits AS (SELECT subject_id, list_sort(list_distinct(list(admittime))) AS visit_times FROM admissions
    WHERE hadm_id IN (SELECT hadm_id FROM stays) GROUP BY subject_id),
units AS (SELECT hadm_id, list_sort(list_distinct(list(intime))) AS unit_times FROM stays GROUP BY hadm_id),
detail AS (SELECT subject_id, hadm_id, stay_id, gender, admittime, dischtime,
    CAST(dischtime AS DATE) - CAST(admittime AS DATE) AS los_hospital,
    CAST(anchor_age + (year(admittime) - anchor_year) AS INTEGER) AS admission_age, ethnicity, hospital_expire_flag,
    CAST(list_position(visit_times, admittime) AS BIGINT) AS hospstay_seq, admittime = visit_times[1] AS first_hosp_stay,
    intime AS icu_intime, outtime AS icu_outtime, round((epoch(date_trunc('hour', outtime)) - epoch(date_trunc('hour', intime))) / 86400, 2) AS los_icu,
    CAST(list_position(unit_times, intime) AS BIGINT) AS icustay_seq, intime = unit_times[1] AS first_icu_stay
    FROM admissions JOIN visits USING (subject_id) JOIN units USING (hadm_id) JOIN stays USING (hadm_id) JOIN patients USING (subject_id))"""


def with_roles(*ctes: str, body: str) -> str:
    """A statement over the given roles; a body may start with a comma to add its own."""
    return "WITH " + ",\n".join(ctes) + body if body.lstrip().startswith(",") else "WITH " + ",\n".join(ctes) + "\n" + body
