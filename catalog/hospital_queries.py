"""Hospital queries on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import roles as r
from catalog.registry import query
from wardline.operators import codes, select
from wardline.plans import hospital
from wardline.session import cut_lineage

EVENT_ROLES = (r.ANTIBIOTICS_SQL, r.CULTURES_SQL, r.SUSPICION_SQL)


def suspicion(t):
    return hospital.suspicion_of_infection(r.antibiotics(t), r.cultures(t))


@query("suspicion_match", r.with_roles(*EVENT_ROLES, body="SELECT * FROM suspicion"))
def suspicion_match(t):
    return suspicion(t)


def onset(t):
    return hospital.sepsis_onset(suspicion(t), r.sofa(t), extra=("renal",), tie=("score_id",)).select(
        "subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time", "sofa_time", "sofa_score", "renal", "sepsis3")


@query("sepsis_onset", r.with_roles(*EVENT_ROLES, r.SOFA_SQL, r.ONSET_SQL, body="SELECT * FROM onset"))
def sepsis_onset(t):
    return onset(t)


@query("onset_first_match", """
WITH anchors AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
scores AS (SELECT user_id, event_id AS score_id, ts AS score_time, value FROM events WHERE event_type = 'error' AND value >= 2),
m AS (SELECT a.user_id, a.event_id, a.ts AS anchor_time, s.score_id, s.score_time, s.value,
  row_number() OVER (PARTITION BY a.user_id ORDER BY a.ts, a.event_id, s.score_time, s.score_id) AS rn
  FROM anchors a JOIN scores s ON a.user_id = s.user_id AND s.score_time >= a.ts - INTERVAL 48 HOUR AND s.score_time <= a.ts + INTERVAL 24 HOUR)
SELECT user_id, event_id, anchor_time, score_id, score_time, value FROM m WHERE rn = 1""")
def onset_first_match(t):
    from wardline.operators import matching, ranking
    anchors = t.events.filter("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("anchor_time"))
    scores = select.score_threshold(t.events.filter("event_type = 'error'"), "value", 2).select(
        "user_id", F.col("event_id").alias("score_id"), F.col("ts").alias("score_time"), "value")
    m = matching.window_match(anchors, scores, ["user_id"], "anchor_time", "score_time", 48, 24,
                              ["score_id", "score_time", "value"], tie=["score_id"]).filter("match is not null")
    first = ranking.first_per(m, ["user_id"], [F.col("anchor_time"), F.col("event_id")])
    return first.select("user_id", "event_id", "anchor_time", "match.*")


@query("onset_with_latest", r.with_roles(
    *EVENT_ROLES, r.SOFA_SQL, r.ONSET_SQL, r.VITALS_SQL, r.PATIENTS_SQL, body="""
, measured AS (SELECT stay_id, unnest(last({'charttime': charttime, 'heart_rate': heart_rate, 'sbp': sbp} ORDER BY charttime, vital_id))
  FROM onset JOIN vitals USING (subject_id, stay_id) WHERE charttime <= sofa_time GROUP BY stay_id)
SELECT DISTINCT ON (subject_id) subject_id, stay_id, antibiotic_time, culture_time, suspected_infection_time, sofa_time, sofa_score, renal, sepsis3,
  charttime, heart_rate, sbp, gender, anchor_age FROM measured JOIN onset USING (stay_id) LEFT JOIN patients USING (subject_id)
ORDER BY subject_id, sofa_time DESC, stay_id DESC"""))
def onset_with_latest(t):
    detail = r.patients(t).select("subject_id", F.col("subject_id").alias("stay_id"), "gender", "anchor_age")
    return hospital.onset_with_latest_vitals(onset(t), r.vitals(t), detail, ["heart_rate", "sbp"], ["vital_id"])


@query("age_at_event", r.with_roles(r.PATIENTS_SQL, r.ADMISSIONS_SQL, body="""
SELECT a.subject_id, a.hadm_id, a.admittime, anchor_age, anchor_year, CAST(year(a.admittime) - anchor_year + anchor_age AS INTEGER) AS age
FROM admissions a JOIN patients p ON a.subject_id = p.subject_id"""))
def age_at_event(t):
    return hospital.age_at_admission(r.admissions(t), r.patients(t))


@query("stay_detail", r.with_roles(r.PATIENTS_SQL, r.ADMISSIONS_SQL, r.STAYS_SQL, r.DETAIL_SQL, body="SELECT * FROM detail"))
def stay_detail(t):
    return detail_table(t)


def detail_table(t, of=None):
    """The stays and admissions made from the driver's tables are written first, as they are tables in their own right."""
    stays = r.stays(t).select("hadm_id", "stay_id", "intime", "outtime")
    return hospital.stay_detail(cut_lineage(stays), cut_lineage(r.admissions(t)), r.patients(t), of)


# --- code sets -----------------------------------------------------------------------

def case_sql(conditions: codes.Conditions, trim: bool = False) -> str:
    """The rules as plain CASE terms, for the check only."""
    code = "trim(icd_code)" if trim else "icd_code"
    cols = []
    for name, by_version in conditions.items():
        tests = []
        for version, tokens in by_version.items():
            for tok in tokens:
                if tok.startswith("="):
                    hit = f"{code} = '{tok[1:]}'"
                elif "-" in tok:
                    lo, hi = tok.split("-")
                    hit = f"substr({code}, 1, {len(lo)}) BETWEEN '{lo}' AND '{hi}'"
                else:
                    hit = f"substr({code}, 1, {len(tok)}) = '{tok}'"
                tests.append(f"(icd_version = {version} AND {hit})")
        cols.append(f"max(CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END) AS {name}")
    return ", ".join(cols)


CHARLSON = codes.load_conditions(codes.RULES / "charlson.csv")
ANGUS = hospital.published_sepsis()
DX = {c: ANGUS[c] for c in ("infection", "explicit_sepsis", "organ_dysfunction")}


@query("code_flags", r.with_roles(r.DIAGNOSES_SQL, body=f"SELECT hadm_id, {case_sql(CHARLSON)} FROM diagnoses GROUP BY hadm_id"))
def code_flags(t):
    return codes.any_code_flag(r.diagnoses(t), "hadm_id", "icd_version", "icd_code", CHARLSON)


# Points of a condition; of one family only the highest count.
POINTS_SQL = """points(condition, family, weight) AS (VALUES ('myocardial_infarct', 'heart attack', 1), ('congestive_heart_failure', 'heart failure', 1),
  ('peripheral_vascular_disease', 'vessels', 1), ('cerebrovascular_disease', 'brain', 1), ('dementia', 'dementia', 1),
  ('chronic_pulmonary_disease', 'lung', 1), ('rheumatic_disease', 'rheumatic', 1), ('peptic_ulcer_disease', 'ulcer', 1),
  ('mild_liver_disease', 'liver', 1), ('severe_liver_disease', 'liver', 3), ('diabetes_without_cc', 'diabetes', 1),
  ('diabetes_with_cc', 'diabetes', 2), ('malignant_cancer', 'cancer', 2), ('metastatic_solid_tumor', 'cancer', 6),
  ('paraplegia', 'paraplegia', 2), ('renal_disease', 'kidney', 2), ('aids', 'aids', 6))"""


@query("comorbidity_index", r.with_roles(r.PATIENTS_SQL, r.ADMISSIONS_SQL, r.DIAGNOSES_SQL, POINTS_SQL, body=f"""
, flags AS (SELECT hadm_id, {case_sql(CHARLSON)} FROM diagnoses GROUP BY hadm_id),
had AS (UNPIVOT flags ON {", ".join(CHARLSON)} INTO NAME condition VALUE hit),
totals AS (SELECT hadm_id, CAST(sum(best) AS INTEGER) AS total FROM (
  SELECT hadm_id, family, max(hit * weight) AS best FROM had JOIN points USING (condition) GROUP BY hadm_id, family) GROUP BY hadm_id),
aged AS (SELECT hadm_id, CAST(age > 40 AS INTEGER) + CAST(age > 50 AS INTEGER) + CAST(age > 60 AS INTEGER) + CAST(age > 70 AS INTEGER) AS age_score
  FROM (SELECT hadm_id, anchor_age + (year(admittime) - anchor_year) AS age FROM patients JOIN admissions USING (subject_id)))
SELECT subject_id, hadm_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in CHARLSON)}, age_score,
  age_score + coalesce(total, 0) AS charlson_comorbidity_index
FROM admissions LEFT JOIN flags USING (hadm_id) LEFT JOIN totals USING (hadm_id) LEFT JOIN aged USING (hadm_id)"""))
def comorbidity_index(t):
    ages = hospital.age_at_admission(r.admissions(t), r.patients(t))
    return hospital.comorbidity_index(r.admissions(t), r.diagnoses(t), ages)


CLAIMS_SQL = f"""coded AS (SELECT hadm_id, {case_sql(DX, True)} FROM diagnoses GROUP BY hadm_id
  UNION ALL BY NAME SELECT hadm_id, {case_sql({"mech_vent": ANGUS["mech_vent"]}, True)} FROM procedures GROUP BY hadm_id),
claims AS (SELECT *, greatest(explicit_sepsis, infection * greatest(organ_dysfunction, mech_vent)) AS angus_sepsis FROM (
  SELECT subject_id, hadm_id, {", ".join(f"coalesce(max({c}), 0) AS {c}" for c in [*DX, "mech_vent"])}
  FROM admissions LEFT JOIN coded USING (hadm_id) GROUP BY subject_id, hadm_id))"""
CLAIM_ROLES = (r.ADMISSIONS_SQL, r.DIAGNOSES_SQL, r.PROCEDURES_SQL, CLAIMS_SQL)


def claims(t):
    return hospital.claims_sepsis(r.admissions(t), r.diagnoses(t), r.procedures(t), ANGUS)


@query("decision_flag", r.with_roles(*CLAIM_ROLES, body="SELECT * FROM claims"))
def decision_flag(t):
    return claims(t)


ROLLUP = ", ".join(f"bool_or({f} = 1) AS {f}" for f in hospital.SEPSIS_FLAGS)


@query("flag_rollup", r.with_roles(*CLAIM_ROLES, body=f"SELECT subject_id, {ROLLUP} FROM claims GROUP BY subject_id"))
def flag_rollup(t):
    return hospital.patient_flags(claims(t))


@query("unit_flags", r.with_roles(*CLAIM_ROLES, r.STAYS_SQL, body="""
SELECT c.*, first_careunit, last_careunit FROM claims c JOIN stays s ON c.hadm_id = s.hadm_id"""))
def unit_flags(t):
    return hospital.unit_flags(claims(t), r.stays(t))


@query("unit_flag_rollup", r.with_roles(*CLAIM_ROLES, r.STAYS_SQL, body=f"""
SELECT subject_id, {ROLLUP} FROM claims c JOIN stays s ON c.hadm_id = s.hadm_id GROUP BY subject_id"""))
def unit_flag_rollup(t):
    return hospital.patient_flags(hospital.unit_flags(claims(t), r.stays(t)))


@query("combine_versions", r.with_roles(r.DIAGNOSES_SQL, body=f"""
, v9 AS (SELECT hadm_id, {case_sql(DX, True)} FROM diagnoses WHERE icd_version = 9 GROUP BY hadm_id),
v10 AS (SELECT hadm_id, {case_sql(DX, True)} FROM diagnoses WHERE icd_version = 10 GROUP BY hadm_id)
SELECT coalesce(v9.hadm_id, v10.hadm_id) AS hadm_id, {", ".join(f"greatest(coalesce(v9.{c}, 0), coalesce(v10.{c}, 0)) AS {c}" for c in DX)}
FROM v9 FULL JOIN v10 ON v9.hadm_id = v10.hadm_id"""))
def combine_versions(t):
    by = {v: codes.any_code_flag(r.diagnoses(t).filter(F.col("icd_version") == v), "hadm_id", "icd_version", "icd_code", DX, True) for v in (9, 10)}
    return codes.combine_versions(by[9], by[10], "hadm_id", list(DX))


@query("demographics", r.with_roles(r.PATIENTS_SQL, r.ADMISSIONS_SQL, body="""
SELECT gender, anchor_age, ethnicity FROM patients p JOIN admissions a ON p.subject_id = a.subject_id"""))
def demographics(t):
    return hospital.demographics(r.patients(t), r.admissions(t))


# --- features ---------------------------------------------------------------------------

FEATURES_SQL = """labs AS (SELECT l_orderkey * 10 + l_linenumber AS stay_id, min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max
  FROM lineitem GROUP BY 1),
vit AS (SELECT l_orderkey * 10 + l_linenumber AS stay_id, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max,
  round(avg(l_quantity), 6) AS quantity_mean FROM lineitem GROUP BY 1),
mark AS (SELECT l_orderkey AS hadm_id, max(l_tax) AS troponin_t_max FROM lineitem GROUP BY 1)"""


def first_day_tables(t):
    line = t.lineitem.withColumn("stay_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    labs = line.groupBy("stay_id").agg(F.min("l_extendedprice").alias("price_min"), F.max("l_extendedprice").alias("price_max"))
    vit = line.groupBy("stay_id").agg(F.min("l_quantity").alias("quantity_min"), F.max("l_quantity").alias("quantity_max"),
                                      F.round(F.avg("l_quantity"), 6).alias("quantity_mean"))
    marks = t.lineitem.select(F.col("l_orderkey").alias("hadm_id"), F.col("l_tax").alias("troponin_t"))
    return labs, vit, marks


@query("feature_table", r.with_roles(r.PATIENTS_SQL, r.ADMISSIONS_SQL, r.STAYS_SQL, r.DETAIL_SQL, FEATURES_SQL, body="""
SELECT d.*, price_min, price_max, quantity_min, quantity_max, quantity_mean, troponin_t_max
FROM (SELECT stay_id FROM detail WHERE hospital_expire_flag = 1) c JOIN detail d ON c.stay_id = d.stay_id
JOIN labs ON d.stay_id = labs.stay_id JOIN vit ON d.stay_id = vit.stay_id LEFT JOIN mark ON d.hadm_id = mark.hadm_id"""))
def feature_table(t):
    ended = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("hadm_id"))
    line = t.lineitem.select(F.col("l_orderkey").alias("hadm_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stay_id")).distinct()
    died = line.join(ended, "hadm_id").select("stay_id")
    labs, vit, marks = first_day_tables(t)
    return hospital.first_day_features(died, lambda of: detail_table(t, of), labs, vit, marks)


@query("onset_lab_averages", r.with_roles(*EVENT_ROLES, r.SOFA_SQL, body="""
SELECT s.stay_id, round(avg(f.renal), 6) AS renal_avg FROM suspicion s JOIN sofa f ON s.stay_id = f.stay_id
  AND f.endtime >= s.suspected_infection_time - INTERVAL 48 HOUR AND f.endtime <= s.suspected_infection_time + INTERVAL 24 HOUR
WHERE f.sofa_score >= 2 GROUP BY s.stay_id"""))
def onset_lab_averages(t):
    return hospital.onset_lab_averages(suspicion(t), r.sofa(t), ["renal"]).withColumn("renal_avg", F.round("renal_avg", 6))


@query("stay_averages", r.with_roles(r.VITALS_SQL, body="""
SELECT subject_id, stay_id, round(avg(heart_rate), 6) AS heart_rate_avg, round(avg(sbp), 6) AS sbp_avg FROM vitals GROUP BY 1, 2"""))
def stay_averages(t):
    out = hospital.vital_averages(r.vitals(t), ["heart_rate", "sbp"])
    return out.withColumns({c: F.round(c, 6) for c in ("heart_rate_avg", "sbp_avg")})


@query("order_summaries", """
SELECT l_orderkey, round(avg(l_quantity), 6) AS l_quantity_avg, round(avg(l_extendedprice), 6) AS l_extendedprice_avg,
  max(l_discount) AS l_discount_max, max(l_tax) AS l_tax_max FROM lineitem GROUP BY l_orderkey""")
def order_summaries(t):
    from wardline.operators import aggregates
    out = aggregates.summary_by_key(t.lineitem, ["l_orderkey"], ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity_avg", "l_extendedprice_avg")})


@query("subset_database", r.with_roles(r.PATIENTS_SQL, r.ADMISSIONS_SQL, r.STAYS_SQL, r.DIAGNOSES_SQL, body="""
, chosen AS (SELECT subject_id FROM (SELECT DISTINCT subject_id FROM admissions) d ORDER BY md5(concat_ws('|', '7', CAST(subject_id AS VARCHAR))), subject_id LIMIT 100),
keys AS (SELECT DISTINCT a.subject_id, a.hadm_id, s.stay_id FROM stays s JOIN admissions a ON s.hadm_id = a.hadm_id
  JOIN chosen c ON a.subject_id = c.subject_id)
SELECT 'patients' AS table_name, count(*) AS n FROM patients WHERE subject_id IN (SELECT subject_id FROM keys)
UNION ALL SELECT 'admissions', count(*) FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM keys)
UNION ALL SELECT 'diagnoses', count(*) FROM diagnoses WHERE hadm_id IN (SELECT hadm_id FROM keys)
UNION ALL SELECT 'stays', count(*) FROM stays WHERE stay_id IN (SELECT stay_id FROM keys)
UNION ALL SELECT 'unit_detail', count(*) FROM stays WHERE hadm_id IN (SELECT hadm_id FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM keys))
UNION ALL SELECT 'nation', count(*) FROM nation"""))
def subset_database(t):
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in subset(t).items()]
    return select.union_sites(counts)


def subset(t):
    tables = {"patients": r.patients(t), "admissions": r.admissions(t), "diagnoses": r.diagnoses(t), "stays": r.stays(t),
              "unit_detail": r.stays(t), "nation": t.nation}
    detail = r.stays(t).join(r.admissions(t).select("subject_id", "hadm_id"), "hadm_id")
    return hospital.cohort_subset(tables, r.admissions(t), detail, 100,
                                  {"patients": "subject_id", "admissions": "hadm_id", "diagnoses": "hadm_id", "stays": "stay_id"},
                                  {"unit_detail": ("admissions", "hadm_id")}, ("nation",), seed=7)


@query("subset_rows", r.with_roles(r.PATIENTS_SQL, r.ADMISSIONS_SQL, r.STAYS_SQL, r.DIAGNOSES_SQL, body="""
, chosen AS (SELECT subject_id FROM (SELECT DISTINCT subject_id FROM admissions) d ORDER BY md5(concat_ws('|', '7', CAST(subject_id AS VARCHAR))), subject_id LIMIT 100),
keys AS (SELECT DISTINCT a.subject_id, a.hadm_id, s.stay_id FROM stays s JOIN admissions a ON s.hadm_id = a.hadm_id
  JOIN chosen c ON a.subject_id = c.subject_id)
SELECT 'patients' AS table_name, * FROM patients WHERE subject_id IN (SELECT subject_id FROM keys)
UNION ALL BY NAME SELECT 'admissions' AS table_name, * FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM keys)
UNION ALL BY NAME SELECT 'diagnoses' AS table_name, * FROM diagnoses WHERE hadm_id IN (SELECT hadm_id FROM keys)
UNION ALL BY NAME SELECT 'stays' AS table_name, * FROM stays WHERE stay_id IN (SELECT stay_id FROM keys)
UNION ALL BY NAME SELECT 'unit_detail' AS table_name, * FROM stays WHERE hadm_id IN (SELECT hadm_id FROM keys)
UNION ALL BY NAME SELECT 'nation' AS table_name, n_nationkey, n_name, n_regionkey FROM nation"""))
def subset_rows(t):
    """The rows of every table of the subset; a column that a table lacks is null."""
    parts = subset(t) | {"nation": t.nation.select("n_nationkey", "n_name", "n_regionkey")}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("table_name", F.lit(name)) for name, df in parts.items()])
