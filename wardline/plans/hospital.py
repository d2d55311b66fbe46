"""Composed queries over the hospital tables (patients, admissions, stays, codes, timed events)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import age_at, days_between, hours_between
from wardline.operators import aggregates, codes, matching, ranking, select
from wardline.scale import HOUR
from wardline.session import cut_lineage, salted_join

SCORE_PARTS = ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]


def suspicion_of_infection(antibiotic: DataFrame, microbiology: DataFrame, grain: int = HOUR) -> DataFrame:
    """One row per antibiotic with the culture that makes an infection suspected.

    A culture up to 72 h (or 3 days, if only its date is known) before the antibiotic comes
    first, else one up to 24 h (1 day) after it.
    """
    order = [F.col(c).asc_nulls_last() for c in ("starttime", "stoptime", "antibiotic")]
    abx = ranking.sequence_id(antibiotic, ["subject_id"], "starttime", order, "ab_id", grain)
    # one row per specimen, read once per series and once for their first rows
    cultures = cut_lineage(aggregates.collapse_duplicates(
        microbiology, "micro_specimen_id", ["subject_id", "chartdate", "charttime", "spec_type_desc"], "org_name", "positive"))
    both = matching.window_match_precision(
        abx, cultures, ["subject_id", "ab_id"], ["subject_id"], "starttime", "charttime", "chartdate",
        {"_before": ("earlier", 72, 3), "_after": ("later", 24, 1)}, ["spec_type_desc", "positive"], ["micro_specimen_id"])
    last, nxt = "_before", "_after"
    either = lambda f: F.coalesce(F.col(f"{last}.{f}"), F.col(f"{nxt}.{f}"))
    found = either("spec_type_desc").isNotNull()
    return both.select(
        "subject_id", "stay_id", "hadm_id", "ab_id", "antibiotic", F.col("starttime").alias("antibiotic_time"),
        F.when(found, 1).otherwise(0).alias("suspected_infection"),
        F.when(found, F.coalesce(F.col(f"{last}.time"), F.col("starttime"))).alias("suspected_infection_time"),
        either("time").alias("culture_time"), either("spec_type_desc").alias("specimen"),
        either("positive").alias("positive_culture"))


def sepsis_onset(suspicion: DataFrame, sofa: DataFrame, threshold: int = 2, extra: tuple[str, ...] = (),
                 tie: tuple[str, ...] = ()) -> DataFrame:
    """Earliest suspected infection per stay with a score at or over the threshold from 48 h
    before to 24 h after it, and the earliest such score."""
    scores = select.score_threshold(sofa, "sofa_score", threshold)
    parts = [c for c in dict.fromkeys([*SCORE_PARTS, *extra]) if c in scores.columns]
    in_unit = suspicion.filter(F.col("stay_id").isNotNull() & F.col("suspected_infection_time").isNotNull())
    matched = matching.window_match(in_unit, scores, ["stay_id"], "suspected_infection_time", "endtime", 48, 24,
                                    ["endtime", "sofa_score", *parts], "_score", tie=list(tie))
    matched = matched.filter(F.col("_score").isNotNull())
    order = ["suspected_infection_time", "antibiotic_time", "culture_time"]
    first = ranking.first_per(matched, ["stay_id"], [*[F.col(c).asc_nulls_last() for c in order],
                                                     F.col("_score.endtime"), F.col("ab_id")])
    return first.select(
        "subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time",
        F.col("_score.endtime").alias("sofa_time"), F.col("_score.sofa_score").alias("sofa_score"),
        *[F.col(f"_score.{c}").alias(c) for c in parts],
        ((F.col("_score.sofa_score") >= threshold) & (F.col("suspected_infection") == 1)).alias("sepsis3"))


def onset_with_latest_vitals(onset: DataFrame, vitals: DataFrame, detail: DataFrame, cols: list[str],
                             tie: list[str], grain: int = HOUR) -> DataFrame:
    """Onset with the latest vital signs at or before it, latest onset per patient, and stay detail.

    Stays without any earlier vital signs are left out, as the reference's ranking does.
    """
    # one row per stay, read twice below
    seen = matching.asof_latest_before(cut_lineage(onset), vitals, ["subject_id", "stay_id"], "sofa_time", "charttime",
                                       ["charttime", *cols], "_v", tie, grain)
    seen = seen.filter(F.col("_v").isNotNull())
    last = ranking.last_per(seen, ["subject_id"], "sofa_time", ["stay_id"])
    flat = last.select(*[c for c in last.columns if c != "_v"], "_v.charttime", *[F.col(f"_v.{c}") for c in cols])
    return flat.join(detail, ["subject_id", "stay_id"], "left")


def age_at_admission(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    joined = matching.attach(admissions.select("subject_id", "hadm_id", "admittime"),
                             patients.select("subject_id", "anchor_age", "anchor_year"), "subject_id")
    return joined.withColumn("age", age_at("admittime", "anchor_year", "anchor_age"))


def stay_detail(stays: DataFrame, admissions: DataFrame, patients: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Stays with their admission and patient. With ``of`` (rows by stay_id), only the stays of its rows, with its other columns at the end."""
    # ranks are taken on the narrow inputs; an admission's stays all stay or all go in the joins
    admitted = cut_lineage(admissions.join(stays.select("hadm_id"), "hadm_id", "left_semi"))
    # what is known of a patient joins where visits lie by patient, so that no stay moves for it
    visits = ranking.dense_sequence(admitted, ["subject_id"], "admittime", "hospstay_seq").join(
        patients.select("subject_id", "gender", "anchor_age", "anchor_year"), "subject_id").select(
        "hadm_id", "subject_id", "admittime", "dischtime", "ethnicity", "hospital_expire_flag", "hospstay_seq", "gender", "anchor_age", "anchor_year")
    units = ranking.dense_sequence(stays, ["hadm_id"], "intime", "icustay_seq").select("hadm_id", "stay_id", "intime", "outtime", "icustay_seq")
    more = [c for c in of.columns if c != "stay_id"] if of is not None else []
    if of is not None:
        units = units.join(of, "stay_id")
    ranked = units.join(visits, "hadm_id")
    ranked = ranked.withColumns({"first_hosp_stay": F.col("hospstay_seq") == 1, "first_icu_stay": F.col("icustay_seq") == 1})
    return ranked.select(
        "subject_id", "hadm_id", "stay_id", "gender", "admittime", "dischtime", days_between("dischtime", "admittime").alias("los_hospital"),
        age_at("admittime", "anchor_year", "anchor_age").alias("admission_age"), "ethnicity", "hospital_expire_flag",
        "hospstay_seq", "first_hosp_stay", F.col("intime").alias("icu_intime"), F.col("outtime").alias("icu_outtime"),
        F.round(hours_between("outtime", "intime") / 24.0, 2).alias("los_icu"), "icustay_seq", "first_icu_stay", *more)


# Weights of the comorbidity index and the pairs of which only the greater counts.
CHARLSON_WEIGHTS = {
    "myocardial_infarct": 1, "congestive_heart_failure": 1, "peripheral_vascular_disease": 1, "cerebrovascular_disease": 1,
    "dementia": 1, "chronic_pulmonary_disease": 1, "rheumatic_disease": 1, "peptic_ulcer_disease": 1, "mild_liver_disease": 1,
    "severe_liver_disease": 3, "diabetes_without_cc": 1, "diabetes_with_cc": 2, "malignant_cancer": 2, "metastatic_solid_tumor": 6,
    "paraplegia": 2, "renal_disease": 2, "aids": 6,
}
CHARLSON_PAIRS = [["mild_liver_disease", "severe_liver_disease"], ["diabetes_without_cc", "diabetes_with_cc"],
                  ["malignant_cancer", "metastatic_solid_tumor"]]
CHARLSON_AGES = [40, 50, 60, 70]


def comorbidity_index(admissions: DataFrame, diagnoses: DataFrame, ages: DataFrame,
                      conditions: codes.Conditions | None = None) -> DataFrame:
    """Charlson flags, age score and index per admission; an admission without an age has no index."""
    conditions = conditions or codes.load_conditions(codes.RULES / "charlson.csv")
    flags = codes.any_code_flag(diagnoses, "hadm_id", "icd_version", "icd_code", conditions)
    full = codes.with_all_entities(flags, admissions.select("subject_id", "hadm_id"), "hadm_id")
    scored = ages.select("hadm_id", codes.age_band_score("age", CHARLSON_AGES).alias("age_score"))
    index = F.col("age_score") + codes.weighted_index(CHARLSON_WEIGHTS, CHARLSON_PAIRS)
    return full.join(scored, "hadm_id", "left").withColumn("charlson_comorbidity_index", index)


def published_sepsis() -> codes.Conditions:
    """The claims rules with the whole published list of version-10 infection codes."""
    conditions = codes.load_conditions(codes.RULES / "angus.csv")
    conditions["infection"][10] += conditions.pop("infection_listed")[10]
    return conditions


def claims_sepsis(admissions: DataFrame, diagnoses: DataFrame, procedures: DataFrame,
                  conditions: codes.Conditions | None = None, infection_10: list[str] | None = None) -> DataFrame:
    """Claims-based sepsis flags per admission.

    All published codes are tested unless ``conditions`` says otherwise; ``infection_10`` adds exact
    version-10 infection codes of the caller's.
    """
    conditions = conditions or published_sepsis()
    if infection_10:
        conditions = {c: {v: list(t) for v, t in by.items()} for c, by in conditions.items()}
        conditions["infection"].setdefault(10, []).extend(f"={c}" for c in infection_10)
    dx = {c: conditions[c] for c in ("infection", "explicit_sepsis", "organ_dysfunction")}
    flags = codes.any_code_flag(diagnoses, "hadm_id", "icd_version", "icd_code", dx, trim=True)
    vent = codes.any_code_flag(procedures, "hadm_id", "icd_version", "icd_code", {"mech_vent": conditions["mech_vent"]}, trim=True)
    base = admissions.select("subject_id", "hadm_id").join(flags, "hadm_id", "left").join(vent, "hadm_id", "left")
    base = base.fillna(0, subset=[*dx, "mech_vent"])
    sick = F.col("infection") == 1
    cases = [F.col("explicit_sepsis") == 1, sick & (F.col("organ_dysfunction") == 1), sick & (F.col("mech_vent") == 1)]
    return base.withColumn("angus_sepsis", codes.decision_flag(cases))


SEPSIS_FLAGS = ["infection", "explicit_sepsis", "organ_dysfunction", "mech_vent", "angus_sepsis"]


def patient_flags(flags: DataFrame) -> DataFrame:
    return codes.rollup_flags(flags, "subject_id", SEPSIS_FLAGS).orderBy("subject_id")


def unit_flags(flags: DataFrame, stays: DataFrame) -> DataFrame:
    """Admission flags with the care units of each stay (admissions with a unit stay only)."""
    units = stays.select("hadm_id", "stay_id", "first_careunit", "last_careunit")
    return salted_join(units, flags, ["hadm_id"], ["stay_id"]).drop("stay_id").select("subject_id", "hadm_id", *SEPSIS_FLAGS, "first_careunit", "last_careunit")


def demographics(patients: DataFrame, admissions: DataFrame) -> DataFrame:
    return patients.select("subject_id", "gender", "anchor_age").join(
        admissions.select("subject_id", "ethnicity"), "subject_id").select("gender", "anchor_age", "ethnicity")


def first_day_features(cohort: DataFrame, detail: DataFrame | Callable[[DataFrame], DataFrame], labs: DataFrame, vitals: DataFrame,
                       markers: DataFrame | None = None, marker: str = "troponin_t", on: str = "stay_id") -> DataFrame:
    """Cohort rows with stay detail, lab and vital summaries, ordered by patient and stay.

    ``detail`` is a table, or for a cohort by stay_id a function that gives rows by stay_id their detail (``stay_detail`` with
    ``of``): then narrow rows meet by stay first, and details of other stays are not made. ``markers`` adds the highest cardiac
    marker of the admission.
    """
    if callable(detail):
        measured = cohort.join(labs, "stay_id").join(vitals, "stay_id")
        own = [c for c in cohort.columns if c != "stay_id"]
        met = detail(measured)
        summaries = [c for c in measured.columns if c not in ("stay_id", *own)]
        out = met.select("stay_id", *own, *[c for c in met.columns if c not in measured.columns], *summaries)
    else:
        out = cohort.join(detail, on).join(labs, "stay_id").join(vitals, "stay_id")
    if markers is not None:
        out = out.join(aggregates.max_by_key(markers, ["hadm_id"], [marker]), "hadm_id", "left")
    return out.orderBy("subject_id", "stay_id")


def onset_lab_averages(suspicion: DataFrame, sofa: DataFrame, cols: list[str], threshold: int = 2) -> DataFrame:
    """Mean of score inputs per stay over all (suspicion, score) matches.

    Each score row counts once per suspicion within 24 h before to 48 h after it, which is the
    average over the joined pairs without forming them.
    """
    scores = select.score_threshold(sofa, "sofa_score", threshold)
    # read three times by the sweep
    in_unit = cut_lineage(suspicion.select("stay_id", "suspected_infection_time").dropna())
    weighted = matching.window_sums(scores, in_unit, ["stay_id"], "endtime", "suspected_infection_time", 24, 48,
                                    {"_matches": F.lit(1)})
    return aggregates.weighted_mean_by_key(weighted.filter(F.col("_matches") > 0), ["stay_id"], "_matches", cols)


def vital_averages(vitals: DataFrame, cols: list[str]) -> DataFrame:
    return aggregates.summary_by_key(vitals, ["subject_id", "stay_id"], cols)


def cohort_subset(tables: dict[str, DataFrame], cohort: DataFrame, detail: DataFrame, n: int, grain: dict[str, str],
                  parents: dict[str, tuple[str, str]], copied: tuple[str, ...], seed: int = 0) -> dict[str, DataFrame]:
    """n patients of a cohort and every table cut to them by its finest key."""
    chosen = select.sample_entities(cohort, "subject_id", n, seed)
    keys = detail.select("subject_id", "hadm_id", "stay_id").join(F.broadcast(chosen), "subject_id").distinct()
    return select.extract_cohort_subset(tables, keys, grain, parents, copied)
