"""Grouped summaries, ranks, shares, profiles and dummy columns on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from wardline.operators import aggregates, matching, ranking, reshape, select
from wardline.functions import scalars


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


LABELLED = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def labelled(t):
    return matching.left_attach(t.documents.select("doc_id", "lang", "source", "n_chars"), t.labels, "doc_id")


@query("modal_value", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c) WHERE rn = 1""")
def modal_value(t):
    return aggregates.modal_value(t.events, ["user_id"], "event_type")


@query("group_profile", """SELECT event_type, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value,
round(stddev_samp(value), 6) AS sd_value, count(value) AS n FROM events GROUP BY event_type""")
def group_profile(t):
    return rounded(aggregates.group_profile(t.events, ["event_type"], "value"), "mean_value", "sd_value").orderBy(F.col("n").desc(), "event_type")


@query("value_counts", "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def value_counts(t):
    return rounded(aggregates.value_counts(t.orders, ["o_orderpriority"]), "share")


@query("weighted_group_mean", """WITH g AS (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, round(m, 4) AS mean_value, n, round(n / sum(n) OVER (), 6) AS share, round(m * n / sum(n) OVER (), 4) AS weighted_mean FROM g""")
def weighted_group_mean(t):
    out = aggregates.weighted_group_mean(t.orders, ["o_orderpriority"], "o_totalprice")
    return out.withColumns({"mean_value": F.round("mean_value", 4), "share": F.round("share", 6), "weighted_mean": F.round("weighted_mean", 4)})


@query("group_quantiles", """WITH g AS (SELECT event_type, quantile_cont(value, 0.0) AS q0, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
quantile_cont(value, 0.75) AS q75, quantile_cont(value, 1.0) AS q100 FROM events GROUP BY 1)
SELECT event_type, round(q0, 6) AS q0, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(q100, 6) AS q100,
row_number() OVER (ORDER BY q50, event_type) AS place FROM g""")
def group_quantiles(t):
    return rounded(aggregates.group_median_order(t.events, ["event_type"], "value"), "q0", "q25", "q50", "q75", "q100")


@query("distinct_counts", """SELECT count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem""")
def distinct_counts(t):
    return aggregates.distinct_counts(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"])


@query("site_summary", f"""WITH d AS ({LABELLED}) SELECT source, count(*) AS n, count(quality) AS tested, count(*) FILTER (quality = 0) AS icu,
count(*) FILTER (toxic = 1) AS died, count(*) FILTER (quality = 0 AND toxic = 1) AS both FROM d GROUP BY source""")
def site_summary(t):
    return aggregates.site_summary(labelled(t), "source", F.col("quality").isNotNull(), F.col("quality") == 0, F.col("toxic") == 1)


@query("marker_summary", f"""WITH d AS ({LABELLED}), m AS (SELECT 'long' AS marker, CASE WHEN n_chars > 2000 THEN 'Abnormal' ELSE 'Test not taken' END AS level, * FROM d
UNION ALL SELECT 'graded', CASE WHEN quality IS NULL THEN 'NA' ELSE CAST(quality AS VARCHAR) END, * FROM d
UNION ALL SELECT 'lang', lang, * FROM d)
SELECT marker, count(*) AS n, count(*) FILTER (n_chars > 500) AS tested, count(*) FILTER (quality = 0) AS icu, count(*) FILTER (toxic = 1) AS died,
count(*) FILTER (quality = 0 AND toxic = 1) AS both FROM m WHERE level NOT IN ('Test not taken', 'NA') GROUP BY marker""")
def marker_summary(t):
    df = labelled(t).withColumns({"long": F.when(F.col("n_chars") > 2000, "Abnormal").otherwise("Test not taken"),
                                  "graded": F.coalesce(F.col("quality").cast("string"), F.lit("NA"))})
    no = lambda c: F.coalesce(c, F.lit(False))
    return aggregates.marker_summary(df, ["long", "graded", "lang"], F.col("n_chars") > 500, no(F.col("quality") == 0), no(F.col("toxic") == 1))


FLAGS = ["lang_de", "lang_es", "lang_fr", "long"]
FLAGS_SQL = """SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS lang_de, CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr,
CASE WHEN n_chars >= 100 THEN CAST(n_chars > 2000 AS INTEGER) END AS long, quality, toxic FROM documents JOIN labels USING (doc_id)"""


def flagged(t):
    df = matching.attach(t.documents.select("doc_id", "lang", "n_chars"), t.labels, "doc_id")
    out = {f"lang_{l}": (F.col("lang") == l).cast("int") for l in ("de", "es", "fr")}
    return df.withColumns({**out, "long": F.when(F.col("n_chars") >= 100, (F.col("n_chars") > 2000).cast("int"))})


@query("contingency", f"""WITH f AS ({FLAGS_SQL}), m AS ({' UNION ALL '.join(f"SELECT '{f}' AS flag, {f} AS p, 1 - quality AS y FROM f" for f in FLAGS)})
SELECT flag, count(*) FILTER (y = 0 AND p = 0) AS negative_absent, count(*) FILTER (y = 0 AND p = 1) AS negative_present,
count(*) FILTER (y = 1 AND p = 0) AS positive_absent, count(*) FILTER (y = 1 AND p = 1) AS positive_present, count(*) AS samples,
count(*) FILTER (p = 1) AS observations, round(count(*) FILTER (p = 1) / count(*), 6) AS observed_share FROM m WHERE p IS NOT NULL GROUP BY flag""")
def contingency(t):
    df = flagged(t).withColumn("poor", 1 - F.col("quality"))
    return rounded(aggregates.contingency_counts(df, FLAGS, "poor"), "observed_share")


@query("cohort_summary", """WITH d AS (SELECT CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'train' ELSE 'external' END AS part,
n_chars, lang, toxic FROM documents JOIN labels USING (doc_id))
SELECT coalesce(part, 'all') AS part, count(*) AS n, round(avg(n_chars), 6) AS mean_age, round(stddev_samp(n_chars), 6) AS sd_age,
round(avg(CAST(lang = 'en' AS INTEGER)), 6) AS share_female, round(avg(toxic), 6) AS outcome_share FROM d GROUP BY GROUPING SETS ((part), ())""")
def cohort_summary(t):
    df = matching.attach(t.documents.select("doc_id", "lang", "source", "n_chars"), t.labels, "doc_id")
    train, external = select.split_by_site(df, "source", [f"src{i}" for i in range(10)])
    both = select.stack_measures({"train": train, "external": external}, "part")
    out = aggregates.cohort_summary(both, "part", "n_chars", F.col("lang") == "en", F.col("toxic") == 1)
    return rounded(out, "mean_age", "sd_age", "share_female", "outcome_share")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def per_column(cols, body):
    return "\nUNION ALL ".join(body.format(c=c) for c in cols)


@query("describe", per_column(NUMERIC, """SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean_value, round(stddev_samp({c}), 6) AS sd_value, min({c}) AS q0,
round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS q100 FROM lineitem"""))
def describe(t):
    return rounded(aggregates.describe(t.lineitem, NUMERIC), "mean_value", "sd_value", "q25", "q50", "q75")


# --- first, last, n-th --------------------------------------------------------------------------

WITH_LABELS = """WITH e AS (SELECT e.event_id, e.user_id, e.ts, e.event_type, l.quality, CASE WHEN e.value >= 50 THEN e.value END AS high
FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id)"""


def with_labels(t):
    ev = t.events.select("event_id", "user_id", "ts", "event_type", F.when(F.col("value") >= 50, F.col("value")).alias("high"))
    return ev.join(t.labels.select(F.col("doc_id").alias("event_id"), "quality"), "event_id", "left")


@query("first_nonnull_per", WITH_LABELS + """ SELECT user_id, arg_min(quality, (ts, event_id)) FILTER (quality IS NOT NULL) AS quality,
arg_min(high, (ts, event_id)) FILTER (high IS NOT NULL) AS high FROM e GROUP BY user_id""")
def first_nonnull_per(t):
    return ranking.first_nonnull_per(with_labels(t), ["user_id"], ["ts", "event_id"], ["quality", "high"])


@query("nth_per", """SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 3""")
def nth_per(t):
    return ranking.nth_per(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], 2).select("user_id", "event_id", "ts", "value")


@query("last_per", """SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_per(t):
    return ranking.last_per(t.events, ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "ts", "value")


@query("sequence_id", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def sequence_id(t):
    slim = t.events.select("event_id", "user_id", "ts")
    return ranking.sequence_id(slim, ["user_id"], "ts", [F.col("ts").asc_nulls_last(), F.col("event_id")], "seq").select("event_id", "user_id", "seq")


@query("stay_sequence", """SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS hospstay_seq,
dense_rank() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate) AS icustay_seq FROM orders""")
def stay_sequence(t):
    slim = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    out = ranking.dense_sequence(slim, ["o_custkey"], "o_orderdate", "hospstay_seq")
    out = ranking.dense_sequence(out, ["o_custkey", "o_orderpriority"], "o_orderdate", "icustay_seq")
    return out.select("o_orderkey", "o_custkey", "hospstay_seq", "icustay_seq")


@query("min_sequence", """WITH s AS (SELECT o_custkey, o_orderpriority, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS seq FROM orders)
SELECT o_custkey, o_orderpriority, min(seq) AS seq FROM s GROUP BY 1, 2""")
def min_sequence(t):
    ranked = ranking.dense_sequence(t.orders.select("o_custkey", "o_orderpriority", "o_orderdate"), ["o_custkey"], "o_orderdate", "seq")
    return ranking.first_stay_by_min(ranked, ["o_custkey", "o_orderpriority"], ["seq"])


@query("keep_first_admission", """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def keep_first_admission(t):
    return ranking.keep_first_admission(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", ["o_orderkey"])


@query("distinct_on", """SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def distinct_on(t):
    return select.distinct_on(t.documents.select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")]).drop("n_chars")


@query("distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(t):
    return select.distinct_rows(t.customer, ["c_nationkey", "c_mktsegment"])


@query("asof_latest_before", """SELECT event_id, user_id, ts, last_view, last_value FROM (SELECT p.event_id, p.user_id, p.ts, v.event_id AS last_view, v.value AS last_value,
row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS rn
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts) WHERE rn = 1""")
def asof_latest_before(t):
    left = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("last_view"), F.col("value").alias("last_value"))
    out = matching.asof_latest_before(left, right, ["user_id"], "ts", "seen_at", ["last_view", "last_value"], tie=["last_view"])
    return out.select("event_id", "user_id", "ts", "latest.*")


@query("window_sums", """SELECT p.event_id, count(v.event_id) AS views, round(coalesce(sum(v.value), 0), 4) AS total FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts >= p.ts - INTERVAL 48 HOUR AND v.ts <= p.ts + INTERVAL 6 HOUR GROUP BY p.event_id""")
def window_sums(t):
    left = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), "value")
    out = matching.window_sums(left, right, ["user_id"], "ts", "seen_at", 48, 6, {"views": F.lit(1), "total": F.col("value")})
    return out.select("event_id", F.col("views").cast("bigint").alias("views"), (F.round("total", 4) + F.lit(0.0)).alias("total"))


# --- shares, top-k, order -------------------------------------------------------------------------

@query("cumulative_share", """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY n DESC, o_orderpriority) / sum(n) OVER (), 6) AS cumulative_share FROM c""")
def cumulative_share(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return rounded(ranking.cumulative_share(counts, "n", ["o_orderpriority"]), "share", "cumulative_share")


@query("top_k", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def top_k(t):
    return ranking.top_k(t.events.groupBy("user_id").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("user_id")], 20)


@query("argmax_per", """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def argmax_per(t):
    return ranking.argmax_per(t.lineitem, ["l_orderkey"], "l_extendedprice", ["l_partkey", "l_linenumber"], ["l_partkey", "l_linenumber", "l_extendedprice"])


LEVELS = ["5-LOW", "3-MEDIUM", "1-URGENT"]


@query("order_by_level", """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS level FROM orders""")
def order_by_level(t):
    return select.order_by_level(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", LEVELS, ["o_orderkey"])


@query("sample_entities", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(concat_ws('|', '3', CAST(user_id AS VARCHAR))), user_id LIMIT 25")
def sample_entities(t):
    return select.sample_entities(t.events, "user_id", 25, 3)


@query("split_by_site", """SELECT 'train' AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE source IN ('src0', 'src1', 'src2')
UNION ALL SELECT 'other', count(*), sum(n_chars)::BIGINT FROM documents WHERE source NOT IN ('src0', 'src1', 'src2')""")
def split_by_site(t):
    parts = select.split_by_site(t.documents, "source", ["src0", "src1", "src2"])
    total = lambda df, n: df.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(n).alias("part"), "n", "chars")
    return total(parts[0], "train").unionByName(total(parts[1], "other"))


@query("trim_outliers", "SELECT event_id, value FROM events WHERE value < 200")
def trim_outliers(t):
    return select.trim_outliers(t.events.select("event_id", "value"), "value", 200)


# --- reshape and profile ---------------------------------------------------------------------------

@query("melt_normalised", per_column(NUMERIC, """SELECT l_orderkey, l_linenumber, '{c}' AS variable, round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS value FROM lineitem"""))
def melt_normalised(t):
    return rounded(reshape.melt_normalised(t.lineitem, ["l_orderkey", "l_linenumber"], NUMERIC), "value")


@query("normalise_columns", """WITH g AS (SELECT event_type, min(value) AS a, max(value) AS b, avg(value) AS c FROM events GROUP BY 1)
SELECT event_type, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 6) AS min_value, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS max_value,
round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS mean_value FROM g""")
def normalise_columns(t):
    profile = aggregates.group_profile(t.events, ["event_type"], "value").select("event_type", "min_value", "max_value", "mean_value")
    return rounded(reshape.normalise_columns(profile, ["min_value", "max_value", "mean_value"]), "min_value", "max_value", "mean_value")


@query("moments", """WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events),
p AS (SELECT event_type, count(*) AS n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4 FROM m GROUP BY 1)
SELECT event_type, n, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2), 6) AS kurtosis FROM p""")
def moments(t):
    return rounded(reshape.moments(t.events, ["event_type"], "value"), "skewness", "kurtosis")


@query("histogram", "SELECT event_type, CAST(floor(value / 25.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def histogram(t):
    return reshape.histogram(t.events, "value", 25.0, ["event_type"])


@query("series_by", """SELECT event_type, CAST(ts AS DATE) AS day, count(value) AS n, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.25), 6) AS q25,
round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1, 2""")
def series_by(t):
    daily = t.events.select("event_type", F.col("ts").cast("date").alias("day"), "value")
    return rounded(reshape.series_by(daily, "day", "value", "event_type"), "mean_value", "q25", "q50", "q75")


@query("label_coverage", f"WITH d AS ({LABELLED}) SELECT source, count(*) AS n, round(avg(CAST(quality IS NOT NULL AS INTEGER)), 6) AS labelled_share FROM d GROUP BY source")
def label_coverage(t):
    return rounded(reshape.label_coverage(labelled(t), "quality", "source"), "labelled_share")


@query("dummies", f"""WITH d AS ({LABELLED}) SELECT doc_id, CAST(coalesce(lang = 'de', false) AS INTEGER) AS lang_de, CAST(coalesce(lang = 'es', false) AS INTEGER) AS lang_es,
CAST(coalesce(lang = 'fr', false) AS INTEGER) AS lang_fr, CAST(coalesce(quality = 1, false) AS INTEGER) AS quality_1, CAST(quality IS NULL AS INTEGER) AS quality_NA FROM d""")
def dummies(t):
    df = labelled(t).withColumn("quality", F.col("quality").cast("string"))
    out = reshape.dummy_columns(df, {"lang": ["de", "en", "es", "fr"], "quality": ["0", "1", "NA"]}, {"lang": "en", "quality": "0"})
    return out.select("doc_id", "lang_de", "lang_es", "lang_fr", "quality_1", "quality_NA")


@query("one_hot", """SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS event_type_click, CAST(event_type = 'error' AS INTEGER) AS event_type_error,
CAST(event_type = 'purchase' AS INTEGER) AS event_type_purchase, CAST(event_type = 'signup' AS INTEGER) AS event_type_signup, CAST(event_type = 'view' AS INTEGER) AS event_type_view FROM events""")
def one_hot(t):
    return reshape.one_hot(t.events.select("event_id", "event_type"), "event_type", ["click", "error", "purchase", "signup", "view"])


@query("binarise", """SELECT event_id, CASE WHEN value >= 40 THEN 1 ELSE 0 END AS band_Abnormal FROM events""")
def binarise(t):
    level = F.when(F.col("value") >= 150, "Severe").when(F.col("value") >= 80, "Moderate").when(F.col("value") >= 40, "Mild").otherwise("Normal")
    df = reshape.dummy_columns(t.events.select("event_id", level.alias("band")), {"band": ["Mild", "Moderate", "Severe"]}, missing=None)
    return reshape.binarise_levels(df, "band", ["Mild", "Moderate", "Severe"], "band_Abnormal").select("event_id", "band_Abnormal")


@query("recode", """SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END AS priority,
CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished FROM orders""")
def recode(t):
    return t.orders.select("o_orderkey", select.recode("o_orderpriority", {"4-NOT SPECIFIED": None, "2-HIGH": "1-URGENT"}).alias("priority"),
                           select.binary_encode("o_orderstatus", "F").alias("finished"))


PROFILE = ["lang", "n_chars", "quality", "toxic"]


@query("missingness", f"WITH d AS ({LABELLED}) " + per_column(PROFILE, """SELECT '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS missing, count(*) AS n,
round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS share FROM d"""))
def missingness(t):
    return rounded(reshape.missingness(labelled(t), PROFILE), "share")


@query("missing_pattern", f"""WITH d AS ({LABELLED}) SELECT CASE WHEN lang IS NULL THEN '1' ELSE '0' END || '|' || CASE WHEN quality IS NULL THEN '1' ELSE '0' END || '|' ||
CASE WHEN toxic IS NULL THEN '1' ELSE '0' END AS pattern, count(*) AS n FROM d GROUP BY 1""")
def missing_pattern(t):
    return reshape.missing_pattern(labelled(t), ["lang", "quality", "toxic"])


@query("drop_sparse", f"WITH d AS ({LABELLED}) SELECT doc_id, n_chars FROM d")
def drop_sparse(t):
    return reshape.drop_sparse_columns(labelled(t).select("doc_id", "n_chars", "quality", "toxic"), ["n_chars", "quality", "toxic"], 0.5)


@query("complete_case", f"WITH d AS ({LABELLED}) SELECT doc_id, quality, toxic FROM d WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def complete_case(t):
    return select.require_complete(labelled(t).select("doc_id", "quality", "toxic"), ["quality", "toxic"])


@query("text_functions", """SELECT p_partkey, replace(replace(p_name, ' ', '_'), 'small', 's') AS clean, CASE WHEN trim(substr(p_name, 1, 3)) = 'red' THEN 'red' ELSE 'other' END AS start,
list_aggregate(string_split(p_name, ' '), 'string_agg', ', ') AS listed, string_split(p_name, ' ')[-1] AS last_word FROM part""")
def text_functions(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", scalars.clean_name("p_name", {" ": "_", "small": "s"}).alias("clean"),
                         F.when(F.trim(F.substring("p_name", 1, 3)) == "red", "red").otherwise("other").alias("start"),
                         F.array_join(scalars.drop_blanks(words), ", ").alias("listed"), scalars.last_move(words).alias("last_word"))


@query("blank_to", "SELECT event_id, CASE WHEN value < 20 THEN 'none' ELSE event_type END AS label FROM events")
def blank_to(t):
    return t.events.select("event_id", scalars.blank_to(F.when(F.col("value") < 10, "  ").when(F.col("value") >= 20, F.col("event_type")), "none").alias("label"))


@query("parse_text", """SELECT event_id, CASE WHEN value > 90 THEN 90.1 ELSE value END AS censored, (floor(value) + floor(value) + 3) / 2 AS midpoint,
CAST(strftime(ts, '%Y-%m-%d %H:%M:00') AS TIMESTAMP) AS seen FROM events""")
def parse_text(t):
    shown = F.when(F.col("value") > 90, ">90").otherwise(F.col("value").cast("string"))
    low = F.floor("value").cast("string")
    return t.events.select("event_id", scalars.parse_censored(F.lit(None), shown, {">90": 90.1}).alias("censored"),
                           scalars.parse_range_midpoint(F.concat(low, F.lit("-"), (F.floor("value") + 3).cast("string"))).alias("midpoint"),
                           scalars.combine_date_time(F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "HH:mm")).alias("seen"))
