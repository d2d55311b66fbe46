"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, collocations, decontaminate, exact_dedup, html_text, jaccard_join, line_dedup, markov, packing, periodic, quality, substring_dedup, warc
from wardline.llm.common import prepare

# Twins of texts that are lower-cased in A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, false AS known, h AS text_sha256
FROM d
"""


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(_table(spark, folder, "documents")))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM p) WHERE n > 1
), cut AS (
  SELECT doc_id, array_agg(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS k FROM later) GROUP BY doc_id
), one AS (
  SELECT w.doc_id, w.ws, unnest(generate_series(1, len(w.ws))) AS k FROM w JOIN cut USING (doc_id)
), kept AS (
  SELECT o.doc_id, coalesce(string_agg(o.ws[o.k], ' ' ORDER BY o.k), '') AS t
  FROM one o ANTI JOIN (SELECT doc_id, unnest(ks) AS k FROM cut) g ON o.doc_id = g.doc_id AND o.k = g.k GROUP BY o.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, folder, "documents"))


OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') for i in generate_series(1, len(ws) - 4)] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)
), e AS (
  SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.u = e.u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.c AS component_id
FROM (SELECT u AS doc_id, min(c) AS c FROM r GROUP BY u) d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[j:j + 9], ' ') for j in generate_series(1, len(ws) - 9)] END) AS p FROM i
), q AS (
  SELECT doc_id, j, k, array_to_string(ws[j:j + k - 1], ' ') AS p
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS j FROM d, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k)
), m AS (
  SELECT doc_id, j, p.k, item_id FROM q JOIN p ON p.p = q.p AND p.k = q.k
), h AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(j, j + k - 1)) AS x FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(_table(spark, folder, "pages"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(_table(spark, folder, "documents")))


OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT r, source, i, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(13)) AS t
  FROM (SELECT r, source, ls, unnest(generate_series(1, len(ls))) AS i FROM d)
), w AS (
  SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 8
), k AS (
  SELECT r, count(*) FILTER (w.t IS NOT NULL) AS gone, string_agg(line, chr(10) ORDER BY i) FILTER (w.t IS NULL) AS kept
  FROM l LEFT JOIN w USING (t) GROUP BY r
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def op6_markov_score(spark: SparkSession, folder: str) -> DataFrame:
    return markov.score_texts(_table(spark, folder, "documents"))


def op9_quality_filter(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_filter(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_round_trip(_table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)
                        for i in generate_series(0, 31)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.decode(bpe.encode(_table(spark, folder, "documents"), path), path))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which some repeat a stretch of their own words up to the end, by a rule on doc_id."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.expr("crc32(cast(string(doc_id) as binary)) div 10").alias("g"))
    some = some.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    some = some.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), int(1 + (n - a) div p)))), 1, n)")
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(periodic.collapse_runs(with_planted_runs(_table(spark, folder, "documents"))))


OP12_SQL = r"""
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295, list_reduce(
    list_concat([4294967295], flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS h FROM documents
), b AS (
  SELECT *, len(ws) AS n, h // 10 AS g FROM c
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM b
), q AS (
  SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a
), d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE [CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END for i in generate_series(0, n - 1)] END AS ws FROM q
), w AS (
  SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d
), e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND y.i - x.i <= x.n // 4
), s AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k
), r AS (
  SELECT doc_id, s, e - s AS l, min(q) AS q FROM s WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e
), t AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(r, (-l, s, q)) AS top, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s + q, s + l - 1)) AS i FROM r
), k AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period,
       CAST(1000 * top.l // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


OP13_SQL = rf"""
WITH s AS (
  SELECT lang, doc, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents)
), w AS (
  SELECT lang, doc, k, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM s
), g AS (
  SELECT lang, len, array_to_string(ws[i:i + len - 1], ' ') AS phrase
  FROM (SELECT lang, ws, len, unnest(generate_series(1, len(ws) - len + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE len(ws) >= len)
), f AS (
  SELECT lang, len, phrase, count(*) AS n FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(n) AS n FROM f WHERE len = 1 GROUP BY lang
), c AS (
  SELECT lang, len, phrase, n AS a, string_split(phrase, ' ') AS v FROM f WHERE len >= 2 AND n >= 30
), k AS (
  SELECT *, unnest(generate_series(1, len - 1)) AS k FROM c
), r AS (
  SELECT k.lang, k.phrase, a, k, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.n + y.n) AS BIGINT) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(v[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(v[k + 1:len(v)], ' ')
), b AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT DISTINCT lang, a, array_to_string(v[j:j + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, v, m, unnest(generate_series(1, len(v) - m + 1)) AS j FROM (SELECT lang, a, v, unnest(generate_series(2, len(v) - 1)) AS m FROM c WHERE len(v) >= 3))
), h AS (
  SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL
), z AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT z.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_markov_score": op6_markov_score,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_filter": op9_quality_filter,
    "op10_warc": op10_warc,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_decontaminate": OP8_SQL,
                       "op10_warc": OP10_SQL, "op12_periodic_runs": OP12_SQL,
                       "op13_collocations": OP13_SQL}
