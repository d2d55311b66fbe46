"""Quality and toxicity of documents: evidence of the text, combined with what is known of its host and path.

1. Evidence. Two logistic classifiers on counts of a text (shape, repetition, signs, capitals; for toxicity the words whose
   presence goes with the label) are fitted on a bounded sample of labelled rows (``FIT_ROWS``, chosen by a hash of the id).
2. Hierarchy. Over all documents, hosts and paths sum the evidence of their documents. A host's rate is shrunk to
   the global one and a path's to its host's, by beta-binomial weights whose strength is estimated from how much rates
   differ between groups (method of moments): sites with few documents stay near what lies above them.
3. Decision. The log odds of a document's evidence, moved by the log odds of its path's rate against the global rate.

Groups are only ever summed, with partial sums in each task, so a host may hold any share of all documents.
Null texts count as empty, null hosts and paths as groups of their own. Without labels of both kinds a
classifier says nothing and every document stays. Several labels of one id count as their largest values;
labels without an id or a document are not used. Repeated rows give a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import attach, cut_lineage, prepare, rows_of

FIT_ROWS = 20_000
PREFIXES = (4, 5, 6)
MARK_LEAST = 5  # texts of the label that a word must be in to count
STRONG = 1.0
BLOCK_BYTES = 2 << 20
# A group's own rate can move a document's log odds by so much at most: sites inform, texts decide.
MOST_SHIFT = 2.0
TARGETS = ("quality", "toxic")

KNOWN = ["bias", "log_words", "no_words", "word_length", "distinct", "repeat_next", "capitals", "signs", "digits", "other_bytes", "sign_ends", "lone_signs",
         "line_words", "top_share", "log_words_2"]
WORDY = ["bias", "most", "second", "strong", "strong_share"]


def _alpha_words(table: pa.Table) -> W.Words:
    """Words of letters and digits only, lower-cased: signs around a word do not hide it."""
    return W.Words(table.column("text"), W.NOT_ALNUM, lower=True)


def shape(table: pa.Table) -> np.ndarray:
    """One row of ``KNOWN`` for each text."""
    words = W.Words(table.column("text"))
    n = words.counts
    rows = len(n)
    owner = np.repeat(np.arange(rows), n)
    many = np.maximum(n, 1)
    lengths = words.stop - words.start
    size = np.maximum(np.diff(words.offsets), 1)
    doc_of = np.repeat(np.arange(rows), np.diff(words.offsets))
    data = words.data

    def share_of(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of[mask], minlength=rows) / size

    is_sign = np.zeros(256, bool)
    is_sign[33:127] = True
    is_sign[48:58] = is_sign[65:91] = is_sign[97:123] = False
    plain = is_sign.copy()
    plain[[ord(c) for c in ".,'\"-"]] = False
    hashes = words.hashes()
    same = np.concatenate((hashes[1:] == hashes[:-1], [False])) if len(hashes) else np.zeros(0, bool)
    same[words.first[1:][n > 0] - 1] = False
    order = np.lexsort((hashes, owner))
    head = W.runs(W.mix(hashes[order]) ^ W.mix(owner[order].astype(np.uint64), 9))
    kinds = np.bincount(owner[order][head], minlength=rows)
    top = np.zeros(rows, np.int64)
    if len(head):
        np.maximum.at(top, owner[order][head], np.diff(np.append(head, len(order))))
    log_words = np.log1p(n)
    cols = [np.ones(rows), log_words / 10, n == 0, np.bincount(owner, lengths, rows) / many / 10, kinds / many * np.minimum(1, log_words / 5),
            np.bincount(owner[same], minlength=rows) / many, share_of((data >= 65) & (data <= 90)), share_of(plain[data]), share_of((data >= 48) & (data <= 57)),
            share_of(data >= 128), np.bincount(owner[plain[data[words.stop - 1]]], minlength=rows) / many,
            np.bincount(owner[(lengths == 1) & plain[data[words.start]]], minlength=rows) / many,
            np.log1p(many / (1 + np.bincount(doc_of[data == 10], minlength=rows))) / 10, top / many * np.minimum(1, log_words / 5), (log_words / 10) ** 2]
    return np.stack([np.asarray(c, float) for c in cols], axis=1)


def _marks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, hash) of the distinct words of each text, and of their first ``PREFIXES`` bytes where they are longer."""
    words = _alpha_words(table)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    found = [(owner, words.hashes())]
    for size in PREFIXES:
        longer = words.stop - words.start > size
        start = words.start[longer]
        found.append((owner[longer], W.mix(W.range_hashes(words.data, start, start + size), size)))
    row, mark = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((mark, row))
    row, mark = row[order], mark[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
    return row[new], mark[new], len(words.counts)


def wordy(table: pa.Table, marks: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One row of ``WORDY`` for each text; ``odds``: log odds of the label where a mark occurs, others have none."""
    row, mark, rows = _marks(table)
    size = np.maximum(np.bincount(row, minlength=rows), 1)
    if len(marks):
        at = np.minimum(np.searchsorted(marks, mark), len(marks) - 1)
        hit = marks[at] == mark
        row, value = row[hit], odds[at[hit]]
    else:
        row, value = row[:0], np.zeros(0)
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    head = W.runs(row)
    most, second = np.zeros(rows), np.zeros(rows)
    most[row[head]] = value[head]
    next_one = head + 1
    inside = next_one < np.append(head[1:], len(row))
    second[row[head][inside]] = value[next_one[inside]]
    strong = np.bincount(row[value > STRONG], minlength=rows)
    return np.stack([np.ones(rows), most / 5, second / 5, np.log1p(strong), 10 * strong / size], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps with a ridge on all but the first term; zeros if there are not both classes."""
    beta = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return beta
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - keep * beta
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(keep), grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            return beta
    raise ValueError("the classifier did not converge in 100 steps")


def _presence(batches):
    """mark, toxic, documents: how many sampled texts of each label have a mark, added up for each block."""
    for table in W.blocks(batches, "text", BLOCK_BYTES):
        toxic = table.column("toxic").to_numpy() > 0
        row, mark, _ = _marks(table)
        for label in (False, True):
            seen, count = np.unique(mark[toxic[row] == label], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.full(len(seen), label)), pa.array(count, pa.int64())], names=["mark", "toxic", "documents"])


def _rows(marks: np.ndarray, odds: np.ndarray):
    """Features of sampled texts, with their labels."""

    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            x = np.concatenate([shape(table), wordy(table, marks, odds)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), *[table.column(c).combine_chunks() for c in TARGETS]], names=["x", *TARGETS])

    return work


class Classifier:
    """Log odds of good quality and of toxicity from a text alone."""

    def __init__(self, marks: np.ndarray, odds: np.ndarray, quality: np.ndarray, toxic: np.ndarray):
        self.marks, self.odds, self.quality, self.toxic = marks, odds, quality, toxic

    def logits(self, table: pa.Table) -> np.ndarray:
        one, two = shape(table), wordy(table, self.marks, self.odds)
        return np.clip(np.stack([one @ self.quality, two @ self.toxic]), -30, 30)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """``docs``: doc_id, text; ``labels``: doc_id, quality, toxic. At most ``rows`` labelled rows are used."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max(t), F.lit(0)).cast("bigint").alias(t) for t in TARGETS])
    chosen = cut_lineage(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = cut_lineage(docs.join(F.broadcast(chosen), "doc_id").select("text", *TARGETS))
    have = {bool(k): n for k, n in sample.groupBy(F.col("toxic") > 0).count().collect()}
    seen = sample.mapInArrow(_presence, "mark bigint, toxic boolean, documents bigint").groupBy("mark").agg(
        *[F.sum(F.when(F.col("toxic") == label, F.col("documents")).otherwise(0)).alias(name) for label, name in ((False, "clean"), (True, "marked"))])
    # Log odds less one standard error. At most all marks of the sample over MARK_LEAST can come through.
    ratio = [(F.col(name) + 0.5) / (have.get(label, 0) + 1) for label, name in ((True, "marked"), (False, "clean"))]
    odds = F.log(ratio[0] / ratio[1]) - F.sqrt(1 / (F.col("marked") + 0.5) + 1 / (F.col("clean") + 0.5))
    seen = seen.where(F.col("marked") >= MARK_LEAST).select("mark", odds.alias("odds")).where(F.col("odds") > 0).toArrow()
    marks, odds = seen.column("mark").to_numpy().view(np.uint64), seen.column("odds").to_numpy()
    order = np.argsort(marks)
    marks, odds = marks[order], odds[order]
    table = sample.mapInArrow(_rows(marks, odds), "x array<double>, quality bigint, toxic bigint").toArrow()
    if not table.num_rows:
        return Classifier(marks, odds, np.zeros(len(KNOWN)), np.zeros(len(WORDY)))
    x = np.array(table.column("x").to_pylist())
    y = [(table.column(t).to_numpy() > 0).astype(float) for t in TARGETS]
    return Classifier(marks, odds, fit_logistic(x[:, :len(KNOWN)], y[0]), fit_logistic(x[:, len(KNOWN):], y[1]))


SCORED_DDL = "doc_id bigint, host string, path string, quality_logit double, toxic_logit double"


def _score(model: Classifier):
    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            logits = model.logits(table)
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ("doc_id", "host", "path")], pa.array(logits[0]), pa.array(logits[1])],
                                             names=["doc_id", "host", "path", "quality_logit", "toxic_logit"])

    return work


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, total: str, rate: float) -> float:
    """Prior weight (in documents) of a beta-binomial by moments: small if groups differ more than chance makes them."""
    spread = groups.agg(F.sum(n).alias("n"), F.sum(F.col(n) * (F.col(total) / F.col(n) - rate) ** 2).alias("ss"),
                        F.sum(F.col(n) * F.col(n)).alias("n2"), F.count(F.lit(1)).alias("k")).first()
    if not spread["n"] or spread["k"] < 2:
        return 100.0
    within = rate * (1 - rate)
    room = spread["n"] - spread["n2"] / spread["n"]
    between = (spread["ss"] - (spread["k"] - 1) * within) / room if room > 0 else 0.0
    return float(min(1e4, max(1.0, within / between - 1))) if between > 0 else 1e4


def site_rates(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, rates of each target shrunk level by level; global rates)."""
    sums = [F.sum(_logistic(F.col(f"{t}_logit"))).alias(t) for t in TARGETS]
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums))
    hosts = cut_lineage(paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(t).alias(f"h_{t}") for t in TARGETS]))
    whole = hosts.agg(F.sum("hn"), *[F.sum(f"h_{t}") for t in TARGETS]).first()
    rates = {t: (whole[i + 1] / whole[0] if whole[0] else 0.5) for i, t in enumerate(TARGETS)}
    upper, lower = hosts.select(F.col("host").alias("_host"), "hn"), paths
    for t in TARGETS:
        rate = rates[t]
        upper = upper.join(hosts.select(F.col("host").alias(f"_h_{t}"), F.col(f"h_{t}")), F.col("_host").eqNullSafe(F.col(f"_h_{t}"))).drop(f"_h_{t}")
        strong = _strength(hosts, "hn", f"h_{t}", rate)
        upper = upper.withColumn(f"host_{t}", (F.col(f"h_{t}") + strong * rate) / (F.col("hn") + strong)).drop(f"h_{t}")
    both = lower.join(upper.drop("hn"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    for t in TARGETS:
        strong = _strength(paths, "n", t, rates[t])
        both = both.withColumn(f"path_{t}", (F.col(t) + strong * F.col(f"host_{t}")) / (F.col("n") + strong))
    names = [f"{level}_{t}" for t in TARGETS for level in ("host", "path")]
    return both.select("host", "path", *names), rates


def quality_filter(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str | Column = "source", path: str | Column = "lang",
                   rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text evidence, host and path rates, combined probabilities of each target, kept.

    ``host`` and ``path`` are columns; a path is only told apart within its host. A document is kept if it is
    more likely good than not and not more likely toxic than not.
    """
    prepare(docs.sparkSession)
    columns = {"doc_id": id, "text": text, "host": host, "path": path}
    named = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("bigint" if n == "doc_id" else "string").alias(n) for n, c in columns.items()]
    own = docs.select(*named)
    model = fit(own.select("doc_id", "text"), rows_of(labels, doc_id="doc_id", quality="quality", toxic="toxic"), rows)
    scored = cut_lineage(own.mapInArrow(_score(model), SCORED_DDL))
    sites, rates = site_rates(scored)
    # One key for both levels, where null is a value of its own.
    key = F.to_json(F.struct("host", "path"))
    known = cut_lineage(sites.withColumn("site", key).drop("host", "path"))
    out = attach(scored.withColumn("site", key), known, "site")
    for t in TARGETS:
        shift = _log_odds(F.col(f"path_{t}")) - _log_odds(F.lit(rates[t]))
        shift = F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), shift))
        out = out.withColumn(f"p_{t}", _logistic(F.col(f"{t}_logit") + shift))
    unknown = {t: not np.any(getattr(model, t)) for t in TARGETS}
    good = F.lit(True) if unknown["quality"] else F.col("p_quality") >= 0.5
    bad = F.lit(False) if unknown["toxic"] else F.col("p_toxic") > 0.5
    return out.select("doc_id", "host", "path", "quality_logit", "toxic_logit", *[f"{level}_{t}" for t in TARGETS for level in ("host", "path")], *[f"p_{t}" for t in TARGETS],
                      (good & ~bad).alias("kept"))
