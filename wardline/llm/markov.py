"""A hidden Markov language model over tokens, trained by Baum-Welch and scored by the exact forward recursion.

Every state emits tokens themselves: P(w | state) = (E[state, w] + A * prior(w | state)) / (E[state] + A), where E are the
expected counts of Baum-Welch, a number for each state and distinct token of the corpus, and A is the number of distinct
training tokens and one (as many added counts as the base score has). The prior passes through the *kind* of a token (its
first and last two bytes; the end of a text is a kind of its own): P(kind | state) * (c + 1) / (N_kind + V_kind + 1), where c
is the token's count in the training texts and the last 1 is for all unknown tokens of the kind. For each state this sums to one.

* Start: states begin from clusters of kind histograms of a bounded sample of training texts (``SAMPLE`` texts, whose
  histograms alone travel). A hash of token and state shifts the first round's emissions, so that states that agree in
  kinds can come to differ in tokens. The first round also estimates the kinds of each state.
* Tokens: homes run forward and backward over all their training texts and send the expected counts of their distinct
  tokens, by state, to buckets, which add them up and answer; the next round emits by these sums. They travel as shares of
  the token's count, in parts of 65,535, and the last state has the rest, so they add up to the count on either side. Nothing that grows with
  the vocabulary is gathered in one place; the driver gets sums of states * (states + 2) numbers a round.
* Rounds end when the likelihood of the training texts settles (``TOLERANCE``), or after ``ROUNDS``.
* Texts are whole: forward values are carried over a long text and kept at intervals, between which the backward pass works
  them out again. Scores are one forward recursion, scaled at each token.

Null texts are empty: their only token is the end. Rows without an id are trained on. Repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import cut_lineage, prepare, rows_of
from wardline.llm.homes import Homes, bucket_of, by_bucket, in_order

KINDS = 512
STATES = 6
SAMPLE = 600
ROUNDS = 3
TOLERANCE = 0.001  # log10 a token
WHOLE = 65_535  # shares of a token's count travel as parts of this
CHUNK_TOKENS = 200_000  # forward values held at a time
END = np.uint64(0x454E44)  # stands for the end of a text among token hashes
FOLDS, HELD_OUT = 7, 2

SENT_DDL = "bucket int, home int, hashes binary, counts binary, kinds binary, expected binary"
SENT = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("kinds", pa.binary()), ("expected", pa.binary())])
TOTAL_DDL = "home int, bucket int, counts binary, expected binary, tokens array<bigint>, types array<bigint>, mass array<double>, sums array<double>"
TOTAL = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("expected", pa.binary()),
                   ("tokens", pa.list_(pa.int64())), ("types", pa.list_(pa.int64())), ("mass", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))])
SCORE_DDL = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
SCORE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _held_out(ids: pa.ChunkedArray) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()], bool)


class Tokens:
    """Tokens of texts: their words, lower-cased in A-Z, and an end after each. ``first`` bounds each text."""

    def __init__(self, texts, hashed: bool = True):
        words = W.Words(texts, lower=True)
        n = len(words.counts)
        self.first = words.first + np.arange(n + 1)
        place = np.arange(len(words)) + np.repeat(np.arange(n), words.counts)
        data = words.data
        last = data[words.stop - 1].astype(np.uint64)
        before = np.where(words.stop - words.start > 1, data[np.maximum(words.stop - 2, 0)], 0).astype(np.uint64)
        start = data[words.start].astype(np.uint64)
        self.kinds = np.full(int(self.first[-1]), KINDS - 1, np.int64)
        self.kinds[place] = (W.mix(last | before << np.uint64(8) | start << np.uint64(16), 11) % np.uint64(KINDS - 1)).astype(np.int64)
        if hashed:
            self.hashes = np.full(int(self.first[-1]), END, np.uint64)
            self.hashes[place] = words.hashes()


class _Types:
    """Distinct tokens of one home: hash, kind, number of occurrences in training texts, and their buckets."""

    def __init__(self, table: pa.Table, buckets: int):
        self.table = in_order(table)
        tokens = Tokens(self.table.column("text"))
        self.first, hashes = tokens.first, tokens.hashes
        order = np.argsort(hashes)
        begin = W.runs(hashes[order])
        self.number = np.empty(len(hashes), np.int32)
        self.number[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(order))))
        self.hashes, self.kinds = hashes[order[begin]], tokens.kinds[order[begin]]
        self.trained = ~_held_out(self.table.column("doc_id"))
        self.counts = np.bincount(self.number[np.repeat(self.trained, np.diff(self.first))], minlength=len(self.hashes))
        self.order, self.bounds = by_bucket(bucket_of(W.mix(self.hashes, 13), buckets), buckets)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in schema.names}, schema)


class Model:
    """start (states), step (states x states) and emit (states x kinds); rows sum to one.

    ``with_tokens`` adds what emission of tokens needs: ``mass``, the expected tokens of each state, ``room``, the
    tokens and types of each kind, and ``weight`` of the prior.
    """

    mass = room = None
    weight = 0.0

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def _rows(counts: np.ndarray, add: float) -> np.ndarray:
        counts = counts + add
        return counts / counts.sum(axis=-1, keepdims=True)

    @staticmethod
    def of_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        return Model(Model._rows(start, 0.1), Model._rows(step, 0.1), Model._rows(emit, 0.01))

    def with_tokens(self, sums: np.ndarray, mass: np.ndarray, tokens_of: np.ndarray, types_of: np.ndarray) -> Model:
        """From the sums of a round (``_message``); those of the first have the kinds of each state."""
        states = len(self.start)
        start, step, kinds = np.split(sums[:-1], np.cumsum([states, states * states]))
        model = Model.of_counts(start, step.reshape(states, states), kinds.reshape(states, KINDS) if len(kinds) else self.emit)
        if not len(kinds):
            model.emit = self.emit
        model.mass, model.room, model.weight = mass, tokens_of + types_of + 1, float(types_of.sum() + 1)
        return model

    @staticmethod
    def of_histograms(seen: np.ndarray, states: int) -> Model:
        """States from clusters of the kind histograms of some texts."""
        share = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
        chosen = [0] if len(seen) else []
        for _ in range(min(states, len(seen)) - 1):
            away = np.min([((share - share[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
            chosen.append(int(np.argmax(away)))
        middle = share[chosen] if chosen else np.zeros((0, KINDS))
        for _ in range(10 if len(seen) else 0):
            nearest = np.argmin(((share[:, None, :] - middle[None]) ** 2).sum(axis=2), axis=1)
            middle = np.array([share[nearest == k].mean(axis=0) if (nearest == k).any() else middle[k] for k in range(len(middle))])
        # Half of every state is the whole sample, so that a state without texts of its own is not left without tokens.
        whole = Model._rows(seen.sum(axis=0), 1.0)
        emit = np.tile(whole, (states, 1))
        for k in range(len(middle)):
            if (nearest == k).any():
                emit[k] = (whole + Model._rows(seen[nearest == k].sum(axis=0), 1.0)) / 2
        emit *= np.random.default_rng(3).uniform(0.9, 1.1, emit.shape)
        step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=1, keepdims=True))

    def told_apart(self, kinds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """What each distinct token's kind is emitted with, shifted by a hash of the token and the state: states that agree in
        their kinds can so come to differ in their tokens."""
        shift = np.column_stack([W.mix(hashes, 31 + s) >> np.uint64(11) for s in range(len(self.start))]) / 2.0 ** 53
        return self.emit.T[kinds] * (0.5 + shift)

    def emitted(self, kinds: np.ndarray, counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """P(token | state), a row for each of the given distinct tokens."""
        prior = self.emit.T[kinds] * ((counts + 1) / self.room[kinds])[:, None]
        return (expected + self.weight * prior) / (self.mass + self.weight)

    def expected(self, emitted: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts over whole sequences ``number[first[i]:first[i+1]]`` of rows of ``emitted``: of starts, steps and
        emissions (states x rows), and the log10 likelihood."""
        states, lengths = len(self.start), np.diff(first)
        start, step, emit, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((states, len(emitted))), 0.0
        emitted = emitted.astype(np.float32)  # counts are added up in doubles, scores are worked out in doubles
        order = np.argsort(-lengths, kind="stable")
        ends, low = np.cumsum(lengths[order]), 0
        while low < len(order):
            room = CHUNK_TOKENS + (int(ends[low - 1]) if low else 0)
            to = max(low + 1, int(np.searchsorted(ends, room, "right")))
            some = order[low:to]
            likelihood += self._add(start, step, emit, emitted, number, first[:-1][some], lengths[some])
            low = to
        return start, step * self.step, emit, likelihood

    def _forward(self, before: np.ndarray | None, seen: np.ndarray, live: list[int], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(scaled forward values, scales) of tokens in order of time; ``live`` sequences at each time, from row ``at``."""
        move = self.step.astype(np.float32)
        values, scales = np.empty_like(seen), np.empty(len(seen), np.float32)
        for a, n in zip(at, live, strict=True):
            now, scale = values[a:a + n], scales[a:a + n]
            if before is None:
                now[:] = self.start
            else:
                np.matmul(before[:n], move, out=now)
            now *= seen[a:a + n]
            np.add.reduce(now, axis=1, out=scale)
            now /= scale[:, None]
            before = now
        return values, scales

    def _add(self, start, step, emit, emitted, number, begin, lengths) -> float:
        """Add the counts of sequences, longest first, whose forward values fit, or of one longer sequence by spans."""
        all_live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right")  # sequences of at least t + 1 tokens
        back = np.ascontiguousarray(self.step.T.astype(np.float32))
        likelihood, entering, made = 0.0, [None], None

        def span(k: int):
            live = all_live[k:k + CHUNK_TOKENS]
            at = np.cumsum(live) - live
            numbers = number[begin[W.ragged(np.zeros(len(live), np.int64), live)] + np.repeat(np.arange(k, k + len(live)), live)]
            seen = emitted[numbers]
            return live, at, numbers, seen, *self._forward(entering[k // CHUNK_TOKENS], seen, live.tolist(), at.tolist())

        starts = range(0, len(all_live), CHUNK_TOKENS)
        for k in starts:
            made = span(k)
            entering.append(made[4][made[1][-1]:].copy())
            likelihood += float(np.log10(made[5]).sum(dtype=np.float64))
        ahead = None
        for k in reversed(starts):
            live, at, numbers, seen, values, scales = made if k == starts[-1] else span(k)
            seen /= scales[:, None]
            betas = np.ones_like(seen)
            for a, n in zip(at[::-1].tolist(), live[::-1].tolist(), strict=True):
                beta = betas[a:a + n]
                if ahead is not None:
                    np.matmul(ahead, back, out=beta[:len(ahead)])
                ahead = seen[a:a + n] * beta
            seen *= betas
            rest = int(live[0])
            step += values[np.arange(rest, len(seen)) - np.repeat(live[:-1], live[1:])].T @ seen[rest:]
            if k:
                step += entering[k // CHUNK_TOKENS][:rest].T @ seen[:rest]
            betas *= values
            for s in range(len(start)):
                emit[s] += np.bincount(numbers, weights=betas[:, s], minlength=len(emitted))
            if not k:
                start += betas[:rest].sum(axis=0, dtype=np.float64)
        return likelihood

    def log10(self, emitted: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 P of each whole sequence of rows of ``emitted``, by the scaled forward recursion."""
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[:-1][order], lengths[order]
        out = np.zeros(len(order))
        if not len(order):
            return out
        live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right")
        alpha, step = None, self.step
        total = np.zeros(len(order))
        for t, n in enumerate(live.tolist()):
            alpha = (self.start if t == 0 else alpha[:n] @ step) * emitted[number[begin[:n] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[order] = total
        return out


def _histograms(batches):
    for batch in batches:
        tokens = Tokens(batch.column("text"), hashed=False)
        seen = np.zeros((batch.num_rows, KINDS), np.int64)
        np.add.at(seen, (np.repeat(np.arange(batch.num_rows), np.diff(tokens.first)), tokens.kinds), 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.list_(pa.int64()))], names=["seen"])


def _settled(before: float | None, now: float, tokens: float, tolerance: float = TOLERANCE) -> bool:
    return before is not None and now - before < tolerance * tokens


def first_model(docs: DataFrame, states: int = STATES) -> Model:
    """States from clusters of the kind histograms of a sample of the training rows of ``docs`` (doc_id, text)."""
    sample = docs.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", "text")).select("text").limit(SAMPLE)
    seen = sample.mapInArrow(_histograms, "seen array<bigint>").toArrow().column("seen").to_pylist()
    return Model.of_histograms(np.array(seen, float).reshape(len(seen), KINDS), states)


class _Answers:
    """Corpus counts and expected counts of a home's distinct tokens, read off the buckets' answers by position."""

    def __init__(self, types: _Types, answers: pa.Table, states: int):
        self.counts, shares = np.zeros(len(types.hashes), np.int64), np.zeros((len(types.hashes), states - 1), np.uint16)
        for bucket, counts, expected in zip(*(answers.column(c).to_pylist() for c in ("bucket", "counts", "expected")), strict=True):
            at = types.order[types.bounds[bucket]:types.bounds[bucket + 1]]
            if counts is not None:
                self.counts[at] = np.frombuffer(counts, np.int64)
            if expected is not None:
                shares[at] = np.frombuffer(expected, np.uint16).reshape(len(at), states - 1)
        self.expected = _expected_counts(shares, self.counts)


def _shares(expected: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of all states but the last in a token's count, which the expected counts of its states add up to, in parts of ``WHOLE``."""
    shares = np.floor(expected[:, :-1] * (WHOLE / np.maximum(counts, 1))[:, None])
    return np.clip(shares, 0, WHOLE).astype(np.uint16)


def _expected_counts(shares: np.ndarray, counts: np.ndarray) -> np.ndarray:
    last = np.maximum(WHOLE - shares.sum(axis=1, dtype=np.int64), 0)
    return np.column_stack([shares, last]) * (counts / WHOLE)[:, None]


def _message(types: _Types, home: int, model: Model, emitted: np.ndarray, buckets: int, counted: bool) -> pa.Table:
    """Expected counts of a home's distinct tokens by bucket, and their kinds if ``counted`` (the first round). The
    sums of starts, steps, kinds of each state (in the first round) and the likelihood go to a bucket below zero."""
    number = types.number[np.repeat(types.trained, np.diff(types.first))]
    first = np.concatenate(([0], np.cumsum(np.diff(types.first)[types.trained])))
    start, step, emit, likelihood = model.expected(emitted, number, first)
    kinds = [np.bincount(types.kinds, weights=e, minlength=KINDS) for e in emit] if counted else []
    sums = np.concatenate([start, step.ravel(), *kinds, [likelihood]])
    rows = [(-1 - home % buckets, home, None, None, None, sums.tobytes())]
    shares = _shares(emit.T, types.counts)
    for b in np.flatnonzero(np.diff(types.bounds)).tolist():
        at = types.order[types.bounds[b]:types.bounds[b + 1]]
        kinds = types.kinds[at].astype(np.int16).tobytes() if counted else None
        rows.append((b, home, types.hashes[at].tobytes(), types.counts[at].astype(np.int32).tobytes(), kinds, shares[at].tobytes()))
    W.give_back()
    return _table(rows, SENT)


def _first(model: Model, buckets: int):
    """Expected counts under the first model, which knows kinds."""

    def work(table: pa.Table) -> pa.Table:
        types = _Types(table, buckets)
        return _message(types, table.column("home")[0].as_py(), model, model.told_apart(types.kinds, types.hashes), buckets, True)

    return work


def _again(model: Model, buckets: int):
    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SENT.empty_table()
        types = _Types(table, buckets)
        known = _Answers(types, answers, len(model.start))
        return _message(types, table.column("home")[0].as_py(), model, model.emitted(types.kinds, known.counts, known.expected), buckets, False)

    return work


def _totals(table: pa.Table) -> pa.Table:
    """For one bucket: the corpus' expected counts of each entry, its count, and tokens and types of each kind (in the first row).

    Homes are added up in their order, so that a task run again has the same sums."""
    table = table.sort_by("home")
    bucket, raw = table.column("bucket")[0].as_py(), table.column("expected").to_pylist()
    if bucket < 0:
        return _table([(-1, bucket, None, None, None, None, None, np.sum([np.frombuffer(x) for x in raw], axis=0).tolist())], TOTAL)
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    sizes = [len(x) for x in hashes]
    ends, hashes = np.cumsum(sizes), np.concatenate(hashes)
    order = np.argsort(hashes, kind="stable")
    begin = W.runs(hashes[order])
    back = np.empty(len(hashes), np.int32)
    back[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(order))))
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
    total = np.add.reduceat(counts[order], begin, dtype=np.int64)
    shares = np.concatenate([np.frombuffer(x, np.uint16) for x in raw]).reshape(len(hashes), len(raw[0]) // (2 * sizes[0]))
    expected = _expected_counts(shares, counts)
    expected = np.column_stack([np.bincount(back, weights=expected[:, s], minlength=len(begin)) for s in range(expected.shape[1])])
    each = _shares(expected, total)
    mass, all_counts, of_kinds = _expected_counts(each, total).sum(axis=0).tolist(), None, (None, None)
    if table.column("kinds")[0].is_valid:
        of = np.concatenate([np.frombuffer(x, np.int16) for x in table.column("kinds").to_pylist()])[order[begin]].astype(np.int64)
        tokens = np.zeros(KINDS, np.int64)
        np.add.at(tokens, of, total)
        all_counts, of_kinds = total, (tokens.tolist(), np.bincount(of[total > 0], minlength=KINDS).tolist())
    rows = [(h, bucket, None if all_counts is None else all_counts[back[e - n:e]].tobytes(), each[back[e - n:e]].tobytes(), None, None, None, None)
            for h, n, e in zip(table.column("home").to_pylist(), sizes, ends.tolist(), strict=True)]
    W.give_back()
    return _table([(-1, bucket, None, None, *of_kinds, mass, None), *rows], TOTAL)


def _score(model: Model, buckets: int):
    base_room = np.log10(model.room.sum() - KINDS + 1)

    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SCORE.empty_table()
        types = _Types(table, buckets)
        facts = _Answers(types, answers, len(model.start))
        first = types.first
        known, begin, n = facts.counts[types.number], first[:-1], np.diff(first)
        base = np.add.reduceat(np.log10(known + 1), begin) - n * base_room
        score = model.log10(model.emitted(types.kinds, facts.counts, facts.expected), types.number, first)
        return pa.table([types.table.column("doc_id"), pa.array(n), pa.array(np.add.reduceat((known > 0).astype(np.int64), begin)), pa.array(base), pa.array(score)], schema=SCORE)

    return work


def _summed(totals: DataFrame, column: str) -> np.ndarray:
    """Element sums of an array column over the buckets."""
    rows = totals.where(f"home = -1 and {column} is not null").select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i")
    return rows.toArrow().column("x").to_numpy()


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (log10 P under the model)."""
    prepare(docs.sparkSession)
    rows = rows_of(docs, doc_id=id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = first_model(rows, states)
    homes = Homes(docs, id, text)
    buckets = homes.buckets

    def add_up(sent: DataFrame) -> DataFrame:
        return cut_lineage(sent.groupBy("bucket").applyInArrow(_totals, TOTAL_DDL))

    totals = add_up(homes.send(_first(model, buckets), SENT_DDL))
    tokens, types = _summed(totals, "tokens"), _summed(totals, "types")
    tokens, types = (x if len(x) else np.zeros(KINDS, np.int64) for x in (tokens, types))
    counts = totals.where("home >= 0").select("home", "bucket", "counts", F.lit(None).cast("binary").alias("expected"))
    answers, before = totals.where("home >= 0").select("home", "bucket", "counts", "expected"), None
    for number in range(1, rounds + 1):
        sums = _summed(totals, "sums")
        sums = sums if len(sums) else np.zeros(states * (states + 1) + 1)
        mass = _summed(totals, "mass")
        model = model.with_tokens(sums, mass if len(mass) else np.zeros(states), tokens, types)
        # The likelihood of the first round is one of kinds, not of tokens.
        if number == rounds or number > 1 and _settled(before, sums[-1], tokens.sum(), tolerance):
            break
        before = sums[-1] if number > 1 else None
        totals = add_up(homes.receive(answers, _again(model, buckets), SENT_DDL))
        expected = totals.where("home >= 0").select("home", "bucket", F.lit(None).cast("binary").alias("counts"), "expected")
        answers = counts.unionByName(expected)
    scored = homes.receive(answers, _score(model, buckets), SCORE_DDL)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens.sum())).cast("bigint").alias("train_tokens"), "base_score", "score")
