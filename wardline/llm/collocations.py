"""Phrases whose words occur together far more often than apart, counted by multikey quicksort of suffixes.

Every word of a text starts a suffix: itself and up to ``longest - 1`` words after it in the same piece. A task sorts the
suffixes of a block of texts and sends equal ones once, with their number. Suffixes are routed by (language, first word) to
groups of a bounded size; a prefix that holds more than a group's share of all suffixes is routed by one more word, as
often as needed, so neither a frequent word nor a frequent passage meets in one task. Which prefixes these are is known to
all tasks before anything is sent: each block names those that hold half a group's share of it, and a prefix that is over
the share everywhere must be among them.

A group then partitions pointers to its suffixes by their first word into less, equal and greater, equal ones on by the next
word, down to the maximum depth. The weight of an equal partition is the count of the phrase of its words. A partition
lighter than the least count is abandoned at once: nothing in it can reach that count, as nothing outside the group has its
leading words. Only prefixes routed deeper occur in several groups; their parts are added up.

Words are compared by 64-bit hashes. A null language is ``und``; a null or empty text has no words; rows without an id and
repeated rows count like any others. An empty table gives an empty one, other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import cut_lineage, pieces, prepare, rows_of, shuffle_partitions, text_volume

BLOCK_BYTES = 4 << 20
GROUP_BYTES = 3 << 20
GATHER_BYTES = 1 << 20
SPREAD = 32
SPLIT = np.zeros(256, bool)
SPLIT[[ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)]] = True
GAP = SPLIT.copy()
GAP[[0x20, 0x09]] = True
END = np.uint64(0)  # in place of a word after the last of a piece

HEAVY_DDL = "prefix bigint, n bigint"
HEAVY = pa.schema([("prefix", pa.int64()), ("n", pa.int64())])
SENT_DDL = "bucket int, lang string, phrases binary, weights binary, routed binary"
SENT = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("weights", pa.binary()), ("routed", pa.binary())])
COUNT_DDL = "lang string, phrase string, words int, n bigint"
COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def multikey(keys: np.ndarray, weight: np.ndarray, start: np.ndarray, depth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a pointer, length, weight) of every prefix of at least weight ``least``.

    ``keys``: a row of numbers for each suffix, ``END`` after its last. Suffixes stand in segments that begin at ``start`` and
    agree in their first ``depth`` numbers. All open partitions are cut three ways at once, each round by a pivot of its own.
    """
    width = keys.shape[1]
    pointer = np.arange(len(keys))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        size = np.diff(np.append(start, len(pointer)))
        heavy = np.add.reduceat(weight[pointer], start) >= least
        if not heavy.all():  # abandon the others
            pointer = pointer[np.repeat(heavy, size)]
            size, depth = size[heavy], depth[heavy]
            start = np.cumsum(size) - size
            if not len(start):
                break
        of = np.repeat(np.arange(len(start)), size)
        key = keys[pointer, depth[of]]
        ends = key[start], key[start + size // 2], key[start + size - 1]
        pivot = np.maximum(np.minimum(ends[0], ends[1]), np.minimum(np.maximum(ends[0], ends[1]), ends[2]))[of]
        part = of * 3 + (key > pivot) + (key >= pivot)
        count = np.bincount(part, minlength=3 * len(start))
        first = np.cumsum(count) - count
        place = np.empty(len(pointer), np.int64)
        for side in range(3):
            at = np.flatnonzero(part - of * 3 == side)
            there = part[at]
            place[at] = first[there] + np.arange(len(at)) - np.searchsorted(there, there)
        moved = np.empty_like(pointer)
        moved[place] = pointer
        pointer = moved
        depth = np.repeat(depth, 3)
        filled = count > 0
        equal = np.flatnonzero(filled & (np.arange(len(count)) % 3 == 1))
        total = np.zeros(len(count), np.int64)
        total[filled] = np.add.reduceat(weight[pointer], first[filled])
        word = keys[pointer[first[equal]], depth[equal]] != END
        named = equal[word & (total[equal] >= least)]
        out.append((pointer[first[named]], depth[named] + 1, total[named]))
        depth[equal] += 1
        open_ = filled & (depth < width)
        open_[equal[~word]] = False
        keep = np.repeat(open_[filled], count[filled])
        pointer, depth, size = pointer[keep], depth[open_], count[open_]
        start = np.cumsum(size) - size
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Suffixes:
    """Suffixes of all words of a block, as hashes of their first 1, 2, .. words."""

    def __init__(self, table: pa.Table, longest: int):
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.words = words = W.Words(table.column("text"), GAP, lower=True)
        n = len(words)
        self.longest = longest
        self.of_lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.counts)
        splits = np.concatenate(([0], np.cumsum(SPLIT[words.data])))
        new = np.ones(n + 1, bool)
        if n:
            new[1:-1] = splits[words.start[1:]] != splits[words.stop[:-1]]
            new[words.first] = True
        # words from here to the end of the piece, no more than the longest
        borders = np.flatnonzero(new)
        self.reach = np.minimum(borders[np.searchsorted(borders, np.arange(n), "right")] - np.arange(n), longest) if n else np.zeros(0, np.int64)
        named = [W.text_bytes(pa.array([lang]))[0] for lang in self.langs]
        seed = np.array([W.range_hashes(b, np.array([0]), np.array([len(b)]))[0] if len(b) else 0 for b in named], np.uint64)
        own = words.hashes()
        self.prefix = [W.mix(own + W.mix(seed, 9)[self.of_lang], 7)] if n else [own]  # a language's number is not that of the word
        for k in range(1, longest):
            longer = np.flatnonzero(self.reach > k)
            hashes = W.mix(self.prefix[-1], 8)  # an ended suffix goes on as such
            hashes[longer] = W.mix(self.prefix[-1][longer] * np.uint64(0x9E3779B97F4A7C15) + own[longer + k], k)
            self.prefix.append(hashes)


def _heavy(longest: int, share: float):
    """Prefixes that hold more than ``share`` of a block; without a prefix, all its words."""
    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            own = Suffixes(table, longest)
            within = np.arange(len(own.reach))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(within)], pa.int64())], schema=HEAVY)
            for k in range(longest - 1):
                within = within[own.reach[within] > k]
                kinds, which, count = np.unique(own.prefix[k][within], return_inverse=True, return_counts=True)
                many = count > share * len(own.reach)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[many].view(np.int64)), pa.array(count[many], pa.int64())], schema=HEAVY)
                within = within[many[which.ravel()]] if len(within) else within
                if not len(within):
                    break

    return work


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _route(longest: int, buckets: int, heavy: np.ndarray):
    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            own = Suffixes(table, longest)
            words, n = own.words, len(own.reach)
            if not n:
                continue
            # words as one text with a space after each
            size = words.stop - words.start
            at = np.concatenate(([0], np.cumsum(size + 1)))
            text = np.full(int(at[-1]), 0x20, np.uint8)
            inner = np.ones(len(text), bool)
            inner[at[1:] - 1] = False
            text[inner] = words.data[~GAP[words.data]]
            order = np.argsort(own.prefix[-1])
            begin = W.runs(own.prefix[-1][order])
            weight = np.diff(np.append(begin, n))
            some = order[begin]
            route, routed = own.prefix[0][some].copy(), np.ones(len(some), np.int8)
            deeper = np.arange(len(some))
            for k in range(longest - 1):
                deeper = deeper[_member(own.prefix[k][some[deeper]], heavy)]
                if not len(deeper):
                    break
                route[deeper] = own.prefix[k + 1][some[deeper]]
                routed[deeper] = k + 2
            bucket = (route >> np.uint64(20)) % np.uint64(buckets)
            by = np.lexsort((bucket, own.of_lang[some]))
            some, weight, routed, bucket = some[by], weight[by], routed[by], bucket[by].astype(np.int32)
            lang = own.of_lang[some]
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(lang) != 0))))
            length = at[some + own.reach[some]] - at[some]
            ends = np.cumsum(length)
            packed = np.empty(int(ends[-1]), np.uint8)
            low = 0
            while low < len(some):
                to = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GATHER_BYTES, "right")))
                a, b = (ends[low - 1] if low else 0), ends[to - 1]
                packed[a:b] = text[W.ragged(at[some[low:to]], length[low:to])]
                low = to
            packed[ends - 1] = 0x0A  # a suffix ends with a line end, which no word holds
            edges = np.append(cut, len(some))
            byte_edges = np.concatenate(([0], ends))[edges]
            counts = weight.astype(np.int32)
            for a in range(0, len(cut), 4096):
                z = min(a + 4096, len(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cut[a:z]]), pa.array([own.langs[i] for i in lang[cut[a:z]].tolist()], pa.string()),
                    _binaries(packed, byte_edges[a:z + 1]), _binaries(counts.view(np.uint8), 4 * edges[a:z + 1]), _binaries(routed.view(np.uint8), edges[a:z + 1])], schema=SENT)

    return work


def _binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    offsets = (edges - edges[0]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[edges[0]:edges[-1]].tobytes())])


def _count(longest: int, least: int):
    def work(table: pa.Table) -> pa.Table:
        """Counts of one group's phrases; parts of the counts of prefixes routed deeper; a row without phrase for all words."""
        rows = []
        langs = table.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            own = table.filter(pa.array([x == lang for x in langs])) if len(set(langs)) > 1 else table
            raw = b"".join(own.column("phrases").to_pylist())
            weight = np.frombuffer(b"".join(own.column("weights").to_pylist()), np.int32).astype(np.int64)
            routed = np.frombuffer(b"".join(own.column("routed").to_pylist()), np.int8).astype(np.int64)
            data = np.frombuffer(raw, np.uint8)
            stop = np.flatnonzero((data == 0x20) | (data == 0x0A))
            start = np.concatenate(([0], stop[:-1] + 1))
            hashes = np.maximum(W.range_hashes(data, start, stop), 1)
            last = data[stop] == 0x0A
            of = np.concatenate(([0], np.cumsum(last)[:-1]))
            lead = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
            keys = np.full((len(weight), longest), END, np.uint64)
            keys[of, np.arange(len(stop)) - lead[of]] = hashes
            # segments: suffixes that agree in the words before the one they were routed by
            shared = np.zeros(len(weight), np.uint64)
            for k in range(1, longest):
                deep = np.flatnonzero(routed > k)
                shared[deep] = W.mix(shared[deep] * np.uint64(0x9E3779B97F4A7C15) + keys[deep, k - 1], k)
                part, which = np.unique(shared[deep], return_inverse=True)
                if len(part):
                    sums = np.bincount(which.ravel(), weights=weight[deep]).astype(np.int64)
                    sample = np.empty(len(part), np.int64)
                    sample[which.ravel()] = deep
                    rows.append((lang, sample, np.full(len(part), k), sums, raw, start, stop, lead))
            order = np.lexsort((shared, routed))
            border = np.concatenate(([True], (np.diff(routed[order]) != 0) | (np.diff(shared[order].view(np.int64)) != 0)))
            begin = np.flatnonzero(border)
            pointer, words, total = multikey(keys[order], weight[order], begin, routed[order][begin] - 1, least)
            rows.append((lang, order[pointer], words, total, raw, start, stop, lead))
            rows.append((lang, None, np.zeros(1, np.int64), np.array([weight.sum()]), raw, start, stop, lead))
        out = {name: [] for name in COUNT.names}
        for lang, pointer, words, total, raw, start, stop, lead in rows:
            out["lang"] += [lang] * len(words)
            out["words"] += words.tolist()
            out["n"] += total.tolist()
            if pointer is None:
                out["phrase"].append("")
            else:
                first = lead[pointer]
                out["phrase"] += [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), stop[first + words - 1].tolist(), strict=True)]
        return pa.Table.from_pydict(out, COUNT)

    return work


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """lang, phrase, words, n: all phrases of up to ``longest`` words that occur ``least`` times in a language, and a row with
    an empty phrase for the number of all words. A written table."""
    spark = prepare(docs.sparkSession)
    rows = rows_of(docs, text=text, lang=lang).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    buckets = pieces(text_volume(rows)[1], group_bytes)
    heavy = np.zeros(0, np.uint64)
    if buckets > 1:
        # Of the words of a prefix over the share 1 / buckets of everything, more than half lie in blocks that hold more than
        # half the share of it. So what blocks name finds them all, and fewer than 2 * buckets of each length pass.
        named = cut_lineage(rows.mapInArrow(_heavy(longest, 0.5 / buckets), HEAVY_DDL).groupBy("prefix").agg(F.sum("n").alias("n")))
        words = named.where("prefix IS NULL").first()
        many = named.where(F.col("prefix").isNotNull() & (F.col("n") * 2 * buckets > (words.n if words else 0)))
        heavy = np.sort(many.select("prefix").toArrow().column("prefix").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(heavy)
    sent = rows.mapInArrow(_routed_by(longest, buckets, shared), SENT_DDL)
    sent = sent.repartition(max(pieces(buckets, 8), shuffle_partitions(spark)), "bucket")
    counted = sent.groupBy("bucket").applyInArrow(_count(longest, least), COUNT_DDL)
    return cut_lineage(counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(f"n >= {least} OR words = 0"))


def _routed_by(longest: int, buckets: int, shared):
    return lambda batches: _route(longest, buckets, shared.value)(batches)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, inside: int = 80, top: int = 2000,
                 group_bytes: int = GROUP_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    a, l, r: occurrences of the phrase, of its part before a cut and of the rest; score: 2000000 a / (l + r), rounded down, for
    the cut where it is lowest (ties: the first). n: all words of the language. A phrase inside a longer one goes if that
    occurs at least ``inside`` per cent as often. Ties in score: more frequent ones first, then by bytes.
    """
    counts = phrase_counts(docs, text, lang, longest, least, group_bytes)
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda low, size: F.array_join(F.slice("w", low, size), " ")
    cut = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    parts = counts.where(f"words BETWEEN 1 AND {longest - 1}")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    # decimals: the product may pass 64 bits
    score = F.expr("cast((cast(a as decimal(20, 0)) * cast(2000000 as decimal(10, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("words") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))))
    held = phrases.where("words >= 3").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR cast(longer as decimal(20, 0)) * 100 < cast(best.a as decimal(20, 0)) * {inside}")
    totals = counts.where("words = 0").select("lang", "n")
    flat = left.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    # the first of each of many parts of a language, then of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = near.where(f"place <= {top}").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(f"rank <= {top}")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
