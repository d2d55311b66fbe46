"""Collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from wardline.llm import collocations as C

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id bigint, text string, lang string, phrase string, n int, words string, bucket int, rank bigint"


def counted(rows, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def plain(rows, least=30, inside=80, top=2000, longest=4):
    f, n = counted(rows, longest)
    candidates = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longer[lang, w[i:i + size]] = max(longer[lang, w[i:i + size]], a)
    out = {}
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= inside * a and longer[lang, w]:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def corpus():
    rng = np.random.default_rng(4)
    vocab = ["the", "of", "New", "YORK", "é", "Ünï", "日本", "　", "a-b", "x\x00y"] + [f"w{i}" for i in range(25)]
    weight = np.array([9, 7, 5, 5] + [1] * (len(vocab) - 4), float)
    some = lambda n: " ".join(rng.choice(vocab, n, p=weight / weight.sum()))
    texts = [(f"{some(int(rng.integers(0, 60)))}{rng.choice(list('.,;:!? ') + [chr(9), chr(10), chr(11), chr(13)])}{some(20)} in the beginning was the word", lang)
             for lang in ("en", "de", None, "und", "") for _ in range(50)]
    texts += [("again and again " * 400, "en"), ("x " * 3000, "fr"), (None, "en"), ("", None), (" .,; ", "zz"), ("one two", "rare"), ("en. " * 40, "de"), ("de. " * 50, "en"), ("und " * 60, None), (some(20_000), "long")]
    return texts + texts[:20]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i % 9 else None, t, l, "x", 1, "y", 2, 3) for i, (t, l) in enumerate(corpus())], DDL).repartition(5)


@pytest.mark.parametrize("group_bytes", [4 << 20, 20_000, 900])
def test_against_plain_counting(docs, group_bytes):
    got = sorted(map(tuple, C.collocations(docs, group_bytes=group_bytes).collect()))
    assert got == plain(corpus())


def test_counts_with_small_blocks(monkeypatch):
    """The functions of the tasks, on blocks of a few texts, and with prefixes of every length routed deeper."""
    import pyarrow as pa

    monkeypatch.setattr(C, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(C, "GATHER_BYTES", 100)
    rows = [(t, "und" if l is None else l) for t, l in corpus()]
    batches = pa.table({"lang": [l for _, l in rows], "text": pa.array([t for t, _ in rows], pa.string())}).to_batches(7)
    named = pa.Table.from_batches(list(C._heavy(4, 0.01)(iter(batches))))
    heavy = np.unique(named.column("prefix").drop_null().to_numpy().view(np.uint64))
    sent = pa.Table.from_batches(list(C._route(4, 13, heavy)(iter(batches))))
    assert {1, 2, 3, 4} == {x for b in sent.column("routed").to_pylist() for x in b}
    total = Counter()
    for b in range(13):
        part = sent.filter(pa.array([x == b for x in sent.column("bucket").to_pylist()]))
        for r in C._count(4, 30)(part).to_pylist():
            total[r["lang"], r["phrase"], r["words"]] += r["n"]
    f, n = counted(corpus())
    want = {(lang, " ".join(w), len(w)): a for (lang, w), a in f.items() if a >= 30} | {(lang, "", 0): a for lang, a in n.items() if a}
    assert {k: a for k, a in total.items() if a >= 30 or not k[2]} == want


def test_hot_prefixes_are_spread():
    """A word that starts half of all suffixes meets in no one group, whatever follows it."""
    rng = np.random.default_rng(8)
    texts = [(" ".join(f"hot v{rng.integers(3000)}" for _ in range(300)), "en") for _ in range(100)]
    import pyarrow as pa
    batches = pa.table({"lang": [l for _, l in texts], "text": [t for t, _ in texts]}).to_batches(10)
    named = pa.Table.from_batches(list(C._heavy(4, 0.5 / 40)(iter(batches))))
    heavy = np.unique(named.column("prefix").drop_null().to_numpy().view(np.uint64))
    sent = pa.Table.from_batches(list(C._route(4, 40, heavy)(iter(batches))))
    size = Counter()
    for b, w in zip(sent.column("bucket").to_pylist(), sent.column("weights").to_pylist()):
        size[b] += len(w) // 4
    assert len(heavy) < 80 and max(size.values()) < 3 * sum(size.values()) / 40


def test_multikey_against_counting():
    rng = np.random.default_rng(6)
    for _ in range(300):
        keys = rng.integers(0, 4, (int(rng.integers(1, 60)), 4)).astype(np.uint64)
        keys[np.cumsum(keys == 0, axis=1) > 0] = 0
        keys = keys[keys[:, 0] > 0]
        if not len(keys):
            continue
        weight = rng.integers(1, 5, len(keys))
        least = int(rng.integers(1, 12))
        pointer, words, total = C.multikey(keys, weight, np.array([0]), np.array([0]), least)
        want = Counter()
        for row, x in zip(keys.tolist(), weight.tolist()):
            for k in range(1, 5):
                if row[k - 1]:
                    want[tuple(row[:k])] += x
        assert {tuple(keys[p, :k].tolist()): int(t) for p, k, t in zip(pointer, words, total)} == {k: v for k, v in want.items() if v >= least}


def test_empty_and_limits(spark, docs):
    assert C.collocations(docs.limit(0)).collect() == []
    assert C.collocations(docs.where("text IS NULL")).collect() == []
    got = sorted(map(tuple, C.collocations(docs, longest=3, least=10, inside=50, top=7).collect()))
    assert got == plain(corpus(), 10, 50, 7, 3)


def test_score_beyond_64_bits(spark, monkeypatch):
    big = 10**13
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, 3 * big), ("en", "", 0, 9 * big)], C.COUNT_DDL)
    monkeypatch.setattr(C, "phrase_counts", lambda *a: counts)
    row = C.collocations(counts).first()
    assert (row.a, row.l, row.r, row.n, row.score) == (big, big + 7, 3 * big, 9 * big, 2000000 * big // (4 * big + 7))
