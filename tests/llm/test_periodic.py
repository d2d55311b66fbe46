"""Periodic runs against a plain search."""

import hashlib
import re
import zlib

import numpy as np

from wardline.llm import periodic


def plain(w, exponent=4, shortest=6):
    """(start, stop, period) of every run, by trying all periods."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(shortest, exponent * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_finder_against_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(600):
        docs = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 70))
            docs.append(np.resize(rng.integers(0, 4, int(rng.integers(1, 9))), n) if rng.random() < 0.4 else rng.integers(0, int(rng.integers(1, 4)), n))
            if n > 30 and rng.random() < 0.5:
                docs[-1][rng.integers(0, n)] = 9
        for exponent, shortest in ((4, 6), (2, 2), (3, 8)):
            doc, start, stop, period = periodic.Finder(np.concatenate(docs), np.cumsum([0, *map(len, docs)]), exponent, shortest).runs()
            got = [[(int(s), int(e), int(q)) for d, s, e, q in zip(doc, start, stop, period) if d == i] for i in range(len(docs))]
            assert [sorted(g) for g in got] == [plain(d.tolist(), exponent, shortest) for d in docs]
            assert all(g == sorted(g, key=lambda r: (r[0], r[2])) for g in got)


def test_grammar_extensions():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 120))
        w = np.append(np.resize(rng.integers(0, 3, int(rng.integers(1, 20))), n), 77)
        grammar = periodic.Grammar(w)
        one, two = rng.integers(0, n, 50), rng.integers(0, n, 50)
        one, two = one[one != two], two[one != two]
        want = [next(k for k in range(n + 1) if w[a + k] != w[b + k]) for a, b in zip(one.tolist(), two.tolist())]
        assert grammar.extend(one, two).tolist() == want


def test_long_texts_stay_quick():
    import time
    begin = time.time()
    for w in (np.zeros(300_000, int), np.tile([0, 1, 0, 2, 2], 60_000), np.random.default_rng(3).integers(0, 3, 100_000)):
        periodic.Finder(w, np.array([0, len(w)])).runs()
    assert time.time() - begin < 30


TEXTS = [None, "", " \n ", "a", "a " * 5, "a " * 6, "x y " * 4, "x y " * 3 + "x", "start " + "the cat sat " * 5 + "the cat end", "a b a b a b a b c a b a b a b a b a",
         "A a " * 9, "é　ü " * 8, "z\tz\nz\x0bz\x0cz\rz", "a a a a a a a b " * 6, "w " * 120_000]


def expected(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain(w) if len(w) < 5000 else [(0, len(w), 1)]
    top = min(((s - e, s, q) for s, e, q in runs), default=None)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def test_table_with_every_odd_case(spark):
    rows = [(i if i % 4 else None, t, 3, "x") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int, n_words string").repartition(3)
    got = sorted(tuple(r)[:1] + tuple(r)[1:] for r in periodic.digest(periodic.collapse_runs(docs)).collect() if r[0] is not None)
    assert got == sorted((i, *expected(t)) for i, t, _, _ in rows if i is not None)
    assert periodic.collapse_runs(docs).where("doc_id IS NULL").count() == sum(r[0] is None for r in rows)
    assert periodic.digest(periodic.collapse_runs(docs.limit(0))).collect() == []


def test_query_with_planted_runs(spark):
    from wardline.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    want = {}
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want[d.doc_id] = expected(" ".join(w))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 5


def test_digest_of_ties(spark):
    runs = [{"start": 4, "length": 8, "period": 2}, {"start": 4, "length": 8, "period": 1}, {"start": 9, "length": 8, "period": 1}]
    row = spark.createDataFrame([(1, 99, runs, "")], periodic.FOUND_DDL)
    assert tuple(periodic.digest(row).first())[1:6] == (3, 4, 8, 1, 8000)
