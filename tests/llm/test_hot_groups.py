"""One template, one id or one very long text holds most of the rows: results stay whole, groups stay bounded."""

import base64
import hashlib
import itertools
import uuid
from collections import Counter

import numpy as np


def test_pages_of_one_template_are_held_in_bounded_chunks(spark, monkeypatch, tmp_path):
    from wardline.llm import jaccard_join as J

    rng = np.random.default_rng(5)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for k in range(90):  # each shares the template, and its own end keeps it apart
        texts.append(" ".join(template + [f"own{k}_{i}" for i in range(30)]))
    for k in range(0, 90, 3):  # near copies of some of them
        own = texts[k].split()
        own[int(rng.integers(155, 175))] = f"changed{k}"
        texts.append(" ".join(own))
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    part = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            part = [part[i] if p == part[j] else p for p in part]
    assert 80 < len(set(part)) < len(texts)

    across, most, folder = J._across, 12, tmp_path
    monkeypatch.setattr(J, "CHUNK", most)

    def watched(num, den):
        work = across(num, den)

        def bounded(table):
            # chunks are dealt by hash, so they differ in size
            (folder / uuid.uuid4().hex).write_text(str(max(sum(table.column(side).to_pylist()) for side in ("probe", "target"))))
            return work(table)

        return bounded

    monkeypatch.setattr(J, "_across", watched)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_join(rows).collect()}
    first = {p: part.index(p) for p in set(part)}
    assert got == {k: first[p] for k, p in enumerate(part)}
    sizes = [int(f.read_text()) for f in folder.iterdir()]
    assert len(sizes) > 9 and max(sizes) <= 3 * most


def test_lines_of_a_very_long_text(spark):
    from wardline.llm.line_dedup import line_dedup

    lines = [f"menu {i // 2}" if i % 2 else f"own {i}" for i in range(60_000)]
    menu = "\n".join(x for x in lines if x.startswith("menu"))
    rows = [(1, "\n".join(lines), "a", "x"), (2, menu, "b", "y"), (3, menu + "\nlast", "c", "z"), (3, "\n".join(["menu 1", "", "menu 2"]), "c", None)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string, gone string"), min_sites=3).collect()
    want = [(1, 60_000, 30_000, "\n".join(x for x in lines if x.startswith("own"))), (2, 30_000, 30_000, ""), (3, 30_001, 30_000, "last"), (3, 3, 2, "")]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_tables_of_few_lines_are_few_files(spark, tmp_path, monkeypatch):
    from wardline import session
    from wardline.llm.line_dedup import line_dedup

    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "\n".join([f"own {i}", *[f"menu {k}" for k in range(200)]]), f"site {i}") for i in range(10)]
        got = line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_sites=8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in got) == [(i, 201, 200, f"own {i}") for i in range(10)]
    assert 0 < len(list(tmp_path.rglob("part-*.parquet"))) <= 2 * 3


def test_memory_of_a_task_follows_its_shard():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from wardline.llm import decontaminate as D

    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(30_000)])
    texts = [" ".join(vocabulary[rng.integers(0, len(vocabulary), 2000)]) for _ in range(800)]
    items = pa.table({"item_id": pa.array([7, 8, 9]), "text": [" ".join(texts[3].split()[50:70]), " ".join(texts[700].split()[-4:]), "w1 unheard"]})
    phrases = SimpleNamespace(value=D.Phrases(items, 10))
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    tracemalloc.start()
    try:
        found = [r for b in D._search(phrases, True)(table.to_batches(100)) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(r["doc_id"], r["spans"], r["items"]) for r in found if r["spans"]] == [
        (3, [{"start": 50, "stop": 70}], [7]), (700, [{"start": 1996, "stop": 2000}], [8])]
    assert peak < 80 << 20


def test_one_id_holds_all_pages(spark):
    from wardline.llm.warc import archive_round_trip

    rows = [(i, f"u{k}", f"page {k}", "d", 1) for k in range(300) for i in (None, 5)] + [(9, "u", "page 7", "d", 1), (9, "u", "page 7", "d", 1), (2, "u", "page 8", "d", 1)]
    got = archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, first int")).collect()
    first = {h: min(i for i, _, other, *_ in rows if other == h and i is not None) for _, _, h, *_ in rows}
    want = Counter()
    for i, _, h, *_ in rows:
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want[(i, len(h), digest, *(("response", None) if first[h] == i else ("revisit", first[h])))] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    none = [(None, None, None)] * 3
    got = archive_round_trip(spark.createDataFrame(none, "page_id bigint, url string, html string")).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in got] == [(None, 0, "response")] * 3
