"""Byte-level BPE against the reference encoder, plain merging and Python's decoder."""

import base64
import hashlib
import random

import numpy as np
import pytest

from wardline.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n  x", "a", "Hello  world's it'll 12345 !!!\t\r\n", "naïve 日本語テキスト Ωmega", "a" * 3000, "= " * 400, "-" * 777, "<|endoftext|> x", "\x00\x1c\x85 　z",
         "👩‍👩‍👧‍👦 ok", "".join(chr(0x558 + 50 * i) for i in range(300)), "Ⅷ²³ 1½", "　​" * 9, "word " * 9000, "abcdefghij" * 12000]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(codec):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_codec_equals_the_reference_encoder(codec, plain):
    rng = random.Random(3)
    tokens = list(codec.ranks)
    drawn = [b"".join(rng.choice(tokens) for _ in range(rng.randrange(9))).decode("utf-8", "ignore") for _ in range(3000)]
    drawn += ["".join(rng.choice("abeinrst é'0 \n=") for _ in range(rng.randrange(80))) for _ in range(3000)]
    for text in [t or "" for t in TEXTS] + drawn:
        got = codec.encode(text)
        assert ids(got) == plain.encode_ordinary(text), text[:80]
        parts = np.frombuffer(got, "<u4")
        assert "".join(codec.decode(parts[i:i + 3] for i in range(0, len(parts), 3))) == text


def test_every_code_point_is_cut_as_the_reference_encoder_does(codec):
    """A letter or number joins one before it, which shows if the pair's bytes merge: every leading byte does here."""
    import tiktoken
    ranks = {bytes([i]): i for i in range(256)}
    for lead in range(0xC2, 0xF5):
        for sign in b"a1":
            ranks[bytes([sign, lead])] = len(ranks)
    own = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for low in range(0, 0x110000, 0x400):
        signs = [chr(c) for c in range(low, low + 0x400) if c >= 0x80 and not 0xD800 <= c < 0xE000]
        text = "\n".join(f"a{s}\n1{s}" for s in signs)
        want = [i for a, b in codec._spans(text) for i in _merged(text[a:b].encode(), ranks)]
        assert own.encode_ordinary(text) == want


def _merged(data, ranks):
    return [ranks[data]] if data in ranks else [ranks[p] for p in bpe.merge(data, ranks)]


def test_toy_ranks_against_plain_merging():
    """Tables grown from drawn texts, some with a token that merging can't reach; also with hardly any room for states."""
    rng = random.Random(5)
    for round_ in range(30):
        ranks = {bytes([i]): i for i in range(256)}
        while len(ranks) < 256 + 25:
            text = bytes(rng.choice(b"aab") for _ in range(40))
            parts = bpe.merge(text, ranks)
            at = rng.randrange(len(parts) - 1) if len(parts) > 1 else 0
            if len(parts) > 1:
                ranks[parts[at] + parts[at + 1]] = len(ranks)
        if round_ % 5 == 4:
            ranks[b"cbca"] = len(ranks) + 1
        for most in (1 << 18, 7):
            machine = bpe.Transducer(ranks, most)
            for _ in range(60):
                data = bytes(rng.choice(b"aaabc") for _ in range(rng.randrange(1, 50)))
                assert machine.encode(data) == _merged(data, ranks)
            assert len(machine.moves) <= most + 256


def test_tables_out_of_order_are_refused():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257}
    with pytest.raises(ValueError):
        bpe.Merges(ranks)


def test_streaming_decoder_equals_the_whole_one():
    rng = random.Random(7)
    alphabet = [b"a", b"\x80", b"\xc3", b"\xa9", b"\xe2", b"\x82", b"\xac", b"\xf0", b"\x9f", b"\x98", b"\xed", b"\xa0", b"\xf4", b"\x90", b"\xc0", b"\xff", b"\xe0"]
    for _ in range(20000):
        data = b"".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = rng.randrange(1, 4)
            out += stream.feed(data[at:at + step])
            at += step
        assert out + stream.finish() == data.decode("utf-8", "replace"), data


def test_encode_and_decode_tables(spark, plain):
    rows = [(i if i % 6 else None, t, "x", b"ids") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids binary").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH), PATH, chunk=5)
    want = sorted((i or -1, len(e := plain.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t, _, _ in rows)
    assert sorted((r[0] or -1, *r[1:]) for r in bpe.digest(got).collect()) == want
    assert bpe.digest(bpe.decode(bpe.encode(docs.limit(0), PATH), PATH)).count() == 0
    with pytest.raises(ValueError):
        bpe.Codec(_short(spark), public_tokenizers.PATTERN)


def _short(spark):
    import os
    import tempfile
    path = os.path.join(tempfile.mkdtemp(), "short.tiktoken")
    with open(path, "wb") as out:
        out.write(base64.b64encode(b"a") + b" 0\n\n")
    return path


def test_query_equals_the_reference_encoder(spark, plain):
    from wardline.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {d.doc_id: plain.encode_ordinary(d.text or "") for d in docs}
    got = QUERIES["op11_byte_bpe"](spark, folder).collect()
    assert len(got) == len(docs)
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    for r in got:
        e = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[r.doc_id]).hexdigest())
