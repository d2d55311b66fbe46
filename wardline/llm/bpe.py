"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

A sequence of tokens is the encoding of its bytes just when every two neighbours in it are: merging the bytes of
both gives the two back. So a transducer need not merge anything. Its nondeterministic form guesses token by token:
a state is the token before and a place in the trie of all tokens' bytes, and a token may end where the pair fits.
Determinised, a state is the set of all open guesses, each with the tokens it has not emitted yet; tokens that all
guesses share are emitted, so output lags behind the input by a bounded number of bytes. States and moves are made
when a text first needs them and forgotten all at once when there are too many, so memory is bounded.

A pretoken that is itself a token is that token, as in the reference implementation of the format. Tokens that
merging cannot reach are otherwise never emitted.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import prepare, rows_of

BLOCK_BYTES = 2 << 20
MOST_MOVES = 1 << 19
MOST_KNOWN = 1 << 18
KNOWN_BYTES = 64
NEVER = 1 << 62

# Letters and numbers that the installed pattern library knows and the reference encoder, which goes by an
# older Unicode, does not (first and last code point). They count as neither here.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
ENCODED_DDL = "doc_id bigint, n_tokens bigint, ids binary"
DECODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
DECODED_DDL = "doc_id bigint, n_tokens bigint, ids binary, text string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of every token; all 256 single bytes must be there."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} lacks {len(missing)} single bytes")
    return ranks


def merge(data: bytes, ranks: dict[bytes, int], below: int = NEVER, least: int = 1) -> list[bytes]:
    """Plain BPE: join the neighbours of lowest rank, the leftmost first, while there are any (of rank under ``below``)."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > least:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Merges:
    """The merges behind a table of ranks: how a token comes about, and which tokens can be neighbours.

    Every token must come after the parts it is merged from, as in any table that was grown by merging.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        self.spines: dict[bytes, tuple[list, list]] = {}
        reached = []
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge(token, ranks, rank, 2)
                late = merge(token, ranks, least=2)
                if len(late) == 2 and late != parts:
                    raise ValueError(f"the parts of token {rank} come after it")
                if len(parts) != 2:
                    continue
                self.split[token] = (parts[0], parts[1])
            reached.append(token)
        self.reached = reached

    def _spines(self, token: bytes) -> tuple[list, list]:
        """(rank it forms at, bytes) of the parts at the left edge and at the right edge, from one byte to the token."""
        have = self.spines.get(token)
        if have is None:
            both = []
            for side in (0, 1):
                spine, part = [], token
                while part in self.split:
                    spine.append((self.ranks[part], part))
                    part = self.split[part][side]
                both.append([(-1, part), *reversed(spine)])
            have = self.spines[token] = (both[0], both[1])
        return have

    def neighbours(self, left: bytes, right: bytes) -> bool:
        """Whether merging ``left + right`` gives the two back.

        Merges inside either don't depend on the other until one across the border comes first. So only the parts
        at the border are followed, in order of rank.
        """
        a, b = self._spines(left)[1], self._spines(right)[0]
        i = j = 0
        while True:
            next_a = a[i + 1][0] if i + 1 < len(a) else NEVER
            next_b = b[j + 1][0] if j + 1 < len(b) else NEVER
            across = self.ranks.get(a[i][1] + b[j][1], NEVER)
            if across < next_a and across <= next_b and across < NEVER:  # of equal ranks the leftmost goes first
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1


class Transducer:
    """Ids of byte strings, one byte after the other."""

    def __init__(self, ranks: dict[bytes, int], most_moves: int = MOST_MOVES):
        self.merges = Merges(ranks)
        self.ranks, self.most = ranks, most_moves
        self.below: dict[int, int] = {}  # place << 8 | byte -> place in the trie
        self.ends: list[bytes | None] = [None]
        self.leaf: list[bool] = [True]
        for token in self.merges.reached:
            node = 0
            for byte in token:
                deeper = self.below.get(node << 8 | byte)
                if deeper is None:
                    deeper = self.below[node << 8 | byte] = len(self.ends)
                    self.leaf[node] = False
                    self.ends.append(None)
                    self.leaf.append(True)
                node = deeper
            self.ends[node] = token
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [((None, 0, ()),)]  # each guess: token before, place in the trie, tokens held back
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple]] = {}
        self.fits: dict[tuple, bool] = {}

    def _fits(self, before: bytes | None, token: bytes) -> bool:
        if before is None:
            return True
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) > self.most >> 2:
                self.fits.clear()
            known = self.fits[before, token] = self.merges.neighbours(before, token)
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        guesses, ended = [], None
        for before, node, held in self.states[state >> 8]:
            deeper = self.below.get(node << 8 | byte)
            if deeper is None:
                continue
            if ended is None:
                token = self.ends[deeper]
                if token is not None and self._fits(before, token):
                    ended = (token, 0, (*held, self.ranks[token]))
            if not self.leaf[deeper]:
                guesses.append((before, deeper, held))
        guesses.append(ended)  # single bytes are tokens, so one guess ends here
        emitted: tuple = ()
        if len(guesses) == 1:
            emitted = ended[2]
            target = ((ended[0], 0, ()),)
        else:
            shared = 0
            for column in zip(*[g[2] for g in guesses]):
                if column.count(column[0]) < len(column):
                    break
                shared += 1
            if shared:
                emitted = ended[2][:shared]
                guesses = [(before, node, held[shared:]) for before, node, held in guesses]
            target = tuple(guesses)
        found = self.moves[state + byte] = (self._number(target), emitted)
        return found

    def _number(self, target: tuple) -> int:
        """A state's number, with room for a byte."""
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states) << 8
            self.states.append(target)
        return number

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ids, state, known = [], 0, self.moves.get
        for byte in data:
            found = known(state + byte)
            if found is None:
                found = self._move(state, byte)
                if len(self.moves) > self.most:  # start anew from the state it is in
                    here = self.states[found[0] >> 8]
                    self.forget()
                    known = self.moves.get
                    found = (self._number(here), found[1])
            state, emitted = found
            if emitted:
                ids += emitted
        ids += self.states[state >> 8][-1][2]  # what ends with the text
        return ids


class Utf8Stream:
    """Text from chunks of bytes that may cut characters anywhere.

    States: 0 between characters, else what may follow. Bytes that cannot belong to a character become U+FFFD, one for
    each broken beginning, as for Python's decoder.
    """

    # state -> (lowest and highest byte that may follow, state after it)
    NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}

    def __init__(self):
        self.state, self.held = 0, b""

    @staticmethod
    def lead(byte: int) -> int | None:
        """State after a first byte; None if no character begins with it."""
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return None

    def feed(self, chunk: bytes) -> str:
        """All characters that are complete after ``chunk``; the rest is held back."""
        data = self.held + chunk
        # Only the last three bytes can belong to an open character; what stands before is complete.
        end = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                state = self.lead(byte)
                for follow in data[len(data) - back + 1:]:
                    low, high, after = self.NEXT.get(state or 0, (1, 0, None))
                    state = after if low <= follow <= high else None
                if state:
                    end, self.state = len(data) - back, state
                break
        self.held = data[end:]
        if not self.held:
            self.state = 0
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        text, self.held, self.state = self.held.decode("utf-8", "replace"), b"", 0
        return text


class _Known(dict):
    """Ids of pretokens met before; long ones are not kept."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= KNOWN_BYTES:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one table of ranks and one pattern of pretokens (without groups)."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.cut = regex.compile(pattern)
        later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER)
        self.later = regex.compile(f"[{later}]")
        self.stand_in = "\ue000"  # private use: neither letter nor number, nor white space
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def known(self) -> _Known:
        return _Known(Transducer(self.ranks))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed."""
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        pieces = [text[a:b] for a, b in self._spans(text)] if self._later(text) else self.cut.findall(text)
        packed = b"".join(map(self.known.__getitem__, filter(None, pieces)))
        return packed if sys.byteorder == "little" else np.frombuffer(packed, "=u4").astype("<u4").tobytes()

    def _later(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")  # quicker than a search
        except UnicodeEncodeError:
            return self.later.search(text) is not None
        return False

    def _spans(self, text: str) -> list[tuple[int, int]]:
        """Pretokens as places, with a private-use sign for every later letter or number."""
        return [m.span() for m in self.cut.finditer(self.later.sub(self.stand_in, text))]

    def decode(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of ids that come chunk by chunk."""
        stream = Utf8Stream()
        for ids in chunks:
            yield stream.feed(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))
        yield stream.finish()


@cache
def _codec(path: str, pattern: str) -> Codec:
    """One for each Python worker: states it has made serve later tasks."""
    return Codec(path, pattern)


@lru_cache(1)
def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encode(path: str, pattern: str):
    def work(batches):
        codec = _codec(path, pattern)
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            texts = table.column("text").cast(pa.large_binary())
            ids = [codec.encode((t.as_py() or b"").decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array([len(i) // 4 for i in ids], pa.int64()),
                                              pa.array(ids, pa.binary())], schema=ENCODED)

    return work


def _decode(path: str, pattern: str, chunk: int):
    def work(batches):
        codec = _codec(path, pattern)
        for table in W.blocks(batches, "ids", BLOCK_BYTES):
            texts = []
            for packed in table.column("ids"):
                ids = np.frombuffer(packed.as_py() or b"", "<u4")
                texts.append("".join(codec.decode(ids[i:i + chunk] for i in range(0, len(ids), chunk))))
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ENCODED.names] + [pa.array(texts, pa.string())], schema=DECODED)

    return work


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit numbers, lowest byte first) of every row.

    ``path``: a table of ranks, at the same place on every executor. ``pattern`` cuts texts into pretokens. A null or
    empty text has no ids, bytes that are not UTF-8 count as U+FFFD. Repeated rows and rows without an id are encoded
    like any others; an empty table gives an empty one, other columns don't matter.
    """
    prepare(docs.sparkSession)
    rows = rows_of(docs, doc_id=id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(path, pattern or _pattern()), ENCODED_DDL)


def decode(encoded: DataFrame, path: str, pattern: str | None = None, chunk: int = 4096) -> DataFrame:
    """``encode``'s rows with their ``text``, decoded ``chunk`` ids at a time. Null ids give an empty text."""
    return encoded.select(*ENCODED.names).mapInArrow(_decode(path, pattern or _pattern(), chunk), DECODED_DDL)


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
