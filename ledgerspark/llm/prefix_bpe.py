"""Byte-level BPE by prefix dynamic programming: encoding, appending, editing and decoding."""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import repeat
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerspark.llm.chunks import Chunks
from ledgerspark.llm.common import arrow_map, as_texts, process_cache, slices

_NEVER = 1 << 40

#: Remembered pairs of tokens at most.
PAIR_ENTRIES = 300_000


class Ranks:
    """A vocabulary of byte strings with ranks, and which tokens may stand side by side."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.words = {i: w for w, i in ids.items()}
        self.longest = max(map(len, ids))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int | None, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as file:
            return cls({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (token, token) for a byte, None if merging never gets there."""
        found = self._halves.get(token, 0)
        if found == 0:
            word = self.words[token]
            parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
            found = (token, token) if len(parts) == 1 else None
            while len(parts) > 1:
                made = [self.ids.get(self.words[a] + self.words[b], _NEVER) for a, b in zip(parts, parts[1:])]
                best = min(made)
                if best > token:
                    break
                at = made.index(best)
                if best == token and len(parts) == 2:
                    found = (parts[0], parts[1])
                    break
                parts[at : at + 2] = [best]
            self._halves[token] = found
        return found

    def fits(self, a: int | None, b: int) -> bool:
        """Whether merging the bytes of both ends at exactly these two tokens (at ``b`` alone, if ``a`` is None).

        Looking back in time: while the tokens at the border are ``x`` and ``y``, merging them must not come
        before the merge that takes ``x`` (at equal rank the left one is first) or ``y`` away. The one made
        last is split, until both are bytes.
        """
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs.clear()
        found = self.halves(b) is not None
        if found and a is not None:
            x, y, taken_x, taken_y = a, b, _NEVER, _NEVER
            words, rank_of = self.words, self.ids.get
            while True:
                rank = rank_of(words[x] + words[y], _NEVER)
                if rank < taken_x and rank <= taken_y and rank < _NEVER:
                    found = False
                    break
                made_x, made_y = (x if len(words[x]) > 1 else -1), (y if len(words[y]) > 1 else -1)
                if made_x < 0 and made_y < 0:
                    break
                if made_x > made_y:
                    taken_x, x = x, self.halves(x)[1]
                else:
                    taken_y, y = y, self.halves(y)[0]
        self.pairs[a, b] = found
        return found


class Prefixes:
    """The last token of every prefix of a byte string.

    Each prefix has exactly one token that can end its encoding: one that fits behind the last token of the
    prefix before it. Appending goes on from the table; after an edit the table is renewed from there
    until it agrees with the old one over as many bytes as the longest token has.
    """

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def become(self, data: bytes) -> None:
        """Go over to other bytes; what both begin with keeps its table."""
        same = len(commonprefix([data, self.data]))
        del self.last[same:]
        self.data = data
        self._extend(len(data))

    def _extend(self, until: int) -> None:
        token_of, known, fits, data, last, longest = self.ranks.ids.get, self.ranks.pairs.get, self.ranks.fits, self.data, self.last, self.ranks.longest
        for end in range(len(last) + 1, until + 1):
            for start in range(max(0, end - longest), end):
                token = token_of(data[start:end])
                if token is not None:
                    before = last[start - 1] if start else None
                    fit = known((before, token))
                    if fit or fit is None and fits(before, token):
                        break
            else:
                raise ValueError("a byte is missing in the vocabulary")
            last.append(token)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace the bytes from ``start`` to ``end``; returns how many prefixes were computed."""
        old, moved = self.last[end:], self.data[end:]
        self.data, self.last = self.data[:start] + new + moved, self.last[:start]
        agreed = 0
        for at in range(start, len(self.data)):
            self._extend(at + 1)
            behind = at - start - len(new)
            agreed = agreed + 1 if behind >= 0 and self.last[at] == old[behind] else 0
            if agreed >= self.ranks.longest:
                self.last += old[behind + 1 :]
                return at + 1 - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.ranks.words[token])
        return out[::-1]


@process_cache
def _codec(path: str, pattern: str) -> tuple[Ranks, Chunks]:
    ranks = Ranks.read(path)

    def encode(tokens: list[str]) -> list[bytes]:
        found, table = {}, Prefixes(ranks)
        for word in sorted(t.encode() for t in tokens):
            table.become(word)
            found[word] = packed(table.ids())
        return [found[t.encode()] for t in tokens]

    return ranks, Chunks(pattern, encode)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(map(int.to_bytes, ids, repeat(4), repeat("little")))


def unpacked(data: bytes) -> list[int]:
    out = array("I", data)
    if memoryview(b"\1\0").cast("H")[0] != 1:
        out.byteswap()
    return out.tolist()


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """The ids of each text, packed."""
    _, chunks = _codec(path, pattern)
    return [b"".join(v) for start, end in slices(texts) for v in chunks.values(texts[start:end])]


def decode(data: bytes, path: str, pattern: str) -> bytes:
    return b"".join(map(_codec(path, pattern)[0].words.__getitem__, unpacked(data)))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (packed as little-endian unsigned 32-bit integers) per row of ``docs``; null texts have none.

    Rows are encoded by themselves and whole, whatever their length; repeated rows give repeated codes, an empty table an
    empty result. Other columns are left out.
    """

    def encode(batch: pa.RecordBatch) -> list:
        return [batch.column(0), encode_texts(as_texts(batch.column(1)), path, pattern)]

    df = docs.select(key, text)
    return arrow_map(df, encode, T.StructType([df.schema.fields[0], T.StructField("ids", T.BinaryType())]))


def decoded(codes: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, ids and bytes (what the ids stand for) per row of ``codes``; null ids give null, empty ones no bytes; an empty table gives an empty result."""

    def back(batch: pa.RecordBatch) -> list:
        return [batch.column(0), batch.column(1), [None if x is None else decode(x, path, pattern) for x in batch.column(1).to_pylist()]]

    df = codes.select(key, "ids")
    return arrow_map(df, back, T.StructType([*df.schema.fields, T.StructField("bytes", T.BinaryType())]))


def round_trip_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, keeping digests only.

    Null texts count as empty; long texts are encoded whole, repeated rows each by itself; an empty table
    gives an empty result. Other columns are left out.
    """

    def digests(batch: pa.RecordBatch) -> list:
        codes = encode_texts(as_texts(batch.column(1)), path, pattern)
        return [batch.column(0), [len(c) // 4 for c in codes], [hashlib.sha256(c).hexdigest() for c in codes], [hashlib.sha256(decode(c, path, pattern)).hexdigest() for c in codes]]

    df = docs.select(key, text)
    return arrow_map(df, digests, T.StructType([df.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
