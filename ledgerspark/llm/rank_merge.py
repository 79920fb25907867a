"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerspark.llm.chunks import Chunks
from ledgerspark.llm.common import arrow_map, as_texts, free_name, process_cache, slices

_NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    stands = dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(others)}
    return [chr(stands[b]) for b in range(256)]


class PairTable:
    """Ranks and results of pairs of symbols, in open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.result = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, rest, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(rest):
            at = (slot[rest] + self.probes) & (size - 1)
            free = self.keys[at] < 0
            _, one = np.unique(at, return_index=True)
            chosen = np.zeros(len(rest), bool)
            chosen[one] = True
            chosen &= free
            self.keys[at[chosen]], self.rank[at[chosen]], self.result[at[chosen]] = keys[rest[chosen]], rank[rest[chosen]], result[rest[chosen]]
            rest = rest[~chosen]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (the largest int32 for none) and result of each pair."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        hit = self.keys[slot] == keys
        open_ = np.flatnonzero(~hit & (self.keys[slot] >= 0))
        rank, result = np.where(hit, self.rank[slot], _NONE), self.result[slot]
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + probe) & ((1 << self.bits) - 1)
            same = self.keys[at] == keys[open_]
            rank[open_[same]], result[open_[same]] = self.rank[at[same]], self.result[at[same]]
            open_ = open_[~same & (self.keys[at] >= 0)]
        return rank, result


class RankMerger:
    """Byte-level BPE on many pre-tokens at once.

    All sequences lie one behind the other in one array. In each round every sequence merges all
    occurrences of its lowest-ranked pair (of overlapping ones, as in ``aaa``, every other from the left);
    sequences without a mergeable pair leave the arrays.
    """

    def __init__(self, byte_ids: np.ndarray, pairs: PairTable):
        self.byte_ids, self.pairs = byte_ids, pairs

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all tokens, one behind the other, and how many each has."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        counts = np.zeros(len(tokens), np.int64)
        ready_ids, ready_owners = [], []
        rank, result = self._ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(owner)])
            live = np.repeat(lowest < _NONE, lengths)
            if not live.all():
                ready_ids.append(symbols[~live])
                ready_owners.append(owner[~live])
                symbols, owner, rank, result = symbols[live], owner[live], rank[live], result[live]
                lengths, lowest = lengths[lowest < _NONE], lowest[lowest < _NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, lengths))
            run = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = result[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank, result = symbols[keep], owner[keep], rank[keep], result[keep]
            near = np.zeros(len(symbols), bool)
            near[place[at]] = True
            near[np.maximum(place[at] - 1, 0)] = True
            touched = np.flatnonzero(near)
            rank[touched], result[touched] = self._ranks(symbols, owner, touched)
        ids = np.concatenate(ready_ids) if ready_ids else np.empty(0, np.int32)
        owners = np.concatenate(ready_owners) if ready_owners else np.empty(0, np.int64)
        counts += np.bincount(owners, minlength=len(tokens))
        return ids[np.argsort(owners, kind="stable")], counts

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at the places ``at``; none across sequences."""
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, result = self.pairs.find(symbols[at], symbols[after])
        rank[(owner[at] != owner[after]) | (at == after)] = _NONE
        return rank, result


class Vocabulary:
    """A byte-level tokenizers file: its merges, and its added tokens, which are found before anything else."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        ids, merges = found["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in found["model"]["merges"]]
        column = lambda strings: np.array([ids[s] for s in strings], np.int32)
        pairs = PairTable(column(a for a, _ in merges), column(b for _, b in merges), np.arange(len(merges), dtype=np.int32), column(a + b for a, b in merges))
        self.merger = RankMerger(column(byte_characters()), pairs)
        self.added = {t["content"]: t["id"] for t in found["added_tokens"]}

    def segments(self, text: str) -> tuple[list[str], list[int]]:
        """The parts of a text between added tokens, and the ids of these; longer added tokens go first."""
        import re

        if not any(t in text for t in self.added):
            return [text], []
        cut = re.split("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")", text)
        return cut[::2], [self.added[t] for t in cut[1::2]]


@process_cache
def _counter(path: str, pattern: str) -> tuple[Vocabulary, Chunks]:
    vocabulary = Vocabulary(path)
    encode = lambda tokens: vocabulary.merger.merge([t.encode() for t in tokens])[1].tolist()
    return vocabulary, Chunks(pattern, encode)


def count_texts(texts: list[str], path: str, pattern: str) -> list[int]:
    """The number of tokens of each text."""
    vocabulary, chunks = _counter(path, pattern)
    out: list[int] = []
    for start, end in slices(texts):
        cut = [vocabulary.segments(t) for t in texts[start:end]]
        values = iter(chunks.values(list(chain.from_iterable(parts for parts, _ in cut))))
        out += [len(added) + sum(sum(next(values)) for _ in parts) for parts, added in cut]
    return out


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Null texts count as empty: 0 bytes, 0 tokens. Columns of these names in ``docs`` are replaced. Texts
    may have any length; a row is counted by itself, so repeated rows and empty tables need no care.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    df = docs.drop(*[c for c in docs.columns if c.lower() in new and c != text])
    source = df
    if text.lower() in new:
        source = df.withColumnRenamed(text, text := free_name(df, "_text"))
    schema = T.StructType([*[f for f in source.schema.fields], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    place = source.columns.index(text)

    def count(batch: pa.RecordBatch) -> list:
        texts = as_texts(batch.column(place))
        tokens = np.array(count_texts(texts, path, pattern), np.int64)
        return [*batch.columns, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]

    return arrow_map(source, count, schema)
