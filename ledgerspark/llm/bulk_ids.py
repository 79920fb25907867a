"""Ids of many texts at once: chunks between spaces are told apart in Arrow, and only new ones are encoded."""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ledgerspark.llm.chunks import Chunks
from ledgerspark.llm.common import process_cache, slices
from ledgerspark.llm.rank_merge import Vocabulary

#: Chunks that a process remembers at most; then those seen in one batch only are forgotten.
CHUNKS = 400_000

#: Bytes of text that one step splits.
STEP_BYTES = 8 << 20

#: Small batches are put together up to this size: a chunk is looked up once in a batch, however often it comes.
GATHER_BYTES = 4 << 20


@process_cache
def _encoder(path: str, pattern: str) -> tuple[Vocabulary, Chunks]:
    vocabulary = Vocabulary(path)

    def encode(tokens: list[str]) -> list[bytes]:
        ids, counts = vocabulary.merger.merge([t.encode() for t in tokens])
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    return vocabulary, Chunks(pattern, encode)


def text_ids(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """The ids of each text as the tokenizers file gives them, as little-endian unsigned 32-bit integers."""
    vocabulary, chunks = _encoder(path, pattern)
    out: list[bytes] = []
    for start, end in slices(texts):
        cut = [vocabulary.segments(t) for t in texts[start:end]]
        values = iter(chunks.values(list(chain.from_iterable(parts for parts, _ in cut))))
        for parts, added in cut:
            ids = [b"".join(next(values)) for _ in parts]
            marks = [i.to_bytes(4, "little") for i in added]
            out.append(b"".join(chain.from_iterable(zip(ids, [*marks, b""]))))
    return out


class ChunkPool:
    """The ids of chunks, one behind the other in one array.

    A single space between other characters always begins a pre-token, so a chunk's ids (with the space
    before it) don't depend on what stands around it. Chunks with white space at an edge, or none in them, have no ids of their own.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.find = Vocabulary(path), regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.used = np.empty(0, np.int32), 0
        self.start, self.count, self.seen = (np.empty(0, np.int64) for _ in range(3))

    def _put(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember the keys, whose ids lie one behind the other."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.empty(max(len(ids), self.used, 1 << 16), np.int32)]
        self.ids[self.used : self.used + len(ids)] = ids
        first, ends = len(self.start), np.cumsum(counts)
        self.start, self.count = np.r_[self.start, self.used + ends - counts], np.r_[self.count, counts]
        self.seen = np.r_[self.seen, np.zeros(len(keys), np.int64)]
        self.used += len(ids)
        self.slots.update(zip(keys, range(first, first + len(keys))))

    def _add(self, keys: list[str]) -> None:
        """Encode keys; one that begins with a space is a text's first chunk, without a space before it.

        Letters alone are one pre-token. With a full stop or comma behind them they are two, of which the
        first is looked up, so that a word is encoded once however it ends. Other chunks are matched.
        """
        merge = self.vocabulary.merger.merge
        words, marked, others = [], [], []
        for k in keys:
            (words if k.isalpha() else marked if k[-1] in ".," and k[:-1].isalpha() else others).append(k)
        if marked:
            known = self.slots
            words += {k[:-1] for k in marked if k[:-1] not in known}.difference(words)
        if words:
            self._put(words, *merge([f" {k}".encode() for k in words]))
        if marked:
            stems = np.fromiter(map(self.slots.__getitem__, [k[:-1] for k in marked]), np.int64, len(marked))
            marks = dict(zip(".,", merge([b".", b","])[0].tolist()))
            counts = self.count[stems] + 1
            ends = np.cumsum(counts)
            ids, room = np.empty(int(ends[-1]), np.int32), np.ones(int(ends[-1]), bool)
            room[ends - 1] = False
            ids[room], ids[ends - 1] = gathered(self.ids, self.start[stems], counts - 1), [marks[k[-1]] for k in marked]
            self._put(marked, ids, counts)
        if others:
            tokens = [self.find(k[1:] if k[0] == " " else " " + k) for k in others]
            ids, counts = merge([t.encode() for own in tokens for t in own])
            sums = np.r_[0, np.cumsum(counts)][np.cumsum([0, *map(len, tokens)])]
            self._put(others, ids, np.diff(sums))

    def _forget(self) -> None:
        """Keep the chunks of more than one batch, half of the room at most, those of most batches first."""
        order = np.argsort(-self.seen, kind="stable")[: CHUNKS // 2]
        order = np.sort(order[self.seen[order] > 1])
        place = np.full(len(self.start), -1, np.int64)
        place[order] = np.arange(len(order))
        new = place.tolist()
        self.slots = {k: new[v] for k, v in self.slots.items() if new[v] >= 0}
        counts = self.count[order]
        self.ids, self.used = gathered(self.ids, self.start[order], counts), int(counts.sum())
        self.start, self.count, self.seen = np.r_[0, np.cumsum(counts)[:-1]] if len(counts) else counts, counts, np.zeros(len(order), np.int64)

    def find_slots(self, keys: list[str]) -> np.ndarray:
        """The slot of each of the different keys; -1 where a chunk has no ids of its own."""
        if len(self.slots) > CHUNKS:
            self._forget()
        out = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        # Of other chunks than first ones, empty ones and those with white space at an edge stay without ids.
        missing = [i for i in np.flatnonzero(out < 0).tolist() if (k := keys[i]) and (k[0] == " " or k == k.strip())]
        if missing:
            new = list(map(keys.__getitem__, missing))
            self._add(new)
            out[missing] = list(map(self.slots.__getitem__, new))
        self.seen[out[out >= 0]] += 1
        return out


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges of ``values``, one behind the other."""
    ends = np.cumsum(counts)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]))]


@process_cache
def _pool(path: str, pattern: str) -> ChunkPool:
    return ChunkPool(path, pattern)


def _step(texts: pa.Array, pool: ChunkPool, path: str, pattern: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with ``end_id`` behind each, and how many each has."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    heads = [" " + h for h in coded.take(pa.array(edges[:-1])).to_pylist()]
    different = list(dict.fromkeys(heads))
    found = pool.find_slots([*coded.dictionary.to_numpy(zero_copy_only=False).tolist(), *different])
    slots, of_heads = found[coded.indices.to_numpy()], found[len(coded.dictionary) :]
    head_slots = dict(zip(different, of_heads.tolist()))
    slots[edges[:-1]] = [head_slots[h] for h in heads]
    sizes = np.diff(edges)
    whole = np.bincount(np.repeat(np.arange(len(sizes)), sizes), slots < 0, minlength=len(sizes)) > 0
    # White space at the end of a first chunk, with a space behind it.
    whole |= (sizes > 1) & np.array([len(h) > 1 and h[-1].isspace() for h in heads])
    for token in pool.vocabulary.added:
        whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    slots[np.repeat(whole, sizes)] = 0
    counts = np.where(np.repeat(whole, sizes), 0, pool.count[slots] if len(pool.count) else 0)
    by_text = np.add.reduceat(counts, edges[:-1])
    bulk = gathered(pool.ids, pool.start[slots] if len(pool.start) else slots, counts)
    full = {i: np.frombuffer(text_ids([texts[i].as_py()], path, pattern)[0], "<u4") for i in np.flatnonzero(whole).tolist()}
    for i, ids in full.items():
        by_text[i] = len(ids)
    ends = np.cumsum(by_text + 1)
    out = np.full(int(ends[-1]), end_id, np.int32)
    room = np.ones(len(out), bool)
    room[ends - 1] = False
    for i, ids in full.items():
        at = int(ends[i]) - 1 - len(ids)
        out[at : at + len(ids)], room[at : at + len(ids)] = ids, False
    out[room] = bulk
    return out, by_text + 1


def ended_ids(texts: pa.Array, path: str, pattern: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts (null: empty) all ids, with ``end_id`` behind each text, as the tokenizers file gives them; and how many each text has.

    Texts with white space beside a space, or with an added token, are matched in full by themselves.
    """
    pool = _pool(path, pattern)
    texts = texts.fill_null("")
    done = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    out, start = [], 0
    while start < len(texts):
        limit = (int(done[start - 1]) if start else 0) + STEP_BYTES
        end = max(start + 1, int(np.searchsorted(done, limit, side="right")))
        out.append(_step(texts[start:end], pool, path, pattern, end_id))
        start = end
    return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])
