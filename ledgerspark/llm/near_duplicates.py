"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Equal texts are one node from the start, so copies are never paired. Nodes that share a band are candidates.
First the node of each band that meets the most others (the centre of a group, if it has one) stands against
the rest, and links run through the classes that this makes. Bands whose other nodes are in several classes
then are taken up again: their nodes meet by rare shingle, without which no two texts can be similar enough,
until all that share a band are compared or in one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import arrow_map, as_texts, free_name, mixed, prepare, slices, staged, to_arrow, word_hashes


@dataclass(frozen=True)
class Settings:
    """With 20 bands of 4 samples, a pair of similarity 0.8 shares a band but for 3 in 100,000 cases.

    ``buckets``: document frequencies are counted by hash of the shingle; on texts of some hundred words the share of
    documents that meet in a bucket by chance stays the same, below a hundredth, however many there are.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    buckets: int = 1 << 17
    randoms: int = 4096
    seed: int = 3


@dataclass
class Weights:
    """``idf`` by bucket, from 1 (in every document) to 1.25 (in none): what many texts share counts less, but still counts."""

    idf: np.ndarray
    settings: Settings

    @classmethod
    def of_counts(cls, counts: np.ndarray, documents: int, settings: Settings) -> Weights:
        rare = np.log((1 + documents) / (1 + np.minimum(counts, documents))) / math.log(2 + documents)
        return cls((1 + rare / 4).astype(np.float32), settings)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles in ascending order within each text, their weights, and their number per text."""
        shingles, owner = shingle_hashes(texts, self.settings.shingle)
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        first = np.flatnonzero(np.r_[True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else np.empty(0, np.int64)
        times = np.diff(np.r_[first, len(owner)])
        shingles = shingles[first]
        return shingles, times * self.idf[bucket_of(shingles, self.settings)], np.bincount(owner[first], minlength=len(texts))


def bucket_of(shingles: np.ndarray, settings: Settings) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) % settings.buckets


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``k`` words, and the text it is of. A text with fewer words has one shingle, one without words none."""
    words, counts = word_hashes(texts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    padded = np.r_[words, np.zeros(k, np.uint64)]
    out = np.zeros(len(owner), np.uint64)
    size = np.repeat(counts, n)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(size > i, padded[begin + i], np.uint64(0)) + np.uint64(i + 1))
    return out, owner


class Sampler:
    """Improved consistent weighted sampling: gamma and uniform numbers by row of a table, which a shingle's hash chooses."""

    def __init__(self, settings: Settings):
        draw, shape = np.random.default_rng(settings.seed), (settings.randoms, settings.bands * settings.rows)
        self.settings = settings
        self.r = draw.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, shape)).astype(np.float32)
        self.beta = draw.random(shape, np.float32)

    def samples(self, shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per text with shingles, one sample for each column: a hash of the chosen shingle and its step."""
        starts, n = np.cumsum(counts) - counts, len(shingles)
        row = (shingles >> np.uint64(44)).astype(np.int64) % self.settings.randoms
        log_w = np.log(weights).astype(np.float32)[:, None]
        out = np.empty((len(counts), self.r.shape[1]), np.uint64)
        text = 0
        while text < len(counts):
            # As many texts as have some thousand shingles, one at least.
            end = max(text + 1, int(np.searchsorted(starts, starts[text] + 4096)))
            a, b = int(starts[text]), int(starts[end]) if end < len(counts) else n
            best, at, step = None, None, None
            for c in range(a, b, 65536) if end == text + 1 else (a,):
                d = min(b, c + 65536) if end == text + 1 else b
                r, beta = self.r[row[c:d]], self.beta[row[c:d]]
                t = np.floor(log_w[c:d] / r + beta)
                cost = self.log_c[row[c:d]] - r * (t - beta) - r
                own = starts[text:end] - a if c == a else np.zeros(1, np.int64)
                low = np.minimum.reduceat(cost, own, axis=0)
                of = np.repeat(np.arange(end - text), counts[text:end])[: d - c] if end > text + 1 else np.zeros(d - c, np.int64)
                i, j = np.nonzero(cost == low[of])
                # Written from the back, the first shingle (the smallest hash) with the lowest cost stays.
                place = np.empty((end - text, self.r.shape[1]), np.int64)
                place[of[i[::-1]], j[::-1]] = i[::-1]
                chosen = np.take_along_axis(t, place, 0)
                if best is None:
                    best, at, step = low, place + c, chosen
                else:
                    less = low < best
                    best, at, step = np.where(less, low, best), np.where(less, place + c, at), np.where(less, chosen, step)
            with np.errstate(over="ignore"):
                out[text:end] = mixed(shingles[at] + step.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            text = end
        return out

    def bands(self, shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One key per text and band, different from band to band."""
        some = counts > 0
        samples = self.samples(shingles, weights, counts[some]).reshape(int(some.sum()), self.settings.bands, self.settings.rows)
        keys = np.tile(np.arange(self.settings.bands, dtype=np.uint64), (len(samples), 1))
        with np.errstate(over="ignore"):
            for i in range(self.settings.rows):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, :, i])
        return keys.view(np.int64)


def weights_of(docs: DataFrame, text: str, settings: Settings) -> Weights:
    """Counts, over all rows, of the texts that hold a shingle of each bucket; ``settings.buckets`` numbers come to the driver."""
    schema = T._parse_datatype_string("bucket int, n long")
    kinds = to_arrow(schema)
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(settings.buckets, np.int64), 0
        for batch in batches:
            texts = as_texts(batch.column(0))
            rows += len(texts)
            for a, b in slices(texts):
                shingles, owner = shingle_hashes(texts[a:b], settings.shingle)
                pairs = np.unique(owner * settings.buckets + bucket_of(shingles, settings))
                total += np.bincount(pairs % settings.buckets, minlength=settings.buckets)
        used = np.flatnonzero(total)
        # The number of rows goes along as bucket -1.
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used], pa.int32()), pa.array(np.r_[rows, total[used]])], schema=kinds)

    found = docs.select(text).mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts = np.zeros(settings.buckets, np.int64)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return Weights.of_counts(counts, int(n[bucket < 0].sum()), settings)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending shingles, weights); 0 without shingles."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = b[0][at] == a[0]
    shared = np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64)
    return float(shared / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - shared))


def text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: _key, _node (of its text), class_id, class_texts (different texts in its class), kept.

    ``class_id`` is the smallest key in the class (null if all are null). ``kept`` marks the class's keeper, the
    first by key and then by text; repeated rows of a keeper are all marked. Null texts count as empty; texts
    without words are linked to equal texts only. Long texts are read whole; an empty table gives an empty result.
    """
    weights = weights_of(docs, text, settings)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batch: pa.RecordBatch) -> list:
        texts, keys = as_texts(batch.column(2)), []
        for a, b in slices(texts):
            found = shared.value.of(texts[a:b])
            rows = iter(sampler(settings).bands(*found).tolist())
            keys += [next(rows) if n else [] for n in found[2]]
        return [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))]

    source = docs.select(F.col(f"`{key}`").alias("_key"), text_key(text).alias("_node"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = staged(arrow_map(source, sign, schema))
    nodes = signed.groupBy("_node").agg(F.min("_key").alias("first"), F.any_value("bands").alias("bands"))
    nodes = staged(nodes.withColumn("n", F.monotonically_increasing_id()))
    met = band_members(nodes)
    pairs = staged(centre_pairs(met))
    texts = staged(candidate_texts(nodes, pairs, source))
    links = staged(verified(pairs, texts, shared, settings))
    label = components(links)
    label = closed(unsettled(met, label), nodes, texts, label, shared, settings)
    named = nodes.join(label, "n", "left").select("_node", "first", F.coalesce("label", "n").alias("label"))
    named = staged(named)
    keeper = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "_node")))
    groups = named.groupBy("label").agg(keeper.alias("keeper"), F.min("_node").alias("least"), F.count("*").alias("class_texts"))
    groups = groups.select("label", F.col("keeper.first").alias("class_id"), F.coalesce("keeper._node", "least").alias("chosen"), "class_texts")
    known = named.join(groups, "label").select("_node", "class_id", "chosen", "class_texts")
    out = signed.select("_key", "_node").join(known, "_node")
    return out.select("_key", "_node", "class_id", "class_texts", ((F.col("_node") == F.col("chosen")) & F.col("_key").eqNullSafe(F.col("class_id"))).alias("kept"))


_samplers: dict[Settings, Sampler] = {}


def sampler(settings: Settings) -> Sampler:
    if settings not in _samplers:
        _samplers[settings] = Sampler(settings)
    return _samplers[settings]


def centred(entries: DataFrame, key: str) -> DataFrame:
    """``entries`` (key, n and more) with size, the nodes of the key, and centre, the one of them that meets the most nodes over all keys."""
    sized = staged(entries.join(entries.groupBy(key).agg(F.count("*").alias("size")).filter("size > 1"), key))
    scores = sized.groupBy("n").agg(F.sum(F.col("size") - 1).alias("score"))
    centres = sized.select(key, "n").join(scores, "n").groupBy(key).agg(F.max_by("n", F.struct("score", (-F.col("n")).alias("least"))).alias("centre"))
    return sized.join(centres, key)


def band_members(nodes: DataFrame) -> DataFrame:
    """band, n of the bands with several nodes, and the node there that meets the most others (centre)."""
    return staged(centred(nodes.select(F.explode("bands").alias("band"), "n"), "band").select("band", "n", "centre"))


def centre_pairs(met: DataFrame) -> DataFrame:
    """Candidates (a, b): each node with the centres of its bands."""
    return met.filter("n != centre").select(F.least("n", "centre").alias("a"), F.greatest("n", "centre").alias("b")).distinct()


def unsettled(met: DataFrame, label: DataFrame) -> DataFrame:
    """n: the nodes, but for centres, of the bands where these aren't all in one component."""
    inner = met.filter("n != centre").select("band", "n")
    several = inner.join(label, "n", "left").groupBy("band").agg(F.min(F.coalesce("label", "n")).alias("least"), F.max(F.coalesce("label", "n")).alias("most"))
    return staged(inner.join(several.filter("least < most").select("band"), "band").select("n").distinct())


def rarest_first(shingles: np.ndarray, own: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rarest shingles, so many that the others weigh less than ``similarity`` of the text, and the weight from each on.

    Two texts that share none of theirs share less than that of their weight, by an order that is the same for all texts.
    """
    order = np.lexsort((shingles, -weights.idf[bucket_of(shingles, weights.settings)]))
    total, run = own.sum(dtype=np.float64), np.cumsum(own[order], dtype=np.float64)
    # A little more than needed, against rounding.
    n = int(np.argmax(total - run < (weights.settings.similarity - 1e-6) * total)) + 1
    return order[:n], total - run[:n] + own[order[:n]]


def rare_shingles(shingles: np.ndarray, own: np.ndarray, weights: Weights) -> np.ndarray:
    return shingles[rarest_first(shingles, own, weights)[0]]


def meetings(open_: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """key, n of the nodes of ``open_`` by rare shingle that several have, with the text's weight (total) and that from the shingle on (rest)."""

    def rare(batch: pa.RecordBatch) -> list:
        given, keys, rests, totals = as_texts(batch.column(1)), [], [], []
        for a, b in slices(given):
            shingles, own, counts = weights.value.of(given[a:b])
            cut = np.cumsum(counts)[:-1]
            for x, w in zip(np.split(shingles, cut), np.split(own, cut)):
                chosen, rest = rarest_first(x, w, weights.value) if len(x) else ([], np.empty(0))
                keys.append(x[chosen].view(np.int64) if len(x) else [])
                rests.append(rest)
                totals.append(float(w.sum(dtype=np.float64)))
        return [batch.column(0), pa.array(totals, pa.float64()), pa.array(keys, pa.list_(pa.int64())), pa.array(rests, pa.list_(pa.float64()))]

    each = arrow_map(texts.join(open_, "n", "left_semi").select("n", "text"), rare, "n long, total double, keys array<long>, rests array<double>")
    rows = staged(each.select("n", "total", F.explode(F.arrays_zip("keys", "rests")).alias("at")).select(F.col("at.keys").alias("key"), "n", "total", F.col("at.rests").alias("rest")))
    shared = rows.groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high")).filter("low < high").select("key")
    return rows.join(shared, "key")


#: In each round, so many times more nodes of a meeting stand against all others; in the first it's the centre alone.
PIVOTS = 8


def closed(open_: DataFrame, nodes: DataFrame, texts: DataFrame, label: DataFrame, weights, settings: Settings) -> DataFrame:
    """``label`` after all links between nodes of ``open_`` that share a band.

    In each round some nodes of a meeting, the centre and others by hash, stand against those in other components,
    then leave it. A meeting ends when its nodes are in one component; the rounds grow with the logarithm of its size.
    """
    if not open_.take(1):
        return label
    entries, pivots = staged(meetings(open_, texts, weights)), 1
    bands = staged(nodes.join(open_, "n", "left_semi").select("n", "bands"))
    # Of the first shingle that two texts share, all they share comes after: both rests are as heavy as what must be shared.
    part = (settings.similarity - 1e-6) / (1 + settings.similarity - 1e-6)
    enough = F.least("rest", "other_rest") >= part * (F.col("total") + F.col("other_total"))
    while True:
        at = entries.join(label, "n", "left").select("key", "n", "total", "rest", F.coalesce("label", "n").alias("own"))
        several = at.groupBy("key").agg(F.min("own").alias("least"), F.max("own").alias("most")).filter("least < most").select("key")
        live = centred(at.join(several, "key"), "key")
        chosen = (F.col("n") == F.col("centre")) | (F.pmod(F.xxhash64("n"), F.col("size")) < pivots - 1)
        live = staged(live.select("key", "n", "total", "rest", "own", chosen.alias("pivot")))
        if not live.take(1):
            return label
        first = live.filter("pivot").select("key", F.col("n").alias("other"), F.col("own").alias("theirs"), F.col("total").alias("other_total"), F.col("rest").alias("other_rest"))
        first = first.withColumnRenamed("key", "their_key")
        met = live.join(first, (live["key"] == first["their_key"]) & (F.col("own") != F.col("theirs")) & (~F.col("pivot") | (F.col("n") < F.col("other"))) & enough)
        pairs = met.select(F.least("n", "other").alias("a"), F.greatest("n", "other").alias("b")).distinct()
        pairs = pairs.join(bands.select(F.col("n").alias("a"), F.col("bands").alias("bands_a")), "a").join(bands.select(F.col("n").alias("b"), F.col("bands").alias("bands_b")), "b")
        pairs = staged(pairs.filter(F.arrays_overlap("bands_a", "bands_b")).select("a", "b"))
        found = staged(verified(pairs, texts, weights, settings))
        if found.take(1):
            label = joined_labels(label, found)
        entries, pivots = live.filter("NOT pivot").select("key", "n", "total", "rest"), pivots * PIVOTS


#: Bits of the hash by which rows are passed over that can't be candidates; bounds what is broadcast.
PASS_BITS = 20


def candidate_texts(nodes: DataFrame, pairs: DataFrame, source: DataFrame) -> DataFrame:
    """n, text of every node in ``pairs``. A broadcast of at most 2**20 hash values keeps most other texts from being moved."""
    wanted = staged(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "n").select("n", "_node"))
    spot = F.pmod(F.xxhash64("_node"), F.lit(1 << PASS_BITS))
    passed = source.withColumn("_spot", spot).join(F.broadcast(wanted.select(spot.alias("_spot")).distinct()), "_spot", "left_semi")
    # One row of each text is enough; each task passes on one at most.
    first = passed.select("_node", "_text").dropDuplicates(["_node"])
    return first.join(wanted, "_node").select("n", F.coalesce("_text", F.lit("")).alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, weights, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    left = texts.select(F.col("n").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("n").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batch: pa.RecordBatch) -> list:
        held: dict[int, tuple] = {}
        names = [batch.column(i).to_pylist() for i in (0, 1)]
        for ids, column in zip(names, (2, 3)):
            new = {n: i for i, n in enumerate(ids) if n not in held}
            found = as_texts(batch.column(column).take(pa.array(list(new.values()), pa.int64())))
            for a, b in slices(found):
                shingles, own, counts = weights.value.of(found[a:b])
                cut = np.cumsum(counts)[:-1]
                held.update(zip(list(new)[a:b], zip(np.split(shingles, cut), np.split(own, cut))))
        good = [(a, b) for a, b in zip(*names) if similarity(held[a], held[b]) >= settings.similarity]
        return [list(c) for c in zip(*good)] if good else [[], []]

    return arrow_map(both, check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """n, label: the smallest node that each linked node is connected to.

    Every round takes the smallest label among neighbours, then the label of that label, so the rounds grow
    with the logarithm of the longest chain.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")))
    state = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    while True:
        near = both.join(state.select(F.col("n").alias("b"), "label"), "b").groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = state.join(near, "n").select("n", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = state.select(F.col("n").alias("label"), F.col("label").alias("beyond"))
        new = staged(step.join(jump, "label", "left").select("n", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        state = new.select("n", "label")
        if not new.filter("label < old").take(1):
            return state


def joined_labels(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (of ``components``) after more ``links``: only the components that these connect are looked at, each as one node."""
    a = label.select(F.col("n").alias("a"), F.col("label").alias("label_a"))
    b = label.select(F.col("n").alias("b"), F.col("label").alias("label_b"))
    ends = links.join(a, "a", "left").join(b, "b", "left")
    step = components(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a != b"))
    moved = step.select(F.col("n").alias("label"), F.col("label").alias("now"))
    known = label.join(moved, "label", "left").select("n", F.coalesce("now", "label").alias("label"))
    return staged(known.unionByName(step.join(label, "n", "left_anti")))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without all but one of each class, with its columns."""
    found = staged(classes(docs, text, key, settings))
    node = free_name(docs, "_node")
    gone = found.filter(~F.col("kept")).select(F.col("_key").alias("_gone_key"), F.col("_node").alias("_gone_node")).distinct()
    marked = docs.withColumn(node, text_key(text))
    out = marked.join(gone, (marked[node] == gone["_gone_node"]) & marked[f"`{key}`"].eqNullSafe(gone["_gone_key"]), "left_anti")
    kept = found.filter("kept")
    if kept.groupBy("_key", "_node").count().filter("count > 1").take(1):
        out = out.dropDuplicates([key, node])
    return out.select(*[f"`{c}`" for c in docs.columns])
