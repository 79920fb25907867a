"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import arrow_map, as_texts, mixed, replaced, slices

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

#: Words whose sums are remembered in a task at most.
CACHE_WORDS = 100_000

#: Characters of new words that are looked up at once; a longer word is counted by bucket.
STEP_WORDS = 1 << 16


@dataclass(frozen=True)
class Settings:
    """The training sample has about ``sample`` rows at most, the same number for each language. Texts up to ``longest``
    characters come first; where a language has too few, so much of longer ones, from a place chosen by hash.

    One more class stands for what is no known language; it is learned from made-up texts, ``noise`` times as many as a
    language has. A text is rejected if its calibrated score is below the lowest one at which accepted texts
    (made-up ones among them) are right with ``precision``, but of the texts told rightly only ``lost`` may
    go, and none that is more likely in its language than not; and in any case below ``floor`` times the score of a blind guess. Every text is learned from a
    second time as a passage of ``passage`` characters at most, as short texts look different. Small samples are gone
    through more often, for ``steps`` in all.
    """

    sample: int = 1600
    longest: int = 20_000
    buckets: int = 1 << 15
    width: int = 16
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    epochs: int = 6
    rate: float = 1.0
    boost: float = 2.0
    batch: int = 32
    steps: int = 240
    noise: int = 2
    passage: int = 120
    precision: float = 0.995
    lost: float = 0.004
    floor: float = 1.2
    seed: int = 5


def subwords(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of ``<word>``, word after word, and how many each word has."""
    data = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(data)), np.fromiter(map(len, data), np.int64, len(data)))
    code, owners, buckets = np.zeros(len(raw), np.uint64), [], []
    for n in range(1, max(settings.sizes) + 1):
        code = code[: len(raw) - n + 1] * np.uint64(257) + raw[n - 1 :]
        if n in settings.sizes and len(code):
            inside = owner[: len(code)] == owner[n - 1 :]
            buckets.append(mixed(code[inside] + np.uint64(n << 56)) % np.uint64(settings.buckets))
            owners.append(owner[: len(code)][inside])
    owner, bucket = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    return bucket[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """``table``: per bucket its embedding times the output layer; averaging and the layer are both linear.

    Its last column is the class of texts in no known language, if there are languages.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings
    _rows: dict[str, int] = field(default_factory=dict)
    _sums: np.ndarray | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities of the languages, and last that of none; texts without subwords get those of the bias."""
        width = len(self.bias)
        out = np.zeros((len(texts), width))
        for start, end in slices(texts):
            words = [t.lower().split() for t in texts[start:end]]
            if self._sums is None or len(self._rows) > CACHE_WORDS:
                self._rows, self._sums = {}, np.empty((0, width + 1))
            new = list(set(filterfalse(self._rows.__contains__, chain.from_iterable(words))))
            if new:
                self._rows.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
                self._sums = np.concatenate([self._sums, *[self._summed(new[a:b]) for a, b in slices(new, STEP_WORDS)]])
            for i, own in enumerate(words, start):
                total = self._sums[list(map(self._rows.__getitem__, own))].sum(axis=0) if own else np.zeros(width + 1)
                out[i] = total[:-1] / max(total[-1], 1) + self.bias
        return softmax(out / self.temperature)

    def _summed(self, words: list[str]) -> np.ndarray:
        """Per word the sum of its subwords' rows, and their number."""
        bucket, counts = subwords(words, self.settings)
        if len(words) == 1:
            return np.r_[np.bincount(bucket, minlength=self.settings.buckets) @ self.table, counts][None]
        return np.column_stack([np.add.reduceat(self.table[bucket], np.cumsum(counts) - counts), counts])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether the text is rejected; ``und`` with score 0 for texts without a letter, or all if no language is known."""
        scores = self.scores(texts)[:, :-1] if self.languages else np.zeros((len(texts), 1))
        letters = np.array([bool(_LETTER.search(t)) for t in texts], bool)
        best = scores.argmax(axis=1)
        score = np.where(letters, scores[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if ok and self.languages else UNKNOWN for b, ok in zip(best, letters)], np.clip(score, 0, 1), ~letters | (score < self.threshold)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": {}, "_sums": None}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def made_up(texts: list[str], n: int, draw: np.random.Generator) -> list[str]:
    """``n`` texts in no language, as long as texts that are given: shuffled letters of a text, letters of all
    texts at random, letters of a stretch of Unicode that stands for another script, and printable characters.

    Letters have even or falling shares, words between 1 and 12 letters.
    """
    own = sorted({c for t in texts for c in t[:2000].lower() if c.isalpha()}) or ["a"]
    out = []
    for i in range(n):
        length = int(min(len(texts[draw.integers(len(texts))]), 2000)) + 1
        if i % 5 < 2:
            source = texts[draw.integers(len(texts))][:2000]
            out.append("".join(draw.permutation(list(source or "a"))))
            continue
        letters = own
        if i % 5 == 3:
            letters = []
            while len(letters) < 20:
                start, width = int(draw.integers(0x250, 0xFFFF)), int(draw.choice([40, 80, 3000]))
                letters = [chr(c) for c in range(start, min(start + width, 0xD800 if start < 0xD800 else 0x10000)) if chr(c).isalpha()]
        elif i % 5 == 4:
            letters = [chr(c) for c in range(0x21, 0x7F)]
        letters = list(draw.permutation(letters))
        weight = np.ones(len(letters)) if draw.random() < 0.5 else 1 / np.arange(1, len(letters) + 1)
        drawn = draw.choice(letters, length, p=weight / weight.sum())
        ends = np.cumsum(draw.integers(1, 13, length))
        out.append(" ".join("".join(w) for w in np.split(drawn, ends[ends < length])))
    return out


def fit(texts: list[str], languages: list[str], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent on four fifths of the rows; temperature and threshold come from the last fifth.

    Only texts with a letter count. Without any, the model knows no language and rejects only texts without a letter.
    """
    rows = [(t, x) for t, x in zip(texts, languages) if _LETTER.search(t)]
    names = sorted({x for _, x in rows})
    model = Model(names, np.zeros((settings.buckets, len(names) + 1)), np.zeros(len(names) + 1), 1.0, 0.0, settings)
    if not names:
        return model
    draw = np.random.default_rng(settings.seed)
    none = settings.noise * max(1, len(rows) // len(names))
    label = np.array([names.index(x) for _, x in rows] + [len(names)] * none)
    whole = [t for t, _ in rows] + made_up([t for t, _ in rows], none, draw)
    order = draw.permutation(len(whole))
    held, used = order[: len(whole) // 5], order[len(whole) // 5 :]
    passages = []
    for text in whole:
        size = int(draw.integers(settings.passage // 6, settings.passage))
        start = int(draw.integers(max(1, len(text) - size)))
        # Whole words, if there are any.
        passages.append(" ".join(text[start : start + size].split(" ")[1:-1]) or text[start : start + size])
    label, used, count = np.r_[label, label], np.r_[used, used + len(whole)], len(names) + 1
    features = []
    for text in [*whole, *passages]:
        bucket, n = np.unique(subwords(text.lower().split() or [""], settings)[0], return_counts=True)
        features.append((bucket, n / n.sum()))
    embedding = draw.standard_normal((settings.buckets, settings.width)) / settings.width
    layer, bias = draw.standard_normal((settings.width, count)) / settings.width, np.zeros(count)
    epochs = max(settings.epochs, -(-settings.steps * settings.batch // len(used)))
    for epoch in range(epochs):
        rate = settings.rate * (1 - epoch / epochs)
        for part in np.array_split(draw.permutation(used), max(1, len(used) // settings.batch)):
            bucket, weight = (np.concatenate(x) for x in zip(*[features[i] for i in part]))
            sizes = np.array([len(features[i][0]) for i in part])
            hidden = np.add.reduceat(embedding[bucket] * weight[:, None], np.cumsum(sizes) - sizes)
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(part)), label[part]] -= 1
            # A weight is one part in hundreds, so embeddings take larger steps than the layer.
            step = settings.boost * rate * weight[:, None] * np.repeat(error @ layer.T, sizes, axis=0)
            layer -= rate * hidden.T @ error / len(part)
            bias -= 0.1 * rate * error.mean(axis=0)
            np.subtract.at(embedding, bucket, step)
    model.table, model.bias = embedding @ layer, bias
    calibrate(model, [t for i in held for t in (whole[i], passages[i])], np.repeat(label[held], 2))
    return model


def calibrate(model: Model, texts: list[str], label: np.ndarray) -> None:
    """The temperature with the least log loss, and the threshold of rejection; texts in no language have the last label."""
    if not texts:
        return
    raw = np.log(np.maximum(model.scores(texts), 1e-300))
    loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(label)), label], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.02, 20, 200), key=loss))
    scores = softmax(raw / model.temperature)[:, :-1]
    top, right = scores.max(axis=1), scores.argmax(axis=1) == label
    order = np.argsort(-top, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= model.settings.precision)
    lowest = 0.0 if len(good) and good[-1] == len(order) - 1 else top[order][good[-1]] if len(good) else 1.0
    spared = np.quantile(top[right], model.settings.lost) if right.any() else 1.0
    model.threshold = float(max(model.settings.floor / (len(model.languages) + 1), min(lowest, spared, 0.5)))


def held_out(key: str) -> F.Column:
    """Rows that are never learned from; a row without a key is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model from a sample of the labelled rows that aren't held out, chosen by a hash of the key."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("key"), held_out(key).alias("held"))
    rows = rows.filter(~F.col("held") & F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    length, unit = F.length("text"), 1 << 30
    rows = rows.withColumn("long", length > settings.longest)
    counts = {(r["lang"], r["long"]): r["n"] for r in rows.groupBy("lang", "long").agg(F.count("*").alias("n")).collect()}
    names = {k for k, _ in counts}
    if not names:
        return fit([], [], settings)
    each, limits = max(1, settings.sample // len(names)), []
    for k in names:
        short = min(each, counts.get((k, False), 0))
        for long, wanted in ((False, short), (True, each - short)):
            limits.append((F.struct(F.lit(k).alias("lang"), F.lit(long).alias("long")), int(min(1.0, wanted / max(1, counts.get((k, long), 0))) * unit)))
    shares = F.create_map(*[x for k, n in limits for x in (k, F.lit(n))])
    begin = F.when(F.col("long"), F.pmod(F.xxhash64("key", F.lit(settings.seed)), length - settings.longest + 1)).otherwise(0).cast("int") + 1
    rows = rows.filter(F.pmod(F.xxhash64("key"), F.lit(unit)) < shares[F.struct("lang", "long")])
    chosen = rows.select(F.substring("text", begin, F.lit(settings.longest)).alias("text"), "lang").collect()
    chosen = sorted((r["text"], r["lang"]) for r in chosen)
    return fit([t for t, _ in chosen], [x for _, x in chosen], settings)


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with held_out, lang_pred, score and rejected; its own columns of these names go.

    Whole texts count. Null texts and texts without a letter get ``und`` with score 0 and are rejected. Each row
    is told by itself, so repeated rows agree and null keys are fine; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = replaced(docs, held_out=held_out(key))
    base = base.drop(*[c for c in base.columns if c.lower() in ("lang_pred", "score", "rejected")])
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    place = base.columns.index(text)

    def predict(batch: pa.RecordBatch) -> list:
        lang, score, rejected = shared.value.predict(as_texts(batch.column(place)))
        return [*batch.columns, lang, pa.array(score), pa.array(rejected)]

    return arrow_map(base, predict, schema)
