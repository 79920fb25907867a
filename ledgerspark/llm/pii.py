"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span classifier is trained."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import arrow_map, as_texts, replaced

# The patterns of the four base kinds.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: What the classifier may add: kinds that no base pattern covers, found by broad patterns.
ADDED = {
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    "number": re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[\x20./-]?[0-9]{2,5}){1,5}(?![\w-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"),
}
KINDS = (*BASE, *ADDED)

# The same matches in linear time, however long a run of letters or digits is: an address is sought from its
# ``@``, and numbers from where digits begin, as a run that fails at its begin fails behind it too.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_HINT = re.compile(r"[0-9@]")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_KEYWORDS = {
    "account": re.compile(r"\b(iban|account|konto|compte|cuenta|bic)\b", re.I),
    "number": re.compile(r"\b(phone|tel|telephone|mobile|call|fax|ssn|passport|telefon|téléphone|teléfono)\b", re.I),
    "secret": re.compile(r"\b(token|key|api|secret|password|passwd|pwd|auth|bearer|credential)\w*", re.I),
    "email": re.compile(r"\b(e-?mail|mail|contact|write|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|addr|login|from)\b", re.I),
    "card": re.compile(r"\b(card|visa|credit|karte|carte|tarjeta|pay)\w*", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|mobile|call|fax|telefon|téléphone|teléfono)\b", re.I),
}
_AGAINST = re.compile(r"\b(isbn|ean|version|pages?|figure|table|section|sha|commit|revision|orders?|invoice|part|model|file|total|sum|since|year|https?|www|path)\b", re.I)
# Beginnings and endings that are well known for each kind.
_GAZETTEER = {
    "account": ("AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IT", "LI", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK"),
    "number": ("0", "(0"),
    "secret": ("AKIA", "ASIA", "sk-", "sk_", "pk_", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-"),
    "email": ("com", "org", "net", "edu", "gov", "de", "fr", "es", "io", "info"),
    "ip": ("10.", "127.", "172.", "192.168."),
    "card": ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65"),
    "phone": ("+1", "+31", "+33", "+34", "+39", "+41", "+43", "+44", "+49"),
}
_RUNS = re.compile(r"[0-9]+|[A-Z]?[a-z]+|[A-Z]+")
_WRITTEN = re.compile(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?0[0-9]{1,4}\)?(?:[\x20./-][0-9]{2,8}){1,4}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2(?:19|20)[0-9]{2}")

#: Code points before a span that the context labeler reads.
CONTEXT = 40

#: Share of a kind's spans that counts for the rates assumed in advance.
ANCHOR = 0.2

#: How often a labeler that votes is right, assumed in advance.
ASSUMED = 0.75

#: Share of true spans assumed in advance: one that no labeler speaks for is left alone.
RARE = 0.3

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = "".join(_DIGIT.findall(found))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at += 1


def base_spans(text: str) -> list[Span]:
    """The base spans by kind as listed, then by start: matches from the left that pass their check."""
    if not _HINT.search(text):
        return []
    spans = [("email", a, b) for a, b in _addresses(text)]
    patterns = {"ip": _IP, "card": BASE["card"]} | ({"phone": BASE["phone"]} if "+" in text else {})
    return spans + [(kind, m.start(), m.end()) for kind, pattern in patterns.items() for m in pattern.finditer(text) if _passes(kind, m[0])]


def added_candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans of the added kinds that touch no base span and no candidate of a kind before."""
    if not _DIGIT.search(text):
        return []
    spans, out = list(base), []
    for kind, pattern in ADDED.items():
        taken = [(a, b) for a, b, _ in _merged(spans)]
        for m in pattern.finditer(text):
            if kind == "secret" and not (_DIGIT.search(m[0]) and _LETTER.search(m[0])):
                continue
            if kind == "number" and not 6 <= len(_DIGIT.findall(m[0])) <= 20:
                continue
            # Of the spans that begin before this one ends, the last reaches furthest.
            before = bisect_left(taken, (m.end(), 0)) - 1
            if before < 0 or taken[before][1] <= m.start():
                out.append((kind, m.start(), m.end()))
        spans = [*base, *out]
    return out


def _checked(account: str) -> bool:
    """Length and check digits of an international account number: moved to the end, letters as 10 to 35, it leaves 1 of 97."""
    compact = account.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _shape(kind: str, found: str) -> int:
    """The regex labeler: the form of the span alone."""
    if kind in BASE:
        return 1
    if kind == "account":
        return 1 if _checked(found) else -1
    if kind == "secret":
        if len(found) in (32, 40, 64, 128) and not re.search(r"[^0-9a-f]", found):
            return 1
        # Drawn characters change between digits, large and small letters every second or third; words don't.
        run = len(found) / len(_RUNS.findall(found))
        return 1 if run < 3 else -1 if run > 4 else 0
    digits = len(_DIGIT.findall(found))
    groups = [len(g) for g in re.findall("[0-9]+", found)]
    # No line has more than 15 digits.
    if _DATE.fullmatch(found) or max(groups) < 3 or digits > 15 or (len(groups) == 2 and groups[0] == groups[1]):
        return -1
    return 1 if _WRITTEN.fullmatch(found) and 7 <= digits <= 13 else 0


def _known(kind: str, found: str) -> int:
    """The gazetteer labeler: beginnings and endings."""
    if kind == "email":
        return 1 if found.rsplit(".", 1)[-1].lower() in _GAZETTEER[kind] else 0
    if found.startswith(_GAZETTEER[kind]):
        return 1
    return -1 if kind == "account" or (kind == "number" and found.startswith(("978", "979", "19", "20"))) else 0


def _context(kind: str, text: str, start: int) -> int:
    """The context labeler: which sort of word stands nearer before the span."""
    before = text[max(0, start - CONTEXT) : start]
    last = lambda pattern: max((m.end() for m in pattern.finditer(before)), default=-1)
    good, bad = last(_KEYWORDS[kind]), last(_AGAINST)
    return (good > bad) - (bad > good)


def votes(text: str, span: Span) -> tuple[int, int, int]:
    """The regex, gazetteer and context labelers on one span: 1 for, -1 against, 0 without an opinion."""
    kind, start, end = span
    found = text[start:end]
    return _shape(kind, found), _known(kind, found), _context(kind, text, start)


def features(text: str, span: Span, given: tuple[int, int, int]) -> tuple[int, ...]:
    """What the classifier sees of a span beside its kind; each is 0 or 1."""
    kind, start, end = span
    found = text[start:end]
    digits = len(_DIGIT.findall(found))
    return (
        int(len(found) >= 20),
        int(len(found) >= 36),
        int(2 * digits >= len(found)),
        int(bool(re.search(r"[\x20./()_-]", found))),
        int(text[start - 1 : start] in ("'", '"', "=", ":")),
        *[int(v == x) for v in given for x in (1, -1)],
    )


FEATURES = 11


@dataclass
class Supervision:
    """What was learned. ``reliability[kind, labeler, truth]``: how often a labeler that votes on a span of that kind and truth is right.

    A labeler without an opinion says nothing either way; spans on which all are silent get the share ``RARE``.
    """

    prior: dict[str, float]
    reliability: np.ndarray
    weights: np.ndarray
    bias: float

    def posterior(self, kinds: list[str], given: np.ndarray) -> np.ndarray:
        prior = np.where(given.any(axis=1), [self.prior[k] for k in kinds], RARE)
        right = self.reliability[[KINDS.index(k) for k in kinds]]
        vote = given[:, :, None]
        # The chance of each vote if the span is false, and if it is true.
        chance = np.where(vote == 0, 1, np.where((vote > 0) == np.array([False, True]), right, 1 - right))
        false, true = np.log(chance).sum(axis=1).T
        return 1 / (1 + np.exp(np.clip(np.log(1 - prior) - np.log(prior) + false - true, -500, 500)))

    def probability(self, kinds: list[str], seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(kinds, seen) @ self.weights + self.bias, -500, 500)))


def inputs(kinds: list[str], seen: np.ndarray) -> np.ndarray:
    """The kind as indicators, and each feature for each kind."""
    which = np.array([[k == x for x in KINDS] for k in kinds], float).reshape(-1, len(KINDS))
    return np.hstack([which, (which[:, :, None] * seen.reshape(len(kinds), 1, -1)).reshape(len(kinds), -1)])


def learned(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 50, steps: int = 400) -> Supervision:
    """Expectation-maximisation over (kind, votes, features, count), then logistic regression on the soft labels.

    Both see counts only. Every rate is drawn towards that assumed in advance, with ``ANCHOR`` of the kind's spans (three at least),
    and no labeler counts as more often wrong than right: without this, kinds whose true spans come in two sorts, each known to one
    labeler, may settle with truth and error exchanged.
    """
    found = Supervision(dict.fromkeys(KINDS, RARE), np.full((len(KINDS), 3, 2), ASSUMED), np.zeros(len(KINDS) * (FEATURES + 1)), 0.0)
    if not patterns:
        return found
    kinds = [k for k, *_ in patterns]
    given, seen = np.array([v for _, v, *_ in patterns]), np.array([f for _, _, f, _ in patterns], float)
    n = np.array([c for *_, c in patterns], float)
    voted = given.any(axis=1)
    which = {k: np.array([x == k for x in kinds]) & voted for k in set(kinds)}
    for _ in range(rounds):
        truth = found.posterior(kinds, given)
        for k, own in which.items():
            held = max(3.0, ANCHOR * n[own].sum())
            found.prior[k] = float((n[own] @ truth[own] + held * RARE) / (n[own].sum() + held))
            for j in range(3):
                for t, share in enumerate((1 - truth[own], truth[own])):
                    weight, vote = n[own] * share, given[own, j]
                    right = weight @ (vote == (1 if t else -1)) + held * ASSUMED
                    found.reliability[KINDS.index(k), j, t] = np.clip(right / (weight @ (vote != 0) + held), 0.55, 0.99)
    truth, x, share = found.posterior(kinds, given), inputs(kinds, seen), np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(steps):
        error = (found.probability(kinds, seen) - truth) * share
        found.weights -= 8 * (x.T @ error + 1e-4 * found.weights)
        found.bias -= 8 * error.sum()
    return found


def supervised(docs: DataFrame, text: str = "text") -> Supervision:
    """Votes of all rows of ``docs``, counted by pattern in Spark: what comes to the driver doesn't grow with the rows.

    Null texts count as empty, repeated rows as often as they are there, long texts are searched whole; an empty table, or
    one without candidates, gives a model that adds no spans. Only ``text`` is read.
    """

    def count(batch: pa.RecordBatch) -> list:
        found: Counter = Counter()
        for t in as_texts(batch.column(0)):
            base = base_spans(t)
            found.update((s[0], v := votes(t, s), features(t, s, v)) for s in [*base, *added_candidates(t, base)])
        return [list(c) for c in zip(*[(k, list(v), list(f), n) for (k, v, f), n in found.items()])] if found else [[], [], [], []]

    each = arrow_map(docs.select(text), count, "kind string, votes array<int>, seen array<int>, n long")
    rows = each.groupBy("kind", "votes", "seen").agg(F.sum("n").alias("n")).collect()
    return learned(sorted((r["kind"], tuple(r["votes"]), tuple(r["seen"]), r["n"]) for r in rows))


def spans_of(text: str, model: Supervision, threshold: float = 0.5) -> tuple[list[Span], list[Span]]:
    """The base spans, and the candidates beyond them that the classifier accepts."""
    base = base_spans(text)
    more = added_candidates(text, base)
    if more:
        accepted = model.probability([k for k, *_ in more], np.array([features(text, s, votes(text, s)) for s in more], float)) >= threshold
        more = [s for s, ok in zip(more, accepted) if ok]
    return base, more


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in _merged(spans):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _merged(spans: list[Span]) -> Iterator[tuple[int, int, str]]:
    held = None
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if held and start < held[1]:
            held = (held[0], max(end, held[1]), held[2])
        else:
            if held:
                yield held
            held = (start, end, kind)
    if held:
        yield held


def find(docs: DataFrame, model: Supervision, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256 and spans per row; null texts count as empty and have none.

    Each row is searched by itself and as a whole, so repeated rows, null keys and long texts need no care; an
    empty table gives an empty result. Other columns are left out, so their names don't matter.
    """
    df = docs.select(key, text)
    schema = T.StructType([df.schema.fields[0], *[T.StructField(f"n_{k}", T.LongType()) for k in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def search(batch: pa.RecordBatch) -> list:
        rows = []
        for t in as_texts(batch.column(1)):
            base, more = spans_of(t, model, threshold)
            kinds = [k for k, *_ in base]
            rows.append((*[kinds.count(k) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more])))
        return [batch.column(0), *[list(c) for c in zip(*rows)]]

    return arrow_map(df, search, schema)


def redact(docs: DataFrame, model: Supervision, text: str = "text", length: str | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with spans in ``text`` replaced by their kind; null stays null. ``length`` names a column for the new number of code points.

    If ``docs`` has no such column, none is added. Repeated rows stay repeated, an empty table stays empty,
    whole texts are searched whatever their length, and all other columns stay as they are.
    """
    length = length if length in docs.columns else None
    place = docs.columns.index(text)

    def replace(batch: pa.RecordBatch) -> list:
        texts = [t if t is None else redacted(t, [s for part in spans_of(t, model, threshold) for s in part]) for t in batch.column(place).to_pylist()]
        return [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]

    out = arrow_map(docs, replace, docs.schema)
    return replaced(out, **{length: F.length(text).cast(docs.schema[length].dataType)}).select(docs.columns) if length else out
