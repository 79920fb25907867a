"""The whole pipeline on a small table with planted cases, every stage held against a plain version of itself."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from ledgerspark.llm.queries import BYTE_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PERSONAL = ["write to jane.doe@mail.example.org soon", "login from 192.168.7.12 failed", "paid by 4111 1111 1111 1111 today", "call +49 30 1234567 now"]


def words_of(draw, text, n):
    """A new text with the words of another, so it is in its language."""
    return draw.choices([w for w in text.split() if w.isalpha()], k=n)


def planted():
    draw = random.Random(11)
    base = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [tuple(r[c] for c in COLUMNS) for r in base]
    english = next(r["text"] for r in base if r["lang"] == "en" and len(r["text"]) > 3000)
    notes = collections.defaultdict(set)

    def add(kind, text, source, lang="en"):
        notes[kind].add(len(rows) + 100_000)
        rows.append((len(rows) + 100_000, text, lang, source, len(text or "")))

    for _ in range(20):
        add("short", "x y", "bad.example")
    for _ in range(2):
        add("of a bad host", " ".join(words_of(draw, english, 90)), "bad.example")
    for letters in ["abcdefghijklmnopqrstuvwxyz"] * 5 + ["αβγδεζηθικλμνξοπρστυφχψω"] * 3:
        add("noise", " ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(60)), "src1", None)
    centre = words_of(draw, english, 300)
    add("star", " ".join(centre), "src2")
    for i in range(12):
        copy = list(centre)
        for place in draw.sample(range(300), 5):
            copy[place] = f"{copy[place]}{'abcdefghijkl'[i]}"
        add("star", " ".join(copy), "src2")
    for _ in range(5):
        add("copy", base[0]["text"], "src3")
    for i in range(8):
        own = words_of(draw, english, 60)
        own.insert(30, PERSONAL[i % 4])
        add("personal", " ".join(own), "src4")
    add("empty", None, "src5")
    add("empty", "", "src5")
    add("no host", " ".join(words_of(draw, english, 60)), None)
    rows.append(rows[-1])
    return rows, notes


def quality(rows):
    """Kept rows: counts per row, then rates per host with a beta prior by the moments of the hosts' rates."""
    failed = []
    for _, text, *_ in rows:
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = collections.Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
        failed.append(len(words) < 10 or 100 * len(covered) > 20 * len(words))
    hosts = collections.defaultdict(list)
    for row, bad in zip(rows, failed):
        if row[3] is not None:
            hosts[row[3]].append(bad)
    rates = [sum(h) / len(h) for h in hosts.values()]
    mean = sum(rates) / len(rates)
    spread = sum((r - mean) ** 2 for r in rates) / (len(rates) - 1)
    size = sum(map(len, hosts.values())) / len(hosts)
    weight = min(mean * (1 - mean) / spread - 1, size) if 0 < spread < mean * (1 - mean) else 1.0
    rejected = {h for h, bad in hosts.items() if (sum(bad) + mean * weight) / (len(bad) + weight) > 0.6}
    return [row for row, bad in zip(rows, failed) if not bad and row[3] not in rejected]


def near_dedup(rows):
    """The first row of each component of links at a weighted Jaccard of 0.8, all pairs compared."""
    bags = []
    for _, text, *_ in rows:
        words = (text or "").split()
        bags.append(collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter())
    seen = collections.Counter(s for bag in bags for s in bag)
    idf = {s: 1 + math.log((1 + len(rows)) / (1 + n)) / math.log(2 + len(rows)) / 4 for s, n in seen.items()}
    label = list(range(len(rows)))
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            both = sum(min(a[s], b[s]) * idf[s] for s in a.keys() & b.keys())
            if (rows[i][1] or "") == (rows[j][1] or "") or both >= 0.8 * sum(max(a[s], b[s]) * idf[s] for s in a.keys() | b.keys()):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    groups = collections.defaultdict(list)
    for x, row in zip(label, rows):
        groups[x].append(row)
    return [min(g, key=lambda r: (r[0], hashlib.md5((r[1] or "").encode()).hexdigest())) for g in groups.values()]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def redaction(text):
    """Spans of the four patterns of the contract, overlapping ones as one, replaced by the kind of the first."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    spans = sorted((m.start(), m.end(), k) for k, (p, good) in kinds.items() for m in re.finditer(p, text) if good(m[0]))
    out, end = [], 0
    for i, (start, stop, kind) in enumerate(spans):
        if i == 0 or start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def test_every_stage_against_its_plain_version(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rows, notes = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    given = {}

    def noted(name, stage):
        def run(session, docs, folder):
            given[name] = [tuple(r) for r in docs.select(COLUMNS).collect()]
            return stage(session, docs, folder)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = lambda found: sorted(found, key=repr)
    assert order(given["quality_rules"]) == order(rows)

    good = quality(rows)
    assert order(given["language_id"]) == order(good)
    assert not {r[0] for r in good} & (notes["short"] | notes["of a bad host"] | notes["empty"]) and notes["noise"] < {r[0] for r in good}

    told = [r for r in good if r[0] not in notes["noise"]]
    assert order(given["near_dedup"]) == order(told)

    single = near_dedup(told)
    ids = {r[0] for r in single}
    assert order(given["pii_redaction"]) == order(single)
    assert len(ids & notes["star"]) == 1 and not ids & notes["copy"] and notes["personal"] <= ids and len(ids) == len(single)

    clean = {r[0]: r for r in given["sequence_packing"]}
    assert clean.keys() == ids
    compared = 0
    for key, text, *_ in single:
        assert clean[key][4] == len(clean[key][1])
        plain = redaction(text)
        if not re.search("[0-9]", plain):
            assert clean[key][1] == plain
            compared += 1
    assert compared > 0.8 * len(single) and all(re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", clean[k][1]) for k in notes["personal"])

    library = Tokenizer.from_file(BYTE_BPE)
    tokens = {k: [*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for k, r in clean.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == tokens.keys()
    for key, own in pieces.items():
        at = 0
        for i, r in enumerate(sorted(own, key=lambda r: r.piece)):
            ids = tokens[key][at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
            assert r.length == 2048 or i == 0
            at += r.length
        assert at == len(tokens[key]) and len(own) == -(-at // 2048)
    for own in sequences.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    bins = []
    for length in sorted((r.length for r in packed), reverse=True):
        place = next((i for i, held in enumerate(bins) if held + length <= 2048), None)
        if place is None:
            bins.append(length)
        else:
            bins[place] += length
    assert -(-sum(map(len, tokens.values())) // 2048) <= len(sequences) <= len(bins)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "", None, "s", 0)]])
def test_pipeline_on_tables_without_texts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
