import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import forest, langid, near_duplicates, packing, pii, prefix_bpe, quality, rank_merge, sharding, templates
from ledgerspark.llm.queries import BYTE_BPE, MULTI_BPE, PATTERN

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _WORDS int"
ODD = ["", " ", None, "a  b\n\n c ", "don't  we'll<|endoftext|> x <|endoftext|>", "aaaaaaa" * 50, " " * 50 + "x", "日本語 한국어 🎉🎉\u00a0y", "==" * 40, "1234 ½ ٣", "\t\tif x:\n\treturn 'y'\r\n"]


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 0, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = docs(spark, ODD)
    return rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame([(None, "x y", None, None, None, None, None)], SCHEMA))


def test_tokens_agree_with_the_libraries(spark, odd):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    found = rank_merge.token_counts(odd, BYTE_BPE, PATTERN).collect()
    assert len(found) == len(ODD) + 4 and found[0]._WORDS == 1
    assert [r.n_tokens for r in found] == [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in found]
    texts = [t or "" for t in ODD]
    assert [prefix_bpe.unpacked(c) for c in packing.text_ids(texts, BYTE_BPE, PATTERN)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI_BPE, "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codes = prefix_bpe.encode_texts(texts, MULTI_BPE, PATTERN)
    assert [prefix_bpe.unpacked(c) for c in codes] == [other.encode_ordinary(t) for t in texts]
    assert [prefix_bpe.decode(c, MULTI_BPE, PATTERN).decode() for c in codes] == texts
    back = prefix_bpe.decoded(prefix_bpe.encoded(odd, MULTI_BPE, PATTERN), MULTI_BPE, PATTERN)
    assert sorted(bytes(r.bytes).decode() for r in back.collect() if r.doc_id in (3, 7)) == sorted([ODD[3], ODD[7]])


def test_prefixes_append_and_edit_like_a_new_table():
    ranks = prefix_bpe.Ranks.read(MULTI_BPE)
    draw = np.random.default_rng(1)
    data = bytes(draw.choice(np.frombuffer(b"the internationalisation of", np.uint8), 400))
    whole = prefix_bpe.Prefixes(ranks, data)
    grown = prefix_bpe.Prefixes(ranks, data[:150])
    grown.append(data[150:])
    assert grown.last == whole.last and b"".join(ranks.words[i] for i in whole.ids()) == data
    computed = grown.edit(10, 13, b"zebra")
    assert grown.last == prefix_bpe.Prefixes(ranks, data[:10] + b"zebra" + data[13:]).last and computed < len(data)


def test_packing_keeps_every_token_and_fills_sequences(spark, odd):
    rows = packing.pack(odd, BYTE_BPE, PATTERN, capacity=16, with_ids=True).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= 16 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 16) + 1
    assert packing.pack(odd.limit(0), BYTE_BPE, PATTERN).count() == 0


def test_fullest_is_the_largest_sum():
    draw = np.random.default_rng(2)
    for _ in range(50):
        have = {int(k): int(n) for k, n in zip(draw.integers(1, 30, 5), draw.integers(1, 4, 5))}
        sums = {0}
        for k, n in have.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= 40}
        taken = packing.fullest(sorted(have.items(), reverse=True), 40)
        assert sum(k * n for k, n in taken.items()) == max(sums) and all(n <= have[k] for k, n in taken.items())


@pytest.mark.parametrize("shards", [1, 7])
def test_shards_are_even_and_copies_meet(spark, shards):
    texts = ["hot"] * 60 + [None, ""] + [f"pair {i // 2}" for i in range(40)] + [f"single {i}" for i in range(38)]
    rows = sharding.sharded(docs(spark, texts), shards).collect()
    per = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and len(per) == shards and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    place = {r.doc_id: r.shard for r in rows}
    assert sum(place[62 + 2 * i] != place[63 + 2 * i] for i in range(20)) <= 2
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len(texts[r.doc_id] or "") + 16 for r in rows)


@pytest.mark.parametrize("texts, places", [([f"pair {i // 2}" for i in range(800)], 410), ([f"group {i // 100}" for i in range(600)] + [f"single {i}" for i in range(200)], 212), (["hot"] * 300 + [f"pair {i // 2}" for i in range(160)] + [f"single {i}" for i in range(340)], 424)])
def test_copies_meet_in_full_shards(spark, texts, places):
    rows = sharding.sharded(docs(spark, texts), 8).collect()
    per = collections.Counter(r.shard for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and set(per.values()) == {100}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(100)) for s in per)
    assert len({(texts[r.doc_id], r.shard) for r in rows}) <= places


def test_shards_of_nothing(spark):
    assert sharding.sharded(docs(spark, []), 5).count() == 0


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((900, 8))
    x[300:600] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0]), (None, [1.0] * 8), (20, x[20].tolist())]
    found = collections.defaultdict(list)
    for r in forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    ids, all_ = np.r_[np.arange(900), 20], np.vstack([x, x[20]])
    right = 0
    for q in range(0, 900, 20):
        score = (all_ * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        own = found[q][:20]
        assert all(abs(s - float(x[v] @ x[q])) < 1e-9 for v, s in own)
        right += len(set(ids[order]) & {v for v, _ in own})
    assert right >= 0.9 * 45 * 20 and not {2000, 2020, 2040, 2060} & set(found)
    assert [v for v, _ in found[0]] == list(range(300, 320))
    assert forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_of_held_out_texts():
    words = {"en": "the of and thing ther ing", "de": "der und ung schein keit", "fr": "le des eau tion été ç"}
    draw = np.random.default_rng(4)
    texts, langs = zip(*[(" ".join(draw.choice(w.split(), 30)), k) for k, w in words.items() for _ in range(60)])
    model = langid.fit(list(texts[::2] + texts[1::4]), list(langs[::2] + langs[1::4]))
    lang, score, rejected = model.predict(list(texts[3::4]) + ["", "12 34 !!"])
    assert lang == [*langs[3::4], "und", "und"] and rejected[-2:].all() and not rejected[:-2].any() and (score <= 1).all()
    assert langid.fit([], []).predict(["text"])[0] == ["und"]


def test_a_long_word_counts_like_short_ones(monkeypatch):
    texts = ["der und ung", "the of and"] * 40
    model = langid.fit(texts, ["de", "en"] * 40)
    given = [" ".join(f"the{i}" for i in range(50)), "ungund" * 300]
    whole = model.scores(given)
    monkeypatch.setattr(langid, "STEP_WORDS", 20)
    assert np.allclose(langid.fit(texts, ["de", "en"] * 40).scores(given), whole)


def test_languages_of_long_texts_are_learned(spark):
    words = {"en": "the of and thing ther ing", "de": "der und ung schein keit"}
    draw = np.random.default_rng(10)
    rows = [(i, " ".join(draw.choice(words[k].split(), 300 if k == "de" else 30)), k) for i, k in enumerate(["en", "de"] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(table, settings=langid.Settings(longest=400))
    assert model.languages == ["de", "en"] and model.predict([rows[1][1], rows[0][1]])[0] == ["de", "en"]
    assert langid.trained(table.filter("lang = 'de'"), settings=langid.Settings(longest=400)).languages == ["de"]


def test_documents_stay_where_no_language_is_known(spark):
    import corpus_pipeline

    table = docs(spark, ["some words", "12 34", None]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, table, "").collect()] == [0]


def test_languages_on_odd_rows(spark, odd):
    model = langid.trained(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert langid.identify(odd.limit(0), model).count() == 0


def test_personal_data_against_the_patterns(spark):
    text = "Mail a.b@x.example.com or call +1 (555) 555-0199, from 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111, token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\""
    table = docs(spark, [text] * 5 + ["clean words only", None, ""])
    model = pii.supervised(table)
    rows = {r.doc_id: r for r in pii.find(table, model).collect()}
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (1, 1, 1, 1)
    cut = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[0].spans.split(","))]
    assert cut[:4] == ["a.b@x.example.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 555-0199"] and "9f86d0" in cut[4]
    assert rows[5].spans == rows[6].spans == rows[7].spans == ""
    clean = {r.doc_id: r for r in pii.redact(table, model, length="n_chars").collect()}
    assert "example.com" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[5].text == "clean words only" and clean[6].text is None
    assert pii.find(table.limit(0), pii.supervised(table.limit(0))).count() == 0


def test_base_spans_are_those_of_the_patterns():
    draw = np.random.default_rng(8)
    for _ in range(3000):
        text = "".join(draw.choice(list("a1.2@.-+_ %9(b3"), int(draw.integers(1, 40))))
        plain = [(k, m.start(), m.end()) for k, p in pii.BASE.items() for m in p.finditer(text) if pii._passes(k, m[0])]
        assert pii.base_spans(text) == plain, text


def test_personal_data_in_very_long_runs():
    texts = ["a" * 400_000 + " x@y.de", "1" * 400_000 + " 10.0.0.1 x@y", "12-345-6789 " * 20_000, "a@" * 200_000 + "b.de", "+1" + " " * 400_000 + "+1 555 555 0199"]
    assert [len([s for s in pii.base_spans(t) if s[0] in ("email", "ip", "phone")]) for t in texts] == [1, 1, 0, 1, 1]
    assert all(len(pii.added_candidates(t, pii.base_spans(t))) <= 20_000 for t in texts)


def test_near_duplicates_against_brute_force(spark):
    draw = np.random.default_rng(5)
    word = lambda: "w" + str(draw.integers(0, 5000))
    base = [[word() for _ in range(120)] for _ in range(6)]
    passage = [word() for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for i, b in enumerate(base[:3]):
        for j in range(8):
            changed = list(b)
            changed[10 + 12 * j % 100] = word()
            texts.append(" ".join(changed))
    texts += [" ".join(passage + [word() for _ in range(90)]) for _ in range(10)] + [texts[0], texts[0], "", None, " ", "two words", "two  words"]
    rows = near_duplicates.classes(docs(spark, texts)).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (texts[i] or "") == (texts[j] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert {r._key: r.class_id for r in rows} == dict(enumerate(label))
    assert sum(r.kept for r in rows) == len(set(label))
    left = near_duplicates.deduplicated(docs(spark, texts))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(label)) and left.columns == docs(spark, texts).columns


@pytest.mark.parametrize("pivots", [1, 8])
def test_links_within_crowded_bands_are_found(spark, monkeypatch, pivots):
    monkeypatch.setattr(near_duplicates, "PIVOTS", pivots + 1)
    draw = np.random.default_rng(6)
    word = lambda: "w" + str(draw.integers(0, 10**6))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(60):
        own = [word() for _ in range(40)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + [word()])]
    texts = [texts[i] for i in draw.permutation(len(texts))]
    settings = near_duplicates.Settings(bands=2, rows=1)
    table = docs(spark, texts)
    weights = near_duplicates.weights_of(table, "text", settings)
    shingles, own, counts = weights.of(texts)
    bands = near_duplicates.Sampler(settings).bands(shingles, own, counts)
    cut = np.cumsum(counts)[:-1]
    sets = list(zip(np.split(shingles, cut), np.split(own, cut)))
    label, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if (bands[i] == bands[j]).any() and near_duplicates.similarity(sets[i], sets[j]) >= settings.similarity:
                low, high = sorted((label[i], label[j]))
                label, links = [low if x == high else x for x in label], links + 1
    assert links >= 50 and max(collections.Counter(bands[:, 0]).values()) > 20
    assert {r._key: r.class_id for r in near_duplicates.classes(table, settings=settings).collect()} == dict(enumerate(label))


def test_similar_texts_share_a_rare_shingle():
    draw = np.random.default_rng(7)
    settings = near_duplicates.Settings()
    weights = near_duplicates.Weights((1 + draw.random(settings.buckets) / 4).astype(np.float32), settings)
    for _ in range(200):
        words = [f"w{i}" for i in draw.integers(0, 60, 80)]
        other = [f"w{i}" if draw.random() < 0.03 else w for i, w in zip(draw.integers(0, 60, 80), words)]
        shingles, own, counts = weights.of([" ".join(words), " ".join(other)])
        a, b = (shingles[: counts[0]], own[: counts[0]]), (shingles[counts[0] :], own[counts[0] :])
        if near_duplicates.similarity(a, b) >= settings.similarity:
            assert set(near_duplicates.rare_shingles(*a, weights)) & set(near_duplicates.rare_shingles(*b, weights))


def test_copies_of_a_centre_are_one_class(spark):
    draw = np.random.default_rng(9)
    word = lambda: "w" + str(draw.integers(0, 10**6))
    centre = [word() for _ in range(300)]
    copies = []
    for _ in range(300):
        copies.append(list(centre))
        for place in draw.choice(300, 5, replace=False):
            copies[-1][place] = word()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in [centre, *copies]]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert np.mean([jaccard(sets[0], s) for s in sets[1:]]) > 0.84 and np.mean([jaccard(sets[1], s) < 0.8 for s in sets[2:]]) > 0.95
    texts = [" ".join(w) for w in copies]
    texts.insert(150, " ".join(centre))
    rows = near_duplicates.classes(docs(spark, texts)).collect()
    assert len(rows) == 301 and {r.class_texts for r in rows} == {301}


def test_near_duplicates_of_odd_rows(spark, odd):
    kept = near_duplicates.deduplicated(odd).collect()
    assert len(kept) == len({r.text or "" for r in odd.collect()})
    assert near_duplicates.deduplicated(odd.limit(0)).count() == 0
    named = near_duplicates.deduplicated(odd.selectExpr("*", "'own' AS _Node")).collect()
    assert len(named) == len(kept) and {r["_Node"] for r in named} == {"own"}


def test_weighted_samples_agree_as_often_as_texts_do():
    settings = near_duplicates.Settings(bands=100)
    weights = near_duplicates.Weights(np.ones(settings.buckets, np.float32), settings)
    a, b = [f"w{i}" for i in range(200)], [f"w{i}" for i in range(40, 240)]
    found = weights.of([" ".join(a), " ".join(b)])
    samples = near_duplicates.Sampler(settings).samples(*found)
    assert abs((samples[0] == samples[1]).mean() - (156 / 236)) < 0.08


def test_articles(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">Accept</div><article><h1>Head &amp; line</h1><p><b>One\n two<br><p>Three &lt;x&gt;</p><div class="comments"><p>me</p></div></article><aside>More</aside><form><p>mail</p></form><footer>&copy; x'
    plain = '<html><body><div class="menu">Home</div><div class="story"><p>Body {0}</p></div><div class="box">Same on all</div></body></html>'
    rows = [(1, "https://a.example/x", page), (2, "https://a.example/x", None), (3, None, ""), (3, None, "")] + [(10 + i, f"http://b.example/{i}", plain.replace("{0}", str(i))) for i in range(6)]
    found = {r.page_id: r for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Head & line\nOne two\nThree <x>" and found[1].n_chars == len(found[1].text)
    assert found[2].text == found[3].text == "" and all(found[10 + i].text == f"Body {i}" for i in range(6))


def host_pages(spark, source):
    rows = [(i, f"http://c.example/{i}", source.replace("{0}", str(i))) for i in range(6)]
    return {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_boxes_in_the_main_box_belong_to_the_article(spark):
    story = '<p>A, the longest of all{0}</p><ul><li>B{0}</li></ul><blockquote>C{0}</blockquote><div class="part"><p>D{0}</p><table><tr><td>E{0}</td></tr></table></div><div class="rest"><div>F{0}</div></div>'
    found = host_pages(spark, f'<html><body><div class="menu">Home</div><div class="story">{story}</div><div class="box">Same on all</div></body></html>')
    assert found == {i: "\n".join(f"{x}{i}" for x in ("A, the longest of all", *"BCDEF")) for i in range(6)}


def test_templates_decide_where_pages_have_articles(spark):
    cards = '<article class="card"><p>Card {0}a</p></article><article class="card"><p>Card {0}b</p></article>'
    found = host_pages(spark, f'<html><body>{cards}<div class="story"><p>Long story {{0}}</p><ul><li>Its list {{0}}</li></ul></div></body></html>')
    assert found == {i: f"Long story {i}\nIts list {i}" for i in range(6)}
    found = host_pages(spark, '<html><body><article><h1>Head {0}</h1><p>Body {0}</p><div class="x"><p>Same on all pages, and long</p></div></article><div class="y">Low {0}</div></body></html>')
    assert found == {i: f"Head {i}\nBody {i}" for i in range(6)}
    found = host_pages(spark, "<html><body><article><h1>One page</h1><p>Under several addresses</p></article></body></html>")
    assert set(found.values()) == {"One page\nUnder several addresses"}


def test_quality_against_plain_python(spark, odd):
    line = "one two three four five six seven eight nine ten"
    texts = [line, f"{line}\n{line}\n \n{line}", "a b c d e a b c d e a b", "## $$ x", None, " \t"]
    space = re.compile(r"[^\x20\x09-\x0D]+")
    for r in quality.judge(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        words = space.findall(t)
        seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) for j in range(5) if seen[tuple(words[i : i + 5])] > 1}
        lines = [x for x in t.split("\n") if space.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.kept and r.base_failed)
    assert quality.judge(odd).count() == odd.count() and quality.judge(odd.limit(0)).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good = "one two three four five six seven eight nine ten"
    texts, hosts = ["x"] * 90 + [good] * 10 + [good] * 100, ["bad"] * 100 + ["fine"] * 100
    kept = collections.Counter(r.source for r in quality.judge(docs(spark, texts, hosts)).filter("kept").collect())
    assert kept == {"fine": 100}
