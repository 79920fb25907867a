import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import centroids, token_files, vectors, whitening
from ledgerspark.llm.queries import BYTE_BPE, PATTERN, QUERIES

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, n int, x string, cluster int, component int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 7, 8, 9) for i, v in rows], VECTORS)


def drawn(n, d, seed=1):
    draw = np.random.default_rng(seed)
    return (draw.standard_normal((n, d)) @ draw.standard_normal((d, d)) / 4).astype(np.float32)


def odd_rows(d):
    """Vectors that take no part."""
    bad = [1.0] * d
    return [(901, None), (902, [None, *bad[1:]]), (903, [math.nan, *bad[1:]]), (904, [math.inf, *bad[1:]]), (905, [-math.inf, *bad[1:]])]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["random", "diagonal", "equal", "split", "graded", "zero"])
def test_eigenvectors_agree_with_a_library(n, kind):
    draw = np.random.default_rng(n)
    a = draw.standard_normal((n, n))
    a = {"random": a @ a.T, "diagonal": np.diag(draw.random(n)), "equal": np.eye(n) * 3, "split": np.kron(np.eye(n), [[2.0, 1.0], [1.0, 2.0]]), "graded": (a * 10.0 ** -np.arange(n)) @ (a * 10.0 ** -np.arange(n)).T, "zero": np.zeros((n, n))}[kind]
    k = len(a)
    values, vecs = whitening.eigen(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * max(1, np.abs(a).max() * k), rtol=0)
    assert np.abs(vecs @ vecs.T - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vecs.T - vecs.T * values).max() <= 1e-13 * k * max(1.0, np.abs(a).max())


def test_whitening_agrees_with_exact_figures(spark):
    d, data = 40, drawn(150, 40)
    rows = [(i if i else None, v.tolist()) for i, v in enumerate(data)] + [(7, data[7].tolist())] * 3
    found = whitening.whitened(table(spark, rows + odd_rows(d)).repartition(5)).collect()
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert len(found) == n * 32 and {r.n for r in found} == {n}
    far = {}
    for (i, _), v in zip(rows, x):
        far[i] = sum((n * a - s) ** 2 for a, s in zip(v, sums))
    assert all(r.deviation == far[r.vec_id] for r in found)
    centred = [[Fraction(n * a - s, n) for a, s in zip(v, sums)] for v in x]
    real = np.array([[float(a) for a in v] for v in centred])
    cov = real.T @ real / n
    values = np.linalg.eigvalsh(cov)[::-1]
    assert all(math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9) for r in found)
    white = np.zeros((n, 32))
    used = {}
    place = {}
    for at, (i, _) in enumerate(rows):
        place.setdefault(i, []).append(at)
    for r in found:
        k = used.setdefault((r.vec_id, r.component), 0)
        used[r.vec_id, r.component] += 1
        white[place[r.vec_id][k], r.component - 1] = r.whitened
    spread = white.T @ white / n
    assert np.abs(spread - np.eye(32)).max() < 1e-9 and {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9
    # The coordinates are those along eigenvectors: the covariance with the data gives them back.
    axes = white.T @ real / n / np.sqrt(values[:32])[:, None]
    assert np.abs(cov @ axes.T - axes.T * values[:32]).max() < 1e-9 * values[0]


def test_whitening_of_few_and_flat_vectors(spark):
    assert whitening.whitened(table(spark, odd_rows(3))).collect() == []
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, []), (2, [])])).collect() == []
    one = whitening.whitened(table(spark, [(1, [0.5, 2.0])] * 2)).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(1, None, 0.0, 0, 0.0), (2, None, 0.0, 0, 0.0)] * 2
    line = whitening.whitened(table(spark, [(1, [0.0, 1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [2.0, 1.0, 2.0])])).orderBy("component", "vec_id").collect()
    assert [r.whitened is None for r in line] == [False] * 3 + [True] * 6 and line[0].identity_error < 1e-12
    assert np.allclose([abs(r.whitened) for r in line[:3]], [math.sqrt(1.5), 0, math.sqrt(1.5)], atol=1e-12)
    with pytest.raises(Exception, match="components"):
        whitening.whitened(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]).coalesce(1))
    with pytest.raises(Exception, match="components"):
        whitening.whitened(table(spark, [(i, [1.0] * (1 + i // 50)) for i in range(100)]).repartitionByRange(8, "vec_id"))


def test_exact_figures_beyond_the_range_of_doubles():
    rows = np.array([[3 << 40, -5], [7, 1 << 45]])
    assert vectors.gram(rows).tolist() == [[sum(int(a) * int(b) for a, b in zip(rows[:, i], rows[:, j])) for j in range(2)] for i in range(2)]
    w = whitening.Whitening(10**9, [10**9 * 5 + 3, -7], np.eye(2), 2)
    assert w.deviations(np.array([[5, 0], [9, 0], [40, 2]])) == [9 + 49, (4 * 10**9 - 3) ** 2 + 49 if (4 * 10**9 - 3) ** 2 + 49 < 1 << 63 else None, None]
    far = np.array([[1 << 49, 0], [0, 1]])
    assert centroids.distances(far, np.array([[-(1 << 49), 0]])).tolist() == [[1 << 100], [(1 << 98) + 1]]


def plain_clusters(rows, k=40, rounds=5):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in rows:
            own[nearest(v)[1]].append(v)
        centres = [[sum(c) // len(vs) for c in zip(*vs)] if vs else centre for vs, centre in zip(own, centres)]
    got = [(i, *nearest(v)[::-1]) for i, v in rows]
    sums = {}
    for _, j, far in got:
        sums[j] = sums.get(j, 0) + far
    return [(i, j, far, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, far in got]


def order(rows):
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in map(tuple, rows))


def test_clusters_agree_with_a_plain_version(spark):
    data = drawn(180, 64, 3)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(5, data[5].tolist())] * 40 + [(300 + i, [0.25] * 64) for i in range(30)] + [(None, [0.5] * 64)]
    found = centroids.clustered(table(spark, rows + odd_rows(64) + [(906, [1.0] * 63), (907, [])]).repartition(6))
    assert order(found.collect()) == order(plain_clusters(rows))
    few = rows[:7] + [(None, data[9].tolist())]
    assert order(centroids.clustered(table(spark, few)).collect()) == order(plain_clusters(few))
    assert centroids.clustered(table(spark, odd_rows(64))).collect() == []


def test_vector_queries_on_a_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert order(QUERIES["op13_centroids"](spark, FOLDER).collect()) == order(plain_clusters(rows))
    white = QUERIES["op11_whitening"](spark, FOLDER)
    assert white.count() == len(rows) * min(32, len(rows[0][1])) and white.agg(F.max("identity_error")).first()[0] < 1e-6


TEXTS = ["", " ", None, "a  b\n\n c ", "don't  we'll<|endoftext|> x <|endoftext|>", "aaaaaaa" * 50, "日本語 한국어 🎉🎉\u00a0y", "1234 ½ ٣", "\t\tif x:\n\treturn 'y'\r\n", "long words and text " * 9000, "<|endoftext|>"]


def plain_tokens(rows):
    from tokenizers import Tokenizer

    library, out, start = Tokenizer.from_file(BYTE_BPE), [], 0
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    schema = "doc_id long, text string, ids string, shard int, start int, n_tokens string, first int"
    rows = [(1000 - 7 * i, t, "k", 1, 2, "3", 4) for i, t in enumerate(TEXTS * 12)]
    return spark.createDataFrame(rows, schema).repartition(9), sorted((r[0], r[1]) for r in rows)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_hold_the_ids_in_order(spark, texts, tmp_path, encoding):
    docs, rows = texts
    path = str(tmp_path / encoding)
    # Small partitions would be put together into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write(docs, path, BYTE_BPE, PATTERN, layout=token_files.Layout(encoding, row_group_bytes=64 << 10, page_bytes=8 << 10, page_rows=5))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = plain_tokens(rows)
    assert [tuple(r) for r in token_files.digests(token_files.read(spark, path)).orderBy("doc_id").collect()] == wanted
    files = [pq.ParquetFile(f) for f in sorted((tmp_path / encoding / "tokens").glob("*.parquet"))]
    ends = []
    for file in filter(lambda f: f.metadata.num_rows, files):
        own = file.read()["doc_id"].to_pylist()
        ends.append((own[0], own[-1]))
        assert own == sorted(own)
        column = file.metadata.row_group(0).column(4)
        assert column.path_in_schema == "ids.list.element" and column.has_offset_index and file.metadata.row_group(0).column(1).has_column_index
        assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary") and any("DELTA" in e for e in column.encodings) == (encoding == "delta")
    assert sorted(ends) == sorted(ends, key=lambda e: e[1]) and len(ends) > 1
    # Metadata alone, and some documents alone.
    told = token_files.read(spark, path, columns=("doc_id", "start", "n_tokens"))
    assert "ids" not in told._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert sorted(tuple(r) for r in told.collect()) == sorted(w[:3] for w in wanted)
    some = token_files.read(spark, path, where=F.col("doc_id").between(300, 400))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,300)" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in token_files.digests(some).collect()) == [w for w in wanted if 300 <= w[0] <= 400]


def test_bulk_ids_agree_with_the_library(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from ledgerspark.llm import bulk_ids

    library, draw = Tokenizer.from_file(BYTE_BPE), np.random.default_rng(4)
    parts = [" ", " ", " ", "a", "b.", "word", "don't", "'s", ".", ",", "\n", "\t", "  ", "é", "日本", "<|endoftext|>", "1", "½", "%%", "\u00a0", "\u2003", "x" * 20]
    texts = ["".join(draw.choice(parts, draw.integers(0, 15))) for _ in range(4000)]
    texts[7] = None
    # Few chunks are remembered, and steps are short, so that both are renewed.
    monkeypatch.setattr(bulk_ids, "CHUNKS", 300)
    monkeypatch.setattr(bulk_ids, "STEP_BYTES", 2000)
    ids, counts = bulk_ids.ended_ids(pa.array(texts), BYTE_BPE, PATTERN, 2)
    wanted = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_token_files_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string"
    path = str(tmp_path / "none")
    token_files.write(spark.createDataFrame([], schema), path, BYTE_BPE, PATTERN)
    assert token_files.digests(token_files.read(spark, path)).collect() == []
    rows = [(5, "same text")] * 400 + [(5, "b"), (5, "other words"), (None, "x"), (None, None), (1, "y")]
    path = str(tmp_path / "ties")
    token_files.write(spark.createDataFrame(rows, schema), path, BYTE_BPE, PATTERN)
    found = sorted(map(tuple, token_files.digests(token_files.read(spark, path)).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, 1] + [5] * 402
    assert [r[1] for r in found] == np.r_[0, np.cumsum([r[2] for r in found])[:-1]].tolist()
    assert sorted((r[2], r[3]) for r in found) == sorted(w[2:] for w in plain_tokens(rows))
    with pytest.raises(ValueError):
        token_files.Layout("other").options()


def test_token_query_on_a_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, FOLDER).collect())) == plain_tokens(rows)
