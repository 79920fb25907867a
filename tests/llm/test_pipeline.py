import pytest

import corpus_pipeline
from ledgerspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_return_every_row(spark, name):
    table = {"op3_neighbours": "embeddings", "op8_html_templates": "pages", "op11_whitening": "embeddings", "op13_centroids": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    found = QUERIES[name](spark, FOLDER)
    keys = {"op3_neighbours": ("query_id", "vec_id % 20 = 0", "vec_id"), "op8_html_templates": ("page_id", "true", "page_id"), "op11_whitening": ("vec_id", "true", "vec_id"), "op13_centroids": ("vec_id", "true", "vec_id")}.get(name, ("doc_id", "true", "doc_id"))
    wanted = sorted(r[0] for r in rows.filter(keys[1]).select(keys[2]).collect())
    got = sorted(r[0] for r in found.select(keys[0]).collect())
    assert sorted(set(got)) == wanted if name in ("op3_neighbours", "op9_packing", "op11_whitening") else got == wanted


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, FOLDER))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0] and counts[-1] == counts[-2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r[0] for r in last.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
