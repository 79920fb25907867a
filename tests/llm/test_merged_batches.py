"""Small Arrow batches are put together before texts are encoded."""

import pyarrow as pa

from ledgerspark.llm import common


def test_batches_are_merged_up_to_a_size():
    found = [pa.RecordBatch.from_pydict({"x": pa.array(range(i, i + n), pa.int64())}) for i, n in ((0, 3), (3, 0), (3, 3), (6, 1), (7, 50), (57, 2))]
    merged = list(common.merged(iter(found), 48))
    assert [b.num_rows for b in merged] == [6, 51, 2]
    assert [x for b in merged for x in b.column(0).to_pylist()] == list(range(59))
    assert list(common.merged(iter(found[1:2]), 48)) == []


def test_encoding_sees_merged_batches(spark, monkeypatch):
    df = spark.range(2000, numPartitions=1).selectExpr("cast(id AS string) AS t")
    rows = common.arrow_map(df, lambda batch: [pa.array([batch.num_rows])], "n long", 1 << 20).collect()
    assert [r.n for r in rows] == [2000]
