import random

import pytest

from ledgerspark.schema import LABEL_SCHEMA
from ledgerspark.sources import keyed_store
from ledgerspark.sources.keyed_store import KeyedStore
from ledgerspark.sources.tables import delete_folder, folder_names


def label(key, category, at="2024-01-01 00:00:00"):
    return (key, category, None, at, "Manual")


def held(store):
    return {r["Transaction_ID"]: r["Category"] for r in store.read().collect()}


@pytest.fixture
def made(spark, tmp_path):
    def make(rows, buckets=4):
        store = KeyedStore(spark, f"{tmp_path}/store", LABEL_SCHEMA, ("Transaction_ID",))
        store.create(spark.createDataFrame(rows, LABEL_SCHEMA), buckets)
        return store

    return make


@pytest.mark.parametrize("bound", [0, keyed_store.BROADCAST_BYTES])
def test_batches_and_compactions_in_any_order_agree_with_a_dictionary(spark, made, monkeypatch, bound):
    monkeypatch.setattr(keyed_store, "BROADCAST_BYTES", bound)
    chance = random.Random(5)
    plain = {f"T{i}": "old" for i in range(40)}
    store = made([label(k, c) for k, c in plain.items()], 8)
    for batch in range(6):
        puts = {f"T{chance.randrange(60)}": f"c{batch}" for _ in range(8)}
        gone = {f"T{chance.randrange(60)}" for _ in range(8)}
        store.change(
            spark.createDataFrame([label(k, c) for k, c in puts.items()], LABEL_SCHEMA),
            spark.createDataFrame([(k,) for k in gone], "Transaction_ID string"),
        )
        plain = {k: c for k, c in plain.items() if k not in gone} | puts
        if batch in (1, 3):
            assert store.compact(min_changes=3)
        if batch == 4:
            store.compact()
            store.clean()
        assert held(store) == plain
    assert store.read().count() == len(plain) and store.read().columns == LABEL_SCHEMA.fieldNames()


def test_only_buckets_with_changes_move_and_earlier_versions_stay(spark, made):
    store = made([label(f"T{i}", "old") for i in range(100)], 8)
    before = dict(store._manifest())
    earlier = store.read()
    store.change(spark.createDataFrame([label("T1", "new")], LABEL_SCHEMA))
    assert store.pending().count() == 1 and store.compact(min_changes=2) == []
    due = store.compact()
    after = store._manifest()
    assert len(due) == 1 and [b for b in after if after[b] != before[b]] == due
    assert store.compact() == [] and store.pending().count() == 0
    assert earlier.filter("Category = 'old'").count() == 100 and held(store)["T1"] == "new"


def test_the_last_change_counts_and_upserts_go_before_deletions(spark, made):
    store = made([label("A", "old"), label("A", "twin"), label("B", "old")])
    changes = [label("A", "z", "2024-01-02 00:00:00"), label("A", "a", "2024-01-03 00:00:00"), label("A", "y", "2024-01-01 00:00:00")]
    store.change(spark.createDataFrame(changes, LABEL_SCHEMA), spark.createDataFrame([("A",), ("B",), ("gone",)], "Transaction_ID string"), order="Date_Categorized")
    assert [(r["Transaction_ID"], r["Category"]) for r in store.read().collect()] == [("A", "a")]


def test_what_was_not_written_to_its_end_does_not_count(spark, made):
    store = made([label("A", "old")])
    number = store.change(spark.createDataFrame([label("A", "new")], LABEL_SCHEMA))
    delete_folder(spark, f"{store.base}/segment={number}/_SUCCESS")
    assert held(store) == {"A": "old"}
    assert store.change(spark.createDataFrame([label("A", "newer")], LABEL_SCHEMA)) == number + 1
    assert held(store) == {"A": "newer"}


def test_empty_tables_empty_batches_and_numbers_after_cleaning(spark, made):
    store = made([])
    assert held(store) == {} and store.compact() == []
    store.change(deletes=spark.createDataFrame([], "Transaction_ID string"))
    assert held(store) == {}
    store.change(spark.createDataFrame([label("A", "x")], LABEL_SCHEMA))
    store.compact()
    store.change(deletes=spark.createDataFrame([("A",)], "Transaction_ID string"))
    store.compact()
    store.clean()
    assert held(store) == {}
    assert store.change(spark.createDataFrame([label("B", "x")], LABEL_SCHEMA)) == 4 and held(store) == {"B": "x"}
    assert folder_names(spark, store.base, "segment=")[-1] == "segment=4"


def test_rows_stay_in_place_where_changes_are_few(spark, made, monkeypatch):
    store = made([label(f"T{i}", "old") for i in range(100)])
    store.change(spark.createDataFrame([label("T1", "new")], LABEL_SCHEMA))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [Transaction_ID" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(keyed_store, "BROADCAST_BYTES", 0)
    assert sorted(held(store).values()).count("new") == 1


def test_wrong_use_is_an_error(spark, made):
    store = made([label("A", "old")])
    with pytest.raises(ValueError):
        store.create(spark.createDataFrame([], LABEL_SCHEMA))
    with pytest.raises(ValueError):
        store.change()
    with pytest.raises(Exception, match="a row has no key"):
        store.change(spark.createDataFrame([label(None, "x")], LABEL_SCHEMA))
    assert held(store) == {"A": "old"}
