import datetime as dt
import hashlib

from pyspark.sql import functions as F

from ledgerspark.operators import identity, normalize
from ledgerspark.schema import LAYOUT_A

SCHEMA = "Date timestamp_ntz, Amount double, Description string, Counterparty_Name string, Account_Number string, Sequence_Number bigint, Source_File string"


def test_ids_are_the_md5_of_six_fields(spark):
    rows = [
        (dt.datetime(2025, 10, 5), -12.5, "a b", "Shop", "NL01", 7, "f1"),
        (None, None, "", None, None, None, "f1"),
        (dt.datetime(2025, 1, 1, 10, 0, 0), 1234567.0, "x", "y", "z", 12345678901, "f1"),
    ]
    texts = [
        "2025-10-05 00:00:00|-12.5|a b|Shop|NL01|7",
        "NaT|nan||nan|nan|nan",
        "2025-01-01 10:00:00|1234567.0|x|y|z|12345678901",
    ]
    df = identity.with_transaction_id(spark.createDataFrame(rows, SCHEMA), "key")
    assert df.columns[0] == "Transaction_ID"
    found = {(r["Transaction_ID"], r["key"]) for r in df.collect()}
    digests = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    assert found == {(f"TXN_{d[:8].upper()}", d) for d in digests}


def test_absent_columns_hash_as_empty_text(spark):
    df = identity.with_transaction_id(spark.createDataFrame([("x",)], "Description string"))
    expected = hashlib.md5(b"||x|||").hexdigest()[:8].upper()
    assert df.first()["Transaction_ID"] == f"TXN_{expected}"


def sample(spark):
    """Copies, near copies (other file) and singles under one ID each."""
    rows = [("A", 1, "f1")] * 7 + [("A", 1, "f2")] * 3 + [("A", 2, "f1")] + [("B", 1, "f1")] + [("C", 1, "f1"), ("C", 1, "f2")]
    return spark.createDataFrame(rows, "Transaction_ID string, v int, Source_File string")


def test_suffixes_are_a_gapless_count_per_id(spark, monkeypatch):
    monkeypatch.setattr(identity, "COPIES_PER_SLICE", 2)
    df = sample(spark)
    done = identity.with_unique_ids(df)
    ids = sorted(r["Transaction_ID"] for r in done.collect())
    assert ids == sorted(["A", *[f"A_{i}" for i in range(1, 11)], "B", "C", "C_1"])
    assert done.columns == df.columns
    before = df.groupBy("v", "Source_File").count().collect()
    after = done.groupBy("v", "Source_File").count().collect()
    assert sorted(before) == sorted(after)
    assert identity.duplicate_id_count(df).first()[0] == 11
    assert identity.duplicate_id_count(done).first()[0] == 0


def test_suffixes_do_not_depend_on_row_order(spark):
    df = sample(spark)
    one = identity.with_unique_ids(df).collect()
    other = identity.with_unique_ids(df.repartition(5, "v").orderBy(F.rand(3))).collect()
    assert sorted(one) == sorted(other)


def test_hot_id_is_split(spark, monkeypatch):
    """Half of all rows share an ID; a third of them are exact copies."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("Transaction_ID"),
        F.when(F.col("id") % 6 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"),
    )
    whole = sorted(identity.with_unique_ids(df).collect())
    monkeypatch.setattr(identity, "HOT_ROWS", 1000)
    done = identity.with_unique_ids(df)
    assert sorted(done.collect()) == whole and len(whole) == 60_000
    assert done.select("Transaction_ID").distinct().count() == 60_000
    assert done.filter(F.startswith("Transaction_ID", F.lit("HOT"))).count() == 30_000


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_repeats_leave_the_rows_unshuffled(spark):
    near = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "Transaction_ID string, v int")
    done = identity.with_unique_ids(near)
    assert "hashpartitioning" not in physical_plan(done) and "BroadcastHashJoin" in physical_plan(done)
    unique = near.filter("v < 3")
    assert identity.with_unique_ids(unique) is unique


def test_many_repeats_are_joined_without_a_broadcast(spark, monkeypatch):
    df = sample(spark)
    few = sorted(identity.with_unique_ids(df).collect())
    monkeypatch.setattr(identity, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = identity.with_unique_ids(df)
        assert "Broadcast" not in physical_plan(done)
        assert sorted(done.collect()) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_amounts_as_decimals_have_the_same_ids(spark):
    rows = spark.sql("SELECT '-1,50' AS a").select(F.regexp_replace("a", ",", ".").cast("double").alias("Amount"))
    exact = rows.select(F.col("Amount").cast("decimal(18,2)"))
    assert identity.with_transaction_id(rows).first().Transaction_ID == identity.with_transaction_id(exact).first().Transaction_ID


def test_adding_a_file_keeps_existing_ids(spark):
    header = list(LAYOUT_A.columns)

    def export(lines):
        rows = [tuple({"Datum": d, "Bedrag": a, "Omschrijving-1": t, "Volgnr": n}.get(h) for h in header) for d, a, t, n in lines]
        return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))

    first = export([("2025-01-01", "-1,50", "tea", "000001"), ("2025-01-02", "+2,00", "cup", "000002")])
    second = export([("2025-01-03", "-9,99", "pot", None)])
    alone = normalize.normalize(first, LAYOUT_A)
    united = normalize.union_tables([normalize.normalize(second, LAYOUT_A), alone])
    ids = {r["Transaction_ID"] for r in identity.with_unique_ids(identity.with_transaction_id(alone)).collect()}
    more = {r["Transaction_ID"] for r in identity.with_unique_ids(identity.with_transaction_id(united)).collect()}
    assert ids < more and len(more) == 3
