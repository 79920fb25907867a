"""Records with line breaks are put together by the tasks that scan them; only parts at borders of blocks are moved."""

from ledgerspark.sources import exports

HEADER = "Rekeningnummer,Transactiedatum,Transactiebedrag,Omschrijving"


def test_only_records_across_blocks_are_moved(spark, tmp_path):
    folder, staging = tmp_path / "in", str(tmp_path / "staging")
    folder.mkdir()
    # The quoted text looks like records, so a block that begins in it can be read in two ways.
    records = [f'7,20240131,"-{i},50","n{i}\n8,20240131,1,x\n""a"", b\r\n\n{"y" * (i % 50)}"' for i in range(200)]
    (folder / "one.csv").write_bytes("\n".join([HEADER, *records, ""]).encode())
    (folder / "two.csv").write_bytes(f'{HEADER}\n9,20240131,1,plain\n9,20240131,2,"open\n9,20240131,3,x'.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        load = exports.load_exports(spark, str(folder), staging=staging)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = sorted((r.Amount, r.Description) for r in load.transactions.collect())
    expected = [(-i - 0.5, " ".join(f'n{i} 8,20240131,1,x "a", b {"y" * (i % 50)}'.split())) for i in range(200)]
    assert found == sorted([*expected, (1.0, "plain"), (2.0, "open 9,20240131,3,x")]) and load.rejected_rows.count() == 0
    parts = spark.read.parquet(f"{staging}/lines")
    blocks = parts.filter("lines = 0").count()
    assert blocks > 10
    # Each of two readings has at most a part at either border.
    assert parts.filter("lines > 0 AND NOT (begins AND ends)").count() <= 4 * blocks
    assert parts.filter("begins AND ends AND start IS NULL").count() > 100
