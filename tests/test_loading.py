"""Loading exports in one scan, the ledger of suffixes, and full keys."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import identity, ledger
from ledgerspark.schema import KEY_COLUMN, LAYOUT_A, LAYOUT_B
from ledgerspark.sources import exports, records, tables

A_HEADER = ",".join(LAYOUT_A.columns)
B_HEADER = "Rekeningnummer,Transactiedatum,Transactiebedrag,Omschrijving"


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def text_of(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_rows(seed, n=120):
    draw = random.Random(seed)
    parts = ["tea", "\n", '"', ",", "café", "  ", "\n\n", '""', '",\n"', "x" * 40, "long " * 30]
    return [["7", "20240131", f"-{i},50", "n" + "".join(draw.choice(parts) for _ in range(draw.randint(1, 7))) + "e"] for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_with_line_breaks_are_read_by_many_tasks(spark, tmp_path, small_splits, seed):
    rows = random_rows(seed)
    (tmp_path / "one.csv").write_text(text_of([B_HEADER.split(","), *rows]), encoding="utf-8")
    (tmp_path / "two.csv").write_text(text_of([B_HEADER.split(","), *rows[:50]]), encoding="iso-8859-1")
    (tmp_path / "plain.csv").write_text(f"{B_HEADER}\n8,20240201,\"1,00\",plain\n")
    lines = records.lines_of(spark, str(tmp_path), "*.csv")
    assert lines.rdd.getNumPartitions() > 10
    load = exports.load_exports(spark, str(tmp_path))
    expected = [(f, " ".join(r[3].split()), -float(r[2][1:].replace(",", "."))) for f, rs in (("one.csv", rows), ("two.csv", rows[:50])) for r in rs] + [("plain.csv", "plain", 1.0)]
    assert sorted((r.Source_File, r.Description, r.Amount) for r in load.transactions.collect()) == sorted(expected)
    assert load.rejected_rows.count() == 0 and load.rejected_files.count() == 0


def test_a_missing_quote_costs_its_record_only(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr(records, "LONGEST_RECORD", 2000)
    good = "\n".join(f'7,20240131,"-{i},00",row {i}' for i in range(60))
    tail = "\n".join(f"7,20240131,1,row {i}" for i in range(300))
    (tmp_path / "bad.csv").write_text(f'{B_HEADER}\n{good}\n7,20240131,1,"open {tail}\n')
    load = exports.load_exports(spark, str(tmp_path))
    assert load.transactions.count() == 60
    assert [(r.Source_File, r.row) for r in load.rejected_rows.collect()] == [("bad.csv", None)]
    assert "characters" in load.rejected_rows.first().reason


def test_quotes_inside_plain_fields_are_text(spark, tmp_path):
    (tmp_path / "inch.csv").write_text(f'{B_HEADER}\n7,20240131,"1,00",55" screen\n7,20240201,"2,00",12"\n7,20240202,"3,00",he said "hi" twice\n')
    (tmp_path / "both.csv").write_text(f'{B_HEADER}\n7,20240131,"4,00",55" screen\n7,20240201,"5,00","two\n""lines"", x"\n7,20240202,"6,00",12"\n')
    (tmp_path / "head.csv").write_text('Rekeningnummer,Transactiedatum,Transactiebedrag,"Omschrijving\n2"\n7,20240131,1,x\n')
    assert {r.path.rsplit("/", 1)[-1]: r.multi_line for r in exports.probe_files(spark, str(tmp_path)).collect()} == {"inch.csv": False, "both.csv": True, "head.csv": True}
    load = exports.load_exports(spark, str(tmp_path))
    assert sorted((r.Amount, r.Description) for r in load.transactions.collect()) == [
        (1.0, '55" screen'), (2.0, '12"'), (3.0, 'he said "hi" twice'), (4.0, '55" screen'), (5.0, 'two "lines", x'), (6.0, '12"')
    ]
    assert [r.reason for r in load.rejected_files.collect()] == ["header of several lines"] and load.rejected_rows.count() == 0


def test_plans_of_probing_have_no_sort_over_lines(spark, tmp_path):
    (tmp_path / "one.csv").write_text(f"{B_HEADER}\n8,20240201,1,x\n")
    lines = records.lines_of(spark, str(tmp_path), "*.csv")
    blocks = records.blocks_of(lines)
    assert "Sort" not in physical_plan(blocks) and "HashAggregate" in physical_plan(blocks)
    probed = records.files_of(lines, blocks)
    probed.collect()
    assert "Sort" not in physical_plan(probed).split("Initial Plan")[0]


def test_headers_of_any_form(spark, tmp_path):
    rows = {
        "bom": ("﻿" + B_HEADER + "\r\n1,20240101,\"2,00\",x\r\n").encode(),
        "quoted": ('"Rekeningnummer", Transactiedatum ,"Transactiebedrag","My ""own"", name",Omschrijving\n1,20240101,"2,00",q,"a ""b"""\n').encode(),
        "order": b"Omschrijving,Transactiebedrag,Extra,Transactiedatum\nback,\"-3,00\",,20240102\n",
        "trailing": b"Transactiedatum,Transactiebedrag,\n20240103,4,\n20240104,5,named\n20240105,5,named,more\n",
        "twice": b"Transactiedatum,Transactiebedrag,x,x\n20240103,4,1,2\n",
        "utf": ("Transactiedatum,Transactiebedrag,Omschrijving\n20240106,7,été €\n").encode(),
        "latin": "Transactiedatum,Transactiebedrag,Omschrijving\n20240107,8,été\n".encode("iso-8859-1"),
        "blank": b"\n\n",
    }
    for name, data in rows.items():
        (tmp_path / f"{name} +1.csv").write_bytes(data)
    load = exports.load_exports(spark, str(tmp_path))
    found = sorted((r.Source_File.split(" ")[0], r.Amount, r.Description) for r in load.transactions.collect())
    assert found == [("bom", 2.0, "x"), ("latin", 8.0, "été"), ("order", -3.0, "back"), ("quoted", 2.0, 'a "b"'), ("trailing", 4.0, ""), ("trailing", 5.0, ""), ("utf", 7.0, "été €")]
    assert {r.Source_File for r in load.transactions.collect()} == {f"{n} +1.csv" for n in ("bom", "latin", "order", "quoted", "trailing", "utf")}
    assert [(r.Source_File.split(" ")[0], r.row, r.reason) for r in load.rejected_rows.collect()] == [("trailing", "20240105,5,named,more", "more fields than the header")]
    assert sorted((r.path.rsplit("/", 1)[-1].split("%20")[0], r.reason) for r in load.rejected_files.collect()) == [("blank", "no known layout"), ("twice", "repeated column names")]
    assert load.transactions.columns == ["Transaction_ID", "Date", "Amount", "Description", "Account_Number", "Source_File"]


def table(spark, rows):
    return spark.createDataFrame(rows, "Transaction_ID string, v int, Source_File string")


def ids(df):
    return sorted(map(tuple, df.collect()))


def test_an_empty_ledger_gives_the_ids_of_with_unique_ids(spark):
    df = table(spark, [("A", 1, "f1")] * 7 + [("A", 1, "f2")] * 3 + [("A", 2, "f1"), ("B", 1, "f1"), ("C", 1, "f1"), ("C", 1, "f2")])
    none = spark.createDataFrame([], ledger.LEDGER_SCHEMA)
    done = ledger.assign(df, none)
    assert ids(done.rows) == ids(identity.with_unique_ids(df))
    assert sorted((r.ID, r.First, r.Copies) for r in done.additions.collect()) == [("A", f, c) for f, c in sorted((r.First, r.Copies) for r in done.additions.filter("ID = 'A'").collect())] + [("B", 0, 1), ("C", 0, 1), ("C", 1, 1)]
    assert ledger.assign(df.limit(0), none).rows.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_known_ids_stay_whatever_is_added(spark, tmp_path, seed):
    draw = random.Random(seed)
    base, held, known = str(tmp_path / "ledger"), [], {}
    for load in range(3):
        held += [("ABC"[draw.randrange(3)], draw.randrange(3), f"f{draw.randrange(9 - 3 * load)}") for _ in range(8)]
        done = ledger.assign(table(spark, held).repartition(3), tables.read_segments(spark, base, ledger.LEDGER_SCHEMA))
        tables.append_segment(done.additions, base)
        found = {}
        for id_, v, file in ids(done.rows):
            found.setdefault((id_[0], v, file), set()).add(id_)
        given = [i for s in found.values() for i in s]
        assert len(given) == len(set(given)) == len(held)
        assert all(before <= found[key] for key, before in known.items())
        # Gapless per plain ID.
        for letter in "ABC":
            own = sorted(int(i[2:] or 0) for i in given if i[0] == letter)
            assert own == list(range(len(own)))
        known = found
    gone = ledger.assign(table(spark, held[::2]), tables.read_segments(spark, base, ledger.LEDGER_SCHEMA))
    assert gone.additions.count() == 0 and all(r[0] in known[r[0][0], r[1], r[2]] for r in ids(gone.rows))


def test_hot_ids_in_the_ledger(spark, monkeypatch):
    df = spark.range(4000).select(F.lit("HOT").alias("Transaction_ID"), (F.col("id") % 3000).alias("v"), F.lit("f").alias("Source_File"))
    none = spark.createDataFrame([], ledger.LEDGER_SCHEMA)
    whole = ids(ledger.assign(df, none).rows)
    monkeypatch.setattr(identity, "HOT_ROWS", 100)
    monkeypatch.setattr(identity, "BROADCAST_ROWS", 10)
    assert ids(ledger.assign(df, none).rows) == whole == ids(identity.with_unique_ids(df)) and len({r[0] for r in whole}) == 4000


def test_loads_with_keys_and_a_ledger(spark, tmp_path):
    folder, book = tmp_path / "exports", str(tmp_path / "ledger")
    folder.mkdir()
    line = '8,20240201,"1,00",tea\n'
    (folder / "m.csv").write_text(f"{B_HEADER}\n{line}{line}9,20240201,2,cup\n")
    first = exports.load_exports(spark, str(folder), keyed=True, ledger=book).transactions
    old = {(r.Source_File, r.Description, r.Transaction_ID, r[KEY_COLUMN]) for r in first.collect()}
    assert len({r[3] for r in old}) == 3 and all(len(r[3].split("_")[0]) == 32 for r in old)
    (folder / "a.csv").write_text(f"{B_HEADER}\n{line}\n")
    second = exports.load_exports(spark, str(folder), keyed=True, ledger=book).transactions
    new = {(r.Source_File, r.Description, r.Transaction_ID, r[KEY_COLUMN]) for r in second.collect()}
    assert old < new and len(new) == 4 and max(r[3] for r in new if r[0] == "a.csv").endswith("_2")
    path = str(tmp_path / "store")
    tables.write_transactions(second, path)
    assert {r[KEY_COLUMN] for r in tables.read_transactions(spark, path, keyed=True).collect()} == {r[3] for r in new}


def test_layouts_of_one_load_are_hashed_as_alone(spark, tmp_path):
    (tmp_path / "b.csv").write_text(f"{B_HEADER}\n8,20240201,1,x\n")
    alone = exports.load_exports(spark, str(tmp_path)).transactions.first().Transaction_ID
    (tmp_path / "a.csv").write_text(A_HEADER + "\n" + "," * (len(LAYOUT_A.columns) - 1) + "\n")
    both = exports.load_exports(spark, str(tmp_path)).transactions
    assert both.filter("Source_File = 'b.csv'").first().Transaction_ID == alone
    loaded = exports.load_table(spark, str(tmp_path / "b.csv"), LAYOUT_B, "csv")
    assert loaded.first().Transaction_ID == alone
