import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.rules import RuleSet
from ledgerspark.schema import LABEL_SCHEMA, LAYOUT_A, LAYOUT_B, TRANSACTION_COLUMNS
from ledgerspark.sources import documents, exports, tables

A_HEADER = ",".join(LAYOUT_A.columns)


def a_line(number, date, amount, *descriptions, party="Shop", balance='"1.000,00"'):
    texts = list(descriptions) + [""] * (3 - len(descriptions))
    return ",".join(["NL01", "EUR", number, date, f'"{amount}"', balance, "NL02", party, "", "", "ref", "", "", "", *texts])


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "bank a" / "2024").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    utf8 = "\n".join([A_HEADER, a_line("0001", "2024-01-02", "-12,50", " tea ", "and  \t cake"), a_line("0002", "2024-01-03", "1.234,56", "big", party="NA")])
    (tmp_path / "bank a" / "[x] one.csv").write_bytes(utf8.encode("utf-8"))
    latin = "\r\n".join([A_HEADER, a_line("0003", "bad", "+7,25", "café", balance='"5,50"'), a_line("0004", "2024-01-05", "1,00", "too many") + ",x,y"])
    (tmp_path / "bank a" / "2024" / "two.CSV").write_bytes(latin.encode("iso-8859-1"))
    multi = "\n".join([A_HEADER, a_line("0005", "2024-01-06", "-1,00", '"first\nsecond, ""q"""')])
    (tmp_path / "bank a" / "three.csv").write_bytes(multi.encode("utf-8"))
    (tmp_path / "b" / "four.csv").write_text("Rekeningnummer,Transactiedatum,Transactiebedrag,Omschrijving\n123,20240131,\"-3,00\",rent   march\n")
    (tmp_path / "b" / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b" / "notes.txt").write_text("not an export")
    (tmp_path / "b" / "empty.csv").write_text("")
    return str(tmp_path)


def test_probe_finds_encoding_header_and_quoting(spark, folder):
    probed = {r.path.rsplit("/", 1)[-1]: r for r in exports.probe_files(spark, folder).collect()}
    assert probed["two.CSV"].encoding == "ISO-8859-1" and probed["four.csv"].encoding == "UTF-8"
    assert probed["three.csv"].multi_line and not probed["two.CSV"].multi_line
    assert exports.parse_header(probed["two.CSV"].header) == list(LAYOUT_A.columns)


def test_load_both_layouts(spark, folder):
    load = exports.load_exports(spark, folder)
    df = load.transactions
    assert df.columns == TRANSACTION_COLUMNS
    rows = {(r.Sequence_Number or 0): r for r in df.collect()}
    assert set(rows) == {0, 1, 2, 3, 5}
    assert rows[1].Description == "tea and cake" and rows[1].Amount == -12.5 and rows[1].Source_File == "[x] one.csv"
    assert rows[1].Balance_After is None and rows[3].Balance_After == 5.5
    assert rows[2].Amount is None and rows[2].Counterparty_Name is None
    assert rows[3].Description == "café" and rows[3].Date is None and rows[3].Amount == 7.25
    assert rows[5].Description == 'first second, "q"'
    assert rows[0].Date == dt.datetime(2024, 1, 31) and rows[0].Description == "rent march" and rows[0].Account_Number == "123"
    assert rows[0].Currency is None
    assert len({r.Transaction_ID for r in rows.values()}) == 5
    assert [r.path.rsplit("/", 1)[-1] for r in load.rejected_files.collect()] == ["empty.csv", "other.csv"]
    assert [r.Source_File for r in load.rejected_rows.collect()] == ["two.CSV"]


def test_thousands_dots_can_be_stripped(spark, folder):
    load = exports.load_exports(spark, folder, strip_thousands=True, money_type="decimal(18,2)")
    amount = load.transactions.filter("Sequence_Number = 2").first()["Amount"]
    assert str(amount) == "1234.56"


def test_ids_of_one_layout_do_not_depend_on_files_of_another(spark, tmp_path):
    (tmp_path / "both").mkdir()
    (tmp_path / "alone").mkdir()
    b = "Rekeningnummer,Transactiedatum,Transactiebedrag,Omschrijving\n7,20240131,\"-1,50\",tea\n"
    a = ",".join(LAYOUT_A.columns) + "\n" + "," * (len(LAYOUT_A.columns) - 1) + "\n"
    for place, name, text in (("alone", "b", b), ("both", "b", b), ("both", "a", a), ("both", "none", "")):
        (tmp_path / place / f"{name}.csv").write_text(text)
    alone, both = (exports.load_exports(spark, str(tmp_path / place)) for place in ("alone", "both"))
    ids = {r.Transaction_ID for r in alone.transactions.collect()}
    assert len(ids) == 1 and ids < {r.Transaction_ID for r in both.transactions.collect()}
    assert [(r.path.rsplit("/", 1)[-1], r.reason) for r in both.rejected_files.collect()] == [("none.csv", "empty file")]


def test_empty_folder_gives_an_empty_table(spark, tmp_path):
    load = exports.load_exports(spark, str(tmp_path))
    assert load.transactions.count() == 0 and load.transactions.columns == TRANSACTION_COLUMNS


def test_tables_in_other_formats(spark, tmp_path):
    rows = spark.createDataFrame(
        [("7", dt.datetime(2024, 1, 31), -12345678.5, "  a   b "), ("7", None, 3.0, None)],
        "Rekeningnummer string, Transactiedatum timestamp_ntz, Transactiebedrag double, Omschrijving string",
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "b"))
    found = exports.load_table(spark, str(tmp_path / "b"), LAYOUT_B)
    assert found.columns == ["Transaction_ID", "Date", "Amount", "Description", "Account_Number", "Source_File"]
    values = {(r.Date, r.Amount, r.Description) for r in found.collect()}
    assert values == {(dt.datetime(2024, 1, 31), -12345678.5, "a b"), (None, 3.0, "")}


RULES = {
    "categorization_rules": {
        "rules": [
            {"id": "one", "name": "One", "category": "C", "subcategory": "S", "priority": 80, "active": True,
             "conditions": {"operator": "OR", "rules": [{"field": "Description", "operator": "contains", "value": "x"}]}},
            {"id": "two", "conditions": {"field": "Amount", "operator": "between", "value": [1, 2]}},
        ]
    },
    "operators": {},
}
CATEGORIES = {
    "categories": {
        "Food": {"description": "eat", "active": True, "subcategories": {"Out": {"description": "d", "active": False}, "In": {}}},
        "Bare": {},
    }
}


def test_documents(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps(RULES, indent=2))
    (tmp_path / "tree.json").write_text(json.dumps(CATEGORIES, indent=2))
    rules = documents.read_rule_set(spark, str(tmp_path / "rules.json"))
    assert [r.id for r in rules.rules] == ["one", "two"]
    assert json.loads(rules.rules[0].conditions) == RULES["categorization_rules"]["rules"][0]["conditions"]
    assert rules.rules[1].rank_priority == 50 and rules.rules[1].is_active and rules.rules[1].name == "Unknown Rule"
    assert RuleSet.from_table(rules.to_table(spark)).rules == rules.rules
    categories, tree = documents.read_categories(spark, str(tmp_path / "tree.json"))
    assert {r.category for r in categories.collect()} == {"Food", "Bare"}
    assert {(r.category, r.subcategory, r.active) for r in tree.collect()} == {("Food", "Out", False), ("Food", "In", None)}


def test_missing_or_broken_documents_are_empty(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{ not json")
    for name in ("bad.json", "absent.json"):
        path = str(tmp_path / name)
        assert documents.read_rules(spark, path).count() == 0
        assert [t.count() for t in documents.read_categories(spark, path)] == [0, 0]


def test_label_store_and_snapshots(spark, tmp_path):
    base = str(tmp_path / "labels")
    assert tables.read_latest(spark, base, LABEL_SCHEMA).count() == 0
    assert tables.read_labels(spark, base).columns == LABEL_SCHEMA.fieldNames()
    one = spark.createDataFrame([("a", "C", "S", "2024-01-01 00:00:00", "Manual")], LABEL_SCHEMA)
    tables.write_snapshot(one, base)
    tables.write_snapshot(tables.read_latest(spark, base, LABEL_SCHEMA).union(one.withColumn("Transaction_ID", F.lit("b"))), base)
    (tmp_path / "labels" / "snapshot=99999999_000000_000000").mkdir()
    assert {r.Transaction_ID for r in tables.read_latest(spark, base, LABEL_SCHEMA).collect()} == {"a", "b"}
    assert tables.table_status(spark, base) == "Available" and tables.table_status(spark, base + "x") == "Not Found"


def test_csv_round_trip(spark, tmp_path, folder):
    df = exports.load_exports(spark, folder).transactions
    path = str(tmp_path / "out.csv")
    tables.write_csv(df, path)
    assert sorted(map(str, tables.read_transactions_csv(spark, path).collect())) == sorted(map(str, df.collect()))
    assert tables.read_transactions_csv(spark, path + "x").count() == 0


def test_store_by_year_prunes_folders(spark, tmp_path, folder):
    from ledgerspark.operators import filters

    path = str(tmp_path / "store")
    tables.write_transactions(exports.load_exports(spark, folder).transactions, path)
    found = filters.by_period(tables.read_transactions(spark, path), "this_year", "2024-06-01")
    assert found.count() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_backup_and_restore(spark, tmp_path):
    rules = RuleSet.from_document(RULES).to_table(spark)
    (tmp_path / "tree.json").write_text(json.dumps(CATEGORIES))
    categories, tree = documents.read_categories(spark, str(tmp_path / "tree.json"))
    backup = tables.create_backup(spark, str(tmp_path), rules, categories, tree, now=dt.datetime(2025, 1, 1))
    manifest = tables.read_manifest(spark, backup).first()
    assert manifest.asDict() == {
        "backup_date": "2025-01-01T00:00:00", "app_version": "1.0", "files_included": ["rules", "categories", "tree"],
        "rules_count": 2, "categories_count": 2,
    }
    assert [t.count() for t in tables.restore_backup(spark, backup)] == [2, 2, 2]
    rules.write.mode("append").parquet(f"{backup}/rules")
    with pytest.raises(ValueError):
        tables.restore_backup(spark, backup)
