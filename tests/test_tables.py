import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import dates, numbers, text
from ledgerspark.operators import analytics, catalog, filters, labels, normalize, paging
from ledgerspark.schema import LABEL_SCHEMA, TRANSACTION_COLUMNS
from ledgerspark.sources import tables

STAMP = "2024-01-01 00:00:00"


def label_table(spark, *rows):
    return spark.createDataFrame([(i, c, "S", STAMP, s) for i, c, s in rows], LABEL_SCHEMA)


def ids(df, column="Transaction_ID"):
    return sorted(r[column] for r in df.collect())


def transactions(spark, n=10):
    return spark.range(n).select(
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("Transaction_ID"),
        F.when(F.col("id") != 9, F.make_timestamp_ntz(F.lit(2020) + (F.col("id") % 3).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("Date"),
        (F.col("id") * 30.0 - 120).alias("Amount"),
        F.lit("desc").alias("Description"),
    )


def test_effective_labels(spark):
    manual = label_table(spark, ("T1", "Home", "Manual"), ("T2", " ", "Manual"), ("OLD", "Home", "Manual"))
    ruled = spark.createDataFrame(
        [("T1", "Food", "S", "Rule: r"), ("T2", "Food", "S", "Rule: r"), ("T3", "Food", "S", "Rule: r"), ("T4", "", "", ""), ("T5", " ", "", "Rule: b")],
        "Transaction_ID string, Category string, Subcategory string, Categorization_Source string",
    )
    effective = labels.effective_labels(ruled, manual, STAMP)
    assert effective.columns == LABEL_SCHEMA.fieldNames()
    assert {(r.Transaction_ID, r.Category, r.Source) for r in effective.collect()} == {
        ("T1", "Home", "Manual"), ("T2", " ", "Manual"), ("OLD", "Home", "Manual"), ("T3", "Food", "Rule: r"),
    }
    none = labels.effective_labels(ruled, label_table(spark).limit(0), STAMP)
    assert ids(none) == ["T1", "T2", "T3"]
    figures = analytics.progress(transactions(spark), effective).first()
    assert (figures.total_transactions, figures.categorized, figures.uncategorized, figures.categorized_present) == (10, 4, 6, 2)


def test_label_changes(spark):
    store = label_table(spark, ("a", "x", "Manual"), ("b", "x", "Manual"))
    changes = labels.label_rows(
        spark.createDataFrame([("b", "y", "S"), ("c", "z", "S")], "Transaction_ID string, Category string, Subcategory string"), "2024-02-01 00:00:00"
    )
    older = changes.withColumns({"Category": F.lit("old"), "Date_Categorized": F.lit("2024-01-15 00:00:00")})
    after = labels.upsert_labels(store, older.unionByName(changes))
    assert {(r.Transaction_ID, r.Category) for r in after.collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    assert ids(labels.delete_labels(after, changes)) == ["a"]


def test_status_and_years(spark):
    df = transactions(spark)
    marked = analytics.with_status(df, label_table(spark, ("T0", "c", "Manual"), ("T0", "d", "Rule: r"), ("T1", "", "Manual"), ("T9", "c", "Manual")))
    assert marked.count() == 10
    pivot = {r.Year: (r.Categorized, r.Uncategorized, r.Total) for r in analytics.yearly_pivot(marked).collect()}
    assert pivot == {2020: (1, 2, 3), 2021: (0, 3, 3), 2022: (0, 3, 3)}
    shares = {r.Year: r.Categorized_Pct for r in analytics.yearly_progress(marked).collect()}
    assert shares == {2020: 33.3, 2021: 0.0, 2022: 0.0}
    one_sided = analytics.yearly_progress(marked.filter("Status = 'Uncategorized'")).collect()
    assert one_sided and {r.Categorized_Pct for r in one_sided} == {0.0}
    counts = {(r.Year, r.Status): r.Count for r in analytics.yearly_counts(marked).collect()}
    assert counts == {(2020, "Categorized"): 1, (2020, "Uncategorized"): 2, (2021, "Uncategorized"): 3, (2022, "Uncategorized"): 3}


def test_empty_tables_divide_by_nothing(spark):
    empty = normalize.empty_transactions(spark)
    assert empty.columns == TRANSACTION_COLUMNS
    none = label_table(spark).limit(0)
    assert analytics.progress(empty, none).first().progress_pct == 0.0
    assert analytics.overall_status(empty, none).first().categorized_pct == 0.0
    categorized = empty.withColumns({"Category": F.lit(""), "Categorization_Source": F.lit("")})
    assert analytics.header_metrics(categorized).first().categorized_pct is None
    assert analytics.category_distribution(none).count() == 0


def test_amounts_and_periods(spark):
    df = transactions(spark)
    amounts = [r.Amount for r in df.collect()]
    assert filters.by_amount(df, "large").count() == sum(abs(a) > 100 for a in amounts)
    assert filters.by_amount(df, "small").count() == sum(abs(a) < 50 for a in amounts)
    assert filters.by_amount(df, None).count() == 10
    assert filters.by_period(df, "last_year", "2022-06-01").count() == 3
    assert filters.by_period(df, "this_year", dt.date(2021, 6, 1)).count() == 6
    assert filters.by_period(df, "last30", dt.datetime(2022, 1, 31)).count() == 3
    assert filters.by_period(df, "last30", dt.datetime(2022, 1, 31, 0, 0, 1)).count() == 0
    with pytest.raises(ValueError):
        filters.by_period(df, "never", "2022-01-01")


def test_search(spark):
    df = spark.createDataFrame([("a", "Cost (x) of basis"), ("b", None), ("c", "costs")], "Transaction_ID string, Description string")
    assert ids(filters.search_description(df, "COST")) == ["a", "c"]
    assert ids(filters.search_description(df, "cos")) == ["a", "c"]
    with pytest.raises(ValueError):
        filters.search_description(df, "t (x")
    assert ids(filters.search_description(df, "t (x", literal=True)) == ["a"]


@pytest.mark.parametrize("rows", [1, 25, 1000])
def test_positions(spark, rows):
    df = spark.range(rows).select((F.col("id") * 7919 % 1009).alias("k"), "id")
    order = [F.col("k"), F.col("id")]
    expected = {key: i + 1 for i, key in enumerate(sorted((i * 7919 % 1009, i) for i in range(rows)))}
    found = {(r.k, r.id): r.position for r in paging.numbered(df, order).collect()}
    assert found == expected


def test_pages(spark, monkeypatch):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    order = [F.col("k"), F.col("id")]
    shallow = sorted(map(tuple, paging.page(df, order, 3, 7).collect()))
    monkeypatch.setattr(paging, "TOP_K_LIMIT", 5)
    assert sorted(map(tuple, paging.page(df, order, 3, 7).collect())) == shallow
    assert paging.page(df, order, 16, 7).count() == 0
    monkeypatch.setattr(paging, "SORTED_ROWS", 3)
    monkeypatch.setattr(paging, "_WIDTH", 2)
    for number in (1, 3, 9, 14, 15, 16):
        assert sorted(map(tuple, paging.page_by_keys(df, ["k", "id"], number, 7).collect())) == sorted(map(tuple, paging.page(df, order, number, 7).collect()))
    assert paging.row_at(df, order, 12).first().id == 11
    assert paging.last_row(df, [F.desc("k"), F.desc("id")]).first().id == 99
    after = [(r.k, r.id) for r in paging.rows_after(df, ["k", "id"], [3, 83], 3).collect()]
    assert after == [(3, 93), (4, 4), (4, 14)]
    before = [(r.k, r.id) for r in paging.rows_before(df, ["k", "id"], [3, 3], 2).collect()]
    assert before == [(2, 92), (2, 82)]


def test_category_changes(spark):
    table = spark.createDataFrame([("A", "a", True), ("B", "b", None), ("C", "c", False)], "category string, description string, active boolean")
    new = spark.createDataFrame([("B", "x", True), ("D", "d", True)], table.schema)
    assert [r.category for r in catalog.known_names(new, table, ["category"]).collect()] == ["B"]
    grown = catalog.insert_new(table, new, ["category"])
    assert {(r.category, r.description) for r in grown.collect()} == {("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")}
    renames = spark.createDataFrame([("A", "Z"), ("B", "C"), ("C", ""), ("D", "Z")], "category string, new_name string")
    assert ids(catalog.rename_rows(grown, renames, "category"), "category") == ["B", "C", "D", "Z"]
    tree = spark.createDataFrame([("A", "x"), ("B", "y")], "category string, subcategory string")
    top, below = catalog.rename_categories(table, tree, renames)
    assert ids(top, "category") == ["B", "C", "Z"] and ids(below, "category") == ["B", "Z"]
    top, below = catalog.delete_categories(table, tree, renames.filter("category = 'A'"))
    assert ids(top, "category") == ["B", "C"] and ids(below, "category") == ["B"]
    edit = spark.createDataFrame([("A", None)], "category string, description string")
    edited = {r.category: r.description for r in catalog.update_rows(table, edit, ["category"]).collect()}
    assert edited == {"A": None, "B": "b", "C": "c"}


def test_subcategory_changes(spark):
    tree = spark.createDataFrame(
        [("A", "x", True), ("A", "y", False), ("A", "z", None), ("B", "y", False)], "category string, subcategory string, active boolean"
    )
    assert catalog.drop_inactive(tree, "A").count() == 3
    assert {r.active for r in catalog.set_all_active(tree, "A", True).filter("category = 'A'").collect()} == {True}
    figures = {r.category: tuple(r)[1:] for r in catalog.tree_by_category(tree).collect()}
    assert figures == {"A": (3, 2, 1, pytest.approx(200 / 3)), "B": (1, 0, 1, 0.0)}
    renames = spark.createDataFrame([("A", "x", "y"), ("B", "y", "x")], "category string, subcategory string, new_name string")
    renamed = catalog.rename_rows(tree, renames, "subcategory", ["category"])
    assert sorted((r.category, r.subcategory) for r in renamed.collect()) == [("A", "x"), ("A", "y"), ("A", "z"), ("B", "x")]


def test_deep_condition_trees_are_opened(spark):
    tree = '{"field": "Amount", "operator": "in", "value": ["1", "2"]}'
    for _ in range(7):
        tree = '{"rules": [' + tree + "]}"
    rules = spark.createDataFrame([("deep", tree), ("bad", "{"), ("none", None), ("plain", '{"field": "Date", "value": "[12]-"}')], "id string, conditions string")
    found = {r.id: r for r in catalog.condition_texts(catalog.condition_leaves(rules)).collect()}
    assert set(found) == {"deep", "plain"}
    assert found["deep"].position == "1.1.1.1.1.1.1" and found["deep"].condition_text == "Amount in '[1, 2]' (case insensitive)"
    assert found["plain"].condition_text == "Date  '[12]-' (case insensitive)"


def values(spark, column, *args):
    return spark.range(1).select(*[column(F.lit(a)) for a in args]).first()


def test_number_parsing(spark):
    parsed = values(spark, numbers.parse_decimal_comma, "-1,5", "+2", "1.234,56", "1d", "1e3", "", "x", " 3,0 ")
    assert tuple(parsed) == (-1.5, 2.0, None, None, 1000.0, None, None, 3.0)
    assert tuple(values(spark, numbers.parse_whole_number, "000012", "7.0", "7.5", "-3", "")) == (12, 7, None, -3, None)
    floats = values(spark, numbers.parse_float, "1_000", "1__0", "inf", "-Infinity", "nan", "1d", " 2 ", "2 3")
    assert tuple(floats) == (1000.0, None, float("inf"), float("-inf"), None, None, 2.0, None)
    assert tuple(values(spark, lambda c: numbers.round_half_even(c, 1), 12.25, 12.35, 63.349999999999994)) == tuple(
        [12.2, 12.4, 63.4]
    )


def test_text_forms(spark):
    numbers_in = [100.0, 12.5, 1e15, 123456789.125, 1e16, 1.5e20, 1e-4, 5e-5, -0.01, 1e22, 0.1 + 0.2, 1234567890123.45]
    assert tuple(values(spark, text.float_text, *numbers_in)) == tuple(map(str, numbers_in))
    assert values(spark, text.collapse_whitespace, "  a\t\n b \x1c")[0] == "a b"
    assert tuple(values(spark, text.is_blank, "", " \t ", "x")) == (True, True, False)
    assert values(spark, text.split_lines, " a \n\n b\n")[0] == ["a", "b"]
    assert tuple(values(spark, text.shorten, "short", "exactly fifteen", "a longer category")) == ("short", "exactly fifteen", "a longer catego...")


def test_age_texts(spark):
    def age(stamp):
        created = dates.parse_iso(F.lit(stamp))
        return spark.range(1).select(dates.age_text(created, "2024-03-10T12:00:00")).first()[0]

    def expected(stamp):
        gap = dt.datetime(2024, 3, 10, 12) - dt.datetime.fromisoformat(stamp)
        if gap.days > 0:
            return f"{gap.days} days ago"
        return f"{gap.seconds // 3600} hours ago" if gap.seconds > 3600 else f"{gap.seconds // 60} minutes ago"

    for stamp in ("2024-03-01T10:00:00", "2024-03-10T11:00:00", "2024-03-10T10:59:59", "2024-03-09T12:00:01.500000", "2024-03-11T13:00:00", "2024-03-10"):
        assert age(stamp) == expected(stamp), stamp
    assert age("bad") is None


def test_dates_take_the_first_fitting_format(spark):
    parse = lambda c: dates.parse_date(c, ("yyyy-MM-dd", "yyyyMMdd"))
    assert tuple(values(spark, parse, "2024-01-31", "20240131", "31/01/2024", "2024-02-30")) == (
        dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 31), None, None,
    )


def test_ties_between_changes_go_by_content(spark):
    rows = [("a", f"c{i}", "s", "2024-01-01 00:00:00", "Manual") for i in range(8)]
    for parts in (1, 3, 8):
        changes = spark.createDataFrame(rows, LABEL_SCHEMA).repartition(parts)
        assert [r.Category for r in labels.latest_per_key(changes, ["Transaction_ID"], "Date_Categorized").collect()] == ["c7"]


def test_dates_are_read_alike_in_every_zone(spark):
    text = spark.createDataFrame([("2024-03-31 02:30:00",), ("2024-03-31",), ("nothing",), (None,)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
        found = [r[0] for r in text.select(dates.parse_iso(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == ["2024-03-31 02:30:00", "2024-03-31 00:00:00", None, None]


def test_labels_with_quotes_and_commas_in_csv(spark, tmp_path):
    rows = [("a", 'say "hi", you', "s", "2024-01-01 00:00:00", "Manual")]
    tables.write_csv(spark.createDataFrame(rows, LABEL_SCHEMA), str(tmp_path / "labels"))
    assert [tuple(r) for r in tables.read_labels(spark, str(tmp_path / "labels"), "csv").collect()] == rows
