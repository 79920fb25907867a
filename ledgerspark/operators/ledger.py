"""A ledger of given numbers: IDs stay as they are, whatever later loads add, repeat or leave out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators import identity
from ledgerspark.session import ensure_checkpoint_dir

#: One row per range of numbers: copies of one content of an ID, numbered First, First + 1, ...
LEDGER_SCHEMA = "ID string, Content_Key string, First long, Copies long"


@dataclass
class Assigned:
    """Rows with unique IDs, and the ranges to add to the ledger."""

    rows: DataFrame
    additions: DataFrame


def assign(df: DataFrame, known: DataFrame, id_column: str = "Transaction_ID") -> Assigned:
    """Suffix repeated IDs like ``identity.with_unique_ids``, behind the numbers that ``known`` has given already.

    A content (the row without its file, then the file) that the ledger knows gets its old numbers again; what is new is
    numbered behind all numbers that its ID ever had, by content. Numbers of rows that are gone stay
    taken. With an empty ledger the result is that of ``with_unique_ids``. IDs must not be null.

    Rows are reduced to counts per content first, so the window per ID sees contents, not rows, and an ID with
    very many new contents is summed in buckets. What must change is joined back, as a broadcast where
    it is little. The counting runs when the function is called.
    """
    columns = df.columns
    ensure_checkpoint_dir(df.sparkSession)
    hashed = df.withColumn("__content", identity.content_key(df))
    now = hashed.groupBy(F.col(id_column).alias("__id"), "__content").agg(F.count("*").alias("__now"))
    had = known.groupBy(F.col("ID").alias("__id"), F.col("Content_Key").alias("__content")).agg(
        F.sum("Copies").alias("__had"), F.sort_array(F.collect_list(F.struct("First", "Copies"))).alias("__ranges")
    )
    state = now.join(had, ["__id", "__content"], "left").withColumn("__had", F.coalesce("__had", F.lit(0))).checkpoint()

    additions = _ranges(state, known).checkpoint()
    behind = additions.select(
        F.col("ID").alias("__id"), F.col("Content_Key").alias("__content"), F.struct("First", "Copies").alias("__new")
    )
    no_ranges = F.array().cast("array<struct<First: bigint, Copies: bigint>>")
    given = state.join(behind, ["__id", "__content"], "left").withColumn(
        "__ranges", F.concat(F.coalesce("__ranges", no_ranges), F.array_compact(F.array("__new")))
    )
    changed = given.filter((F.col("__now") > 1) | (F.col("__ranges")[0]["First"] > 0)).select(
        F.col("__id").alias("__rid"), F.col("__content").alias("__rcontent"), "__now", "__ranges"
    ).checkpoint()
    found = changed.agg(F.count("*").alias("rows"), F.count_if(F.col("__now") > 1).alias("copied")).first()
    if not found.rows:
        return Assigned(df, additions)
    joined = hashed.join(
        F.broadcast(changed) if found.rows <= identity.BROADCAST_ROWS else changed,
        (F.col(id_column) == F.col("__rid")) & (F.col("__content") == F.col("__rcontent")),
        "left",
    )
    numbered = joined.filter(F.coalesce("__now", F.lit(1)) == 1).select(
        *columns, F.coalesce(F.col("__ranges")[0]["First"], F.lit(0)).alias("__n")
    )
    if found.copied:
        numbered = numbered.unionByName(_copies(joined.filter(F.col("__now") > 1), columns, id_column))
    return Assigned(identity.suffixed(numbered, "__n", id_column).select(*columns), additions)


def _ranges(state: DataFrame, known: DataFrame) -> DataFrame:
    """The ledger rows for copies that have no number yet."""
    new = state.filter(F.col("__now") > F.col("__had")).select("__id", "__content", (F.col("__now") - F.col("__had")).alias("__copies"))
    hot = new.groupBy(F.col("__id").alias("__rid")).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > identity.HOT_ROWS).checkpoint()
    # An ID with more new contents than HOT_ROWS; there is at most one per HOT_ROWS rows.
    split = not hot.isEmpty()
    if split:
        new = new.join(hot, F.col("__id") == F.col("__rid"), "left").drop("__rid")
    else:
        new = new.withColumn("__rows", F.lit(None).cast("long"))
    starts = identity.running_starts(new, split)
    taken = known.groupBy(F.col("ID").alias("__tid")).agg(F.sum("Copies").alias("__taken"))
    first = F.coalesce("__taken", F.lit(0)) + F.col("__start")
    return starts.join(taken, F.col("__id") == F.col("__tid"), "left").select(
        F.col("__id").alias("ID"), F.col("__content_key").alias("Content_Key"), first.alias("First"), F.col("__copies").alias("Copies")
    )


def _copies(copied: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Equal rows, counted and written out with the lowest numbers of their ranges."""
    counted = copied.groupBy(*columns, "__ranges").agg(F.count("*").alias("__left"))
    counted = counted.select(*columns, "__left", "__ranges", F.posexplode("__ranges").alias("__place", "__range"))
    before = F.aggregate(F.slice("__ranges", 1, F.col("__place")), F.lit(0).cast("long"), lambda sum_, r: sum_ + r["Copies"])
    counted = counted.withColumn("__copies", F.least(F.col("__range.Copies"), F.col("__left") - before)).withColumn("__start", F.col("__range.First"))
    return identity.write_out(counted.filter(F.col("__copies") > 0).select(*columns, "__start", "__copies"), columns, id_column)
