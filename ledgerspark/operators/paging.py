"""Positions in an ordered set, without a one-task global window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerspark.session import ensure_checkpoint_dir

# Up to this position a page comes from a top-k; beyond it rows are numbered first.
TOP_K_LIMIT = 10_000
_ROW_BITS = 33
# Of a deep page's surroundings up to so many rows are sorted.
SORTED_ROWS = 1_000_000
# Ranges of a pass: the square of this.
_WIDTH = 16


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number the rows 1, 2, … in the given total order.

    A distributed sort is checkpointed, so that its partitions stay put; the rows
    per partition are counted and their running sums, one small row per
    partition, are broadcast back. No task sees more than its share.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("__place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("__part"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    )
    inside = F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + inside + 1)
        .select(*df.columns, name)
    )


def page(df: DataFrame, order: list[Column], number: int, size: int, name: str = "position") -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, each with its position."""
    first, last = (number - 1) * size + 1, number * size
    if last <= TOP_K_LIMIT:
        top = df.orderBy(*order).limit(last)
        ranked = top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        ranked = numbered(df, order, name)
    return ranked.filter(F.col(name).between(first, last))


def page_by_keys(df: DataFrame, keys: list[str], number: int, size: int, name: str = "position") -> DataFrame:
    """Like ``page``, ascending by columns; only a bounded part of the rows is ever sorted.

    Order statistics: a sample of keys (those with the smallest hashes) cuts the rows into ranges, which
    are counted in a pass without a shuffle of rows. Only the ranges that hold the page go on, and are cut again
    while they have more than ``SORTED_ROWS``. The keys must give a total order.
    """
    first, last, skipped = (number - 1) * size + 1, number * size, 0
    part, rows = df, None
    while last - skipped > TOP_K_LIMIT and (rows is None or rows > SORTED_ROWS):
        sample = part.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(_WIDTH * _WIDTH - 1).orderBy(*keys).collect()
        if not sample:
            break
        counted = part.groupBy(_range_of(keys, sample).alias("range")).agg(F.count("*").alias("rows")).collect()
        counts = dict((r["range"], r["rows"]) for r in counted)
        before, held = skipped, []
        for i in range(len(sample) + 1):
            n = counts.get(i, 0)
            if before + n >= first and before < last and n:
                held.append((i, before, n))
            before += n
        if not held:
            return part.limit(0).withColumn(name, F.lit(0).cast("long"))
        found = sum(n for _, _, n in held)
        if rows is not None and found >= rows:
            break
        low, high, skipped, rows = held[0][0], held[-1][0], held[0][1], found
        if low > 0:
            part = part.filter(_key(keys) > _literal(keys, df, sample[low - 1]))
        if high < len(sample):
            part = part.filter(_key(keys) <= _literal(keys, df, sample[high]))
    order = [F.col(key) for key in keys]
    if last - skipped <= TOP_K_LIMIT:
        ranked = part.orderBy(*order).limit(last - skipped).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        ranked = numbered(part, order, name)
    return ranked.withColumn(name, F.col(name) + skipped).filter(F.col(name).between(first, last))


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(key) for key in keys])


def _literal(keys: list[str], df: DataFrame, row) -> Column:
    return F.struct(*[F.lit(row[key]).cast(df.schema[key].dataType).alias(key) for key in keys])


def _range_of(keys: list[str], bounds: list) -> Column:
    """How many bounds lie below a row's key, found in two steps of ``_WIDTH`` comparisons."""
    texts = F.array(*[F.struct(*[F.lit(row[key]).alias(key) for key in keys]) for row in bounds])
    every = F.array(*[F.struct(*[F.lit(row[key]).alias(key) for key in keys]) for row in bounds[_WIDTH - 1 :: _WIDTH]]) if len(bounds) >= _WIDTH else None
    below = lambda bound: bound < _key(keys)
    step = F.size(F.filter(every, below)) * _WIDTH if every is not None else F.lit(0)
    return step + F.size(F.filter(F.slice(texts, step + 1, _WIDTH), below))


def row_at(df: DataFrame, order: list[Column], position: int) -> DataFrame:
    """The row at a position, counted from 1: first, jump."""
    return page(df, order, position, 1)


def last_row(df: DataFrame, reverse_order: list[Column]) -> DataFrame:
    return df.orderBy(*reverse_order).limit(1)


def rows_after(df: DataFrame, keys: list[str], values: list, size: int) -> DataFrame:
    """The next ``size`` rows behind the given key values, ascending (next page)."""
    return _beyond(df, keys, values, size, lambda key, value: key > value, lambda key: F.col(key).asc())


def rows_before(df: DataFrame, keys: list[str], values: list, size: int) -> DataFrame:
    """The ``size`` rows ahead of the given key values, nearest first (previous page)."""
    return _beyond(df, keys, values, size, lambda key, value: key < value, lambda key: F.col(key).desc())


def _beyond(df, keys, values, size, compare, order) -> DataFrame:
    alternatives = []
    for index, (key, value) in enumerate(zip(keys, values)):
        same = [F.col(k) == F.lit(v) for k, v in zip(keys[:index], values[:index])]
        alternatives.append(reduce(lambda a, b: a & b, [*same, compare(F.col(key), F.lit(value))]))
    beyond = reduce(lambda a, b: a | b, alternatives)
    return df.filter(beyond).orderBy(*[order(key) for key in keys]).limit(size)
