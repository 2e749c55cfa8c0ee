"""Relational operators: projection, joins, aggregation, sorting, exchange and set operations.

Each is a thin declaration; Catalyst picks the physical strategy.  What these functions add is what
the built-in methods leave open: null rules, ties, checked broadcasts and skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import materialize

#: Rows up to which a side without an equality is broadcast after it was counted.
BROADCAST_ROWS = 1_000_000
#: Rows of a partition whose task sorts or hashes all of it.
PARTITION_ROWS = 500_000


# -- sources of single tuples ---------------------------------------------------------------------
def empty_tuple(spark: SparkSession) -> DataFrame:
    """One row without columns."""
    return spark.range(1).select()


def constant(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# -- projection, selection, unnesting --------------------------------------------------------------
def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def assign(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def select(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def unnest(df: DataFrame, column: str, alias: str, outer: bool = False) -> DataFrame:
    """A row for each element; a scalar column counts as its own only element."""
    value = F.col(column)
    if not df.schema[column].dataType.typeName() in ("array", "map"):
        value = F.array(value)
    return df.select("*", (F.explode_outer if outer else F.explode)(value).alias(alias))


def replicate(df: DataFrame, label: str = "split") -> DataFrame:
    """One computation for several consumers: written once to the shared folder, read by each."""
    return materialize(df, label)


# -- joins -------------------------------------------------------------------------------------------
def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """Hash-partitioned join on one or more keys; adaptive execution splits hot keys and broadcasts small sides."""
    return left.join(right, on if isinstance(on, Column) else list(on), how)


def equi_join_counts(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "n") -> DataFrame:
    """``on, name``: how many rows ``equi_join`` has for each key.

    Each side is counted by key before they meet, so a key that is there ``m`` and ``n`` times costs ``m + n`` rows, not ``m * n``.
    """
    one = left.groupBy(*on).agg(F.count("*").alias("__left"))
    other = right.groupBy(*on).agg(F.count("*").alias("__right"))
    return equi_join(one, other, on).select(*on, (F.col("__left") * F.col("__right")).alias(name))


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Join without an equality: the right side is broadcast if it is as small as it must be.

    A larger right side stays on disk: nested loops run partition against partition, which needs no
    memory that grows with either side.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), condition)
    return left.crossJoin(right).where(condition)


def semi_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def scalar_join(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of an aggregate of one row."""
    return left.crossJoin(F.broadcast(one_row.limit(1)))


def id_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that are in either side, each once."""
    return a.select(key).union(b.select(key)).distinct()


# -- aggregation -------------------------------------------------------------------------------------
def group_by(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Partial aggregation, exchange, final aggregation; without keys one global row."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


# -- order, limit, exchange --------------------------------------------------------------------------
def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of a total order: each partition keeps ``k``, one task merges them."""
    return df.orderBy(*order).limit(k)


def sort(df: DataFrame, *order: Column, globally: bool = True) -> DataFrame:
    """A global order by a range exchange, or an order within partitions."""
    return df.orderBy(*order) if globally else df.sortWithinPartitions(*order)


def hash_partition(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def partitions_for(df: DataFrame, rows: int = PARTITION_ROWS) -> int:
    """Hash partitions of about ``rows`` rows, so that a task needs no more memory when the table grows; at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def hash_partition_merge(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Partitions by hash, each in order."""
    return df.repartition(*keys).sortWithinPartitions(*order)


def custom_partition(df: DataFrame, bucket: Column, n: int) -> DataFrame:
    """Partitions by a number that the caller computes from the row."""
    return df.repartition(n, F.pmod(bucket, F.lit(n)))


def unify(df: DataFrame) -> DataFrame:
    """Everything in one partition; for results that are small by construction."""
    return df.coalesce(1)


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table has at most ``rows`` rows, else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# -- set operations ----------------------------------------------------------------------------------
def union_all(*tables: DataFrame) -> DataFrame:
    """By position, with the names of the first."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out
