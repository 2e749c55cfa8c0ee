"""Named queries over the tables: a DataFrame function and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import relational as R
from quillon.plans import tpch
from quillon.session import TABLES, register, table

Query = Callable[[SparkSession, str], DataFrame]


def _sql(text: str) -> Query:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, names)
        return spark.sql(tpch.for_spark(text))

    return run


def _kept_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q21 in one pass over the line items, where its text sorts and hashes them three times in a task.

    An order has one late supplier if the least is the greatest and none is null, and several
    suppliers if they differ.  Repeated orders or lines change neither.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    n = R.partitions_for(items)
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    # Both sides have this number of partitions, which adaptive execution does not put together again.
    lines = items.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.expr("l_shipdate > o_orderdate + INTERVAL 60 DAY")
    of_order = lines.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("least"),
        F.max("l_suppkey").alias("greatest"),
        F.min(F.when(late, F.col("l_suppkey"))).alias("least_late"),
        F.max(F.when(late, F.col("l_suppkey"))).alias("greatest_late"),
        F.count_if(late & F.col("l_suppkey").isNull()).alias("late_nulls"),
    )
    alone = of_order.where("least < greatest AND least_late = greatest_late AND late_nulls = 0").select("least_late")
    named = table(spark, sf_dir, "supplier").join(alone, F.col("s_suppkey") == F.col("least_late"))
    return R.top_k(named.groupBy("s_name").agg(F.count("*").alias("numwait")), 100, F.desc("numwait"), F.asc("s_name"))


def queries() -> dict[str, Query]:
    from quillon.plans import assembly_queries, graph_queries, operator_queries

    out = {name: _sql(text) for name, text in tpch.QUERIES.items()}
    out["q21_suppliers_who_kept_orders_waiting"] = _kept_waiting
    for module in (operator_queries, graph_queries, assembly_queries):
        out |= module.queries()
    return out


def oracle_sql() -> dict[str, str]:
    from quillon.plans import assembly_queries, graph_queries, operator_queries

    out = {name: tpch.for_duckdb(text) for name, text in tpch.QUERIES.items()}
    for module in (operator_queries, graph_queries, assembly_queries):
        out |= module.oracle_sql()
    return out
