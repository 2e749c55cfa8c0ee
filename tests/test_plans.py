"""The physical plans that the queries are meant to get."""

import re

from pyspark.sql import functions as F

from quillon.operators import relational as R
from quillon.plans import catalog
from quillon.session import table

QUERIES = catalog.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(QUERIES["q6_forecast_revenue"](spark, sf_dir))
    (read,) = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert {c.split(":")[0] for c in read.split(",")} == {"l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_quantity" in pushed


def test_aggregates_run_in_two_phases_around_one_exchange(spark, sf_dir):
    text = plan(QUERIES["a1_group_by"](spark, sf_dir))
    assert text.count("HashAggregate(") == 2 and text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_a_suitable_partitioning_is_reused(spark, sf_dir):
    text = plan(QUERIES["a2_reused_partitioning"](spark, sf_dir))
    assert text.count("Exchange") == 1


def test_top_k_does_not_sort_everything(spark, sf_dir):
    text = plan(QUERIES["o3_top_k"](spark, sf_dir))
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_global_order_is_a_range_exchange(spark, sf_dir):
    assert "Exchange rangepartitioning" in plan(QUERIES["o1_global_order"](spark, sf_dir))


def test_theta_joins_broadcast_the_counted_side(spark, sf_dir):
    assert "BroadcastNestedLoopJoin" in plan(QUERIES["j5_theta"](spark, sf_dir))


def test_broadcast_hints_depend_on_the_count(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        on = F.col("o_custkey") == F.col("c_custkey")
        assert "BroadcastHashJoin" in plan(orders.join(R.broadcast_checked(customers), on))
        assert "BroadcastHashJoin" not in plan(orders.join(R.broadcast_checked(customers, rows=10), on))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_semi_and_anti_joins_stay_that(spark, sf_dir):
    assert "LeftAnti" in plan(QUERIES["j7_anti"](spark, sf_dir)) and "LeftSemi" in plan(QUERIES["j8_semi"](spark, sf_dir))


def test_assembly_builds_without_python(spark, sf_dir):
    text = plan(QUERIES["as_build"](spark, sf_dir))
    assert "Python" not in text and "Arrow" not in text and text.count("Exchange") == 1


def test_join_counts_do_not_make_the_pairs_of_a_key(spark):
    """2 million rows of one key would make 4e12 pairs; null keys meet nothing, and a key of one side only has no row."""
    hot = spark.range(2_000_000).select(F.when(F.col("id") < 7, F.lit(None).cast("int")).otherwise((F.col("id") == 9).cast("int")).alias("k"))
    other = spark.createDataFrame([(0,), (0,), (0,), (2,), (None,)], "k int")
    assert {r.k: r.n for r in R.equi_join_counts(hot, hot, ["k"]).collect()} == {0: 1_999_992**2, 1: 1}
    assert {r.k: r.n for r in R.equi_join_counts(hot, other, ["k"]).collect()} == {0: 3 * 1_999_992}


def test_duplicated_keys_are_counted_before_they_meet(spark, tmp_path):
    rows = spark.range(400_000).select(F.when(F.col("id") > 0, (F.col("id") % 2).cast("int")).alias("c_nationkey"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["j12_duplicated_keys"](spark, str(tmp_path))
    # 8e10 pairs, which the join itself would take many minutes to make.
    assert "Aggregate" in plan(got).split("Join")[1] and {r.k: r.n for r in got.collect()} == {0: 199_999**2, 1: 200_000**2}


def test_waiting_orders_take_one_pass_over_the_lines(spark, tmp_path):
    """More lines are more partitions, not larger ones; nulls, repeated orders and repeated lines count as in SQL."""
    import random
    from datetime import datetime, timedelta

    import duckdb

    r, day = random.Random(3), datetime(1996, 1, 1)
    orders = [(r.choice([None, *range(400)]), r.choice("FFFO"), r.choice([None, day, day + timedelta(30)])) for _ in range(500)]
    lines = [(r.choice([None, *range(400)]), r.choice([None, *range(6)]), r.choice([None, *(day + timedelta(x) for x in (10, 60, 61, 91, 120))])) for _ in range(1500)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"S{i % 5}") for i in range(6)], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    name = "q21_suppliers_who_kept_orders_waiting"
    c = duckdb.connect()
    for t in ("orders", "lineitem", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = c.sql(catalog.oracle_sql()[name]).fetchall()
    got = QUERIES[name](spark, str(tmp_path))
    assert [(x.s_name, x.numwait) for x in got.collect()] == want and len(want) > 2
    assert plan(QUERIES[name](spark, str(tmp_path))).count("ReadSchema: struct<l_") == 1
    items = table(spark, str(tmp_path), "lineitem")
    assert R.partitions_for(items, 100) == 15 and R.partitions_for(items) == spark.sparkContext.defaultParallelism
