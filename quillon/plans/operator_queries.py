"""One query for each relational operator, source, sink and function group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import scalar
from quillon.functions.aggregates import Aggregate, aggregate
from quillon.graph.store import KeyedTable
from quillon.operators import relational as R
from quillon.plans import pig, statements
from quillon.session import materialize, table, work_path
from quillon.sources import files

_REGISTERED: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        _REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _rounded(name: str, alias: str | None = None, digits: int = 2):
    return F.round(name, digits).alias(alias or name)


# -- sources and sinks -------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s1_scan_projected(spark: SparkSession, d: str) -> DataFrame:
    return R.project(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT 1 AS one, 'x' AS letter")
def s2_empty_tuple(spark, d):
    return R.empty_tuple(spark).select(F.lit(1).alias("one"), F.lit("x").alias("letter"))


@query("SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def s3_nested_aggregate(spark, d):
    return R.group_by(table(spark, d, "orders"), ["o_orderstatus"], F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def s4_insert_overwrite(spark, d):
    out = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return files.overwrite(out, work_path(spark, "sink"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s5_delimited_scan(spark, d):
    path = work_path(spark, "delimited")
    files.write_delimited(table(spark, d, "nation"), path)
    return files.read_delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey AS id, n_regionkey AS dst FROM nation")
def s6_vertex_scan(spark, d):
    path = work_path(spark, "vertices")
    table(spark, d, "nation").select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("value")).write.text(path)
    _, edges = files.read_adjacency(spark, path)
    return edges.select(F.col("src").cast("int").alias("id"), F.col("dst").cast("int").alias("dst"))


@query("SELECT s_suppkey AS key, ROUND(s_acctbal, 2) AS value FROM supplier")
def s7_key_value_files(spark, d):
    path = work_path(spark, "kv")
    files.write_key_values(table(spark, d, "supplier").withColumn("b", _rounded("s_acctbal")), path, "s_suppkey", "b")
    return files.read_key_values(spark, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) || CHR(9) || CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def s9_vertex_write(spark, d):
    path = work_path(spark, "sorted")
    files.write_vertices(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey"), path, "n_regionkey")
    return spark.read.text(path)


@query("SELECT r_name AS value FROM region")
def s10_single_file(spark, d):
    path = work_path(spark, "single")
    files.write_single_file(table(spark, d, "region"), path, F.col("r_name"))
    return spark.read.text(path)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def s11_constant_bounds(spark, d):
    bounds = R.constant(spark, [(100000.0, 120000.0)], "lo double, hi double")
    return R.scalar_join(table(spark, d, "orders"), bounds).where("o_totalprice BETWEEN lo AND hi").select("o_orderkey", "o_custkey")


@query("SELECT CAST(i AS BIGINT) AS src, CAST((i + 1) % 1000 AS BIGINT) AS dst, CAST(i * 100 AS DOUBLE) AS weight FROM range(1000) t(i)")
def s14_ring_graph(spark, d):
    return files.ring(spark, 1000)[1].select("src", "dst", "weight")


@query(None)
def s15_fastq(spark, d):
    path = work_path(spark, "fastq")
    reads = table(spark, d, "orders").select(F.translate(F.lpad(F.conv(F.col("o_custkey").cast("string"), 10, 4), 12, "0"), "0123", "ACGT").alias("s"))
    reads.select(F.concat(F.lit("@r\n"), F.col("s"), F.lit("\n+\n"), F.repeat(F.lit("I"), 12)).alias("value")).write.text(path)
    return files.read_fastq(spark, path)


@query("SELECT '>' || p_name || CHR(10) || p_type AS value FROM part")
def s16_fasta(spark, d):
    return files.fasta(table(spark, d, "part"), F.col("p_name"), F.col("p_type"))


@query("SELECT 'digraph G {' AS value UNION ALL SELECT '}' UNION ALL SELECT '  \"' || n_regionkey || '\" -> \"' || n_nationkey || '\";' FROM nation WHERE n_regionkey = 2")
def s17_plot_subgraph(spark, d):
    edges = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("src"), F.concat(F.col("n_nationkey").cast("string")).alias("dst"))
    stars = edges.where("src <> dst").withColumn("src", F.concat(F.lit("r"), "src"))
    lines = files.graphviz(stars.union(edges.where("src = dst").withColumn("src", F.concat(F.lit("r"), "src"))), ["r2"], 1)
    return lines.select(F.regexp_replace("value", '"r', '"').alias("value"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_acctbal * 2 - 1000 > 5000 AND c_mktsegment <> 'BUILDING' OR c_nationkey % 7 = 3")
def s18_pig_dialect(spark, d):
    src, dst = work_path(spark, "pig-in"), work_path(spark, "pig-out")
    files.write_delimited(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"), src, ",")
    pig.run(spark, f'R = load "nc:{src}" as (id : long, balance : double, segment : chararray, nation : int); S = filter R by balance * 2 - 1000 > 5000 and segment != "BUILDING" or nation % 7 == 3; dump S into "nc:{dst}";')
    return files.read_delimited(spark, dst, "id long, balance double, segment string, nation int", ",").drop("nation")


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n FROM region")
def s19_result_reader(spark, d):
    n = sum(1 for _ in files.results(table(spark, d, "region")))
    return R.constant(spark, [(n,)], "n long")


@query("SELECT word, COUNT(*) AS n FROM (SELECT UNNEST(STRING_SPLIT(p_name, ' ')) AS word FROM part) t GROUP BY word")
def s20_word_count(spark, d):
    return files.word_count(table(spark, d, "part"), "p_name")


# -- projection, filter, unnest, split ---------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45")
def p2_assign_select(spark, d):
    out = R.select(table(spark, d, "lineitem"), F.col("l_quantity") > 45)
    return R.assign(out, net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).select("l_orderkey", "l_linenumber", "net")


@query("SELECT p_partkey, UNNEST(STRING_SPLIT(p_name, ' ')) AS word FROM part")
def p4_lateral_view(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return R.unnest(words, "words", "word").select("p_partkey", "word")


@query("SELECT n_nationkey, n_nationkey AS one FROM nation")
def p4_explode_scalar(spark, d):
    return R.unnest(table(spark, d, "nation"), "n_nationkey", "one").select("n_nationkey", "one")


@query("SELECT 'big' AS part, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'small', COUNT(*) FROM orders WHERE o_totalprice <= 200000")
def p5_shared_scan(spark, d):
    shared = R.replicate(table(spark, d, "orders").select("o_totalprice"))
    big = shared.where("o_totalprice > 200000").agg(F.lit("big").alias("part"), F.count("*").alias("n"))
    return R.union_all(big, shared.where("o_totalprice <= 200000").agg(F.lit("small").alias("part"), F.count("*").alias("n")))


# -- joins -----------------------------------------------------------------------------------------
@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_inner(spark, d):
    return R.equi_join(table(spark, d, "orders"), table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT a.l_orderkey AS l_orderkey, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey")
def j2_two_keys(spark, d):
    one = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return R.equi_join(one, one.withColumn("x", F.lit(1)), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def j3_left_outer(spark, d):
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 400000)
    return R.equi_join(table(spark, d, "customer"), table(spark, d, "orders"), on, "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def j4_right_outer(spark, d):
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P")
    return R.equi_join(table(spark, d, "orders"), table(spark, d, "customer"), on, "right").select("o_orderkey", "c_custkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def j5_theta(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    return R.theta_join(a, b, (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).select("a", "b")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j6_cross(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j7_anti(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return R.anti_join(table(spark, d, "customer"), urgent, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)")
def j8_semi(spark, d):
    full = table(spark, d, "lineitem").where("l_quantity = 50")
    return R.semi_join(table(spark, d, "supplier"), full, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def j9_self(spark, d):
    n = table(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) * 1.5E0 FROM customer)")
def j10_scalar(spark, d):
    c = table(spark, d, "customer")
    return R.scalar_join(c, c.agg((F.avg("c_acctbal") * 1.5).alias("bound"))).where("c_acctbal > bound").select("c_custkey")


@query("SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def j11_n_way(spark, d):
    out = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT a.c_nationkey AS k, COUNT(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY a.c_nationkey")
def j12_duplicated_keys(spark, d):
    one = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return R.equi_join_counts(one, one, ["k"])


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal < 0")
def j13_hash_outer(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").hint("shuffle_hash")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_custkey, ROUND(c_acctbal, 2) AS c_acctbal FROM orders RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def j14_index_right_outer(spark, d):
    index = KeyedTable(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", _rounded("c_acctbal")), "c_custkey")
    return R.equi_join(table(spark, d, "orders"), index.rows, F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey", "c_acctbal")


@query("SELECT id FROM (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) t")
def j15_id_union(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return R.id_union(a, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), "id")


# -- aggregation -----------------------------------------------------------------------------------
@query("SELECT l_returnflag, SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS big, ROUND(AVG(ABS(l_discount - 0.05)), 6) AS off, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
def a1_group_by(spark, d):
    return R.group_by(
        table(spark, d, "lineitem"),
        ["l_returnflag"],
        F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("big"),
        F.round(F.avg(F.abs(F.col("l_discount") - 0.05)), 6).alias("off"),
        F.min("l_linenumber").alias("lo"),
        F.max("l_linenumber").alias("hi"),
        F.count("*").alias("n"),
    )


@query("SELECT o_custkey, COUNT(*) AS n, MAX(t) AS largest FROM (SELECT o_custkey, o_orderstatus, COUNT(*) AS t FROM orders GROUP BY o_custkey, o_orderstatus) x GROUP BY o_custkey")
def a2_reused_partitioning(spark, d):
    parts = R.hash_partition(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), "o_custkey")
    inner = parts.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("t"))
    return inner.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("t").alias("largest"))


@query("SELECT l_suppkey, MIN(l_shipdate)::VARCHAR AS first_ship FROM lineitem GROUP BY l_suppkey")
def a3_sorted_group_by(spark, d):
    clustered = R.hash_partition_merge(table(spark, d, "lineitem").select("l_suppkey", "l_shipdate"), ["l_suppkey"], ["l_suppkey"])
    return clustered.groupBy("l_suppkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("first_ship"))


@query("SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem")
def a4_global(spark, d):
    return R.group_by(table(spark, d, "lineitem"), [], F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def a5_distinct(spark, d):
    return R.distinct(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_returnflag, ROUND(AVG(DISTINCT l_quantity), 6) AS avg_q, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def a6_distinct_aggregates(spark, d):
    return R.group_by(table(spark, d, "lineitem"), ["l_returnflag"], F.round(F.expr("avg(DISTINCT l_quantity)"), 6).alias("avg_q"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT o_custkey AS dst, ROUND(SUM(o_totalprice), 2) AS total, ROUND(MIN(o_totalprice), 2) AS least, BIT_OR(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS bits, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def a8_message_combine(spark, d):
    bit = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    return R.group_by(table(spark, d, "orders").withColumn("dst", F.col("o_custkey")), ["dst"], F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.min("o_totalprice"), 2).alias("least"), F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


@query("SELECT COUNT(*) AS vertices, MAX(c_custkey) AS largest, ROUND(SUM(c_acctbal), 2) AS total FROM customer")
def a9_global_aggregators(spark, d):
    return R.group_by(table(spark, d, "customer"), [], F.count("*").alias("vertices"), F.max("c_custkey").alias("largest"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, ROUND(SQRT(SUM(l_quantity * l_quantity)), 6) AS norm FROM lineitem GROUP BY l_returnflag, l_linestatus")
def a10_user_defined(spark, d):
    norm = Aggregate(init=float, iterate=lambda b, x: b if x is None else b + x * x, merge=lambda a, b: a + b, terminate=lambda b: round(b**0.5, 6))
    return aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], norm, "norm")


# -- order, limit, exchange, union -------------------------------------------------------------------
@query("SELECT o_orderkey, ROUND(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 37")
def o3_top_k(spark, d):
    return R.top_k(table(spark, d, "orders"), 37, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", _rounded("o_totalprice"))


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_custkey")
def o1_global_order(spark, d):
    return R.sort(table(spark, d, "customer"), F.asc("c_mktsegment"), F.desc("c_nationkey"), F.asc("c_custkey")).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def o4_sort_within_partitions(spark, d):
    return R.hash_partition_merge(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], ["s_nationkey", "s_suppkey"])


@query("SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY s_nationkey")
def x5_custom_partition(spark, d):
    return R.custom_partition(table(spark, d, "supplier"), F.col("s_nationkey") * 7, 4).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier")
def x7_unify(spark, d):
    return R.unify(table(spark, d, "supplier").select("s_suppkey"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def u3_union_all(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return R.union_all(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), s, s)


# -- functions -------------------------------------------------------------------------------------
@query("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS neq, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge, (p_size > 5 AND p_size < 20) OR NOT p_size < 40 AS logic, NULLIF(p_size, 7) IS NULL AS missing FROM part")
def f1_comparisons(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", (s == 10).alias("eq"), (s != 10).alias("neq"), (s < 10).alias("lt"), (s <= 10).alias("le"), (s > 10).alias("gt"), (s >= 10).alias("ge"), (((s > 5) & (s < 20)) | ~(s < 40)).alias("logic"), F.nullif(s, F.lit(7)).isNull().alias("missing"))


@query("SELECT p_partkey, ROUND(p_retailprice * 2 - 1 + 3, 4) AS a, CASE WHEN p_size - 10 = 0 THEN NULL ELSE ROUND(p_retailprice / (p_size - 10), 6) END AS q, ABS(p_size - 25) AS dist, CAST(p_size % 7 AS INT) AS m FROM part")
def f2_arithmetic(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 2 - 1 + 3, 4).alias("a"), F.round(scalar.divide(F.col("p_retailprice"), s - 10), 6).alias("q"), F.abs(s - 25).alias("dist"), (s % 7).alias("m"))


@query("SELECT p_partkey, SUBSTR(p_name, 2, 3) AS sub, p_name LIKE '%ring%' AS lk, REGEXP_MATCHES(p_type, 'SMALL|PROMO') AS rx, REGEXP_MATCHES(p_type, 'SM CASE||SM BOX') AS rx_empty, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS bucket, CAST(FLOOR(p_retailprice) AS INT) AS whole FROM part")
def f3_strings_case_cast(spark, d):
    p = table(spark, d, "part")
    size = F.when(F.col("p_size") > 25, "big").when(F.col("p_size") > 10, "mid").otherwise("small")
    return p.select("p_partkey", F.substring("p_name", 2, 3).alias("sub"), F.col("p_name").like("%ring%").alias("lk"), scalar.matches(F.col("p_type"), "SMALL|PROMO").alias("rx"), scalar.matches(F.col("p_type"), "SM CASE||SM BOX").alias("rx_empty"), size.alias("bucket"), F.floor("p_retailprice").cast("int").alias("whole"))


@query("SELECT CAST(YEAR(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, COUNT(*) FROM region")
def f4_year_of_string(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    bad = table(spark, d, "region").select(F.col("r_name").alias("s"))
    return o.union(bad).groupBy(scalar.year_of(F.col("s")).alias("y")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS ints, ROUND(SUM(TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'n/a' WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS DOUBLE)), 4) AS strings FROM part GROUP BY p_brand")
def f5_lenient_sum(spark, d):
    text = F.when(F.col("p_size") % 5 == 0, "n/a").when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size").cast("string"))
    p = table(spark, d, "part").withColumn("text", text)
    return p.groupBy("p_brand").agg(scalar.lenient_sum(F.col("p_size"), T.IntegerType()).alias("ints"), F.round(scalar.lenient_sum(F.col("text"), T.StringType()), 4).alias("strings"))


@query("SELECT a.p_name AS a, b.p_name AS b, CAST(LEVENSHTEIN(a.p_name, b.p_name) AS INT) AS dist FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def f6_edit_distance(spark, d):
    p = table(spark, d, "part")
    a, b = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")), p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b"))
    return a.join(b, "k").select("a", "b", scalar.edit_distance(F.col("a"), F.col("b")).alias("dist"))


# -- statements ------------------------------------------------------------------------------------
@query("SELECT 'cheap' AS kind, n_name, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 3000 GROUP BY n_name UNION ALL SELECT 'rich', n_name, COUNT(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 3000 GROUP BY n_name")
def d1_statements(spark, d):
    src = work_path(spark, "ddl")
    files.write_delimited(table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", "n_name"), src)
    run = statements.Runner(spark)
    run.script(f"""
SET limit_balance=3000;
DROP TABLE IF EXISTS supp; DROP TABLE IF EXISTS cheap; DROP TABLE IF EXISTS rich;
CREATE EXTERNAL TABLE supp (s_suppkey INT, s_acctbal DOUBLE, n_name STRING) ROW FORMAT DELIMITED FIELDS TERMINATED BY '|' STORED AS TEXTFILE LOCATION '{src}';
CREATE TABLE cheap (n_name STRING, n BIGINT); CREATE TABLE rich (n_name STRING, n BIGINT);
FROM supp
INSERT OVERWRITE TABLE cheap SELECT n_name, COUNT(*) WHERE s_acctbal < ${{hiveconf:limit_balance}} GROUP BY n_name
INSERT OVERWRITE TABLE rich SELECT n_name, COUNT(*) WHERE s_acctbal >= ${{hiveconf:limit_balance}} GROUP BY n_name;""")
    cheap, rich = run.table("cheap"), run.table("rich")
    return R.union_all(cheap.select(F.lit("cheap").alias("kind"), "n_name", "n"), rich.select(F.lit("rich").alias("kind"), "n_name", "n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 30000 AND l_quantity BETWEEN 10 AND 20")
def m1_spatial_range(spark, d):
    return R.select(table(spark, d, "lineitem"), F.col("l_extendedprice").between(20000, 30000) & F.col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber")


def queries():
    return {name: f for name, (f, _) in _REGISTERED.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
