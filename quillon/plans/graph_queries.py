"""Graph algorithms over a graph that the tables hold.

Its vertices are all parts.  Every line item that is followed by another one in its order gives an
edge from its part to the part of the next, so the graph grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.graph import algorithms as A
from quillon.graph import bsp
from quillon.graph.store import KeyedTable
from quillon.session import materialize, table
from quillon.sources import files

_EDGES = """
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) t
  WHERE src <> dst"""
_VERTICES = "SELECT p_partkey AS id FROM part"
_HEAD = f"e AS MATERIALIZED ({_EDGES}), v AS MATERIALIZED ({_VERTICES})"
#: Vertices that walks start at and end at.
SOURCE, DEST = 3, 99
#: Rounds in which labels settle: more than the diameter of the graph at any size, which falls as the tables grow.
ROUNDS = 12


def trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")), materialize(items.where("src <> dst").distinct(), "trade")


def _page_rank_sql(updates: int) -> str:
    parts = [f"WITH {_HEAD}, deg AS (SELECT src, COUNT(*) AS d FROM e GROUP BY src), n AS (SELECT COUNT(*) AS n FROM v)", "r0 AS (SELECT id, 1.0e0 / n AS r FROM v CROSS JOIN n)"]
    for i in range(1, updates + 1):
        parts.append(f"r{i} AS (SELECT v.id, 0.15e0 / n + 0.85e0 * COALESCE(s, 0) AS r FROM v CROSS JOIN n LEFT JOIN (SELECT e.dst, SUM(r / d) AS s FROM r{i - 1} JOIN e ON e.src = r{i - 1}.id JOIN deg ON deg.src = e.src GROUP BY e.dst) m ON m.dst = v.id)")
    return ", ".join(parts) + f" SELECT id, ROUND(r, 9) AS rank FROM r{updates}"


def g_page_rank(spark, d):
    v, e = trade(spark, d)
    return A.page_rank(v, e, 10).select("id", F.round("value", 9).alias("rank"))


def g_shortest_paths(spark, d):
    v, e = trade(spark, d)
    return A.shortest_paths(v, e, SOURCE).select("id", F.col("value").alias("distance"))


def g_components(spark, d):
    v, e = trade(spark, d)
    return A.connected_components(v, e.union(e.select("dst", "src"))).select("id", F.col("value").alias("component"))


def g_flow_components(spark, d):
    v, e = trade(spark, d)
    return A.connected_components(v, e).select("id", F.col("value").alias("label"))


def g_reachability(spark, d):
    v, e = trade(spark, d)
    return A.reachability(v, e, SOURCE, DEST).select("id", F.col("value").cast("int").alias("bits"))


def g_triangles(spark, d):
    v, e = trade(spark, d)
    return A.triangles(v, e).select("id", F.col("value").alias("n"))


def g_message_counts(spark, d):
    v, e = trade(spark, d)
    return A.message_counts(v, e, 100).select("id", F.col("value").alias("n"))


def g_largest_cliques(spark, d):
    v, e = trade(spark, d)
    return A.largest_cliques(v, e)


def g_mutation(spark, d):
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("value"))
    return A.mutate(v)


def g_stop(spark, d):
    """Distances up to the superstep after which a global aggregator says that most vertices are reached."""
    v, e = trade(spark, d)
    start = v.select("id", F.when(F.col("id") == SOURCE, 0.0).otherwise(A.UNREACHED).alias("value"))
    program = bsp.Program(
        start=lambda value, step: value,
        compute=lambda value, message, step: F.least(value, message),
        message=lambda value, weight, degree: value + weight,
        combine=F.min,
        first_sends=lambda value, step: value < A.UNREACHED,
        sends=lambda old, new, step: new < old,
        aggregators={"reached": lambda: F.count_if(F.col("value") < A.UNREACHED)},
        stop=lambda step: 2 * step.aggregates["reached"] > step.vertices,
    )
    return bsp.run(start, e, program).select("id", F.col("value").alias("distance"))


def g_edge_changes(spark, d):
    """Each vertex drops its edges to smaller ids and adds one to ``SOURCE``; then messages, delivered as lists, are counted."""
    v, e = trade(spark, d)

    def compute(vertex, messages):
        if vertex.superstep == 1:
            for to, _ in list(vertex.edges):
                if to < vertex.id:
                    vertex.remove_edge(to)
            vertex.add_edge(SOURCE)
            vertex.sort_edges()
        elif vertex.superstep == 2:
            vertex.send_to_all(vertex.id)
        else:
            vertex.value = len(messages) * 1_000_000 + max(messages)
        if vertex.superstep > 1:
            vertex.vote_to_halt()

    return bsp.run_python(v, e, compute, value_type="bigint", message_type="bigint").select("id", F.coalesce("value", F.lit(0)).alias("seen"))


def g_max_id(spark, d):
    return A.max_id(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


def g_scale_up(spark, d):
    v, e = files.scale_graph(*trade(spark, d), 3)
    return e.select("src", "dst")


def g_vertex_program(spark, d):
    """The largest id that reaches a vertex, by a program in Python."""
    v, e = trade(spark, d)

    def compute(vertex, messages):
        best = max([vertex.id if vertex.superstep == 1 else vertex.value, *messages])
        if vertex.superstep == 1 or best > vertex.value:
            vertex.value = best
            vertex.send_to_all(best)
        vertex.vote_to_halt()

    return bsp.run_python(v, e, compute, combine=F.max, value_type="bigint", message_type="bigint").select("id", F.col("value").alias("largest"))


def g_keyed_table(spark, d):
    """Load, delete, insert, update, then a range search."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("value"), "s_acctbal")
    store = KeyedTable(s.where("s_acctbal < 6000").select("id", "value"))
    store.delete(s.where("value < 10"))
    store.insert(s.where("s_acctbal > 4000 and value < 20"))
    store.update(F.col("value") == 3, value=F.lit(-1))
    return store.range(low=5)


def _walk(source: int, name: str = "") -> str:
    """Steps from ``source`` to each vertex along edges."""
    return f"walk{name} AS (SELECT CAST({source} AS BIGINT) AS id, 0 AS k UNION SELECT e.dst, k + 1 FROM walk{name} w JOIN e ON e.src = w.id WHERE k < {ROUNDS}), d{name} AS (SELECT id, MIN(k) AS k FROM walk{name} GROUP BY id)"


def _labels(start: str, best: str, edges: str = "e") -> str:
    """Labels that flow along edges, the best of which stays."""
    parts = [f"WITH {_HEAD}", "both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", f"r0 AS ({start})"]
    pick = "LEAST" if best == "MIN" else "GREATEST"
    for i in range(1, ROUNDS + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT r.id, {pick}(r.l, COALESCE(m.l, r.l)) AS l FROM r{i - 1} r LEFT JOIN (SELECT g.dst, {best}(l) AS l FROM r{i - 1} JOIN {edges} g ON g.src = r{i - 1}.id GROUP BY g.dst) m ON m.dst = r.id)")
    return ", ".join(parts)


_FIRST = "SELECT v.id, LEAST(v.id, COALESCE(MIN(dst), v.id)) AS l FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"
_FAR = "1.7976931348623157e308"
_ORACLES = {
    "g_page_rank": _page_rank_sql(9),
    "g_shortest_paths": f"WITH RECURSIVE {_HEAD}, {_walk(SOURCE)} SELECT v.id, COALESCE(CAST(k AS DOUBLE), {_FAR}) AS distance FROM v LEFT JOIN d ON d.id = v.id",
    "g_components": f"{_labels('SELECT id, id AS l FROM v', 'MIN', 'both_ways')} SELECT id, l AS component FROM r{ROUNDS}",
    # Each vertex starts with the smallest of itself and its targets.
    "g_flow_components": f"{_labels(_FIRST, 'MIN')} SELECT id, l AS label FROM r{ROUNDS}",
    # The job stops after the first superstep in which both walks have met in a vertex.
    "g_reachability": f"""WITH RECURSIVE {_HEAD}, {_walk(SOURCE, '1')}, {_walk(DEST, '2')}, met AS (SELECT COALESCE(MIN(GREATEST(d1.k, d2.k)), {ROUNDS}) AS k FROM d1 JOIN d2 ON d1.id = d2.id JOIN v ON v.id = d1.id)
SELECT v.id, CAST(CASE WHEN d1.k <= met.k THEN 1 ELSE 0 END + CASE WHEN d2.k <= met.k THEN 2 ELSE 0 END AS INTEGER) AS bits FROM v CROSS JOIN met LEFT JOIN d1 ON d1.id = v.id LEFT JOIN d2 ON d2.id = v.id""",
    "g_stop": f"""WITH RECURSIVE {_HEAD}, {_walk(SOURCE)}, last AS (SELECT COALESCE(MIN(k), {ROUNDS}) AS k FROM (SELECT s.k FROM (SELECT DISTINCT k FROM d) s JOIN d ON d.k <= s.k JOIN v ON v.id = d.id GROUP BY s.k HAVING 2 * COUNT(*) > (SELECT COUNT(*) FROM v)) t)
SELECT v.id, COALESCE(CAST(CASE WHEN d.k <= last.k THEN d.k END AS DOUBLE), {_FAR}) AS distance FROM v CROSS JOIN last LEFT JOIN d ON d.id = v.id""",
    "g_edge_changes": f"WITH {_HEAD} SELECT v.id, COALESCE(n, 0) AS seen FROM v LEFT JOIN (SELECT dst, 1000000 * COUNT(*) + MAX(src) AS n FROM (SELECT src, dst FROM e WHERE src < dst UNION ALL SELECT id, {SOURCE} FROM v) t GROUP BY dst) m ON m.dst = v.id",
    "g_triangles": f"WITH {_HEAD}, u AS (SELECT DISTINCT LEAST(src, dst) AS a, GREATEST(src, dst) AS b FROM e), t AS (SELECT x.a FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b) SELECT v.id, COUNT(t.a) AS n FROM v LEFT JOIN t ON t.a = v.id GROUP BY v.id",
    "g_message_counts": f"WITH {_HEAD} SELECT v.id, CAST(100 * COUNT(e.dst) AS BIGINT) AS n FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id",
    # Cliques grow by larger and larger vertices that touch all members.
    "g_largest_cliques": f"""WITH RECURSIVE {_HEAD}, u AS (SELECT DISTINCT LEAST(src, dst) AS a, GREATEST(src, dst) AS b FROM e), adj AS MATERIALIZED (SELECT a, LIST(b) AS bs FROM u GROUP BY a),
c AS (SELECT a AS id, [a] AS m, bs AS cand FROM adj UNION ALL
  SELECT t.id, LIST_APPEND(t.m, t.b), LIST_INTERSECT(t.cand, COALESCE(adj.bs, [])) FROM (SELECT id, m, cand, UNNEST(cand) AS b FROM c) t LEFT JOIN adj ON adj.a = t.b),
best AS (SELECT id, MAX(LEN(m)) AS n FROM c GROUP BY id)
SELECT v.id, CAST(COALESCE(MAX(best.n), 1) AS BIGINT) AS size, COALESCE(STRING_AGG(ARRAY_TO_STRING(c.m, ',') || ';', '' ORDER BY c.m), '') AS cliques
FROM v LEFT JOIN best ON best.id = v.id LEFT JOIN c ON c.id = best.id AND LEN(c.m) = best.n GROUP BY v.id""",
    "g_mutation": "WITH kept AS (SELECT p_partkey AS id FROM part WHERE NOT (p_partkey < 100 AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0))) SELECT id, CAST(0 AS DOUBLE) AS value FROM (SELECT id FROM kept UNION SELECT id * 100 FROM kept WHERE id < 100) t WHERE id <> 1900 OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = 19)",
    "g_keyed_table": "SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN -1 ELSE s_nationkey END AS value FROM supplier WHERE (s_acctbal < 6000 AND s_nationkey >= 10 OR s_acctbal > 4000 AND s_nationkey < 20) AND s_suppkey >= 5",
    "g_max_id": "SELECT MAX(o_orderkey) AS max_id FROM orders",
    "g_scale_up": f"WITH {_HEAD} SELECT src + i * (SELECT MAX(id) + 1 FROM v) AS src, dst + i * (SELECT MAX(id) + 1 FROM v) AS dst FROM e CROSS JOIN range(3) t(i)",
    "g_vertex_program": f"{_labels('SELECT id, id AS l FROM v', 'MAX')} SELECT id, l AS largest FROM r{ROUNDS}",
}


def queries():
    names = ["g_page_rank", "g_shortest_paths", "g_components", "g_flow_components", "g_reachability", "g_triangles", "g_message_counts", "g_largest_cliques", "g_mutation", "g_stop", "g_edge_changes", "g_max_id", "g_scale_up", "g_vertex_program", "g_keyed_table"]
    return {n: globals()[n] for n in names}


def oracle_sql():
    return dict(_ORACLES)
