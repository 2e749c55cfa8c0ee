"""Assembly over reads that the tables hold: the letters of a part's name and type, mapped to A, C, G, T."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.assembly import clean, kmers, pipeline, stats
from quillon.session import materialize, table
from quillon.sources import files

K = 9
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ACGTTGCAACTGGTCACATGCTAGTC"
_READS = f"SELECT p_partkey AS read_id, TRANSLATE(REPLACE(LOWER(p_name || p_type), ' ', ''), '{_FROM}', '{_TO}') AS s FROM part"
_HEAD = f"""r AS ({_READS}),
pos AS (SELECT read_id, s, UNNEST(RANGE(1, LENGTH(s) - {K} + 2)) AS i FROM r),
x AS (SELECT read_id, i, SUBSTR(s, i, {K}) AS x, CASE WHEN i > 1 THEN SUBSTR(s, i - 1, {K}) END AS p FROM pos),
y AS (SELECT read_id, i, x, REVERSE(TRANSLATE(x, 'ACGT', 'TGCA')) AS xr, p, REVERSE(TRANSLATE(p, 'ACGT', 'TGCA')) AS pr FROM x),
z AS (SELECT read_id, i, LEAST(x, xr) AS node, CASE WHEN x <= xr THEN 'F' ELSE 'R' END AS xs, CASE WHEN p IS NOT NULL THEN LEAST(p, pr) END AS prev, CASE WHEN p <= pr THEN 'F' ELSE 'R' END AS ps FROM y),
nodes AS (SELECT node, CAST(COUNT(*) AS DOUBLE) AS coverage FROM z GROUP BY node),
l AS (SELECT DISTINCT prev AS src, ps || xs AS kind, node AS dst FROM z WHERE prev IS NOT NULL),
edges AS (SELECT src, kind, dst FROM l UNION SELECT dst, CASE kind WHEN 'FF' THEN 'RR' WHEN 'RR' THEN 'FF' ELSE kind END, src FROM l),
deg AS (SELECT node, CAST(COALESCE(SUM(CASE WHEN kind IN ('FF', 'FR') THEN 1 ELSE 0 END), 0) AS BIGINT) AS o, CAST(COALESCE(SUM(CASE WHEN kind IN ('RF', 'RR') THEN 1 ELSE 0 END), 0) AS BIGINT) AS i FROM nodes LEFT JOIN edges ON src = node GROUP BY node)"""


def reads(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.lower(F.concat("p_name", "p_type")), F.lit(" "), F.lit(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("read_id"), F.translate(text, _FROM, _TO).alias("seq"), F.lit(None).cast("string").alias("mate_seq"))


def graph(spark: SparkSession, d: str) -> kmers.Graph:
    g = kmers.build(reads(spark, d), K)
    return kmers.Graph(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"), g.k)


def as_build(spark, d):
    return kmers.build(reads(spark, d), K).nodes.select("node", "coverage")


def as_edges(spark, d):
    return kmers.build(reads(spark, d), K).edges


def as_read_heads(spark, d):
    n = kmers.build(reads(spark, d), K).nodes
    return n.select("node", F.size("unflipped").cast("long").alias("unflipped"), F.size("flipped").cast("long").alias("flipped"))


def as_degrees(spark, d):
    return kmers.degrees(graph(spark, d))


def as_check_symmetry(spark, d):
    return kmers.asymmetric(graph(spark, d))


def as_stats(spark, d):
    return stats.histogram(graph(spark, d)).where("measure in ('degree', 'length', 'coverage', 'path_node', 'tip_one', 'tip_both', 'self_edge_FR', 'self_edge_RF')")


def as_remove_bad_coverage(spark, d):
    return clean.remove_bad_coverage(graph(spark, d), 40.0).edges


def as_remove_tips(spark, d):
    return clean.remove_tips(graph(spark, d)).nodes.select("node", "coverage")


def as_merge(spark, d):
    return clean.merge_paths(graph(spark, d)).nodes.select("node", F.round("coverage", 6).alias("coverage"))


def as_bubbles(spark, d):
    return clean.remove_bubbles(clean.merge_paths(graph(spark, d)), dissimilarity=0.6).nodes.select("node")


def as_bridges(spark, d):
    return clean.remove_bridges(clean.merge_paths(graph(spark, d)), longest=2 * K).nodes.select("node")


def as_unroll_tandem(spark, d):
    g = clean.unroll_tandem(clean.merge_paths(graph(spark, d)))
    return g.nodes.select("node", F.length("seq").alias("letters"))


def as_assemble(spark, d):
    return files.fasta(pipeline.assemble(reads(spark, d), K, pipeline.DEFAULT, BUBBLE={"dissimilarity": 0.6}).nodes, F.col("node"), F.col("seq"))


def as_plot(spark, d):
    g = graph(spark, d)
    seed = g.nodes.agg(F.min("node")).first()[0]
    return files.graphviz(g.edges.withColumnRenamed("kind", "label"), [seed], 2)


def as_contig_stats(spark, d):
    got = stats.contig_stats(reads(spark, d).select(F.length("seq").alias("length")), 10, 30000)
    return spark.createDataFrame([(got["units"], got["reference"], got["bases"], got["min"], got["max"], round(got["e_size"], 4), got["n50"], got["n50_count"])], "units long, reference long, bases long, shortest int, longest int, e_size double, n50 int, n50_count long")


def as_coverage_cutoff(spark, d):
    return spark.createDataFrame([(stats.coverage_cutoff(graph(spark, d).nodes),)], "cutoff long")


_ORACLES = {
    "as_build": f"WITH {_HEAD} SELECT node, coverage FROM nodes",
    "as_edges": f"WITH {_HEAD} SELECT src, kind, dst FROM edges",
    "as_read_heads": f"WITH {_HEAD} SELECT node, COUNT(CASE WHEN i = 1 AND xs = 'F' THEN 1 END) AS unflipped, COUNT(CASE WHEN i = 1 AND xs = 'R' THEN 1 END) AS flipped FROM z GROUP BY node",
    "as_degrees": f"WITH {_HEAD} SELECT node, o AS out_degree, i AS in_degree FROM deg",
    "as_check_symmetry": f"WITH {_HEAD} SELECT src, kind, dst FROM edges WHERE FALSE",
    "as_stats": f"""WITH {_HEAD}, m AS (
SELECT 'degree' AS measure, o + i AS value FROM deg UNION ALL SELECT 'length', {K} FROM nodes
UNION ALL SELECT 'coverage', CAST(FLOOR(coverage + 0.5) AS BIGINT) FROM nodes
UNION ALL SELECT 'path_node', 1 FROM deg WHERE o = 1 AND i = 1
UNION ALL SELECT 'tip_one', 1 FROM deg WHERE (o = 0) <> (i = 0) UNION ALL SELECT 'tip_both', 1 FROM deg WHERE o = 0 AND i = 0
UNION ALL SELECT 'self_edge_' || kind, 1 FROM edges WHERE src = dst AND kind IN ('FR', 'RF'))
SELECT measure, CAST(value AS BIGINT) AS value, COUNT(*) AS n FROM m GROUP BY measure, value""",
    "as_remove_bad_coverage": f"WITH {_HEAD}, good AS (SELECT node FROM nodes WHERE coverage >= 40) SELECT src, kind, dst FROM edges WHERE src IN (SELECT node FROM good) AND dst IN (SELECT node FROM good)",
    "as_remove_tips": f"WITH {_HEAD} SELECT node, coverage FROM nodes WHERE node NOT IN (SELECT node FROM deg WHERE (o = 0) <> (i = 0))",
    # Walks along the only way on, from every node that no such way leads to, in both directions.
    "as_merge": f"""WITH RECURSIVE {_HEAD},
st AS (SELECT DISTINCT src AS a, src || SUBSTR(kind, 1, 1) AS u, dst AS b, dst || SUBSTR(kind, 2, 1) AS v FROM edges),
link AS (SELECT u, MIN(v) AS v FROM st GROUP BY u HAVING COUNT(*) = 1 AND MIN(a) <> MIN(b) AND MIN(v) IN (SELECT v FROM st GROUP BY v HAVING COUNT(*) = 1)),
ori AS (SELECT node || 'F' AS v, node AS seq, coverage FROM nodes UNION ALL SELECT node || 'R', REVERSE(TRANSLATE(node, 'ACGT', 'TGCA')), coverage FROM nodes),
walk AS (SELECT v AS cur, seq, coverage AS c, 1 AS n FROM ori WHERE v NOT IN (SELECT v FROM link)
  UNION ALL SELECT link.v, walk.seq || SUBSTR(ori.seq, {K}), c + coverage, n + 1 FROM walk JOIN link ON link.u = walk.cur JOIN ori ON ori.v = link.v)
SELECT DISTINCT LEAST(seq, REVERSE(TRANSLATE(seq, 'ACGT', 'TGCA'))) AS node, ROUND(c / n, 6) AS coverage FROM walk WHERE cur NOT IN (SELECT u FROM link)""",
    "as_contig_stats": f"""WITH c AS (SELECT CAST(LENGTH(s) AS INTEGER) AS n FROM ({_READS}) t), o AS (SELECT n, SUM(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS run, ROW_NUMBER() OVER (ORDER BY n DESC) AS k FROM c)
SELECT (SELECT COUNT(*) FROM c WHERE n > 10) AS units, CAST(30000 AS BIGINT) AS reference, (SELECT CAST(SUM(n) AS BIGINT) FROM c WHERE n > 10) AS bases, (SELECT MIN(n) FROM c WHERE n > 10) AS shortest, (SELECT MAX(n) FROM c WHERE n > 10) AS longest,
ROUND((SELECT SUM(n * n) FROM c WHERE n > 10) / 30000.0e0, 4) AS e_size, (SELECT MAX(n) FROM o WHERE run >= 15000) AS n50, (SELECT MIN(k) FROM o WHERE run >= 15000) AS n50_count""",
}


def queries():
    names = ["as_build", "as_edges", "as_read_heads", "as_degrees", "as_check_symmetry", "as_stats", "as_remove_bad_coverage", "as_remove_tips", "as_merge", "as_bubbles", "as_bridges", "as_unroll_tandem", "as_assemble", "as_plot", "as_contig_stats", "as_coverage_cutoff"]
    return {n: globals()[n] for n in names}


def oracle_sql():
    return dict(_ORACLES)
