"""De Bruijn graphs from reads, in built-in functions.

A node is a k-mer in its canonical strand, the smaller of itself and its reverse complement.  An
edge is typed by the strands at its two ends, F or R; ``nodes`` and ``edges`` are two tables, so that
degrees, filters and merges are plain aggregations and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The type of an edge as its other end sees it.
MIRROR = {"FF": "RR", "RR": "FF", "FR": "FR", "RF": "RF"}
HEAD = "struct<mate:int,read_id:bigint,offset:int>"


@dataclass
class Graph:
    """``nodes(node, seq, coverage, unflipped, flipped)``, ``edges(src, kind, dst)`` both ways, and k.

    ``seq`` is the node's sequence in its forward strand; ``node`` identifies it.
    """

    nodes: DataFrame
    edges: DataFrame
    k: int


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def mirror(kind: Column) -> Column:
    return F.when(kind == "FF", "RR").when(kind == "RR", "FF").otherwise(kind)


def is_forward(kind: Column) -> Column:
    """Whether an edge leaves at the end of the forward strand."""
    return kind.isin("FF", "FR")


def id_order(seq: Column) -> tuple[Column, Column]:
    """Sort keys of the order of ids: shorter first, then by letters from the last to the first."""
    return F.length(seq), F.reverse(seq)


def reads_of(lines: DataFrame) -> DataFrame:
    """``read_id, seq, mate_seq`` of lines ``id <tab> read [<tab> mate]``; any other line is an error."""
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts).isin(2, 3), parts).otherwise(F.raise_error(F.concat(F.lit("not a read: "), F.col("value"))))
    p = lines.where(F.trim("value") != "").select(checked.alias("p"))
    return p.select(F.get("p", 0).cast("long").alias("read_id"), F.get("p", 1).alias("seq"), F.get("p", 2).alias("mate_seq"))


def build(reads: DataFrame, k: int, flipped_offset: int = 0) -> Graph:
    """The graph of ``read_id, seq, mate_seq``.

    Reads with letters other than A, C, G, T are dropped; reads of at most k letters are an error.
    Every occurrence of a k-mer counts 1 to its coverage; the first of a read records the read.
    """
    seqs = reads.select("read_id", F.explode(F.array(F.struct(F.lit(0).alias("mate"), F.col("seq").alias("s")), F.struct(F.lit(1).alias("mate"), F.col("mate_seq").alias("s")))).alias("r"))
    seqs = seqs.select("read_id", "r.mate", "r.s").where(F.col("s").rlike("^[ACGT]+$"))
    seqs = seqs.withColumn("s", F.when(F.length("s") > k, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("read is not longer than k: "), F.col("s")))))

    # One row for each place of a read: the k-mer, and the one before it.
    at = seqs.select("read_id", "mate", "s", F.explode(F.sequence(F.lit(1), F.length("s") - k + 1)).alias("i"))
    kmer, before = F.substr("s", "i", F.lit(k)), F.substr("s", F.col("i") - 1, F.lit(k))
    place = at.select("read_id", "mate", "i", kmer.alias("x"), F.when(F.col("i") > 1, before).alias("p"))
    place = place.withColumn("xr", reverse_complement(F.col("x"))).withColumn("pr", reverse_complement(F.col("p")))
    strand = lambda a, b: F.when(F.col(a) <= F.col(b), "F").otherwise("R")
    place = place.select("read_id", "mate", "i", F.least("x", "xr").alias("node"), F.least("p", "pr").alias("prev"), strand("x", "xr").alias("xs"), F.when(F.col("p").isNotNull(), strand("p", "pr")).alias("ps"))

    head = F.when(F.col("i") == 1, F.struct("mate", "read_id", F.when(F.col("xs") == "F", 0).otherwise(flipped_offset).cast("int").alias("offset")))
    nodes = place.groupBy("node").agg(
        F.count("*").cast("double").alias("coverage"),
        F.array_sort(F.collect_list(F.when(F.col("xs") == "F", head))).cast(f"array<{HEAD}>").alias("unflipped"),
        F.array_sort(F.collect_list(F.when(F.col("xs") == "R", head))).cast(f"array<{HEAD}>").alias("flipped"),
    )
    kind = F.concat("ps", "xs")
    links = place.where("prev is not null").select(F.col("prev").alias("src"), kind.alias("kind"), F.col("node").alias("dst")).distinct()
    edges = links.union(links.select("dst", mirror(F.col("kind")), "src")).distinct()
    return Graph(nodes.select("node", F.col("node").alias("seq"), "coverage", "unflipped", "flipped"), edges, k)


def adjacency(g: Graph) -> DataFrame:
    """One row a node with its four edge lists, as the graph is printed."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == t, F.col("dst")))).alias(t.lower()) for t in MIRROR]
    near = g.edges.groupBy(F.col("src").alias("node")).agg(*lists)
    out = g.nodes.join(near, "node", "left")
    return out.select("node", "seq", "coverage", *[F.coalesce(t.lower(), F.array().cast("array<string>")).alias(t.lower()) for t in MIRROR], "unflipped", "flipped")


def degrees(g: Graph) -> DataFrame:
    """``node, out_degree, in_degree``: edges at the end and at the start of the forward strand."""
    d = g.edges.groupBy(F.col("src").alias("node")).agg(F.count_if(is_forward(F.col("kind"))).alias("o"), F.count_if(~is_forward(F.col("kind"))).alias("i"))
    return g.nodes.select("node").join(d, "node", "left").select("node", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def asymmetric(g: Graph) -> DataFrame:
    """Edges whose mirror is missing; none in a sound graph."""
    back = g.edges.select(F.col("dst").alias("src"), mirror(F.col("kind")).alias("kind"), F.col("src").alias("dst"))
    return g.edges.join(back, ["src", "kind", "dst"], "left_anti")


def without(g: Graph, gone: DataFrame) -> Graph:
    """The graph without the nodes in ``gone(node)`` and their edges."""
    edges = g.edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return Graph(g.nodes.join(gone, "node", "left_anti"), edges.select("src", "kind", "dst"), g.k)
