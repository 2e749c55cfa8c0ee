"""Simplifying and cleaning a De Bruijn graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.assembly.kmers import Graph, degrees, is_forward, mirror, reverse_complement, without
from quillon.session import materialize


def _oriented(edges: DataFrame) -> DataFrame:
    """Directed edges between ``node+`` and ``node-``, the two directions in which a node can be read."""
    sign = lambda at: F.when(F.substring("kind", at, 1) == "F", "+").otherwise("-")
    return edges.select(F.col("src").alias("a"), sign(1).alias("sa"), F.col("dst").alias("b"), sign(2).alias("sb")).distinct()


def _at(node: str, sign: str) -> Column:
    return F.concat(F.col(node), F.col(sign))


def merge_paths(g: Graph) -> Graph:
    """Every maximal unbranched path becomes one node.

    Read in a direction, a node continues into the only node that it leads to, if that is led to by
    it alone.  Pointer jumping finds the start of each chain and the place in it in a logarithmic
    number of rounds.  A cycle is cut at its smallest id.  Both directions of a path give the same
    node, named by the smaller of its sequence and the reverse complement.  Coverage is the average
    over k-mers; reads keep their places.
    """
    edges = materialize(g.edges, "merge-edges")
    nodes = materialize(g.nodes, "merge-nodes")
    steps = _oriented(edges).select(_at("a", "sa").alias("u"), _at("b", "sb").alias("v"), "a", "b")
    only_out = steps.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"), F.min("a").alias("a"), F.min("b").alias("b")).where("n = 1 and a <> b")
    only_in = steps.groupBy("v").agg(F.count("*").alias("n")).where("n = 1").select("v")
    link = materialize(only_out.join(only_in, "v").select("u", "v"), "merge-links")
    both = nodes.select(F.explode(F.array(F.concat("node", F.lit("+")), F.concat("node", F.lit("-")))).alias("v"))
    n = both.count()
    rounds = max(1, math.ceil(math.log2(max(2, n))) + 1)

    chain = _ranked(both, link, rounds)
    # What has no start is in a cycle: cut the link into its smallest member, in both directions alike.
    loops = chain.where("not started").select(F.col("v"), "least")
    if loops.limit(1).count():
        other = F.concat(F.expr("substring(v, 1, length(v) - 1)"), F.when(F.col("v").endswith("+"), "-").otherwise("+"))
        twin = loops.select(other.alias("v"), F.col("least").alias("twin"))
        first = loops.join(twin, "v", "left").select("v", F.expr("substring(least, 1, length(least) - 1)").alias("name"))
        # Forward copy of the smallest node starts its cycle; the reverse copy ends the other one.
        starts = first.where(F.col("v") == F.concat("name", F.lit("+"))).select("v")
        ends = first.where(F.col("v") == F.concat("name", F.lit("-"))).select(F.col("v").alias("u"))
        link = materialize(link.join(starts, "v", "left_anti").join(ends, "u", "left_anti").select("u", "v"), "merge-links")
        chain = _ranked(both, link, rounds)

    cut = chain.withColumn("node", F.expr("substring(v, 1, length(v) - 1)")).withColumn("sign", F.expr("right(v, 1)"))
    full = cut.join(nodes, "node")
    seq = F.when(F.col("sign") == "+", F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    kmers = F.length("seq") - g.k + 1
    flip = F.col("sign") == "-"
    part = full.select("head", "v", "place", seq.alias("seq"), kmers.alias("kmers"), "coverage", F.when(flip, F.col("flipped")).otherwise(F.col("unflipped")).alias("unflipped"), F.when(flip, F.col("unflipped")).otherwise(F.col("flipped")).alias("flipped"))
    joined = part.groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("place", "v", "seq", "unflipped", "flipped"))).alias("parts"),
        F.sum("kmers").alias("kmers"),
        (F.sum(F.col("coverage") * F.col("kmers")) / F.sum("kmers")).alias("coverage"),
    )
    text = F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x["seq"]).otherwise(F.substring(x["seq"], g.k, 1 << 30))), "")
    reads = lambda c: F.array_sort(F.flatten(F.transform("parts", lambda x: x[c])))
    whole = joined.select("head", F.element_at("parts", -1)["v"].alias("tail"), text.alias("seq"), "coverage", reads("unflipped").alias("unflipped"), reads("flipped").alias("flipped"))
    whole = whole.withColumn("back", reverse_complement(F.col("seq")))
    # Of the two directions of a path the smaller stays; a palindrome's two copies fall together.
    whole = materialize(whole.withColumn("node", F.least("seq", "back")).withColumn("sign", F.when(F.col("seq") <= F.col("back"), "+").otherwise("-")), "merge-paths")
    kept = whole.where("sign = '+'").groupBy("node").agg(F.min("seq").alias("seq"), F.min("coverage").alias("coverage"), F.min_by("unflipped", "head").alias("unflipped"), F.min_by("flipped", "head").alias("flipped"))

    # Edges between the ends of chains that are no links.
    tails = whole.select(F.col("tail").alias("u"), F.col("node").alias("src"), F.col("sign").alias("s1"))
    heads = whole.select(F.col("head").alias("v"), F.col("node").alias("dst"), F.col("sign").alias("s2"))
    rest = steps.select("u", "v").join(link, ["u", "v"], "left_anti").join(tails, "u").join(heads, "v")
    letter = lambda c: F.when(F.col(c) == "+", "F").otherwise("R")
    new = rest.select("src", F.concat(letter("s1"), letter("s2")).alias("kind"), "dst").distinct()
    return Graph(kept, materialize(new, "merged-edges"), g.k)


def _ranked(both: DataFrame, link: DataFrame, rounds: int) -> DataFrame:
    """``v, head, place, least, started`` by pointer jumping towards the start of each chain."""
    state = both.join(link, "v", "left").select("v", F.coalesce("u", "v").alias("ptr"), F.when(F.col("u").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.least("v", F.coalesce("u", "v")).alias("least"))
    state = materialize(state, "ranks")
    moved = None
    for _ in range(rounds):
        to = state.select(F.col("v").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("more"), F.col("least").alias("other"))
        state = materialize(state.join(to, "ptr").select("v", F.col("next").alias("ptr"), (F.col("dist") + F.col("more")).alias("dist"), F.least("least", "other").alias("least")), "ranks")
        was, moved = moved, state.agg(F.bit_xor(F.xxhash64("v", "ptr"))).first()[0]
        if was == moved:
            break
    roots = both.join(link.select("v"), "v", "left_anti").select(F.col("v").alias("ptr"), F.lit(True).alias("started"))
    out = state.join(roots, "ptr", "left")
    return materialize(out.select("v", F.col("ptr").alias("head"), F.col("dist").alias("place"), "least", F.coalesce("started", F.lit(False)).alias("started")), "ranked")


def remove_bad_coverage(g: Graph, least: float = 3.0, most: float = math.inf) -> Graph:
    """Without nodes whose coverage is below ``least`` or above ``most``."""
    return without(g, g.nodes.where((F.col("coverage") < least) | (F.col("coverage") > most)).select("node"))


def remove_tips(g: Graph, longest: int | None = None) -> Graph:
    """Without dead ends: nodes of at most ``longest`` letters (default k) with edges on one side only."""
    d = degrees(g).where((F.col("out_degree") == 0) != (F.col("in_degree") == 0))
    tips = g.nodes.join(d, "node").where(F.length("seq") <= (g.k if longest is None else longest)).select("node")
    return without(g, tips)


def tips(g: Graph, longest: int | None = None, rounds: int = 1) -> Graph:
    """Merge paths, then drop dead ends, ``rounds`` times."""
    for _ in range(rounds):
        g = remove_tips(merge_paths(g), longest)
    return g


def _ends(g: Graph) -> DataFrame:
    """``node, prev, next``: nodes with one edge on each side, and what they lead to, strands included."""
    near = F.concat(F.col("dst"), F.substring("kind", 2, 1))
    d = g.edges.groupBy(F.col("src").alias("node")).agg(
        F.count_if(is_forward(F.col("kind"))).alias("o"),
        F.count_if(~is_forward(F.col("kind"))).alias("i"),
        F.max(F.when(is_forward(F.col("kind")), near)).alias("next"),
        F.max(F.when(~is_forward(F.col("kind")), near)).alias("prev"),
    )
    return d.where("o = 1 and i = 1").select("node", "prev", "next")


def remove_bubbles(g: Graph, dissimilarity: float = 0.05, longest: int | None = None) -> Graph:
    """Of parallel paths between the same ends, those go that differ little from the best covered one.

    Paths have at most ``longest`` letters (default 5k) and an edit distance of at most
    ``dissimilarity`` of the longer one.  Each is held against the best of its ends only, so that n
    parallel paths cost n comparisons.
    """
    longest = 5 * g.k if longest is None else longest
    path = g.nodes.join(_ends(g), "node").where(F.length("seq") <= longest)
    # Both directions of reading name the same pair of ends; sequences are read from the smaller end.
    turned = F.col("prev") > F.col("next")
    flip = lambda c: F.concat(F.expr(f"substring({c}, 1, length({c}) - 1)"), F.when(F.col(c).endswith("F"), "R").otherwise("F"))
    path = path.select("node", "coverage", F.when(turned, flip("next")).otherwise(F.col("prev")).alias("e1"), F.when(turned, flip("prev")).otherwise(F.col("next")).alias("e2"), F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("read"))
    best = path.groupBy("e1", "e2").agg(F.min_by(F.struct("node", "read"), F.struct(-F.col("coverage"), F.col("node"))).alias("best"), F.count("*").alias("n")).where("n > 1")
    held = path.join(best, ["e1", "e2"]).where(F.col("node") != F.col("best.node"))
    near = F.levenshtein("read", "best.read") <= dissimilarity * F.greatest(F.length("read"), F.length("best.read"))
    return without(g, held.where(near).select("node"))


def remove_bridges(g: Graph, longest: int | None = None) -> Graph:
    """Without short paths (at most k + 1 letters by default) that join two junctions."""
    longest = g.k + 1 if longest is None else longest
    path = g.nodes.join(_ends(g), "node").where(F.length("seq") <= longest).select("node")
    # The side of the neighbour that the path comes in at must have another edge.
    back = g.edges.select("src", "dst", mirror(F.col("kind")).alias("back"))
    sides = g.edges.groupBy(F.col("src").alias("dst"), is_forward(F.col("kind")).alias("side")).agg(F.count("*").alias("n"))
    crowded = back.join(path.withColumnRenamed("node", "src"), "src").withColumn("side", is_forward(F.col("back"))).join(sides, ["dst", "side"]).groupBy(F.col("src").alias("node")).agg(F.min("n").alias("n"))
    return without(g, crowded.where("n > 1").select("node"))


def unroll_tandem(g: Graph) -> Graph:
    """A node that leads to itself between one edge in and one edge out is read twice, and its loop goes.

    Only loops in the forward strand are unrolled, and each once: how often a repeat occurs cannot be
    told from the graph.
    """
    d = g.edges.groupBy(F.col("src").alias("node")).agg(
        F.count_if(is_forward(F.col("kind"))).alias("o"),
        F.count_if(~is_forward(F.col("kind"))).alias("i"),
        F.count_if((F.col("kind") == "FF") & (F.col("src") == F.col("dst"))).alias("loops"),
    )
    tandem = materialize(d.where("o = 2 and i = 2 and loops = 1").select("node"), "tandem")
    twice = F.concat("seq", F.substring("seq", g.k, 1 << 30))
    columns = ["node", "seq", "coverage", "unflipped", "flipped"]
    grown = g.nodes.join(tandem, "node", "left_semi").withColumn("seq", twice).select(columns)
    nodes = g.nodes.join(tandem, "node", "left_anti").select(columns).union(grown)
    loops = tandem.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return Graph(nodes, g.edges.join(loops, ["src", "dst"], "left_anti").select("src", "kind", "dst"), g.k)


def add_tip(g: Graph, at: str, tip: str, coverage: float = 1.0, kind: str = "FF") -> Graph:
    """The graph with a dead end ``tip`` on node ``at``; for tests of cleaning."""
    spark = g.nodes.sparkSession
    node = spark.createDataFrame([(tip, tip, coverage, [], [])], g.nodes.schema)
    back = {"FF": "RR", "RR": "FF"}.get(kind, kind)
    return Graph(g.nodes.union(node), g.edges.union(spark.createDataFrame([(at, kind, tip), (tip, back, at)], g.edges.schema)), g.k)


def add_path(g: Graph, left: str, right: str, path: str, coverage: float = 1.0) -> Graph:
    """The graph with a node ``path`` between two others: a bubble beside another path, or a bridge."""
    grown = add_tip(g, left, path, coverage, "FF")
    more = g.nodes.sparkSession.createDataFrame([(path, "FF", right), (right, "RR", path)], g.edges.schema)
    return Graph(grown.nodes, grown.edges.union(more), g.k)
