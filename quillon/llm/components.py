"""Connected components by alternating stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the smallest node that edges reach.

    Each round hangs all larger neighbours of a node on its smallest neighbour, then all smaller
    ones; a logarithmic number of rounds leaves stars.  Every round is a pair of aggregations and
    joins that split where a node has many neighbours, and is written to the shared folder, so that
    a lost executor costs one round at most.  Self-loops, repeated and null edges are allowed; null
    edges are no edges.  An empty table gives an empty result.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("root"))
    now = materialize(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "cc")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = now.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(hung.union(small.select("hi", "m")).distinct(), "cc")
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo"))
    return stars.union(loops).groupBy("node").agg(F.min("root").alias("root"))
