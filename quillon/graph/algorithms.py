"""Graph algorithms as vertex programs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.graph.bsp import Program, run, run_python
from quillon.session import materialize

#: Fixed value: the distance of a vertex that is not reached.
UNREACHED = 1.7976931348623157e308


def page_rank(vertices: DataFrame, edges: DataFrame, max_supersteps: int = 10, n_vertices: int | None = None, damping: float = 0.85) -> DataFrame:
    """``id, value``: ranks after ``max_supersteps - 1`` updates.

    A vertex starts at 1/N and becomes (1 - damping)/N + damping * sum of what it is sent.  Vertices
    without edges send nothing, and what they hold is not spread.
    """
    program = Program(
        start=lambda value, step: F.lit(1.0 / max(1, step.vertices)),
        compute=lambda value, message, step: F.lit((1 - damping) / max(1, step.vertices)) + damping * F.coalesce(message, F.lit(0.0)),
        message=lambda value, weight, degree: value / degree,
        combine=F.sum,
        sends=lambda old, new, step: F.lit(True),
        halts=lambda value, step: F.lit(False),
    )
    return run(vertices.select("id"), edges, program, max_supersteps, n_vertices, until_quiet=False)


def shortest_paths(vertices: DataFrame, edges: DataFrame, source, max_supersteps: int = 1_000_000) -> DataFrame:
    """``id, value``: least sums of weights from ``source``; ``UNREACHED`` where no path leads."""
    start = vertices.select("id", F.when(F.col("id") == F.lit(source), 0.0).otherwise(UNREACHED).alias("value"))
    program = Program(
        start=lambda value, step: value,
        compute=lambda value, message, step: F.least(value, message),
        message=lambda value, weight, degree: value + weight,
        combine=F.min,
        first_sends=lambda value, step: value < UNREACHED,
        sends=lambda old, new, step: new < old,
    )
    return run(start, edges, program, max_supersteps)


def connected_components(vertices: DataFrame, edges: DataFrame, max_supersteps: int = 1_000_000) -> DataFrame:
    """``id, value``: the smallest id that flows to a vertex along edges.

    A vertex starts with the smallest of itself and the vertices that it points at.  Components are
    undirected ones only if every edge is there both ways.
    """
    near = edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near"))
    start = vertices.select("id").join(near, "id", "left").select("id", F.least("id", F.coalesce("near", "id")).alias("value"))
    program = Program(
        start=lambda value, step: value,
        compute=lambda value, message, step: F.least(value, message),
        message=lambda value, weight, degree: value,
        combine=F.min,
        sends=lambda old, new, step: new < old,
    )
    return run(start, edges, program, max_supersteps)


def reachability(vertices: DataFrame, edges: DataFrame, source, dest, max_supersteps: int = 1_000_000) -> DataFrame:
    """``id, value``: bit 1 if ``source`` reaches a vertex, bit 2 if ``dest`` does; the job stops after a superstep that finds both."""
    start = vertices.select("id", (F.when(F.col("id") == F.lit(source), 1).otherwise(0) + F.when(F.col("id") == F.lit(dest), 2).otherwise(0)).cast("int").alias("value"))
    program = Program(
        start=lambda value, step: value,
        compute=lambda value, message, step: value.bitwiseOR(message),
        message=lambda value, weight, degree: value,
        combine=F.bit_or,
        first_sends=lambda value, step: value != 0,
        aggregators={"met": lambda: F.max(F.col("value") == 3)},
        stop=lambda step: bool(step.aggregates.get("met")),
    )
    return run(start, edges, program, max_supersteps)


def message_counts(vertices: DataFrame, edges: DataFrame, clones: int = 10_000) -> DataFrame:
    """``id, value``: messages received when every vertex sends ``clones`` along each edge."""
    program = Program(
        start=lambda value, step: F.lit(0).cast("long"),
        compute=lambda value, message, step: message,
        message=lambda value, weight, degree: F.lit(clones).cast("long"),
        combine=F.sum,
    )
    return run(vertices.select("id", F.lit(0).cast("long").alias("value")), edges, program, 2)


def triangles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, value``: triangles of the undirected graph, each counted at its smallest vertex.

    The steps are those of ``_corners``; only counts leave them.
    """
    corners = _corners(materialize(_pairs(edges), "pairs"))
    counted = corners.groupBy(F.least("x", "p", "q").alias("id")).agg(F.count("*").alias("n"))
    return vertices.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("value"))


def _pairs(edges: DataFrame) -> DataFrame:
    """``a, b``: the undirected edges, each once with ``a < b``."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _corners(pairs: DataFrame) -> DataFrame:
    """``x, p, q``: every triangle of ``pairs`` once.

    Edges are turned from the end of smaller degree to the other, so that a hub has few outgoing
    edges and all work stays within the bound m * sqrt(m).  The paths of two edges make no rows: an
    edge carries the later targets of its start to its end, and they are cut with the targets there.
    """
    degree = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    turned = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.struct(F.greatest("da", "db").alias("d"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")).alias("to"))
    fans = materialize(turned.groupBy("x").agg(F.sort_array(F.collect_list("to")).getField("y").alias("ys")), "fans")
    carried = fans.where(F.size("ys") > 1).select("x", "ys", F.posexplode("ys").alias("at", "p"))
    carried = carried.where(F.col("at") + 1 < F.size("ys")).select("x", "p", F.slice("ys", F.col("at") + 2, F.size("ys")).alias("rest"))
    met = carried.join(fans.select(F.col("x").alias("p"), F.col("ys").alias("near")), "p")
    return met.select("x", "p", F.explode(F.array_intersect("rest", "near")).alias("q"))


def largest_cliques(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, size, cliques``: of the cliques in which a vertex is the smallest, the largest ones, ``a,b,c;`` each.

    A vertex without triangles among larger ids has its edges as cliques.  The triangles of any other
    hold all that can be larger, and are searched by themselves: they come in order, so that Python
    holds those of one vertex at a time.  A size below 2 gives ''.
    """
    pairs = materialize(_pairs(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))), "pairs")
    corner = _corners(pairs).select(F.array_sort(F.array("x", "p", "q")).alias("v"))
    corner = corner.select(F.col("v")[0].alias("c"), F.col("v")[1].alias("p"), F.col("v")[2].alias("q"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, near = None, {}
        for batch in batches:
            found = []
            for c, p, q in zip(*(column.to_numpy().tolist() for column in batch.columns)):
                if c != of:
                    if near:
                        found.append(_largest(of, near))
                    of, near = c, {}
                near.setdefault(p, set()).add(q)
                near.setdefault(q, set()).add(p)
            if found:
                yield _clique_rows(found)
        if near:
            yield _clique_rows([_largest(of, near)])

    got = corner.repartition("c").sortWithinPartitions("c").mapInArrow(search, "id long, size long, cliques string")
    edge = pairs.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("b")).alias("ps"))
    edge_text = F.array_join(F.transform("ps", lambda p: F.concat(F.col("id").cast("string"), F.lit(","), p.cast("string"), F.lit(";"))), "")
    out = vertices.select(F.col("id").cast("long").alias("id")).join(edge, "id", "left").join(got, "id", "left")
    return out.select(
        "id",
        F.coalesce("size", F.when(F.col("ps").isNotNull(), F.lit(2)), F.lit(1)).cast("long").alias("size"),
        F.coalesce("cliques", edge_text, F.lit("")).alias("cliques"),
    )


def _largest(c: int, near: dict[int, set[int]]) -> tuple[int, int, str]:
    found = list(_maximal(near))
    size = max(map(len, found))
    best = sorted(sorted([c, *k]) for k in found if len(k) == size)
    return c, size + 1, "".join(",".join(map(str, k)) + ";" for k in best)


def _clique_rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    ids, sizes, cliques = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cliques, pa.string())], ["id", "size", "cliques"])


def _maximal(near: dict[int, set[int]]) -> Iterator[frozenset[int]]:
    """Maximal cliques, all of the largest ones among them, by branching on what a pivot does not touch.

    A branch that cannot reach the size of the largest one so far is left.
    """
    best = 0
    stack = [(frozenset(), set(near), set())]
    while stack:
        clique, open_, closed = stack.pop()
        if len(clique) + len(open_) < best:
            continue
        if not open_ and not closed:
            best = len(clique)
            yield clique
            continue
        if not open_:
            continue
        pivot = max(open_ | closed, key=lambda v: len(near[v] & open_))
        for v in sorted(open_ - near[pivot]):
            stack.append((clique | {v}, open_ & near[v], closed & near[v]))
            open_ = open_ - {v}
            closed = closed | {v}


def mutate(vertices: DataFrame) -> DataFrame:
    """``id, value``: vertices below 100 divisible by 2 or 3 go, the others add one of a hundred times their id and send to it.

    Who is sent to runs once more, and 1900 deletes itself then: it stays if there is no vertex 19.
    """

    def compute(vertex, messages):
        if vertex.superstep == 1:
            if vertex.id < 100 and (vertex.id % 2 == 0 or vertex.id % 3 == 0):
                vertex.delete_vertex(vertex.id)
            elif vertex.id < 100:
                vertex.add_vertex(100 * vertex.id, vertex.value)
                vertex.send(100 * vertex.id, 0.0)
        elif vertex.id == 1900:
            vertex.delete_vertex(vertex.id)
        vertex.vote_to_halt()

    none = vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    return run_python(vertices, none, compute)


def max_id(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.max("id").alias("max_id"))
