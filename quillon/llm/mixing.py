"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to.  The flow
network is small: one node for each pattern and each source.  From the origin to a pattern lead one
arc for each repetition, each as wide as the pattern is large and dearer than the last, so that the
flow repeats as little as it can and spreads repetition evenly; from a pattern to its sources; from
a source to the sink as wide as its quota.  The flow of a pattern then selects documents along a
seeded order: whole documents, repetition by repetition.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, materialize

MOST_REPEATS = 3
#: Documents after a cut that may fill what is missing there.
FILL = 64
#: Rows up to which a plan is broadcast.
BROADCAST_ROWS = 100_000
#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Shares of all sizes by weight; what exceeds ``most`` times a source's size is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, list(names)
    while free:
        scale = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * scale > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * scale for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST_REPEATS) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources; cheapest among the largest flows."""
    pats, srcs = list(patterns), list(quotas)
    node = {("p", p): 1 + i for i, p in enumerate(pats)} | {("s", s): 1 + len(pats) + i for i, s in enumerate(srcs)}
    sink = 1 + len(node)
    to, cap, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
        return len(to) - 2

    gives = {}
    for p in pats:
        for r in range(most):
            arc(0, node["p", p], patterns[p], r * (r + 1) // 2)  # convex: 0, 1, 3, ...
        for s in p:
            if s in quotas:
                gives[p, s] = arc(node["p", p], node["s", s], 1 << 62, 0)
    for s in srcs:
        arc(node["s", s], sink, quotas[s], 0)

    height = [0] * (sink + 1)
    while True:
        far = [1 << 62] * (sink + 1)
        far[0], via, heap = 0, [-1] * (sink + 1), [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                y = to[e]
                if cap[e] > 0 and (n := d + cost[e] + height[x] - height[y]) < far[y]:
                    far[y], via[y] = n, e
                    heapq.heappush(heap, (n, y))
        if via[sink] < 0:
            break
        height = [h + min(f, far[sink]) for h, f in zip(height, far)]
        push, x = 1 << 62, sink
        while x:
            push, x = min(push, cap[via[x]]), to[via[x] ^ 1]
        x = sink
        while x:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return {p: {s: cap[gives[p, s] ^ 1] for s in p if (p, s) in gives} for p in pats}


def _keyed(df: DataFrame, sources: Column, size: Column, id_col: str, seed: int) -> DataFrame:
    """``df`` with the columns ``mx``: pattern, size, and the place of the row along the seeded order."""
    pattern = F.array_sort(F.array_distinct(sources.cast("array<string>")))
    ident = F.col(id_col).cast("long")
    place = F.struct(F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 2).alias("h"), ident.alias("id"), size.cast("long").alias("size"))
    return df.withColumn("mx", F.struct(pattern.alias("pattern"), size.cast("long").alias("size"), place.alias("place")))


def plan(
    df: DataFrame,
    sources: Column,
    size: Column,
    id_col: str = "doc_id",
    weights=WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = 11,
    cells: int = 65536,
    fill: int = FILL,
) -> tuple[DataFrame, dict]:
    """``pattern, cuts, more``: for each repetition the last place that is taken, and places after it; and ``{source: (size, target)}``.

    ``sources`` is an array of the sources that a row belongs to; a null one is a source of its own
    and sorts last.  A pattern's words are met from below, but for one last document that comes nearer: whole
    documents up to a cut, then those of
    the next ``fill`` places that fit what is missing: a larger ``fill`` comes nearer to the target, and
    drops nothing.  Documents of a pattern follow a seeded hash of the id, so reruns agree; equal ids
    follow by size.  Rows that agree in both have one place, which is counted as one: of such a place
    after a cut as many rows are taken as fit.  An empty table gives an empty plan.  The driver holds a
    few numbers and at most ``fill`` places a repetition for each pattern, and about ``cells`` sums,
    whatever the number of documents; only rows of cells at a cut are ever sorted.
    """
    spark = df.sparkSession
    base = materialize(_keyed(df, sources, size, id_col, seed).select("mx.*"), "mix-base")
    key = lambda p: tuple(sorted(p or [], key=lambda s: (s is None, s or "")))
    sums = {key(r.pattern): r.n for r in base.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    by_source: dict = {}
    for p, n in sums.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    goal = targets(by_source, weights, most) if by_source else {}
    if goal and any(len(p) != 1 for p in sums):  # a word in two sources is there only once
        scale = sum(sums.values()) / max(1.0, sum(goal.values()))
        goal = {s: t * scale for s, t in goal.items()}
    flow = min_cost_flow(sums, {s: round(t) for s, t in goal.items()}, most)
    wanted = {p: sum(f.values()) for p, f in flow.items()}

    bits = max(1, min(12, (cells // max(1, len(sums))).bit_length() - 1))
    celled = base.where("size > 0").withColumn("cell", F.shiftright(F.col("place.h"), 62 - bits).cast("int"))
    cell_sums: dict[tuple, list[tuple[int, int, int]]] = {}
    for r in celled.groupBy("pattern", "cell").agg(F.sum("size").alias("n"), F.count_distinct("place").alias("k")).collect():
        cell_sums.setdefault(key(r.pattern), []).append((r.cell, r.n, r.k))

    # The cell in which each repetition ends, and those after it with the next FILL rows; a whole
    # repetition ends nowhere, none at all before the start.
    cuts: dict[tuple, list] = {p: [None] * most for p in sums}
    more: dict[tuple, list] = {p: [[] for _ in range(most)] for p in sums}
    asked = []
    for p, total in sums.items():
        for r in range(most):
            rest, run, rows = wanted[p] - total * r, 0, None
            if total > 0 and rest >= total:
                cuts[p][r] = ((1 << 62), None, None)
            elif rest > 0:
                for c, n, k in sorted(cell_sums.get(p, [])):
                    if rows is None and run + n >= rest:
                        asked.append((list(p), c, r, rest - run, True))
                        rows = 0
                    elif rows is not None and rows < fill:
                        asked.append((list(p), c, r, 0, False))
                        rows += k
                    run += n
    if asked:
        table = spark.createDataFrame(asked, "a_pattern array<string>, a_cell int, r int, rest long, ends boolean")
        order = Window.partitionBy("pattern", "cell", "r").orderBy("place")
        at = celled.join(_small(table), F.col("pattern").eqNullSafe(F.col("a_pattern")) & (F.col("cell") == F.col("a_cell")))
        at = at.groupBy("pattern", "cell", "r", "rest", "ends", "place").agg(F.sum("size").alias("size"), F.count("*").alias("k"))
        at = at.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        at = at.withColumn("inside", F.col("ends") & (F.col("upto") <= F.col("rest")))
        taken = at.where("ends").groupBy("pattern", "r", "cell", "rest").agg(F.max(F.when(F.col("inside"), F.col("place"))).alias("cut"), F.max(F.when(F.col("inside"), F.col("upto"))).alias("upto"))
        left = {}
        for e in taken.collect():
            # No place of the cell is taken: the cut lies before the cell.
            cuts[key(e.pattern)][e.r] = tuple(e.cut) if e.cut else ((e.cell << (62 - bits)) - 1, None, None)
            left[key(e.pattern), e.r] = e.rest - (e.upto or 0)
        # What is still missing is filled by the next places of the order that fit, then by the one
        # further document that comes nearest, if it leaves less over than there was missing.
        skipped: dict[tuple, list] = {}
        ahead = Window.partitionBy("pattern", "r").orderBy("place")
        after = at.where(~F.col("inside")).withColumn("nth", F.row_number().over(ahead)).where(F.col("nth") <= fill)
        for e in after.orderBy("r", "nth").select("pattern", "r", "place", "k").collect():
            p = key(e.pattern)
            fits = min(e.k, left[p, e.r] // e.place.size)
            if fits:
                left[p, e.r] -= fits * e.place.size
                more[p][e.r].append((tuple(e.place), fits, e.k))
            else:
                skipped.setdefault((p, e.r), []).append((e.place.size, tuple(e.place), e.k))
        for (p, r), others in skipped.items():
            over, place, k = min(others, key=lambda x: x[0])
            if over < 2 * left[p, r]:
                more[p][r].append((place, 1, k))
    rows = [(list(p), cuts[p], [x for part in more[p] for x in part]) for p in sums]
    place = "struct<h:bigint,id:bigint,size:bigint>"
    return spark.createDataFrame(rows, f"pattern array<string>, cuts array<{place}>, more array<struct<place:{place},takes:bigint,of:bigint>>"), {s: (by_source[s], goal[s]) for s in goal}


def _small(table: DataFrame) -> DataFrame:
    """A broadcast hint for a table of a few rows a pattern, if the patterns are not too many for that."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def apply(df: DataFrame, cuts: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """``df`` with ``mx`` (pattern, size, place) and ``copies``: how often the mix takes the whole document, 0 to 3.

    Rows are judged alone against the cuts of their pattern, which are as few as the patterns; no row
    is shuffled but those of the few places that are taken in part, whose rows are numbered by a hash.
    Empty documents are never taken.  Columns named ``mx`` and ``copies`` are replaced.
    """
    kept = [c for c in df.columns if c not in ("mx", "copies")]
    table = cuts.select(F.col("pattern").alias("mx_pattern"), F.col("cuts").alias("mx_cuts"), F.col("more").alias("mx_more"))
    keyed = _keyed(df.drop("mx", "copies"), sources, size, id_col, seed).join(_small(table), F.col("mx.pattern").eqNullSafe(F.col("mx_pattern")), "left")
    nth = F.lit(0).cast("long")
    if cuts.where(F.exists("more", lambda m: m["takes"] < m["of"])).limit(1).count():
        part = F.coalesce(F.exists("mx_more", lambda m: (m["place"] == F.col("mx.place")) & (m["takes"] < m["of"])), F.lit(False))
        same = Window.partitionBy("mx.pattern", "mx.place").orderBy(F.xxhash64(*kept))
        keyed = keyed.where(~part).withColumn("mx_nth", nth).union(keyed.where(part).withColumn("mx_nth", F.row_number().over(same).cast("long")))
    else:
        keyed = keyed.withColumn("mx_nth", nth)
    taken = F.size(F.filter("mx_cuts", lambda c: c.isNotNull() & (F.col("mx.place") <= c))) + F.size(F.filter("mx_more", lambda m: (F.col("mx.place") == m["place"]) & (F.col("mx_nth") <= m["takes"])))
    copies = F.when((F.col("mx.size") > 0) & F.col("mx_cuts").isNotNull(), taken).otherwise(0)
    return keyed.withColumn("copies", copies).drop("mx_pattern", "mx_cuts", "mx_more", "mx_nth")
