"""Statistics of a graph, of contig lengths, and the coverage cutoff."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.assembly.kmers import Graph, degrees


def measures(g: Graph, seed_mean: float = 0.0, seed_std: float = float("inf")) -> DataFrame:
    """``measure, value``: a row for each measured value of each node."""
    n = g.nodes.join(degrees(g), "node")
    length = F.length("seq").cast("long")
    reads = F.size("unflipped") + F.size("flipped")
    in_range = F.col("coverage").between(seed_mean - seed_std, seed_mean + seed_std)
    rows = {
        "degree": (F.lit(True), F.col("in_degree") + F.col("out_degree")),
        "length": (F.lit(True), length),
        "coverage": (F.lit(True), F.floor(F.col("coverage") + 0.5)),
        "unflipped": (F.lit(True), F.size("unflipped")),
        "flipped": (F.lit(True), F.size("flipped")),
        "seed_score": (in_range, length * reads),
        "path_node": ((F.col("in_degree") == 1) & (F.col("out_degree") == 1), F.lit(1)),
        "tip_forward": (F.col("out_degree") == 0, F.lit(1)),
        "tip_reverse": (F.col("in_degree") == 0, F.lit(1)),
        "tip_both": ((F.col("in_degree") == 0) & (F.col("out_degree") == 0), F.lit(1)),
        "tip_one": ((F.col("in_degree") == 0) != (F.col("out_degree") == 0), F.lit(1)),
        "length_forward": (F.col("out_degree") > 0, length),
        "length_reverse": (F.col("in_degree") > 0, length),
    }
    cells = [F.when(c, F.struct(F.lit(k).alias("measure"), v.cast("long").alias("value"))) for k, (c, v) in rows.items()]
    node = n.select(F.explode(F.array_compact(F.array(*cells))).alias("m")).select("m.measure", "m.value")
    loops = g.edges.where("src = dst").select(F.concat(F.lit("self_edge_"), "kind").alias("measure"), F.lit(1).cast("long").alias("value"))
    return node.union(loops)


def histogram(g: Graph, **ranges) -> DataFrame:
    """``measure, value, n``."""
    return measures(g, **ranges).groupBy("measure", "value").agg(F.count("*").alias("n"))


def summary(g: Graph, **ranges) -> DataFrame:
    """``measure, n, total, largest``."""
    return measures(g, **ranges).groupBy("measure").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))


#: The shares of the total at which contig lengths are reported.
SHARES = (0.1, 0.25, 0.5, 0.75, 0.95)


def contig_stats(lengths: DataFrame, min_length: int = 0, expected_size: int = 0) -> dict:
    """Figures of an assembly from ``length`` rows.

    Contigs of at most ``min_length`` are left out of counts and totals, but not of the running sum
    that the N figures come from.  ``reference`` is the expected size, or the total if that is 0; the
    E-size is null if it is 0.  The driver sees one row for each distinct length.
    """
    rows = sorted(((r.length, r.n) for r in lengths.groupBy("length").agg(F.count("*").alias("n")).collect()), reverse=True)
    long = [(x, n) for x, n in rows if x > min_length]
    bases = sum(x * n for x, n in long)
    reference = expected_size or bases
    out = {"units": sum(n for _, n in long), "reference": reference, "bases": bases, "min": min((x for x, _ in long), default=None), "max": max((x for x, _ in long), default=None)}
    out["e_size"] = sum(x * x * n for x, n in long) / expected_size if expected_size else None
    for share in SHARES:
        run, seen, found = 0, 0, (None, None)
        for x, n in rows:
            need = -(-max(0.0, share * reference - run) // x) if x else n + 1
            if need <= n:
                found = (x, seen + max(1, int(need)))
                break
            run, seen = run + x * n, seen + n
        out[f"n{int(share * 100)}"], out[f"n{int(share * 100)}_count"] = found
    return out


def contig_points(lengths: DataFrame, reference: int, first: int) -> list[tuple[int, int, int, int]]:
    """For goals ``first``, 2 * first, ... up to the reference, ten steps of each size: ``goal, contigs, length, bases`` when the goal is met."""
    rows = sorted(((r.length, r.n) for r in lengths.groupBy("length").agg(F.count("*").alias("n")).collect()), reverse=True)
    goals, step, at = [], first, 0
    while at <= reference:
        step = step * 10 if at // step >= 10 else step
        at += step
        goals.append(at)
    out = []
    for goal in goals:
        run, seen = 0, 0
        for x, n in rows:
            need = -(-(goal - run) // x) if x else n + 1
            if need <= n:
                out.append((goal, seen + need, x, run + need * x))
                break
            run, seen = run + x * n, seen + n
    return out


# Where the fit of the coverage mixture starts.
EXP_MEAN, NORMAL_MEAN, NORMAL_STD, ITERATIONS, TINY = 5.0, 20.0, 5.0, 10, 1e-9


def coverage_cutoff(coverages: DataFrame, iterations: int = ITERATIONS) -> int:
    """The smallest coverage that belongs to the genome rather than to errors, 0 if there is none.

    ``coverages`` has ``coverage`` rows.  A mixture of an exponential and a normal distribution is
    fitted by expectation maximisation over the histogram, which is all that the driver sees.
    """
    rows = sorted((float(r.coverage), r.n) for r in coverages.groupBy("coverage").agg(F.count("*").alias("n")).collect())
    if not rows:
        return 0
    x, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    mean_e, mean_n, std, share_e, share_n = EXP_MEAN, NORMAL_MEAN, NORMAL_STD, 0.5, 0.5

    def density(at):
        e = np.where(at >= 0, np.exp(-at / mean_e) / mean_e, 0.0) * share_e
        g = np.exp(-0.5 * ((at - mean_n) / std) ** 2) / (std * np.sqrt(2 * np.pi)) * share_n
        return e, g

    def expect():
        e, g = density(x)
        e, g = np.where(e == 0, TINY, e), np.where(g == 0, TINY, g)
        return e / (e + g), g / (e + g)

    in_e, in_n = expect()
    for _ in range(iterations):
        total_e, total_n = (in_e * n).sum(), (in_n * n).sum()
        share_e, share_n = total_e / (total_e + total_n), total_n / (total_e + total_n)
        mean_e, mean_n = (in_e * n * x).sum() / total_e, (in_n * n * x).sum() / total_n
        std = float(np.sqrt((in_n * n * (x - mean_n) ** 2).sum() / total_n)) or TINY
        in_e, in_n = expect()
    total_e, total_n = (in_e * n).sum(), (in_n * n).sum()
    share_e, share_n = total_e / (total_e + total_n), total_n / (total_e + total_n)
    for c in range(1, int(np.ceil(x.max()))):
        e, g = density(np.array(float(c)))
        if e < g:
            return c
    return 0
