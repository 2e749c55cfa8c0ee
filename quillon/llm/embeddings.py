"""Near-duplicate embeddings: random-hyperplane hashing in several tables, exact cosines, components.

Equal vectors of one label are one class first, so copies cost nothing further.  Each table hashes a
class to the signs of ``bits`` random projections; classes that agree in a table meet in a bucket.
What travels to the buckets is a class key and a mark, the signs of ``MARK`` more projections: pairs
whose marks differ in more places than pairs at the threshold ever do are ruled out.  Vectors are
fetched only for the classes of a bucket that are left with a partner, and cosines are computed in
double precision.  A pair that meets in several tables counts in the first.  Buckets of more than
``BUCKET`` classes are cut into blocks against blocks, so every pair of a bucket is compared whatever
its size.  A block gives out one row a class, not one a pair.

``bits`` follows the number of vectors of the largest label, so buckets stay small, and the number of
tables follows ``bits`` and the threshold, so that the chance to miss a pair right at the threshold
is at most ``miss`` at every size; the marks add less than a hundredth of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import frugal, materialize
from quillon.llm.components import connected_components

BUCKET = 2048
#: Signs of a mark, a multiple of 64.
MARK = 128
SEED = 20


def table_sizes(most: int, cosine: float, miss: float, per_bucket: int = 16) -> tuple[int, int]:
    """Bits of a signature and number of tables for a label of ``most`` vectors."""
    bits = max(6, math.ceil(math.log2(max(1, most) / per_bucket)))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``tables`` integers and a mark of ``MARK // 8`` bytes for each vector; the hyperplanes depend on the seed and the dimension only."""
    planes = np.random.default_rng([seed, vectors.shape[1], bits]).standard_normal((vectors.shape[1], tables * bits + MARK))
    signs = vectors @ planes > 0
    tabled = signs[:, : tables * bits].reshape(len(vectors), tables, bits)
    return tabled @ (1 << np.arange(bits, dtype=np.int64)), np.packbits(signs[:, tables * bits :], axis=1)


def most_apart(cosine: float, miss: float) -> int:
    """Places in which the marks of a pair at the threshold differ at most, but for a chance of ``miss``: a tail of the binomial distribution."""
    p, left = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 1.0
    for k in range(MARK):
        left -= math.comb(MARK, k) * p**k * (1 - p) ** (MARK - k)
        if left <= miss:
            return k
    return MARK


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1.  They are scaled by a power of two first, which is exact, so that no square overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _class_key(label, v: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(v.tobytes(), seed=label & 0xFFFFFFFFFFFFFFFF)


def pack(a: np.ndarray) -> bytes:
    """A vector as bytes, in single precision if that loses nothing."""
    single = a.astype(np.float32)
    return single.tobytes() if (single == a).all() else a.tobytes()


def unpack(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, dtype=np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64)


def _classes(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors, dims = [], [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("v")):
                a = v.as_py()
                a = None if a is None or label is None or None in a else np.array(a, dtype=np.float64) + 0.0
                fine = a is not None and len(a) and np.isfinite(a).all() and a.any()
                keys.append(_class_key(label, a) if fine else None)
                vectors.append(pack(a) if fine else None)
                dims.append(len(a) if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(dims, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "label", "cls", "dim", "v"])

    return df.mapInArrow(frugal(run), "id long, label long, cls binary, dim long, v binary")


def _marked(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Each class with its signatures and its mark, the vector kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "cls", "copies", "v", "sigs", "mark"]
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim), pa.int64()))
                vectors = unit(np.stack([unpack(b, dim) for b in part.column("v").to_pylist()]))
                sigs, marks = signatures(vectors, bits, tables)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:5]), pa.array(list(sigs), pa.list_(pa.int64())), pa.array([m.tobytes() for m in marks], pa.binary())], names=names)

    return classes.mapInArrow(frugal(run), "label long, dim long, cls binary, copies long, v binary, sigs array<long>, mark binary")


def _partnered(apart: int):
    """The classes of a block that have a partner there by their marks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = np.array(table.column("part").to_pylist())
        marks = np.stack([np.frombuffer(m, np.uint64) for m in table.column("mark").to_pylist()])
        lo, hi = key[4].as_py(), key[5].as_py()
        left = np.flatnonzero(part == lo)
        right = left if lo == hi else np.flatnonzero(part == hi)
        found = np.zeros(len(part), bool)
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            near = np.bitwise_count(marks[rows][:, None, :] ^ marks[right][None, :, :]).sum(axis=2) <= apart
            near &= rows[:, None] != right[None, :]
            found[rows] |= near.any(axis=1)
            found[right] |= near.any(axis=0)
        return table.select(["label", "dim", "sig", "tab", "lo", "hi", "part", "cls"]).filter(pa.array(found))

    return run


def _compare(cosine: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links between the classes of a block: a row for each class that has any."""
        dim, tab, lo, hi = key[1].as_py(), key[3].as_py(), key[4].as_py(), key[5].as_py()
        part = np.array(table.column("part").to_pylist())
        cls, copies = table.column("cls").to_pylist(), np.array(table.column("copies").to_pylist(), dtype=np.int64)
        v = unit(np.stack([unpack(b, dim) for b in table.column("v").to_pylist()]))
        sigs = np.array(table.column("sigs").to_pylist(), dtype=np.int64)
        left = np.flatnonzero(part == lo)
        right = left if lo == hi else np.flatnonzero(part == hi)
        links, root = np.zeros(len(cls), dtype=np.int64), list(range(len(cls)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero(v[rows] @ v[right].T >= cosine)
            i, j = rows[i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                new = ~(sigs[a, :tab] == sigs[b, :tab]).any(axis=1)  # else an earlier table had it
                a, b = a[new], b[new]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for x, y in zip(a.tolist(), b.tolist()):
                    root[top(x)] = top(y)
        kept = np.flatnonzero(links).tolist()
        return pa.table({"cls": pa.array([cls[k] for k in kept], pa.binary()), "root": pa.array([cls[top(k)] for k in kept], pa.binary()), "links": pa.array(links[kept], pa.int64())})

    return run


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, miss: float = 1e-6) -> DataFrame:
    """One row per input row: ``id, n_links, component_id``.

    Vectors of equal, non-null labels and equal dimension link at a cosine of ``cosine`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links
    reach.  Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, as do those without a label.  Null ids are smallest only if a component has no other.
    Repeated rows link like copies.  Other columns are ignored; an empty table gives an empty result.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(_classes(source), "vec-rows")
    fine = rows.where("cls is not null")
    classes = materialize(fine.groupBy("cls").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v")), "vec-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = table_sizes(most, cosine, miss)
    marked = materialize(_marked(classes.select("label", "dim", "cls", "copies", "v"), bits, tables), "vec-marked")
    where = ["label", "dim", "sig", "tab"]
    sized = marked.select("label", "dim", "cls", "mark", F.posexplode("sigs").alias("tab", "sig")).withColumn("tab", F.col("tab").cast("long"))
    counts = sized.groupBy(*where).agg(F.count("*").alias("m")).where("m > 1").withColumn("cuts", F.ceil(F.col("m") / BUCKET).cast("int")).drop("m")
    met = sized.join(counts, where).withColumn("part", F.pmod(F.xxhash64("cls"), "cuts").cast("int"))
    spread = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    spread = spread.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    spread = spread.select(*where, "lo", "hi", "part", "cls", "mark")
    apart = most_apart(cosine, miss / 100)
    partnered = spread.groupBy(*where, "lo", "hi").applyInArrow(_partnered(apart), "label long, dim long, sig long, tab long, lo int, hi int, part int, cls binary")
    needed = materialize(partnered, "vec-met")
    brought = needed.join(marked.select("cls", "copies", "v", "sigs"), "cls")
    linked = materialize(brought.groupBy(*where, "lo", "hi").applyInArrow(_compare(cosine), "cls binary, root binary, links long"), "vec-links")

    comp = connected_components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    reach = comp.select(F.col("node").alias("cls"), "root").join(classes.select("cls", "first_id"), "cls")
    reach = reach.join(reach.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("cls", "least_id")
    degree = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("cls", "first_id", "copies").join(reach, "cls", "left").join(degree, "cls", "left")
    known = known.select("cls", F.coalesce("least_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = fine.select("id", "cls").join(known, "cls").select("id", "n_links", "component_id")
    return full.union(rows.where("cls is null").select("id", F.lit(0).cast("long"), "id"))
