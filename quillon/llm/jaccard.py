"""Grouped prefix join: near-duplicate documents by the Jaccard likeness of their word shingles.

1. Every document becomes the set of its hashed shingles.  Documents of equal sets are one class.
2. All shingles of all documents are counted in ``CELLS`` cells by their hash.  All sets are put in one
   order, shingles of the emptiest cells first, and a class keeps the prefix of that order that any
   set like enough must share a shingle with.  A shingle of several documents lifts its cell above the
   others by as many, so it leaves the prefixes once it is in more of them than the cells differ by
   chance; that grows with the root of the table.  With a bound on frequency, which grows with
   the table, pairs that share nothing else would grow with its square.
3. Classes of identical prefix and size are collapsed to one group.
4. Groups that share a shingle of their prefixes are paired, if sizes and places of the shared
   shingle allow the overlap.  A pair that shares a run of shingles comes up at the run's start only.
   Shingles in at most ``DENSE`` prefixes make rows of pairs.  Others, as a large group of near
   copies has, make no pairs here: their groups are sent to meet in (5), a row each.
   Pairs of single classes must also pass their parity sketches: a bit for each hash value modulo a
   power of two near the set's size, flipped by every shingle that falls there.  Two sketches differ
   in no more bits than the sets differ in shingles, so no pair that links is lost.
5. Groups that were paired are brought together, expanded to their classes and verified on the whole
   sets, block by block.  Pairs of classes that are in one component already are not compared: only
   components are asked for.  A block gives out a spanning forest, so a cluster of m classes makes
   less than m rows, not m*m.  A neighbourhood of more than ``CLASSES`` classes is cut into chunks.
   First each chunk meets itself and one chunk of each hub; only hubs whose classes are in several
   components after that let all their chunks meet.
6. Connected components over the forests.

The order in (2) decides what is compared, never what is linked: any order gives the same links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, frugal, materialize, sweep
from quillon.llm.components import connected_components

#: Cells in which shingles are counted, a power of two, and cells of a row while counts are added.
CELLS = 1 << 22
STRIP = 1 << 16
#: Shingles that a task counts at once.
CHUNK = 1_000_000
#: Place in the order, of 256, of the cell that holds the average.
FREQUENT = 32
#: Prefixes up to which a shingle makes rows of pairs.
DENSE = 64
#: Shingles and classes of a chunk, about; larger neighbourhoods are cut.  A block is at most two chunks, so it compares at most about CLASSES**2 pairs.
BLOCK = 2_000_000
CLASSES = 256
#: Rows up to which a list of documents is broadcast (about 100 bytes a row); longer lists are joined by shuffle.
BROADCAST_ROWS = 300_000

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    A-Z are lower-cased and words end at ASCII white space.  With fewer words than ``words`` the
    whole sequence is one shingle; without words the set is empty.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    k = min(words, len(a))
    n = len(a) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ a[i : i + n]) * np.uint64(_MIX[i % 3])
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketch(s: np.ndarray) -> bytes:
    """Parity of the numbers of hashes in each of b cells; b is the power of two from the size of the set on, 64 at least."""
    cells = max(64, 1 << (len(s) - 1).bit_length())
    at = (s >> np.uint64(20)) & np.uint64(cells - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded, which gives the sketch of fewer cells."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _batches(batch: pa.RecordBatch, words: int):
    for i, text in enumerate(batch.column("t")):
        yield i, shingle_set(text.as_py(), words)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document, and rows with strips of the counts of a task's shingles by cell."""
    cells, strip, chunk = CELLS, STRIP, CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, seen = [], 0, set()
        names = ["id", "th", "n", "sig", "strip", "counts"]
        table = np.zeros(cells, np.uint16)

        def count():
            at = (np.concatenate(waiting) & np.uint64(cells - 1)).astype(np.int64)
            table[:] = np.minimum(table + np.bincount(at, minlength=cells), 65_535)
            waiting.clear()
            seen.clear()

        for batch in batches:
            n, sig = [], []
            for _, s in _batches(batch, words):
                n.append(len(s))
                sig.append(signature(s))
                if len(s) and sig[-1] not in seen:  # copies in a task count once
                    seen.add(sig[-1])
                    waiting.append(s)
                    held += len(s)
                if held >= chunk:
                    count()
                    held = 0
            none = [pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), *none], names=names)
        if waiting:
            count()
        for at in range(0, cells, strip):
            part = table[at : at + strip]
            if part.any():
                blank = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary())]
                low = part if part.max() > 255 else part.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*blank, pa.array([at // strip], pa.int64()), pa.array([zlib.compress(low.tobytes(), 1)], pa.binary())], names=names)

    return docs.mapInArrow(frugal(run), "id long, th long, n long, sig binary, strip long, counts binary")


def _order(made: DataFrame) -> np.ndarray:
    """The place of each cell in the order, 0 to 255: quarters of the deviation that chance gives around the average, then logarithmic."""
    strip, width = STRIP, min(STRIP, CELLS)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column("strip").to_pylist(), batch.column("counts")):
                raw = zlib.decompress(blob.as_buffer())
                part = np.frombuffer(raw, np.uint8 if len(raw) == width else np.uint16)
                sums[at] = sums[at] + part if at in sums else part.astype(np.int64)
        for at, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], names=["strip", "counts"])

    total = np.zeros(CELLS, np.uint32)
    strips = made.where("strip is not null").select("strip", "counts").repartition(_ceil(CELLS, STRIP), "strip")
    for row in strips.mapInArrow(frugal(added), "strip long, counts binary").collect():
        part = np.frombuffer(row.counts, np.uint32)
        total[row.strip * strip : row.strip * strip + len(part)] = part
    mean = total.mean()
    place = np.maximum((total - mean) / max(1.0, math.sqrt(mean) / 4) + FREQUENT, 0)
    far = place > 128
    place[far] = 128 + 12 * np.log2(place[far] / 128)
    return np.minimum(place, 255).astype(np.uint8)


def _prefixes(docs: DataFrame, words: int, percent: int, order) -> DataFrame:
    """``sig, n, gid, prefix, sketch`` of each document; copies in a task give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = order.value, set()
        mask = np.uint64(len(place) - 1)
        for batch in batches:
            sig, n, gid, prefix, marks = [], [], [], [], []
            for _, s in _batches(batch, words):
                mark = signature(s)
                if mark is None or mark in seen:
                    continue
                if len(seen) < 100_000:  # a memory only: a class that comes twice is grouped below
                    seen.add(mark)
                size = len(s) - _ceil(len(s) * percent, 100) + 1
                # Of equal places the smaller hash comes first: sets are sorted, and the sort is stable.
                kept = s[np.argsort(place[(s & mask).astype(np.int64)], kind="stable")[:size]]
                sig.append(mark)
                n.append(len(s))
                prefix.append(kept.view(np.int64))
                gid.append(xxhash.xxh3_64_intdigest(kept.tobytes(), seed=len(s)))
                marks.append(sketch(s))
            ids = np.array(gid, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["sig", "n", "gid", "prefix", "sketch"])

    return docs.mapInArrow(frugal(run), "sig binary, n long, gid long, prefix array<long>, sketch binary")


def _meeting(percent: int, n, pos, prev, side) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the rows of one dense shingle whose groups it brings together."""
    found_i, found_j = [], []
    step = max(1, 200_000 // max(1, len(n)))
    for at in range(0, len(n), step):
        i, j = slice(at, at + step), slice(at + 1, None)
        x, y = (lambda v: v[i, None]), (lambda v: v[None, j])
        both = x(n) + y(n)
        fine = np.minimum(x(n), y(n)) * 100 >= np.maximum(x(n), y(n)) * percent
        fine &= np.minimum(x(n - pos), y(n - pos)) * (100 + percent) >= both * percent
        fine &= (x(side) < 0) | (x(side) != y(side))
        fine &= (x(prev) == 0) | (x(prev) != y(prev))
        a, b = np.nonzero(fine)
        later = b >= a  # column b is place at + 1 + b, row a is place at + a
        found_i.append(a[later] + at)
        found_j.append(b[later] + at + 1)
    return np.concatenate([np.empty(0, np.int64), *found_i]), np.concatenate([np.empty(0, np.int64), *found_j])


class _Block:
    """The classes of a block: sizes, sets, sketches, and the component of each so far."""

    def __init__(self, arrays: list[np.ndarray], roots: list[bytes], percent: int):
        self.arrays, self.percent = arrays, percent
        self.size = np.array([len(x) for x in arrays], dtype=np.int64)
        self.label = np.unique(np.array(roots, dtype=object), return_inverse=True)[1] if roots else np.empty(0, np.int64)
        marks = [np.frombuffer(sketch(x), np.uint8) for x in arrays]
        self.level = np.array([len(m) for m in marks], dtype=np.int64)
        self.marks, self.folded = marks, {}
        self.forest: list[tuple[int, int]] = []

    def _sketches(self, level: int) -> np.ndarray:
        """Sketches of ``level`` bytes of all classes that have as many or more; other rows stay 0."""
        if level not in self.folded:
            table = np.zeros((len(self.marks), level), np.uint8)
            for i in np.flatnonzero(self.level >= level):
                m = self.marks[i]
                while len(m) > level:
                    m = m[: len(m) // 2] ^ m[len(m) // 2 :]
                table[i] = m
            self.folded[level] = table
        return self.folded[level]

    def meet(self, i: int, others: np.ndarray) -> None:
        """Links class i to those of ``others`` that are like enough and not in its component yet."""
        j = others[self.label[others] != self.label[i]]
        j = j[np.minimum(self.size[j], self.size[i]) * 100 >= np.maximum(self.size[j], self.size[i]) * self.percent]
        for level in np.unique(np.minimum(self.level[j], self.level[i])):
            part = j[np.minimum(self.level[j], self.level[i]) == level]
            table = self._sketches(int(level))
            both = self.size[part] + self.size[i]
            apart = np.bitwise_count(table[part] ^ table[i]).sum(axis=1, dtype=np.int64)
            for k in part[apart * (100 + self.percent) <= both * (100 - self.percent)].tolist():
                if self.label[k] != self.label[i] and self._like(i, k):
                    self.label[self.label == self.label[k]] = self.label[i]
                    self.forest.append((i, k))

    def _like(self, i: int, j: int) -> bool:
        x, y = self.arrays[i], self.arrays[j]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int(np.count_nonzero(y[at] == x))
        return 100 * both >= self.percent * (len(x) + len(y) - both)


def _verify(percent: int):
    def run(sets: pa.Table, met: pa.Table) -> pa.Table:
        """A forest of links between the classes of groups that meet in a block."""
        members: dict[int, list[int]] = {}
        names: list[bytes] = []
        arrays, roots = [], []
        for gid, sig, root, blob in zip(*(sets.column(c).to_pylist() for c in ("gid", "sig", "root")), sets.column("s")):
            members.setdefault(gid, []).append(len(names))
            names.append(sig)
            roots.append(root)
            arrays.append(np.frombuffer(blob.as_buffer(), dtype=np.uint64))  # a view, not a copy
        block = _Block(arrays, roots, percent)
        classes = {g: np.array(m, dtype=np.int64) for g, m in members.items()}
        for a, b in sorted({(a, b) for a, b in zip(met.column("a").to_pylist(), met.column("b").to_pylist()) if b is not None and a in classes and b in classes}):
            for i in classes[a]:
                block.meet(i, classes[b] if a != b else classes[b][classes[b] > i])
        dense = met.filter(pc.is_valid(met.column("token"))).sort_by("token")
        tokens, sizes, befores, sides = (dense.column(c).to_numpy() for c in ("token", "np", "prev", "side"))
        groups = dense.column("a").to_pylist()
        cuts = [0, *(np.flatnonzero(tokens[1:] != tokens[:-1]) + 1).tolist(), len(tokens)] if len(tokens) else []
        for lo, hi in zip(cuts, cuts[1:]):
            every = [classes[g] for g in groups[lo:hi] if g in classes]
            if not every or len(np.unique(block.label[np.concatenate(every)])) < 2:
                continue  # all that meet here are in one component
            i, j = _meeting(percent, sizes[lo:hi] >> 24, sizes[lo:hi] & ((1 << 24) - 1), befores[lo:hi], sides[lo:hi])
            for first in np.unique(i):
                near = [classes[groups[lo + k]] for k in j[i == first].tolist() if groups[lo + k] in classes]
                if near and groups[lo + first] in classes:
                    for x in classes[groups[lo + first]]:
                        block.meet(x, np.concatenate(near))
        return pa.table({"a": pa.array([names[i] for i, _ in block.forest], pa.binary()), "b": pa.array([names[j] for _, j in block.forest], pa.binary())})

    return run


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table that was counted and is small enough; any other is joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _entries(groups: DataFrame) -> DataFrame:
    """``token, gid, np, prev``: a row for each shingle of a prefix, with the size and the place in one number, and the shingle before it."""
    at = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"), "prefix")
    return at.select("token", "gid", (F.col("n") * (1 << 24) + F.col("pos")).alias("np"), F.when(F.col("pos") > 0, F.get("prefix", F.col("pos") - 1)).otherwise(0).alias("prev"))


def _paired(entry: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that share a shingle of their prefixes at places that leave room for the overlap.

    A pair that also shares the shingle before has come up there already.
    """
    x, y = entry.alias("x"), entry.alias("y")

    def col(side: str, name: str) -> Column:
        return {"n": F.shiftright(f"{side}.np", 24), "pos": F.col(f"{side}.np").bitwiseAND(F.lit((1 << 24) - 1))}[name]

    nx, ny = col("x", "n"), col("y", "n")
    room = F.least(nx - col("x", "pos"), ny - col("y", "pos"))
    smaller = F.col("x.np").bitwiseAND(F.lit(~((1 << 24) - 1))) < F.col("y.np").bitwiseAND(F.lit(~((1 << 24) - 1)))
    joined = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (smaller | ((nx == ny) & (F.col("x.gid") < F.col("y.gid"))))
        & (nx * 100 >= ny * percent)
        & (room * (100 + percent) >= (nx + ny) * percent)
        & ((F.col("x.prev") == 0) | (F.col("x.prev") != F.col("y.prev"))),
    )
    return joined.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct()


def _sketched(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches do not rule them out; groups of several classes pass."""
    one = lambda c: groups.select(F.col("gid").alias(c), F.col("n").alias(f"n{c}"), F.when(F.col("single"), F.col("sketch")).alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                x is None or y is None or differing(x, y) * (100 + percent) <= (m + n) * (100 - percent)
                for m, x, n, y in zip(*(batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(frugal(run), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id, th, n_shingles, component_id, component``.

    ``th`` is a hash of the text, ``component`` the key of the component, null without shingles.
    Two documents link when ``100 * common >= percent * union`` of their shingle sets, exactly (up to
    64-bit hashes of shingles).  ``component_id`` is the smallest id that links reach.  Links inside a
    component are not counted: their number grows with its square.  Null and empty texts have no
    shingles, link with nothing and are their own component.  Null ids are allowed: they never are
    the smallest id unless all of a component are null.  Repeated rows link like any copies.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    made = materialize(_sets(docs, words), "jaccard-sets")
    rows = made.where("strip is null").select("id", "th", "n", "sig")
    order = spark.sparkContext.broadcast(_order(made))

    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("first_id"), F.min_by("th", F.coalesce("id", F.lit((1 << 63) - 1))).alias("th"))
    prefixes = materialize(_prefixes(docs, words, percent, order), "jaccard-prefixes")
    groups = prefixes.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), (F.min("sig") == F.max("sig")).alias("single"), F.first("sketch").alias("sketch"))
    groups = materialize(groups, "jaccard-groups")  # read four times
    members = materialize(prefixes.select("gid", "sig", "n").distinct(), "jaccard-members")
    discard(prefixes)
    sizes = members.groupBy("gid").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    within = sizes.where("m > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    entry = _entries(groups.select("gid", "n", "prefix"))
    dense = materialize(entry.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > DENSE).select("token"), "jaccard-tokens")
    sweep(spark)
    hubs = materialize(entry.join(_small(dense), "token", "left_semi"), "jaccard-dense")
    met = materialize(_paired(entry.join(_small(dense), "token", "left_anti"), percent), "jaccard-met")
    sweep(spark)
    pairs = materialize(_sketched(met, groups.select("gid", "n", "single", "sketch"), percent).union(within), "jaccard-pairs")
    discard(met, groups)

    # Blocks: neighbours under one label, by two steps of the smallest neighbour; any labels would do.
    both = pairs.union(pairs.select("b", "a"))
    spokes = hubs.select("token", F.col("gid").alias("a"))
    hub = spokes.groupBy("token").agg(F.min("a").alias("m"))
    label = both.union(spokes.select("a", "a")).union(spokes.join(_small(hub), "token").select("a", "m")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label"))
    label = materialize(label, "jaccard-label")
    hub = spokes.join(label, "a").groupBy("token").agg(F.min("label").alias("label"))
    near = both.join(label.select(F.col("a").alias("b"), "label"), "b").select("a", "label")
    label = near.union(label).union(spokes.join(_small(hub), "token").select("a", "label")).groupBy("a").agg(F.min("label").alias("label"))
    label = label.join(sizes.select(F.col("gid").alias("a"), "tokens", "m"), "a")
    cuts = label.groupBy("label").agg(F.ceil(F.greatest(F.sum("tokens") / BLOCK, F.sum("m") / CLASSES)).cast("long").alias("cuts")).where("cuts > 1")
    cell = F.pmod(F.xxhash64("sig"), F.coalesce("cuts", F.lit(1)))
    placed = label.select(F.col("a").alias("gid"), "label").join(_small(cuts), "label", "left").join(members.select("gid", "sig"), "gid")
    placed = materialize(placed.select("gid", "sig", F.xxhash64("label", cell).alias("chunk")), "jaccard-chunks")
    spots = placed.select("gid", "chunk").distinct()

    block = lambda x, y: F.xxhash64(F.least(x, y), F.greatest(x, y)).alias("block")
    blank = [F.lit(None).cast("long").alias(c) for c in ("token", "np", "prev", "side")]
    paired = pairs.join(spots.select(F.col("gid").alias("a"), F.col("chunk").alias("ca")), "a").join(spots.select(F.col("gid").alias("b"), F.col("chunk").alias("cb")), "b")
    paired = paired.where("a <> b or ca <= cb").select(block("ca", "cb"), "ca", "cb", "a", "b", *blank)
    spread = hubs.withColumnRenamed("gid", "a").join(spots.withColumnRenamed("gid", "a"), "a")
    reached = materialize(spread.select("token", F.col("chunk").alias("other")).distinct(), "jaccard-reached")
    first = reached.groupBy("token").agg(F.min("other").alias("pivot"))
    several = materialize(reached.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "jaccard-several")

    def meetings(rows: DataFrame) -> DataFrame:
        """A row for each group of a hub and each chunk ``other`` that its chunk meets."""
        side = F.when(F.col("chunk") == F.col("other"), -1).when(F.col("chunk") < F.col("other"), 0).otherwise(1).cast("long").alias("side")
        return rows.select(block("chunk", "other"), F.col("chunk").alias("ca"), F.col("other").alias("cb"), "a", F.lit(None).cast("long").alias("b"), "token", "np", "prev", side)

    known = classes.select("sig", "first_id", "th")
    once = placed.select("sig").distinct().join(known, "sig").select(F.col("th").alias("w_th"), F.col("first_id").alias("w_id"), "sig")
    if once.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        once = F.broadcast(once)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(i, s) for i, s in _batches(batch, words)]
            kept = [i for i, s in sets if signature(s) == batch.column("sig")[i].as_py()]  # equal ids and hashes of other texts
            blobs = pa.array([sets[i][1].tobytes() for i in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("sig").take(pa.array(kept, pa.int64())), blobs], names=["sig", "s"])

    # One document of each class that is needed brings its whole set.
    held = docs.join(once, (F.col("th") == F.col("w_th")) & F.col("id").eqNullSafe(F.col("w_id"))).select("t", "sig")
    sets = materialize(held.mapInArrow(frugal(whole), "sig binary, s binary").dropDuplicates(["sig"]), "jaccard-wanted")
    sweep(spark)

    def verified(blocks: DataFrame, roots: DataFrame | None) -> DataFrame:
        blocks = materialize(blocks, "jaccard-blocks")
        ends = blocks.select(F.col("a").alias("gid"), "block", "ca", "cb").union(blocks.where("b is not null").select("b", "block", "ca", "cb")).distinct()
        inside = ends.select("gid", "block", F.col("ca").alias("chunk")).union(ends.where("ca <> cb").select("gid", "block", "cb")).distinct().join(placed, ["gid", "chunk"]).dropDuplicates(["block", "sig"])
        inside = inside.join(roots, "sig", "left") if roots is not None else inside.withColumn("root", F.col("sig"))
        brought = inside.join(sets, "sig").select((F.col("block") + 0).alias("block"), "gid", "sig", F.coalesce("root", "sig").alias("root"), "s")
        links = materialize(brought.groupBy("block").cogroup(blocks.drop("ca", "cb").groupBy("block")).applyInArrow(_verify(percent), "a binary, b binary"), "jaccard-links")
        discard(blocks)
        return links

    # Each chunk of a hub meets itself and the pivot, and the pivot's groups meet all other chunks.
    own = spread.withColumn("other", F.col("chunk"))
    split = spread.join(_small(several), "token", "left_semi").join(first, "token")
    there = split.where("chunk <> pivot").withColumnRenamed("pivot", "other")
    back = split.where("chunk = pivot").drop("pivot").join(reached, "token").where("other <> chunk")
    linked = verified(paired.union(meetings(own)).union(meetings(there.select(*own.columns))).union(meetings(back.select(*own.columns))), None)
    comp = connected_components(linked)
    if several.limit(1).count():
        # Hubs over several chunks whose classes are still in several components let all their chunks meet.
        rooted = comp.select(F.col("node").alias("sig"), "root")
        of = hubs.select("token", "gid").join(_small(several), "token", "left_semi").join(placed.select("gid", "sig"), "gid").join(rooted, "sig", "left").select("token", F.coalesce("root", "sig").alias("root"))
        open_ = materialize(of.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token"), "jaccard-open")
        if open_.limit(1).count():
            rest = spread.join(_small(open_), "token", "left_semi").join(reached, "token").join(first, "token").where("chunk <> other and chunk <> pivot and other <> pivot").drop("pivot")
            more = verified(meetings(rest.select(*own.columns)), rooted)
            comp = connected_components(linked.union(more))

    reach = comp.select(F.col("node").alias("sig"), "root").join(classes.select("sig", "first_id"), "sig")
    smallest = reach.groupBy("root").agg(F.min("first_id").alias("least_id"))
    reach = reach.join(smallest, "root").select("sig", "root", "least_id")
    joined = classes.join(reach, "sig", "left").select("sig", F.coalesce("root", "sig").alias("component"), F.coalesce("least_id", "first_id").alias("component_id"))
    full = rows.where("sig is not null").join(joined, "sig").select("id", "th", F.col("n").alias("n_shingles"), "component_id", "component")
    none = rows.where("sig is null").select("id", "th", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return full.union(none)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each component: that of the smallest id.

    Of rows with the same id and text one stays; null ids come last.  Documents without words all stay.
    """
    found = materialize(near_duplicates(df, id_col, text_col, words, percent).where("component is not null"), "jaccard-found")
    sweep(df.sparkSession)
    rank = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), F.col("th"))
    first = found.groupBy("component").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = found.join(first, "component").where(rank != F.col("first")).select(F.col("id").alias("g_id"), F.col("th").alias("g_th")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    left = packed.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")), "left_anti")
    repeated = found.groupBy(F.col("id").alias("r_id"), F.col("th").alias("r_th")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if repeated.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))
        left = left.join(repeated, same, "left_anti").select("row").union(left.join(repeated, same, "left_semi").dropDuplicates(["id", "th"]).select("row"))
    return left.select("row.*")
