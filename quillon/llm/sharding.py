"""Sharding by sampled splitters.

Records get a key that keeps equal texts side by side, ``(hash of the text, id, row)``; the last part
tells repeated rows apart.  A size-weighted sample of keys gives quantile boundaries; the boundaries
cut the records into many fine ranges; ranges that came out overfull are sampled again and
subdivided, inside a group of equal texts or of repeated rows too.  Exact byte counts of the fine
ranges then place every record on the line from 0 to the total, and the line is cut into shards.

What reaches the driver is bounded: about ``samples`` keys a round and one row a range.  No window
is wider than one range.  Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, range_index

LAW = "bytes"


def _key():
    return F.struct(F.col("h"), F.col("id"), F.col("row"))


def _splitter(h: int, i: int | None, row: int | None) -> str:
    number = lambda v: "bigint(null)" if v is None else f"bigint('{v}')"
    return f"named_struct('h', {number(h)}, 'id', {number(i)}, 'row', {number(row)})"


def _order(key: tuple) -> tuple:
    return tuple((v is not None, v or 0) for v in key)


def assign_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    overhead: int = 8,
    ranges_per_shard: int = 16,
    samples_per_range: int = 8,
    rounds: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: ``id, size, text_crc32, shard, slot``.

    Shards have nearly equal bytes: a record goes where the middle of its bytes falls, so a shard's
    size is off by at most one record.  Records of equal text lie side by side on the line: only the
    groups that a boundary between two shards falls into are cut, whatever their size.

    Null texts have ``overhead`` bytes and the CRC of nothing.  Null ids sort first.  Repeated rows
    each get a slot.  An empty table gives an empty result.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(
        df.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),  # fixed once it is written
        ),
        "shard-base",
    )
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return base.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    n_ranges = max(1, min(shards * ranges_per_shard, rows // 16))
    limit = 2.0 * total / n_ranges
    # In [0, 1), a function of the row alone, so that a rerun of a task draws the same keys.
    draw = (F.xxhash64("h", "id", "row", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("draw")

    want = n_ranges * samples_per_range
    keys = sorted(r.h for r in base.where(draw < F.col("size") * F.lit(want / total)).select("h").collect())
    step = max(1, len(keys) // n_ranges)
    found = {(h, None, None) for h in keys[step::step]}  # whole groups of equal hashes at first

    def located(splitters):
        order = sorted(splitters, key=_order)
        return base.withColumn("rng", range_index(_key(), [_splitter(*k) for k in order]).cast("int"))

    for _ in range(rounds):
        placed = located(found)
        sums = {r.rng: r for r in placed.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        over = [k for k, r in sums.items() if r.bytes > limit and r.n > 1]
        if not over:
            break
        rate = F.lit(0.0)
        for k in over:
            rate = F.when(F.col("rng") == k, F.lit(2.0 * samples_per_range / limit)).otherwise(rate)
        again = placed.where(F.col("rng").isin(over)).where(draw < F.col("size") * rate).select("rng", "h", "id", "row").collect()
        for k in over:
            got = sorted(((r.h, r.id, r.row) for r in again if r.rng == k), key=_order)
            parts = max(2, int(2 * sums[k].bytes / limit))
            cut = max(1, len(got) // parts)
            found |= set(got[cut::cut])
    placed = located(found)
    sums = placed.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()

    start_bytes, start_rows, b, n = {}, {}, 0, 0
    for r in sorted(sums, key=lambda r: r.rng):
        start_bytes[r.rng], start_rows[r.rng] = b, n
        b, n = b + r.bytes, n + r.n
    width = max(start_bytes) + 1
    longs = lambda values: F.expr(f"array({', '.join(f'{v}L' for v in values)})")
    at_bytes = longs(start_bytes.get(i, 0) for i in range(width))
    at_rows = longs(start_rows.get(i, 0) for i in range(width))

    by_range = Window.partitionBy("rng").orderBy("h", "id", "row")
    line = (
        placed.withColumn("upto", F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("nth", F.row_number().over(by_range))
        .withColumn("middle", F.get(at_bytes, F.col("rng")) + F.col("upto") - F.col("size") / 2)
    )
    line = line.select(
        "id",
        "size",
        "text_crc32",
        F.least(F.floor(F.col("middle") * shards / F.lit(float(total))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.get(at_rows, F.col("rng")) + F.col("nth") - 1).alias("nth"),
    )
    line = materialize(line, "shard-line")
    first = {r.shard: r.nth for r in line.groupBy("shard").agg(F.min("nth").alias("nth")).collect()}
    starts = longs(first.get(i, 0) for i in range(shards))
    return line.select("id", "size", "text_crc32", "shard", (F.col("nth") - F.get(starts, F.col("shard"))).alias("slot"))
