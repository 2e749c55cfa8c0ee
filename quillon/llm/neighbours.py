"""The row after each row in a global order of keys, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import range_index

LOWEST = -(1 << 63) + 1


def with_guests(df: DataFrame, key: Column, tie: Column, rows_per_bucket: int = 256, most_buckets: int = 16384, per_bucket: int = 12, seed: int = 5) -> DataFrame:
    """``df`` with ``nb_key``, ``nb_bucket`` and ``nb_guest``, ready for windows over buckets in falling order of ``nb_key``.

    ``nb_key`` is the pair of ``key``, null keys lowest, and a hash of ``tie``, so that rows of one key
    spread over buckets too; only rows that agree in both stay together.  Buckets are ranges of these
    pairs with about equally many rows, cut at a bounded sample: a pair is drawn or not, with the number
    of its rows, and the splitters are quantiles of these numbers.  The rows with the highest pair of
    each bucket come a second time, as guests, in the bucket above (the topmost's in the lowest), where
    they sort last: so each row's successor, the successor of the last being the first, is in its own
    bucket.
    """
    spark = df.sparkSession
    keyed = df.withColumn("nb_key", F.struct(F.coalesce(key, F.lit(LOWEST)).alias("k"), F.xxhash64(tie).alias("t")))
    rows = keyed.select("nb_key").count()
    buckets = max(1, min(most_buckets, rows // rows_per_bucket))
    chance = min(1.0, buckets * per_bucket / max(1, rows))
    draw = F.xxhash64("nb_key", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    drawn = sorted((tuple(r.nb_key), r.n) for r in keyed.where(draw < chance).groupBy("nb_key").agg(F.count("*").alias("n")).collect()) if buckets > 1 else []
    step, run, cuts = max(1, sum(n for _, n in drawn) / buckets), 0, []
    for pair, n in drawn:
        if run + n > step and run:
            cuts.append(pair)
            run = 0
        run += n
    literals = [f"named_struct('k', bigint('{k}'), 't', bigint('{t}'))" for k, t in cuts]
    keyed = keyed.withColumn("nb_bucket", range_index(F.col("nb_key"), literals).cast("int"))
    heads = sorted((r.nb_bucket, r.top) for r in keyed.groupBy("nb_bucket").agg(F.max("nb_key").alias("top")).collect())
    above = [(b, top.k, top.t, heads[(i + 1) % len(heads)][0]) for i, (b, top) in enumerate(heads)]
    table = spark.createDataFrame(above, "hd_bucket int, hd_k long, hd_t long, hd_to int")
    same = (F.col("nb_bucket") == F.col("hd_bucket")) & (F.col("nb_key.k") == F.col("hd_k")) & (F.col("nb_key.t") == F.col("hd_t"))
    joined = keyed.join(F.broadcast(table), same, "left")  # at most most_buckets rows
    places = F.array_compact(F.array(F.struct(F.col("nb_bucket").alias("b"), F.lit(0).alias("g")), F.when(F.col("hd_to").isNotNull(), F.struct(F.col("hd_to").alias("b"), F.lit(1).alias("g")))))
    out = joined.withColumn("nb_at", F.explode(places)).withColumn("nb_bucket", F.col("nb_at.b")).withColumn("nb_guest", F.col("nb_at.g"))
    return out.drop("nb_at", "hd_bucket", "hd_k", "hd_t", "hd_to")
