"""Text and file sources and sinks: delimited tables, key-value files, vertices, reads and sequences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# -- tables ----------------------------------------------------------------------------------------
def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "|", last_takes_rest: bool = False) -> DataFrame:
    """Delimited text by position: fields beyond the schema are ignored, missing or bad ones are null.

    With ``last_takes_rest`` the last column holds all that is left of the line.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    parts = F.split("value", "\\Q" + sep + "\\E", len(fields) if last_takes_rest else -1)
    return spark.read.text(path).select(*[_parsed(F.get(parts, i), f.dataType).alias(f.name) for i, f in enumerate(fields)])


def _parsed(text: Column, kind: T.DataType) -> Column:
    return text if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind)


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.mode("overwrite").csv(path, sep=sep)


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """INSERT OVERWRITE into a folder; the table as it then is."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def results(df: DataFrame) -> Iterator[Row]:
    """Rows of a distributed result, one partition at a time on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def write_key_values(df: DataFrame, path: str, key: str, value: str) -> None:
    df.select(F.col(key).alias("key"), F.col(value).alias("value")).write.mode("overwrite").parquet(path)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("key", "value")


def write_single_file(df: DataFrame, path: str, line: Column) -> None:
    """One text file, for results that are small by construction."""
    df.select(line.cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


# -- graphs ----------------------------------------------------------------------------------------
def read_adjacency(spark: SparkSession, path: str, weight: float = 1.0, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """``vertices(id)`` and ``edges(src, dst, weight)`` of lines ``id neighbour neighbour ...``."""
    return parse_adjacency(spark.read.text(path), weight, distinct)


def parse_adjacency(lines: DataFrame, weight: float = 1.0, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    words = lines.where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w"))
    ids = F.transform("w", lambda x: x.cast("long"))
    near = F.slice(ids, 2, F.greatest(F.size("w") - 1, F.lit(0)))
    rows = words.select(F.get(ids, 0).alias("id"), (F.array_distinct(near) if distinct else near).alias("near"))
    edges = rows.select(F.col("id").alias("src"), F.explode("near").alias("dst"), F.lit(weight).alias("weight"))
    return rows.select("id"), edges


def write_vertices(df: DataFrame, path: str, *values: str) -> None:
    """``id <tab> value`` lines in the order of ids over all files."""
    df.orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), *[F.col(v).cast("string") for v in values])).write.mode("overwrite").text(path)


def ring(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """A ring of ``n`` vertices: v leads to v + 1; vertex values 10 * id, edge values 100 * id."""
    v = spark.range(n)
    vertices = v.select("id", (F.col("id") * 10.0).alias("value"))
    return vertices, v.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), (F.col("id") * 100.0).alias("weight"))


def scale_graph(vertices: DataFrame, edges: DataFrame, times: int) -> tuple[DataFrame, DataFrame]:
    """``times`` copies of a graph side by side; the ids of each copy follow those of the one before."""
    step = vertices.agg(F.max("id") + 1).first()[0] or 0
    copy = vertices.sparkSession.range(times).select((F.col("id") * step).alias("shift"))
    near = F.broadcast(copy)  # `times` rows
    v = vertices.crossJoin(near).withColumn("id", F.col("id") + F.col("shift")).drop("shift")
    e = edges.crossJoin(near).withColumn("src", F.col("src") + F.col("shift")).withColumn("dst", F.col("dst") + F.col("shift")).drop("shift")
    return v, e


def graphviz(edges: DataFrame, seeds: list, hops: int = 1) -> DataFrame:
    """``value``: lines of a dot file of the edges within ``hops`` of the seeds."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    near = spark.createDataFrame([(s,) for s in seeds], f"id {kind}")
    for _ in range(hops):
        out = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        back = edges.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        near = near.union(out).union(back).distinct()
    inside = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    label = F.concat(F.lit(' [label="'), F.col("label").cast("string"), F.lit('"]')) if "label" in edges.columns else F.lit("")
    lines = inside.select(F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('"'), label, F.lit(";")).alias("value"))
    one = lambda s: spark.createDataFrame([(s,)], "value string")
    return one("digraph G {").union(lines.distinct().orderBy("value")).union(one("}"))


# -- sequences -------------------------------------------------------------------------------------
def read_fastq(spark: SparkSession, path: str, mate: str | None = None) -> DataFrame:
    """``read_id, seq, mate_seq`` of one or two files of four lines a record; ids count from 1.

    Two files pair up by record number; files of different lengths are an error.
    """
    first = _fastq(spark, path)
    if mate is None:
        return first.withColumn("mate_seq", F.lit(None).cast("string"))
    second = _fastq(spark, mate).withColumnRenamed("seq", "mate_seq")
    both = first.join(second, "read_id", "full")
    whole = F.col("seq").isNotNull() & F.col("mate_seq").isNotNull()
    return both.select("read_id", F.when(whole, F.col("seq")).otherwise(F.raise_error(F.lit("mate files differ in length"))).alias("seq"), "mate_seq")


def _fastq(spark: SparkSession, path: str) -> DataFrame:
    # Line numbers without a global sort: a file is read in order, so partitions are numbered by
    # their counts of lines, which is one number a partition.
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value").select(F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"), "value")
    starts, total = {}, 0
    for r in sorted(lines.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        starts[r.part], total = total, total + r.n
    offset = F.coalesce(*[F.when(F.col("part") == p, F.lit(s)) for p, s in starts.items()], F.lit(0))
    numbered = lines.select((F.col("nth") + offset).alias("line"), "value")
    return numbered.where(F.col("line") % 4 == 1).select((F.floor(F.col("line") / 4) + 1).cast("long").alias("read_id"), F.trim("value").alias("seq"))


def fasta(df: DataFrame, name: Column, seq: Column) -> DataFrame:
    """``value``: one record of two lines for each row."""
    return df.select(F.concat(F.lit(">"), name.cast("string"), F.lit("\n"), seq).alias("value"))


# -- words -----------------------------------------------------------------------------------------
def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """``word, n``: split at white space, combine in each partition, then count."""
    words = lines.select(F.explode(F.split(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))
