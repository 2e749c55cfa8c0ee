"""Sessions, tables and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Settings that plans here count on; a cluster's own values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quillon", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Rows of an Arrow batch: with texts of up to a few MB each a batch stays small in memory on both sides.
ARROW_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context: they need not have it installed.

    Also makes Arrow batches smaller, unless the session sets their size itself.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        folder = Path(tempfile.mkdtemp()).resolve()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = folder / "quillon.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("quillon") / p.relative_to(root))
        context.addPyFile(str(path))
    context._quillon_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES[:8]) -> None:
    """Temporary views of the tables, for SQL text.  A DataFrame made from them keeps its own tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share; it goes when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        root = named.rstrip("/")
    elif spark.sparkContext.master.startswith("local"):
        root = "file:///tmp/checkpoints/quillon"
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillon"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
