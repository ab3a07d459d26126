"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed partition even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # do not record a call site per column expression: large expressions are built much faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # html rows are wide: bound an Arrow batch by bytes as well as by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
}


def builder(app: str = "outings") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="outings-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Where that is unset, a
    local folder is made if all executors are threads of this machine; else it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'this cluster'} share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df, purpose: str, path: str | None = None):
    """Write ``df`` to the shared folder (or to ``path``) and read it back: a stable, lineage-free copy.

    The copy serves whoever reads the result later, so it stays until the owner of the
    shared folder clears it, as Spark's own checkpoints do.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_TABLE = 64 << 20


def spread(table):
    """Even out a small stored table that comes in fewer splits than there are cores.

    For row work that is heavy on the processor (parsing html or JSON): a small table in
    one file would keep one core busy. Files of more than ``SMALL_TABLE`` bytes in all are
    left as they are, so no large table is ever shuffled for this.
    """
    files = table.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    size = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_TABLE else table
