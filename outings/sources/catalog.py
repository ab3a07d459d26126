"""Versioned table snapshots and the import log.

A snapshot is written to a folder of its own and becomes current when one row is
appended to the log. A failed run leaves the log, and so the current table, as it was;
nothing that is being read is ever overwritten.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.schemas import IMPORT_JOBS, WORKS

_LOG = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("rows", T.LongType()),
    T.StructField("token", T.StringType()), T.StructField("folder", T.StringType()),
])


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def snapshot_log(spark: SparkSession, root: str) -> DataFrame:
    return read_if_exists(spark, f"{root}/log", _LOG)


def current_version(spark: SparkSession, root: str) -> int:
    return snapshot_log(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def has_token(spark: SparkSession, root: str, token: str) -> bool:
    return not snapshot_log(spark, root).where(F.col("token") == token).isEmpty()


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The current version, empty before the first."""
    last = snapshot_log(spark, root).agg(F.max_by("folder", F.struct("version", "folder"))).first()[0]
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{last}").select(*schema.names)


def publish_snapshot(df: DataFrame, root: str, token: str | None = None,
                     partition_by: tuple[str, ...] = ()) -> int:
    """Write ``df`` as the next version and make it current; refuses an empty result.

    With a ``token`` (say, a batch id) a repeated publication is a no-op. A table has one writer at a
    time; folders are named anew, so a second one could not damage what the first wrote. Older
    versions stay for those who still read them; whoever owns the table clears them.
    """
    spark = df.sparkSession
    if token is not None and has_token(spark, root, token):
        return current_version(spark, root)
    version = current_version(spark, root) + 1
    folder = f"v{version}-{uuid.uuid4().hex[:12]}"
    path = f"{root}/{folder}"
    written = Observation()
    df.observe(written, F.count("*").alias("rows")).write.partitionBy(*partition_by).parquet(path)
    rows = written.get["rows"]
    if rows == 0:
        raise ValueError("empty result is not published")
    spark.createDataFrame([(version, rows, token, folder)], _LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return version


def scan_works(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, root, WORKS)


def write_works(works: DataFrame, root: str, token: str | None = None) -> int:
    return publish_snapshot(works, root, token, ("section",))


def append_import_job(spark: SparkSession, root: str, source: str, imported: int, now: datetime) -> None:
    stamp = now.astimezone(UTC).replace(tzinfo=None) if now.tzinfo else now
    spark.createDataFrame([(source, imported, stamp)], IMPORT_JOBS).coalesce(1).write.mode("append").parquet(root)


def scan_import_jobs(spark: SparkSession, root: str) -> DataFrame:
    return read_if_exists(spark, root, IMPORT_JOBS)
