"""Show files into the catalog as they arrive.

The stream checks every line of every new file and appends it, good or bad, to a folder of checked rows. It is
Spark's file sink under the stream's checkpoint that says which files of that folder count, so each line is there once,
whatever was run again. The catalog is one aggregate over the checked rows: a merge of shows is associative in the
order of arrival, so no run needs to know what the ones before it did.

A file is one row of the stream, which numbers its lines without a shuffle; drops are files of a size that a task
can hold. Larger ones are for ``import_shows``, which splits them.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from outings.operators.merge import DATA, KEY, last_values, shows_to_batch
from outings.operators.quality import duplicate_url_check, normalize_import, validate_import
from outings.schemas import SHOWS, WORKS, Site, conform
from outings.sources.catalog import read_if_exists, write_works

LINE_ENDS = r"\r\n|\n|\r"
CHECKED = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("arrived", T.TimestampNTZType()),
    *SHOWS.fields, T.StructField("issues", T.ArrayType(T.StringType()))])


def _stamp(now: datetime):
    utc = now.astimezone(UTC).replace(tzinfo=None) if now.tzinfo else now
    return F.lit(utc.isoformat(sep=" ")).cast("timestamp_ntz")


def check_files(files: DataFrame, now: datetime, site: Site = Site()) -> DataFrame:
    """(file, value) -> ``CHECKED``: every line that is not blank, as a record and what is wrong with it."""
    lines = files.select("file", F.posexplode(F.split("value", LINE_ENDS)).alias("pos", "line")).select(
        "file", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    full = lines.where(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")) != "")
    checked = validate_import(full, site).drop("line")
    keep = checked.withColumn("_issues", F.col("issues"))
    return normalize_import(keep).withColumns({"arrived": _stamp(now), "issues": F.col("_issues")}).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHECKED.fields])


def ingest_stream(spark: SparkSession, directory: str, checked: str, checkpoint: str, now: datetime, site: Site = Site(),
                  files_per_batch: int = 1000) -> StreamingQuery:
    """Every new file of ``directory`` is checked once, into the folder ``checked`` that is this stream's own; stops when all are read."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(directory, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value")
    return check_files(files, now, site).writeStream.format("parquet").option("path", checked).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checked_rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [read_if_exists(spark, f, CHECKED) for f in folders])


def rejected_lines(checked: DataFrame) -> DataFrame:
    """(file, line_no, issues) of lines that are wrong, or repeat a url of their file."""
    bad = checked.where(F.size("issues") > 0).select("file", "line_no", "issues")
    repeats = duplicate_url_check(checked.where(F.size("issues") == 0), "line_no", ["file"])[1]
    return bad.unionByName(repeats.select("file", "line_no", F.array(F.concat(
        F.lit("url: duplicate of line "), F.col("first_line").cast("string"))).alias("issues")))


def ingested_works(checked: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The catalog that ``checked`` rows make, merged into ``base`` in the order of (arrival, file, line).

    A file with a bad line, or one that repeats a url, is refused whole.
    """
    refused = checked.groupBy("file", "url").agg(F.count("*").alias("n"), F.bool_or(F.size("issues") > 0).alias("bad")).where(
        "bad OR n > 1").select("file").distinct()
    good = checked.join(refused, "file", "left_anti")
    order = F.struct(F.lit(1).alias("later"), "arrived", "file", "line_no")
    rows = shows_to_batch(good.select(*SHOWS.names, "arrived", order.alias("_order"))).withColumns(
        {"created_at": F.col("arrived"), "updated_at": F.col("arrived"), "id": F.lit(None).cast("string")}).drop("arrived")
    if base is not None:
        nothing = F.struct(F.lit(0).alias("later"), F.lit(None).cast("timestamp_ntz").alias("arrived"), F.lit(None).cast("string").alias("file"),
                           F.lit(None).cast("long").alias("line_no"))
        rows = rows.unionByName(conform(base, WORKS).withColumn("_order", nothing))
    known = F.max("id")  # of the catalog before; a url has one
    created = F.coalesce(F.max(F.when(F.col("_order.later") == 0, F.col("created_at"))), F.min("created_at"))
    return rows.groupBy(KEY).agg(
        F.coalesce(known, F.sha2(KEY, 256)).alias("id"), created.alias("created_at"), F.max("updated_at").alias("updated_at"),
        *last_values(DATA, F.col("_order"))).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in WORKS.fields])


def ingest_run(spark: SparkSession, directories: dict[str, str], root: str, now: datetime, site: Site = Site(),
               base: DataFrame | None = None, files_per_batch: int = 1000) -> int | None:
    """Check what has arrived in the folders, each read by a stream of its own name, and publish the catalog; its version.

    Checked rows and checkpoints lie under ``root``-ingest by name. None where nothing has been accepted yet.
    """
    for name, directory in directories.items():
        ingest_stream(spark, directory, f"{root}-ingest/checked/{name}", f"{root}-ingest/checkpoint/{name}", now, site, files_per_batch).awaitTermination()
    works = ingested_works(checked_rows(spark, [f"{root}-ingest/checked/{name}" for name in directories]), base)
    return None if works.isEmpty() else write_works(works, root)
