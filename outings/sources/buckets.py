"""The catalog in buckets of its key, so that a merge reads and writes the buckets its batch touches.

A work lies in the folder of its bucket, a hash of ``source_url``. A batch is folded and stored once; the buckets
of its urls, at most all of them, are read by partition pruning, merged, and put in place by dynamic
partition overwrite. The other buckets' files are neither read nor replaced, so a merge costs what the batch
touches and not what the catalog holds. A bucket is one file where the rows of a bucket fit a task; choose as many
buckets as make it so (a hundred thousand works each, say), and more where batches are small.

The number of buckets is part of the partition column's name, so reading a table with another number is an error
and never a wrong merge. One writer at a time. What replaces the buckets is stored in the shared folder first: a
commit cut short is completed by ``replace_buckets`` of that copy, or by merging the batch again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.operators.merge import KEY, folded, merge_folded
from outings.schemas import WORKS, conform
from outings.session import materialize
from outings.sources.catalog import read_if_exists

BUCKETS = 256


def bucket_column(buckets: int) -> str:
    return f"bucket_of_{buckets}"


def bucket_of(url: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def replace_buckets(works: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Put ``works`` in place of all that their buckets hold; other buckets stay as they are. Running it again changes nothing."""
    name = bucket_column(buckets)
    parts = min(buckets, int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = conform(works, WORKS).withColumn(name, bucket_of(KEY, buckets))
    rows.repartition(parts, name).sortWithinPartitions(name, KEY).write.partitionBy(name).option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def scan_buckets(spark: SparkSession, root: str, buckets: int = BUCKETS, only: list[int] | None = None) -> DataFrame:
    """The catalog, or of it the buckets ``only``; empty before the first write."""
    name = bucket_column(buckets)
    rows = read_if_exists(spark, root, T.StructType([*WORKS.fields, T.StructField(name, T.IntegerType())]))
    if not rows.isEmpty() and rows.where(F.col(name).isNotNull()).isEmpty():
        raise ValueError(f"{root} is not in {buckets} buckets")
    return (rows if only is None else rows.where(F.col(name).isin(only))).select(*WORKS.names)


def works_by_url(spark: SparkSession, root: str, urls: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The works of a few urls; reads their buckets only."""
    places = spark.createDataFrame([(u,) for u in urls], "u string").select(bucket_of("u", buckets).alias("b")).distinct()
    only = [r.b for r in places.collect()]
    return scan_buckets(spark, root, buckets, only).where(F.col(KEY).isin(urls))


def merge_buckets(spark: SparkSession, root: str, batch: DataFrame, now: datetime, buckets: int = BUCKETS,
                  update_cols: list[str] | None = None) -> list[int]:
    """``upsert_works`` on the buckets that ``batch`` touches; returns them."""
    new = materialize(folded(batch), "batch")
    touched = sorted(r[0] for r in new.select(bucket_of(KEY, buckets)).distinct().collect())  # at most ``buckets`` numbers
    if touched:
        old = scan_buckets(spark, root, buckets, touched)
        replace_buckets(materialize(merge_folded(old, new, now, update_cols), "merged"), root, buckets)
    return touched
