"""The links of all crawls so far, kept in hash buckets of their urls.

A run adds what it learns: urls that no run had, and places before the known ones. Rows are only appended, to a table
bucketed by url, and the first place of a url is a minimum over its rows. Both that minimum and the join with a run's
links take the bucket's partitioning as it is stored, so of a run only its own links are shuffled, after they were
combined to one row per url and task, and the stored side never is (if the session's shuffle partitions are another
number than the buckets, a run's distinct urls move once more).

A run has a name. Running it again, say after a failure, gives the same answer: its own rows are left out of what
is known, and rows that come twice don't change a minimum. One writer at a time. The number of buckets is stored
beside the table and opening it with another is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.operators.frontier import first_seen_links, place_of
from outings.sources.catalog import read_if_exists

LINK = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("section", T.StringType()), T.StructField("page", T.IntegerType()),
    T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())])
_BUCKETS = T.StructType([T.StructField("buckets", T.IntegerType())])


class SeenLinks:
    """The set stored under ``root``; ``order`` ranks sections as in ``first_seen_links``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, order: list[str] | None = None):
        self.spark, self.buckets, self.order = spark, buckets, order
        stored = read_if_exists(spark, f"{root}/buckets", _BUCKETS).first()
        if stored is None:
            spark.createDataFrame([(buckets,)], _BUCKETS).write.parquet(f"{root}/buckets")
        elif stored.buckets != buckets:
            raise ValueError(f"{root} is in {stored.buckets} buckets, not {buckets}")
        self.name = f"seen_links_{hashlib.sha256(root.encode()).hexdigest()[:16]}"
        place = f"{root}/links".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in LINK)}, unseen boolean, run string) "
                  f"USING parquet CLUSTERED BY (url) INTO {buckets} BUCKETS LOCATION '{place}'")

    def links(self) -> DataFrame:
        """The first place of every url, over all runs."""
        return first_seen_links(self.spark.table(self.name), self.order)

    def learned(self, links: DataFrame, run: str) -> DataFrame:
        """The rows that ``add`` stores: urls and places new to the set, ``unseen`` where the url is."""
        new = first_seen_links(links.select(*[F.col(f.name).cast(f.dataType) for f in LINK.fields]), self.order)
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            new = new.repartition(self.buckets, "url")
        known = first_seen_links(self.spark.table(self.name).where(F.col("run") != run), self.order)
        was = known.select("url", place_of(self.order).alias("was"))
        both = new.join(was, "url", "left").where(F.col("was").isNull() | (place_of(self.order) < F.col("was")))
        return both.select(*LINK.names, F.col("was").isNull().alias("unseen"), F.lit(run).alias("run"))

    def add(self, links: DataFrame, run: str) -> DataFrame:
        """Store what ``links`` (section, page, pos, url, text) tell; the links whose urls no other run had."""
        self.learned(links, run).write.insertInto(self.name)
        return first_seen_links(self.spark.table(self.name).where((F.col("run") == run) & F.col("unseen")), self.order)
