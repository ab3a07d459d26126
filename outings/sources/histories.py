"""Tables clustered by user, so that one user's rows are read without the others'.

Rows are dealt by ranges of (user, second key) and sorted in each file, so a user lies in one file, or in a few where
the history is long, and in few row groups of it: their smallest and largest user tell which can be passed over.
Files also carry a Parquet Bloom filter on the user, for tables that many appends have left with a file of
every range in each: a row group without the user is passed over there too. The filter ``user_id = ...`` of
``liked_works``, ``friends_list`` and ``discover`` reaches the scan, so they read such a table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 16 << 20


def write_by_user(rows: DataFrame, path: str, key: str = "user_id", then: str | None = None, mode: str = "error",
                  row_group: int = ROW_GROUP) -> None:
    """Write ``rows`` clustered by ``key``, a long history split by ``then``."""
    keys = [key, *([then] if then else [])]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(row_group)).mode(mode).parquet(path)


def read_by_user(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """How many rows the scans of an executed ``df`` handed on: those of row groups that were not passed over."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(i).metrics().get("numOutputRows").get().value()) for i in range(leaves.size())
               if leaves.apply(i).metrics().contains("numOutputRows"))
