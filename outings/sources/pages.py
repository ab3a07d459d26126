"""Stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.schemas import PAGES
from outings.session import spread


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(page_id, url, html) that have a body."""
    return spread(spark.read.schema(PAGES).parquet(path)).where(F.col("html").isNotNull() & (F.length("html") > 0))
