"""Counters of a crawl, taken while its rows are produced.

``crawl_stats`` reads three finished tables once more. Here the same counters are observed in the jobs that
write those tables: each table passes through one of the ``of_`` functions before it is written, and the row is
there when the writes are done. Spark adds the counters up task by task; nothing is scanned a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from outings.operators.frontier import COUNTERS


class CrawlCounters:
    """One crawl's counters. Each ``of_`` function is for one table, whose rows must be written exactly once."""

    def __init__(self):
        self._seen: list[Observation] = []

    def _observe(self, df: DataFrame, **counters) -> DataFrame:
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in counters.items()])

    def of_pages(self, pages: DataFrame) -> DataFrame:
        return self._observe(pages, pages_crawled=F.count_if(F.col("ok")), pages_failed=F.count_if(~F.col("ok")))

    def of_outcomes(self, outcomes: DataFrame) -> DataFrame:
        fetched = F.count_if(F.col("action") == "fetch")
        return self._observe(
            outcomes, shows_extracted=F.count_if(F.col("valid")), invalid_shows=F.count_if(~F.col("valid")), shows_completed=fetched,
            detail_fetches=fetched, cached_reused=F.count_if(F.col("action") == "reuse"))

    def of_cache(self, cache: DataFrame) -> DataFrame:
        return self._observe(cache, cached_loaded=F.count("*"))

    def row(self, spark: SparkSession) -> DataFrame:
        """The counters of all tables observed; waits for a table that is still being written, 0 for one never observed."""
        found = {}
        for seen in self._seen:
            found |= seen.get
        return spark.createDataFrame([tuple(found.get(c, 0) for c in COUNTERS)], ", ".join(f"{c} bigint" for c in COUNTERS))
