"""One user's rows without the others', counters without a second pass."""

import random

from pyspark.sql import functions as F

from outings.operators.counters import CrawlCounters
from outings.operators.frontier import crawl_stats
from outings.plans.likes import liked_works
from outings.sources.histories import read_by_user, rows_scanned, write_by_user
from tests.test_buckets import catalog, rows

KIND = "user_id string, work_id string, status string, created_at timestamp_ntz"


def reactions(spark, count=60_000, hot="u7"):
    user = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(4000))))
    return spark.range(count).select(user.alias("user_id"), F.col("id").cast("string").alias("work_id"), F.lit("LIKE").alias("status"),
                                     F.lit("2026-01-01").cast("timestamp_ntz").alias("created_at"))


def test_one_user_is_read_without_the_others(spark, tmp_path):
    table, plain = str(tmp_path / "by-user"), str(tmp_path / "plain")
    log = reactions(spark)
    write_by_user(log, table, then="work_id", row_group=64 << 10)
    log.write.parquet(plain)
    for path, most in ((table, 12_000), (plain, None)):
        one = read_by_user(spark, path, KIND).where("user_id = 'u123'")
        found = one.collect()
        assert len(found) == log.where("user_id = 'u123'").count() > 0
        assert most is None or rows_scanned(one) <= most < rows_scanned_of(spark, plain)


def rows_scanned_of(spark, path):
    df = read_by_user(spark, path, KIND).where("user_id = 'u123'")
    df.collect()
    return rows_scanned(df)


def test_a_hot_user_is_many_files(spark, tmp_path):
    path = str(tmp_path / "by-user")
    write_by_user(reactions(spark), path, then="work_id")
    files = spark.read.parquet(path).where("user_id = 'u7'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(f["count"] for f in files) < 12_000


def test_appends_keep_the_filter(spark, tmp_path):
    """Each append has a file of every range; a user that some of them lack is not read from those."""
    path = str(tmp_path / "by-user")
    for part in range(4):
        write_by_user(reactions(spark, 8000, hot=f"hot{part}").where("user_id NOT LIKE 'u1%'" if part else "true"), path, then="work_id", mode="append")
    one = read_by_user(spark, path, KIND).where("user_id = 'u11'")
    one.collect()
    assert rows_scanned(one) < 3000  # of 32,000


def test_likes_of_a_clustered_table(spark, tmp_path):
    path, works = str(tmp_path / "by-user"), catalog(spark, 300)
    log = reactions(spark, 3000)
    write_by_user(log, path, then="work_id")
    assert rows(liked_works(read_by_user(spark, path, KIND), works, "u7")) == rows(liked_works(log, works, "u7"))


def test_counters_equal_the_second_pass(spark):
    r = random.Random(1)
    pages = spark.createDataFrame([(r.random() < 0.8,) for _ in range(50)], "ok boolean").repartition(4)
    outcomes = spark.createDataFrame([(r.choice(["fetch", "reuse"]), r.random() < 0.5) for _ in range(200)], "action string, valid boolean").repartition(4)
    for cache in (spark.range(7), spark.range(0)):
        counters = CrawlCounters()
        for df in (counters.of_pages(pages), counters.of_outcomes(outcomes), counters.of_cache(cache)):
            df.write.format("noop").mode("overwrite").save()
        assert rows(counters.row(spark)) == rows(crawl_stats(pages, outcomes, cache))
    assert CrawlCounters().row(spark).first().pages_crawled == 0
