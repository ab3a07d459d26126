"""What the physical plans must and must not hold."""

from pyspark.sql import functions as F

from outings.operators import frontier as fr
from outings.operators import reactions as re_
from outings.operators.dom import dom_pass
from outings.operators.quality import check_shows
from outings.plans import common as cm
from outings.plans import discover as di
from outings.schemas import SHOWS, WORKS
from outings.standin import tables as st
from tests.test_catalog import NOW, events, work, works


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "works")
    works(spark, work(1)).write.partitionBy("section").parquet(path)
    stored = spark.read.schema(WORKS).parquet(path)
    text = plan(di.filter_section(di.filter_current(stored, NOW), "cinema").select("id"))
    assert "PartitionFilters: [isnotnull(section" in text and "GreaterThanOrEqual(end_date,2026-03-12)" in text
    assert "ReadSchema: struct<id:string,end_date:date>" in text
    assert "TakeOrderedAndProject" in plan(di.discover(stored, events(spark, 10), "u0", NOW))


def test_no_pair_is_made_without_a_key(spark):
    rows, log = works(spark, work(1), work(2)), events(spark, 50)
    users = log.select("user_id").distinct()
    edges = log.select("user_id", F.lit("u1").alias("friend_id")).distinct()
    for df in (di.discover_all_users(rows, log, users, NOW), di.discover_totals_all_users(rows, log, users, NOW),
               cm.common_likes_all_pairs(edges, log, rows)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_reductions_combine_before_the_shuffle(spark):
    links = spark.createDataFrame([("theatre", 1, 1, "u", "t")], "section string, page int, pos int, url string, text string")
    for df in (re_.fold_reactions(events(spark, 50)), fr.first_seen_links(links)):
        text = plan(df)
        assert text.count("Aggregate(") == 2 and text.count("Exchange hashpartitioning") == 1
        assert "partial_max" in text or "partial_min" in text
        assert "Window" not in text


def test_pages_are_parsed_where_they_are_read(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    text = plan(dom_pass(pages).where("parsed").select("text"))
    assert "MapInArrow" in text and "Exchange" not in text


def test_cleaning_runs_once(spark):
    shows = spark.createDataFrame([], SHOWS)
    text = plan(check_shows(shows).where("reason IS NULL"))
    assert "Exchange" not in text


def test_a_hot_work_is_split(spark, tmp_path):
    """Two thirds of the likes are of one work: the join by work splits that partition."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, 300_000, 1, 8)
        likes = ids.select(F.concat(F.lit("user-"), F.sha2(F.col("id").cast("string"), 256)).alias("user_id"),
                           F.when(F.col("id") % 3 < 2, "w0").otherwise(F.concat(F.lit("w"), (F.col("id") % 1000).cast("string"))).alias("work_id"))
        cards = spark.range(1000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("id"), F.lit("t").alias("title"))
        df = di.with_cards(likes, cards, ["title"])
        executed = df._jdf.queryExecution()
        assert executed.toRdd().count() == 300_000
        assert "skew=true" in executed.executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_stand_in_tables_have_the_model_schema(spark):
    d = "/root/testdata/sf0.001"
    assert st.works(spark, d).columns == WORKS.names
    assert st.cache(spark, d).columns == SHOWS.names == st.dirty_shows(spark, d).columns


def test_scratch_space_is_shared_or_refused():
    """Off one machine an unset folder is an error, never a local one."""
    import types

    import pytest

    from outings.session import scratch_dir

    def asked(**conf):
        conf = {k.replace("_", "."): v for k, v in conf.items()}
        return scratch_dir(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: conf.get(key, default))), "x")

    for master in ("spark://host:7077", "yarn", "k8s://https://h", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError):
            asked(spark_master=master)
    assert asked(spark_master="yarn", spark_checkpoint_dir="hdfs://a/b/").startswith("hdfs://a/b/x-")
    assert asked(spark_master="local[8]").startswith("/") and asked(spark_master="local")


def test_measured_sizes(spark):
    from outings.operators.sizes import broadcast_limit, fits_broadcast, measured_bytes

    df = spark.createDataFrame([("abc", 1), (None, 2)], "t string, n int")
    assert measured_bytes(df) == 2 * (64 + 16) + 3 and fits_broadcast(df)
    assert broadcast_limit(spark) == 10 << 20
