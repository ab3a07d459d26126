"""A set of links kept in buckets over many runs."""

import random

import pytest
from pyspark.sql import functions as F

from outings.operators.frontier import first_seen_links
from outings.sources.seen import LINK, SeenLinks

PARTS = 8


def links(spark, seed, count=400, urls=120):
    r = random.Random(seed)
    rows = [(None if r.random() < 0.05 else f"u{r.randrange(urls)}", r.choice(["theatre", "cinema", "other", None]), r.randrange(9), r.randrange(50),
             r.choice(["a", "b", None])) for _ in range(count)]
    return spark.createDataFrame(rows, LINK)


def rows(df):
    return sorted((tuple(r[c] for c in LINK.names) for r in df.collect()), key=str)


def test_runs_one_after_the_other_equal_one_over_all(spark, tmp_path):
    seen, runs = SeenLinks(spark, str(tmp_path / "seen"), PARTS), [links(spark, s) for s in range(4)]
    union = runs[0]
    assert rows(seen.links()) == []
    before = set()
    for k, run in enumerate(runs):
        union = run if k == 0 else union.unionByName(run)
        fresh = rows(seen.add(run, f"run {k}"))
        own = {r.url for r in run.collect()} - {None}
        assert {f[0] for f in fresh} == own - before and fresh == [x for x in rows(first_seen_links(run)) if x[0] not in before]
        before |= own
        assert rows(seen.links()) == rows(first_seen_links(union))
        assert rows(seen.add(run, f"run {k}")) == fresh and rows(seen.links()) == rows(first_seen_links(union))
    assert rows(seen.add(runs[0].limit(0), "none")) == [] and rows(SeenLinks(spark, str(tmp_path / "seen"), PARTS).links()) == rows(seen.links())


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for parts, exchanges in ((PARTS, 1), (PARTS * 2, 2)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            seen = SeenLinks(spark, str(tmp_path / "seen"), PARTS)
            seen.add(links(spark, parts), f"run {parts}")
            learned = seen.learned(links(spark, 9), "next")
            learned.collect()
            plan = learned._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("Exchange hashpartitioning") == exchanges and "Bucketed: true" in plan, plan
            assert "Exchange" not in seen.links()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    SeenLinks(spark, str(tmp_path / "it's"), PARTS).add(links(spark, 1), "a")
    with pytest.raises(ValueError, match="8 buckets"):
        SeenLinks(spark, str(tmp_path / "it's"), PARTS + 1)


def test_only_what_is_learned_is_stored(spark, tmp_path):
    seen = SeenLinks(spark, str(tmp_path / "seen"), PARTS)
    seen.add(links(spark, 1), "a")
    stored = spark.table(seen.name).count()
    seen.add(links(spark, 1), "b")
    assert spark.table(seen.name).count() == stored == seen.links().select(F.col("url")).distinct().count()
