"""Merges of buckets: what a batch doesn't touch stays as it is on disk. Filters of keys, words of likes, blocks of ranks."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from outings.operators import frontier as fr
from outings.operators.bloom import MOST_BITS, filter_bits, possible
from outings.operators.merge import upsert_works
from outings.plans import common as cm
from outings.plans.discover import free_ranks, taken_blocks
from outings.schemas import SHOWS, WORKS
from outings.sources import buckets as bu

NOW = datetime(2026, 3, 12, 7)


def catalog(spark, count, title="T"):
    stamp = F.lit("2026-01-01").cast("timestamp_ntz")
    made = spark.range(count).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit(title), F.col("id")).alias("title"), F.lit("theatre").alias("section"),
        F.concat(F.lit("https://x/"), F.col("id")).alias("source_url"), stamp.alias("created_at"), stamp.alias("updated_at"))
    return made.select(*[F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in WORKS.fields])


def files(root):
    return {p.parent.name + "/" + p.name for p in Path(root).glob("bucket_of_*/*.parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    root, works = str(tmp_path / "works"), catalog(spark, 2000)
    bu.replace_buckets(works, root, 128)
    before = files(root)
    batch = works.where("id % 100 = 3").select("source_url", F.lit("neu").alias("title"), "section", F.lit("V").alias("venue"))
    touched = bu.merge_buckets(spark, root, batch, NOW, 128)
    after = files(root)
    assert 0 < len(touched) <= 20 and {f.split("/")[0] for f in before ^ after} == {f"bucket_of_128={b}" for b in touched}
    want = rows(upsert_works(works, batch, NOW))
    assert rows(bu.scan_buckets(spark, root, 128)) == want
    bu.merge_buckets(spark, root, batch, NOW, 128)  # again
    assert rows(bu.scan_buckets(spark, root, 128)) == want


def test_buckets_are_read_by_url(spark, tmp_path):
    root = str(tmp_path / "works")
    bu.replace_buckets(catalog(spark, 500), root, 16)
    found = bu.works_by_url(spark, root, ["https://x/7", "https://x/none"], 16)
    assert [r.title for r in found.collect()] == ["T7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket_of_16" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_edges_of_buckets(spark, tmp_path):
    root = str(tmp_path / "works")
    assert bu.scan_buckets(spark, root, 8).count() == 0
    empty = spark.createDataFrame([], "source_url string, title string, section string")
    assert bu.merge_buckets(spark, root, empty, NOW, 8) == [] and bu.scan_buckets(spark, root, 8).count() == 0
    twice = spark.createDataFrame([("u", "a", "theatre", 1), ("u", "b", "theatre", 2)], "source_url string, title string, section string, _order int")
    bu.merge_buckets(spark, root, twice, NOW, 8)
    assert [r.title for r in bu.scan_buckets(spark, root, 8).collect()] == ["b"]
    with pytest.raises(ValueError, match="not in 4 buckets"):
        bu.scan_buckets(spark, root, 4)


def test_a_filter_loses_no_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    table = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id")).alias("t")).unionByName(spark.createDataFrame([(None,)], "t string"))
    found = possible(table, "t", keys, "k", filter_bits(5000))
    assert found.join(keys, F.col("t") == F.col("k")).count() == 5000 and found.count() < 5000 + 195_000 // 100
    assert possible(table, "t", keys.where("false"), "k", filter_bits(0)).count() == 0
    assert filter_bits(1) == 64 and filter_bits(1 << 40) == MOST_BITS
    assert possible(table, "t", keys, "k", 64).join(keys, F.col("t") == F.col("k")).count() == 5000  # crowded: more pass, none is lost


def test_the_cache_is_filtered_before_it_is_shuffled(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = spark.range(3000).select(F.concat(F.lit("https://x/"), F.col("id")).alias("url"), F.lit("2026-03-01T00:00:00Z").alias("crawled_at"),
                                     F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("cinema").alias("section"))
    cache.select(*[F.col(f.name) if f.name in cache.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SHOWS.fields]).write.parquet(path)
    frontier = spark.createDataFrame([("https://x/1",), ("https://x/new",)], "url string")
    cached = spark.read.schema(SHOWS).parquet(path)
    planned = fr.refresh_plan(frontier, cached, NOW, 1000, large_cache=True)
    assert rows(planned) == rows(fr.refresh_plan(frontier, cached, NOW, 1000))
    plan = planned._jdf.queryExecution().optimizedPlan().toString().splitlines()
    aggregate = next(i for i, line in enumerate(plan) if "Aggregate [url" in line)
    assert any("Filter" in line and "getbit" in line for line in plan[aggregate:])


def test_a_batch_is_computed_once(spark, tmp_path):
    works, batch = str(tmp_path / "works"), str(tmp_path / "batch")
    catalog(spark, 100).write.parquet(works)
    catalog(spark, 30, "N").write.parquet(batch)
    merged = upsert_works(spark.read.schema(WORKS).parquet(works), spark.read.schema(WORKS).parquet(batch), NOW)
    plan = merged._jdf.queryExecution().optimizedPlan()
    assert batch not in str(merged.inputFiles()) and plan.toString().count("Aggregate") == 0


def test_free_ranks_against_sets(spark):
    r = random.Random(4)
    size, per = 100, 7
    taken = {"none": [], "all": list(range(1, 101)), "first": list(range(1, 96)), "odd": list(range(1, 101, 2)), "far": [99, 100], "hole": [*range(1, 11), *range(21, 31)]}
    taken |= {f"u{i}": sorted(r.sample(range(1, 101), r.randint(1, 99))) for i in range(40)}
    events = spark.createDataFrame([(u, a) for u, ranks in taken.items() for a in ranks * 2] + [("stranger", 1)], "user_id string, at long")
    users = spark.createDataFrame([(u,) for u in taken], "user_id string")
    for block in (7, 10, 64, 1000):
        found = {}
        for row in free_ranks(events, users, F.lit(size), per, block).collect():
            found.setdefault(row.user_id, {})[row["rank"]] = row["at"]
        want = {u: [a for a in range(1, size + 1) if a not in set(ranks)][:per] for u, ranks in taken.items()}
        assert {u: [f[i] for i in sorted(f)] for u, f in found.items()} == {u: w for u, w in want.items() if w}
        assert all(sorted(f) == list(range(1, len(f) + 1)) for f in found.values())


def test_a_long_history_is_no_long_row(spark):
    """A million reactions of one user: rows of a block at most."""
    taken = spark.range(1, 1_000_001).select(F.lit("u").alias("user_id"), F.col("id").alias("at"))
    held = taken_blocks(taken, 1024).agg(F.max(F.size("taken")).alias("most"), F.count("*").alias("n")).first()
    assert held.most == 1024 and held.n == 977
    users = spark.createDataFrame([("u",)], "user_id string")
    assert [r["at"] for r in free_ranks(taken, users, F.lit(2_000_000), 3, 1024).orderBy("rank").collect()] == [1_000_001, 1_000_002, 1_000_003]


def test_words_count_what_rows_count(spark):
    r = random.Random(2)
    works = catalog(spark, 300)
    likes = [(str(u), str(w), r.choice(["LIKE", "LIKE", "SEEN"])) for u in range(12) for w in r.sample(range(310), r.randint(0, 250))]
    reactions = spark.createDataFrame(likes, "user_id string, work_id string, status string")
    edges = [(str(a), str(b)) for a in range(12) for b in range(12) if a != b and r.random() < 0.6]
    friends = spark.createDataFrame(edges, "user_id string, friend_id string")
    want = rows(cm.common_likes_counts(cm.common_likes_all_pairs(friends, reactions, works)))
    assert rows(cm.common_likes_counts_all_pairs(friends, reactions, works)) == want and want
    plan = cm.common_likes_counts_all_pairs(friends, reactions, works)._jdf.queryExecution().optimizedPlan().toString()
    assert "work_id" not in plan


def test_a_pair_is_one_row_of_words(spark, monkeypatch):
    """Users of one row and of many against brute force; a row holds all words of a short history, few of a long one."""
    r = random.Random(3)
    words = {u: r.sample(range(5000), n) for u, n in {"a": 3, "b": 64, "c": 65, "d": 3000}.items()}
    table = spark.createDataFrame([(u, w, w + 1) for u, own in words.items() for w in own], "user_id string, word long, bits long")
    held = {}
    for row in cm.word_rows(table).collect():
        assert row.n == len(words[row.user_id])
        held.setdefault(row.user_id, []).append(row.bits)
    assert {u: sorted(w for m in maps for w in m) for u, maps in held.items()} == {u: sorted(own) for u, own in words.items()}
    assert all(bits == w + 1 for maps in held.values() for m in maps for w, bits in m.items())
    assert [len(held[u]) for u in "abc"] == [1, 1, 2] and len(held["d"]) == 64 and max(map(len, held["d"])) < 100

    monkeypatch.setattr(cm, "ROW_WORDS", 2)
    works = catalog(spark, 1500)
    likes = {str(u): set(r.sample(range(1500), r.choice([0, 1, 2, 5, 40, 400]))) for u in range(30)}
    reactions = spark.createDataFrame([(u, str(w), "LIKE") for u, own in likes.items() for w in own], "user_id string, work_id string, status string")
    known = {x.id for x in works.select("id").collect()}
    edges = [(str(a), str(b)) for a in range(30) for b in range(30) if r.random() < 0.4]
    want = {(a, b): n for a, b in edges if (n := sum(str(w) in known for w in likes[a] & likes[b]))}
    got = cm.common_likes_counts_all_pairs(spark.createDataFrame(edges, "user_id string, friend_id string"), reactions, works).collect()
    assert len(got) == len(want) and {(x.user_id, x.friend_id): x.common for x in got} == want
