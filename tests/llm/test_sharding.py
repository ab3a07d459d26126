import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from outings.llm.sharding import SLOTS, ShardMaps, balanced_map, first_map, numbered, place, rebalance, size_of, slot_bytes


def shards_of(frame, slot_map):
    return {r.doc_id: r.shard for r in place(frame, slot_map).select("doc_id", "shard").collect()}


def test_bytes_are_nearly_even(spark):
    rows = [(i, "x" * (50 + i * 7919 % 300)) for i in range(4000)] + [(9000, "y" * 5000), (9001, None), (9002, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = shards_of(docs, balanced_map(docs, 16).newest())
    load = Counter()
    for i, t in rows:
        load[shards[i]] += len((t or "").encode()) + 1
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 16


def test_edits_move_few_slots(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("z"), (F.col("id") % 90).cast("int")).alias("text"))
    sizes = slot_bytes(docs)
    first = first_map(spark, 8)
    second = rebalance(first, sizes, 8).cache()
    moved = first.join(second.withColumnRenamed("shard", "s"), "vslot").where("shard <> s").count()
    assert 0 < moved < SLOTS // 4
    third = {r.vslot: r.shard for r in rebalance(second, sizes, 9, only_new=True).collect()}
    old = {r.vslot: r.shard for r in second.collect()}
    assert all(third[v] in (old[v], 8) for v in old) and sum(s == 8 for s in third.values()) > SLOTS // 12
    fewer = {r.vslot: r.shard for r in rebalance(second, sizes, 7).collect()}
    assert set(fewer.values()) == set(range(7))


def test_versions_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i) for i in range(300)], "doc_id long, text string")
    maps = balanced_map(docs, 4, folder=str(tmp_path / "map"))
    assert [r.version for r in maps.all().select("version").distinct().orderBy("version").collect()] == [1, 2]
    assert maps.newest().count() == SLOTS and maps.newest().first().version == 2
    assert ShardMaps(spark, str(tmp_path / "map")).newest().count() == SLOTS


def test_numbers_have_no_gaps(spark):
    rows = [(i, "t" * (i % 50)) for i in range(1000)] + [(5, "t" * 5)] * 40 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("vslot_", F.lit(1))
    placed = place(docs.select("doc_id", size_of("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")), balanced_map(docs, 5).newest())
    places = defaultdict(list)
    for r in numbered(placed, "slot", ["doc_id", "crc", "size"]).collect():
        places[r.shard].append(r.slot)
        assert r.doc_id is None or r.crc == zlib.crc32(b"t" * (r.size - 1))
    assert sum(map(len, places.values())) == len(rows) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_no_rows_and_taken_names(spark, nothing):
    assert place(nothing, balanced_map(nothing, 16).newest()).count() == 0
    docs = spark.createDataFrame([(1, "a", "mine", 7)], "doc_id long, text string, shard string, vslot int")
    got = place(docs, first_map(spark, 3))
    assert got.columns == ["doc_id", "text", "shard", "vslot", "vslot_", "shard_"] and got.first().shard == "mine"


def test_rows_without_id_are_spread(spark):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"text {i}") for i in range(12_000)], "doc_id long, text string")
    placed = place(docs, balanced_map(docs, 8).newest(), text="text")
    loads = [r.n for r in placed.groupBy("shard").agg(F.sum(size_of("text")).alias("n")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.02 * sum(loads) / 8
    assert placed.groupBy("vslot").count().agg(F.max("count")).first()[0] < 40
    numbers = numbered(placed.withColumn("crc", F.crc32(F.col("text").cast("binary"))), "slot", ["doc_id", "crc"])
    assert numbers.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("not ok").isEmpty()
