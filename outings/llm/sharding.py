"""Shards made of fixed virtual slots, all in DataFrame operations.

A record's slot is a hash of its id, one of ``SLOTS``, for good. Bytes are summed per slot, and a map
says which shard holds each slot. The map is a stored table with a version; balancing edits it: a shard
keeps its largest slots up to an even share of the bytes, and what is over moves, largest first, to the
shard with least. So all but the moved slots stay where they are, and records never decide by themselves.
The map has ``SLOTS`` rows, whatever the corpus holds: it is joined by broadcast and the texts don't move.

Cases: null text has no bytes, size 1. Rows without id are dealt
by their text, so they don't share one slot. Rows that are the same
get places side by side. No rows leave every slot empty and give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outings.llm.common import free_name, materialize
from outings.session import scratch_dir

SLOTS = 4096  # 16 ** 3: three hex digits of the hash


def virtual_slot(doc_id: str, text: str | None = None) -> F.Column:
    """The slot of a row; ``text`` deals the rows without id, which share one slot where it isn't given."""
    key = F.coalesce(F.col(doc_id).cast("string"), *([F.col(text)] if text else []), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 3), 16, 10).cast("int")


def size_of(text: str) -> F.Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    return spark.range(SLOTS).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def slot_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and rows of each slot that has any."""
    return docs.select(virtual_slot(doc_id, text).alias("vslot"), size_of(text).alias("size")).groupBy("vslot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def rebalance(now: DataFrame, sizes: DataFrame, shards: int, only_new: bool = False) -> DataFrame:
    """The next version of a map for ``shards`` shards, by the bytes of each slot.

    ``only_new``: slots move to shards the map did not have yet, and to no others.
    """
    slots = now.join(sizes.select("vslot", "bytes"), "vslot", "left").select(
        "version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    every = Window.partitionBy()  # at most SLOTS rows
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    share = F.ceil(F.sum("bytes").over(every) / F.lit(shards))
    slots = slots.withColumn("kept", (F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= share) & (F.col("shard") < shards))
    slots = slots.withColumn("old", F.max("shard").over(every))
    loads = slots.where("kept").groupBy("shard").agg(F.sum("bytes").alias("held"))  # a row per shard
    held = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "held")))).scalar()
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at("held", s), F.lit(0).cast("long")))
    one = slots.agg(
        F.max("version").alias("version"), F.max("old").alias("old"),
        F.expr("array_sort(collect_list(if(kept, null, struct(-bytes as bytes, vslot))))").alias("moving")
    ).withColumn("held", held)

    def step(state, slot):
        free = F.transform(state["loads"], lambda x, i: F.when(F.lit(not only_new) | (i > F.col("old")), x))
        at = F.array_position(free, F.array_min(free)) - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == at, x - slot["bytes"]).otherwise(x)).alias("loads"),
            F.array_append(state["moved"], F.struct(slot["vslot"].alias("vslot"), at.cast("int").alias("to"))).alias("moved"))

    begin = F.struct(start.alias("loads"), F.expr("cast(array() as array<struct<vslot: int, to: int>>)").alias("moved"))
    moved = one.select(F.explode(F.aggregate("moving", begin, step)["moved"]).alias("m")).select("m.vslot", "m.to")
    return slots.join(moved, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"))


class ShardMaps:
    """The stored versions of a map."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def store(self, version: DataFrame) -> DataFrame:
        """Add a version; read back."""
        version = version.select("version", "vslot", "shard")
        version.coalesce(1).write.mode("append").parquet(self.folder)
        return self.newest()

    def all(self) -> DataFrame:
        return self.spark.read.schema("version int, vslot int, shard int").parquet(self.folder)

    def newest(self) -> DataFrame:
        last = self.all().agg(F.max("version").alias("v")).first().v
        return self.all().where(F.col("version") == last)


def balanced_map(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> ShardMaps:
    """Versions 1 (slots in turn) and 2 (edited for even bytes) of a map for ``docs``."""
    spark = docs.sparkSession
    maps = ShardMaps(spark, folder or scratch_dir(spark, "shard-map"))
    now = maps.store(first_map(spark, shards))
    maps.store(rebalance(now, materialize(slot_bytes(docs, doc_id, text), "slot-bytes"), shards))
    return maps


def place(docs: DataFrame, slot_map: DataFrame, doc_id: str = "doc_id", text: str | None = None) -> DataFrame:
    """``docs`` with their ``vslot`` and ``shard`` (underscores are added while those names are taken).

    Give ``text`` where ids may be null, as ``slot_bytes`` counts rows without id by their text.
    """
    vslot, shard = free_name(docs, "vslot"), free_name(docs, "shard")
    return docs.withColumn(vslot, virtual_slot(doc_id, text)).join(
        F.broadcast(slot_map.select(F.col("vslot").alias(vslot), F.col("shard").alias(shard))), vslot).select(*docs.columns, vslot, shard)


def numbered(placed: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``placed`` (with vslot and shard) with each row's number in its shard, from 0: by slot, then by ``order``.

    Rows are numbered within their slot, of which a shard has hundreds, and the slots' first numbers are
    added up over the map's few thousand rows.
    """
    rows = Window.partitionBy("vslot").orderBy(*[F.asc_nulls_first(c) for c in order])
    counts = placed.groupBy("shard", "vslot").agg(F.count("*").alias("n"))
    before = counts.select("vslot", (F.sum("n").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n")).alias("first"))
    return placed.withColumn("row", F.row_number().over(rows)).join(F.broadcast(before), "vslot").withColumn(
        name, F.col("first") + F.col("row") - 1).drop("first", "row")
