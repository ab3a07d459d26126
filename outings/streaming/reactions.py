"""Reaction events into the current state.

The state is a streaming aggregate per user and work, ``fold_reactions`` itself, kept in Spark's RocksDB state store: a
batch reads and writes the pairs it holds and costs what the batch costs, not what the state holds. The stream's
checkpoint is all there is: offsets say what was read, the state store what came of it, and a stream that was
killed goes on from there. The state is read out of the checkpoint, at the last batch that was completed.

Because the fold goes by event time and is associative, late events, repeated ones and any split into batches give
one state. Any number of folders may feed it, all of them named from the start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from outings.operators.reactions import fold_reactions
from outings.schemas import REACTION_EVENTS

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch uploads what it changed, not whole files of the store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a count of all rows held would cost a look-up for each row written
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def _with_settings(spark: SparkSession, settings: dict[str, str], start):
    """What ``start`` returns; a stream keeps the session's settings of the moment it was started."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def reaction_stream(spark: SparkSession, directories: list[str], checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Every new file of ``directories`` is folded into the state; stops when all are read."""
    sources = [spark.readStream.schema(REACTION_EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(d) for d in directories]
    state = fold_reactions(reduce(DataFrame.unionByName, sources))
    out = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return _with_settings(spark, STORE, out.start)


def current_reactions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state after the last completed batch, as ``fold_reactions`` gives it."""
    held = _with_settings(spark, STORE, lambda: spark.read.format("statestore").load(checkpoint))
    last, first = (F.col(f"value.`{f.name}`") for f in held.schema["value"].dataType.fields)
    return held.select(
        "key.user_id", "key.work_id", last["status"].alias("status"), first.alias("created_at"),
        last["updated_at"].alias("updated_at"), last["last_seq"].alias("last_seq"))
