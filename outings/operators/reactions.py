"""One current reaction per user and work, and the commands that change it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAIR = ["user_id", "work_id"]


def fold_reactions(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Events (and an earlier state) -> status of the latest event, time of the first and the latest.

    "Latest" is by (ts, seq), never by arrival, so any split of the log into batches gives
    the same state. A mergeable aggregate: a pair that holds a third of the log is reduced
    to one row per task before the only shuffle.
    """
    rows = events.select(*_PAIR, "status", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
                         F.col("seq").alias("last_seq"))
    return fold_states(rows if state is None else rows.unionByName(state))


def fold_states(states: DataFrame) -> DataFrame:
    """Any number of partial states per pair -> one."""
    last = F.max(F.struct("updated_at", "last_seq", "status")).alias("last")
    return states.groupBy(*_PAIR).agg(last, F.min("created_at").alias("created_at")).select(
        *_PAIR, "last.status", "created_at", "last.updated_at", "last.last_seq")


def reaction_transitions(events: DataFrame, stretch: str = "day") -> DataFrame:
    """Adds ``previous`` (status before this event) and ``already`` (it is the same status).

    The log of one pair can be long, so it is cut into stretches of time. Inside a stretch
    the previous event is the row before; the first row of a stretch takes the last
    status of the pair's stretch before, found on one row per pair and stretch.
    """
    cut = events.withColumn("_s", F.date_trunc(stretch, "ts"))
    inside = Window.partitionBy(*_PAIR, "_s").orderBy("ts", "seq", "status")
    across = Window.partitionBy(*_PAIR).orderBy("_s")
    rows = cut.withColumns({"_prev": F.lag("status").over(inside)})
    ends = (
        cut.groupBy(*_PAIR, "_s").agg(F.max(F.struct("ts", "seq", "status")).alias("_end"))
        .select(*_PAIR, "_s", F.lag(F.col("_end.status")).over(across).alias("_before"))
    )
    joined = rows.join(ends, [*_PAIR, "_s"])
    previous = F.coalesce("_prev", "_before")
    return joined.select(
        *events.columns, previous.alias("previous"),
        F.coalesce(previous == F.col("status"), F.lit(False)).alias("already"))


def like_commands(api_log: DataFrame) -> DataFrame:
    """api_log(op, user_id, work_id, ts, seq[, status]) -> events.

    POST always means LIKE whatever status it carries; DELETE means DISLIKE, never a
    removal. Commands without a work are dropped.
    """
    status = F.when(F.col("op") == "POST", "LIKE").when(F.col("op") == "DELETE", "DISLIKE")
    return (
        api_log.withColumn("status", status)
        .where(F.col("status").isNotNull() & (F.length("work_id") > 0))
        .select(*_PAIR, "status", "ts", "seq")
    )


def reaction_lookup(reactions: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(user_id, work_id) with the current status, null where there is none."""
    return keys.join(reactions.select(*_PAIR, "status"), _PAIR, "left")
