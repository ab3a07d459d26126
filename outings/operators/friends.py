"""Friend requests and the symmetric edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def resolve_friend_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests(user_id, user_email, friend_user_id, friend_email) -> friend_id, outcome.

    Requests by id and by address are resolved apart, so that no join key is null.
    Asking for oneself is refused before the friend is looked up.
    """
    by_id = F.col("friend_user_id").isNotNull()
    email = normalize_email(F.col("friend_email"))

    def resolved(df: DataFrame, directory: DataFrame, key: Column, is_self: Column) -> DataFrame:
        found = df.withColumn("_key", key).join(directory, "_key", "left")
        outcome = (
            F.when(is_self, "cannot_add_self")
            .when(F.col("_found").isNull(), "friend_not_found").otherwise("ok")
        )
        return found.withColumn("outcome", outcome).select(
            *requests.columns, F.when(F.col("outcome") == "ok", F.col("_found")).alias("friend_id"), "outcome")

    ids = users.select(F.col("user_id").alias("_key"), F.col("user_id").alias("_found"))
    emails = users.select(F.col("email").alias("_key"), F.col("user_id").alias("_found"))
    return resolved(
        requests.where(by_id), ids, F.col("friend_user_id"), F.col("friend_user_id") == F.col("user_id"),
    ).unionByName(resolved(
        requests.where(~by_id), emails, F.coalesce(email, F.lit("")), email == normalize_email(F.col("user_email")),
    ))


def add_friendships(friendships: DataFrame, pairs: DataFrame) -> DataFrame:
    """Existing edges plus both directions of every pair, without repeats.

    Known pairs are picked out of the (large) edge list by a semi join against the
    (small) wish list, so the edge list is only shuffled when the wish list is large.
    """
    both = F.array(
        F.struct(F.col("user_id").alias("a"), F.col("friend_id").alias("b")),
        F.struct(F.col("friend_id").alias("a"), F.col("user_id").alias("b")),
    )
    wanted = (
        pairs.select(F.explode(both).alias("e"))
        .select(F.col("e.a").alias("user_id"), F.col("e.b").alias("friend_id")).distinct()
    )
    edges = friendships.select("user_id", "friend_id")
    known = edges.join(wanted, ["user_id", "friend_id"], "left_semi")
    return edges.unionByName(wanted.join(known, ["user_id", "friend_id"], "left_anti"))
