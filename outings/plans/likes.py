"""Liked works: what a user liked and whether it is still on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.plans.discover import calendar_day
from outings.schemas import CARD_COLUMNS


def liked_rows(reactions: DataFrame, works: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every LIKE with its work's columns (null when the work is gone), for all users."""
    cards = works.select(*[F.col(c).alias("work_id" if c == "id" else c) for c in (columns or CARD_COLUMNS)])
    likes = reactions.where(F.col("status") == "LIKE").select(
        "user_id", "work_id", F.col("created_at").alias("liked_at"))
    return likes.join(cards, "work_id", "left")


def liked_works(reactions: DataFrame, works: DataFrame, user) -> DataFrame:
    """One user's likes, newest first by the time of the first reaction."""
    rows = liked_rows(reactions.where(F.col("user_id") == user), works)
    return rows.orderBy(F.col("liked_at").desc(), F.col("work_id").asc())


def likes_by_view(liked: DataFrame, as_of: datetime) -> DataFrame:
    """Adds ``view``: archived when the work ended before today, else active."""
    ended = F.coalesce(F.col("end_date") < F.lit(calendar_day(as_of)), F.lit(False))
    return liked.withColumn("view", F.when(ended, "archived").otherwise("active"))


def likes_counts(liked: DataFrame, as_of: datetime) -> DataFrame:
    """total, active and archived likes per user."""
    viewed = likes_by_view(liked, as_of)
    return viewed.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("view") == "active").alias("active"),
        F.count_if(F.col("view") == "archived").alias("archived"),
    )
