"""Friends, and what friends like in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.plans.discover import rank_newest
from outings.schemas import CARD_COLUMNS
from outings.session import materialize


def friends_list(friendships: DataFrame, users: DataFrame, user=None) -> DataFrame:
    """Friends' ids and addresses by address; for one user, or for all (with ``user_id``)."""
    edges = friendships if user is None else friendships.where(F.col("user_id") == user)
    friends = users.select(F.col("user_id").alias("friend_id"), "email")
    rows = edges.select("user_id", "friend_id").join(friends, "friend_id")
    if user is None:
        return rows.select("user_id", "friend_id", "email")
    return rows.select("friend_id", "email").orderBy("email", "friend_id")


def _likes(reactions: DataFrame) -> DataFrame:
    return reactions.where(F.col("status") == "LIKE").select("user_id", "work_id")


def common_likes(friendships: DataFrame, reactions: DataFrame, works: DataFrame, user, friend,
                 strict: bool = False) -> DataFrame:
    """Cards both like, newest first. Without an edge the result is empty, or an error when strict."""
    edge = friendships.where((F.col("user_id") == user) & (F.col("friend_id") == friend))
    if strict and edge.isEmpty():
        raise PermissionError("forbidden")
    likes = _likes(reactions)
    mine = likes.where(F.col("user_id") == user)
    theirs = likes.where(F.col("user_id") == friend).select("work_id")
    shared = mine.join(edge, "user_id", "left_semi").select("work_id").intersect(theirs)
    found = works.join(shared, works["id"] == shared["work_id"], "left_semi")
    return found.orderBy(F.col("created_at").desc(), F.col("id").asc()).select(*CARD_COLUMNS)


def _sided(friendships: DataFrame, counts: DataFrame) -> DataFrame:
    """Edges as pairs a <= b with the ways they hold, which of both has fewer of counts(user_id, n), and the larger n; others drop out."""
    def count_of(side: str) -> DataFrame:
        return counts.select(F.col("user_id").alias(side), F.col("n").alias(f"n_{side}"))

    pairs = (
        friendships.select(F.least("user_id", "friend_id").alias("a"), F.greatest("user_id", "friend_id").alias("b"),
                           (F.col("user_id") <= F.col("friend_id")).alias("ab"))
        .groupBy("a", "b").agg(F.bool_or("ab").alias("ab"), F.bool_or(~F.col("ab")).alias("ba"))
        .join(count_of("a"), "a").join(count_of("b"), "b")
    )
    a_smaller = F.col("n_a") <= F.col("n_b")
    return pairs.select(
        "a", "b", "ab", "ba",
        F.when(a_smaller, F.col("a")).otherwise(F.col("b")).alias("small"),
        F.when(a_smaller, F.col("b")).otherwise(F.col("a")).alias("large"),
        F.greatest("n_a", "n_b").alias("n_large"),
    )


def _both_ways(pairs: DataFrame, *columns: str) -> DataFrame:
    """Pairs as (user_id, friend_id) in the ways their edge holds."""
    directions = F.array_compact(F.array(
        F.when(F.col("ab"), F.struct(F.col("a").alias("u"), F.col("b").alias("f"))),
        F.when(F.col("ba"), F.struct(F.col("b").alias("u"), F.col("a").alias("f"))),
    ))
    return pairs.select(F.explode(directions).alias("e"), *columns).select(
        F.col("e.u").alias("user_id"), F.col("e.f").alias("friend_id"), *columns)


def common_likes_all_pairs(friendships: DataFrame, reactions: DataFrame, works: DataFrame) -> DataFrame:
    """Every (user_id, friend_id, work_id) both sides of an edge like.

    An edge and its mirror are worked out once. From each pair the side with fewer likes
    is expanded and the other side is probed on (user, work), so a pair costs the
    smaller of the two like counts: neither a user with a third of all likes nor one
    with a third of all edges multiplies the two.
    """
    likes = _likes(reactions)
    sided = _sided(friendships, likes.groupBy("user_id").agg(F.count("*").alias("n")))
    shared = (
        sided.join(likes.withColumnRenamed("user_id", "small"), "small")
        .join(likes.withColumnRenamed("user_id", "large"), ["large", "work_id"], "left_semi")
        .join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    )
    return _both_ways(shared, "work_id")


def like_words(reactions: DataFrame, works: DataFrame) -> DataFrame:
    """(user_id, word, bits): each user's likes as bits, 64 works of the catalog's order to a word; empty words are left out.

    A bitwise or per user and word, combined in each task before the shuffle. Likes of unknown works drop out.
    """
    place = rank_newest(works).select("work_id", (F.col("at") - 1).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return _likes(reactions).join(place, "work_id").groupBy("user_id", F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


ROW_WORDS = 64  # words of a user in one row, about


def _level(n: Column) -> Column:
    """The rows of a user of n words are 2 ** level."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n / ROW_WORDS))).cast("int")


def _part(word: Column, level: Column) -> Column:
    """Which of 2 ** level rows a word lies in: the last bits of a hash, so a row of one level is rows of the next."""
    return F.xxhash64(word).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1)


def word_rows(words: DataFrame) -> DataFrame:
    """(user_id, n, part, bits): the ``like_words`` of a user, n in all, as maps of word to bits of about ``ROW_WORDS`` words."""
    counts = words.groupBy("user_id").agg(F.count("*").alias("n"))
    return words.join(counts, "user_id").groupBy("user_id", "n", _part(F.col("word"), _level(F.col("n"))).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def common_likes_counts_all_pairs(friendships: DataFrame, reactions: DataFrame, works: DataFrame) -> DataFrame:
    """(user_id, friend_id, common) of every edge with common likes, without a row per common work.

    A user's words lie in rows of about ``ROW_WORDS``, mostly in one, so a pair is one row on its way from the side with fewer
    words to the other. Where the other side lies in more rows, each row of the smaller is cut by the same hash of
    the word and meets the rows that can hold its words: a pair costs the smaller number of words at most, and no
    row grows with a user's history. A word of both counts the bits they share.
    """
    words = materialize(like_words(reactions, works), "like-words")
    rows = materialize(word_rows(words), "word-rows")
    sided = _sided(friendships, rows.select("user_id", "n").distinct()).select("small", "large", "ab", "ba", _level(F.col("n_large")).alias("level"))
    part_at = F.transform(F.map_keys("x"), lambda w: _part(w, F.col("level")))
    cut = F.transform(F.array_distinct(part_at), lambda p: F.struct(
        p.alias("part"), F.map_filter("x", lambda w, _: _part(w, F.col("level")) == p).alias("x")))
    own = F.array(F.struct(F.col("part"), F.col("x")))
    smaller = sided.join(rows.select(F.col("user_id").alias("small"), "part", F.col("bits").alias("x"), _level(F.col("n")).alias("own")), "small")
    both = smaller.select("small", "large", "ab", "ba", F.inline(F.when(F.col("level") == F.col("own"), own).otherwise(cut))).join(
        rows.select(F.col("user_id").alias("large"), "part", F.col("bits").alias("y")), ["large", "part"])
    shared = F.aggregate(F.map_entries("x"), F.lit(0).cast("long"), lambda n, e: n + F.bit_count(
        F.coalesce(F.element_at("y", e["key"]), F.lit(0).cast("long")).bitwiseAND(e["value"])))
    counted = both.select("small", "large", "ab", "ba", shared.alias("common")).where("common > 0").groupBy("small", "large", "ab", "ba").agg(
        F.sum("common").alias("common"))
    return _both_ways(counted.withColumns({"a": F.least("small", "large"), "b": F.greatest("small", "large")}), "common")


def common_likes_counts(common: DataFrame) -> DataFrame:
    return common.groupBy("user_id", "friend_id").agg(F.count("*").alias("common"))
