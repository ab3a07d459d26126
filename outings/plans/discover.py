"""What is on and not yet reacted to: for one user, and for all users in one job."""

from __future__ import annotations

from datetime import UTC, date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outings import fixed_values as fv
from outings.schemas import CARD_COLUMNS
from outings.session import materialize

# Newest works whose ranks are looked up by broadcast: two columns wide, under a megabyte.
DECK_HEAD = 5000
# Ranks in a row of a user's history.
BLOCK = 1024


def calendar_day(as_of: datetime) -> date:
    """Calendar day of an instant where the events take place; no zone means UTC."""
    instant = as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC)
    return instant.astimezone(ZoneInfo(fv.CALENDAR_ZONE)).date()


def filter_current(works: DataFrame, as_of: datetime) -> DataFrame:
    """Works without an end or ending today or later. The day is a literal, so it reaches the scan."""
    return works.where(F.col("end_date").isNull() | (F.col("end_date") >= F.lit(calendar_day(as_of))))


def filter_since(works: DataFrame, since: datetime | None) -> DataFrame:
    if since is None:
        return works
    utc = since.astimezone(UTC).replace(tzinfo=None) if since.tzinfo else since
    return works.where(F.col("created_at") >= F.lit(utc.isoformat(sep=" ")).cast("timestamp_ntz"))


def filter_category(works: DataFrame, category: str | None) -> DataFrame:
    if category is None:
        return works
    if not category.strip():
        raise ValueError("category is blank")
    return works.where(F.col("category") == category.strip())


def filter_section(works: DataFrame, section: str | None) -> DataFrame:
    if section is None:
        return works
    if section not in fv.SECTIONS:
        raise ValueError(f"unknown section: {section}")
    return works.where(F.col("section") == section)


def card_projection(works: DataFrame) -> DataFrame:
    return works.select(*CARD_COLUMNS)


def _check_per(per: int) -> int:
    if not 1 <= per <= fv.PER_MAX:
        raise ValueError(f"per must be within 1..{fv.PER_MAX}")
    return per


def _offered(works, as_of, since=None, category=None, section=None) -> DataFrame:
    return filter_section(filter_category(filter_since(filter_current(works, as_of), since), category), section)


def _unseen(works, reactions, user, **filters) -> DataFrame:
    offered = _offered(works, **filters)
    if user is None:
        return offered
    mine = reactions.where(F.col("user_id") == user).select(F.col("work_id").alias("id"))
    return offered.join(mine, "id", "left_anti")


def _newest_first():
    return [F.col("created_at").desc(), F.col("id").asc()]


def discover(works: DataFrame, reactions: DataFrame, user, as_of: datetime, per: int = fv.PER_DEFAULT,
             since: datetime | None = None, category: str | None = None, section: str | None = None) -> DataFrame:
    """The newest ``per`` current works the user has no reaction of any kind to."""
    rows = _unseen(works, reactions, user, as_of=as_of, since=since, category=category, section=section)
    return card_projection(rows.orderBy(*_newest_first()).limit(_check_per(per)))


def discover_total(works: DataFrame, reactions: DataFrame, user, as_of: datetime,
                   since: datetime | None = None, category: str | None = None,
                   section: str | None = None) -> DataFrame:
    """How many works ``discover`` would offer without its limit."""
    rows = _unseen(works, reactions, user, as_of=as_of, since=since, category=category, section=section)
    return rows.agg(F.count("*").alias("total"))


def discover_all_users(works: DataFrame, reactions: DataFrame, users: DataFrame, as_of: datetime,
                       per: int = fv.PER_DEFAULT, since: datetime | None = None, category: str | None = None,
                       section: str | None = None, head: int = DECK_HEAD, block: int = BLOCK) -> DataFrame:
    """``discover`` for every user: (user_id, rank, work_id).

    Never users x works, and one way at every size. The offer is ranked once, in range partitions
    with offsets; the ranks a user reacted to are held in blocks, and the first ``per`` free ranks are read from
    the first blocks (see ``free_ranks``). Ranks become works again: the newest ``head``, which nearly all decks
    hold, by broadcast (``head`` rows of two columns, whatever the catalog's size), the others by a shuffled
    join on the rank.
    """
    per = _check_per(per)
    ranked = rank_newest(_offered(works, as_of, since, category, section))
    size = ranked.agg(F.count("*").alias("n")).scalar()
    taken = reactions.select("user_id", "work_id").join(ranked, "work_id").select("user_id", "at")
    decks = free_ranks(taken, users.select("user_id"), size, per, max(block, per))
    newest = decks.where(F.col("at") <= head).join(F.broadcast(ranked.where(F.col("at") <= head)), "at")
    others = decks.where(F.col("at") > head).join(ranked.where(F.col("at") > head), "at")
    return newest.unionByName(others).select("user_id", "rank", "work_id")


def taken_blocks(taken: DataFrame, block: int) -> DataFrame:
    """taken(user_id, at) -> (user_id, block, taken, before): the taken ranks of each block, at most ``block`` of them, and
    how many ranks are free before it; only blocks up to the first that a user has nothing in."""
    number = F.floor((F.col("at") - 1) / block)
    held = taken.groupBy("user_id", number.alias("block")).agg(F.collect_set("at").alias("taken"))
    order = Window.partitionBy("user_id").orderBy("block")
    earlier = F.sum(F.size("taken")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumns({"nth": F.row_number().over(order) - 1, "before": F.col("block") * block - F.coalesce(earlier, F.lit(0))}).where(
        "nth = block").drop("nth")


def free_ranks(taken: DataFrame, users: DataFrame, size, per: int, block: int) -> DataFrame:
    """(user_id, rank, at): the first ``per`` ranks of 1..``size`` that a user has not taken.

    A user's ranks lie in rows of at most ``block`` ranks, and a row's place among the free ranks follows from the
    counts of the rows before it, so a history of any length costs rows, never one row that grows with it. The ranks
    come from the blocks before the first that is wholly free, and from that one, which has ``per`` of them.
    """
    held = taken_blocks(taken, block)
    ends = held.groupBy("user_id").agg(F.count("*").alias("k"), F.sum(F.size("taken")).alias("n"))
    none = F.array().cast("array<bigint>")
    k, n = (F.coalesce(c, F.lit(0)) for c in ("k", "n"))
    open_ = users.join(ends, "user_id", "left").select("user_id", k.alias("block"), none.alias("taken"), (k * block - n).alias("before"))
    rows = held.join(users, "user_id", "left_semi").unionByName(open_).where((F.col("before") < per) & (F.col("block") * block < size))
    first, wanted = F.col("block") * block + 1, per - F.col("before")
    last = F.least(size, first + block - 1, first + F.size("taken") + wanted - 1)
    free = F.slice(F.array_except(F.sequence(first, last), "taken"), F.lit(1), wanted.cast("int"))
    return rows.select("user_id", "before", F.posexplode(free).alias("pos", "at")).select(
        "user_id", (F.col("before") + F.col("pos") + 1).cast("int").alias("rank"), "at")


def rank_newest(offered: DataFrame) -> DataFrame:
    """(work_id, at): the place of every work in the order of decks, from 1; stored.

    Ranges are sorted each by itself; a range's first place is the number of rows before it.
    """
    spark = offered.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit((1 << 33) - 1)
    ordered = offered.select(F.col("id").alias("id"), "created_at").repartitionByRange(parts, *_newest_first()).sortWithinPartitions(*_newest_first())
    placed = materialize(ordered.withColumn("m", F.monotonically_increasing_id()).select(
        F.col("id").alias("work_id"), F.shiftright("m", 33).alias("range"), F.col("m").bitwiseAND(low).alias("row")), "ranked")
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # a row per shuffle partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "range").select("work_id", (F.col("before") + F.col("row") + 1).alias("at"))


def with_cards(decks: DataFrame, works: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Attach card columns to (user, rank, work_id) rows."""
    cards = works.select(F.col("id").alias("work_id"), *[c for c in (columns or CARD_COLUMNS) if c != "id"])
    return decks.join(cards, "work_id")


def discover_totals_all_users(works: DataFrame, reactions: DataFrame, users: DataFrame, as_of: datetime,
                              since: datetime | None = None, category: str | None = None,
                              section: str | None = None) -> DataFrame:
    """``discover_total`` for every user: the size of the offer less the user's reactions inside it."""
    offered = _offered(works, as_of, since, category, section).select(F.col("id").alias("work_id"))
    size = offered.agg(F.count("*").alias("n")).scalar()
    seen = (
        reactions.select("user_id", "work_id").join(offered, "work_id", "left_semi")
        .groupBy("user_id").agg(F.count("*").alias("seen"))
    )
    return users.select("user_id").join(seen, "user_id", "left").select(
        "user_id", (size - F.coalesce("seen", F.lit(0))).alias("total"))
