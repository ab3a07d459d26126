"""Keyed merges into the catalog of works."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outings import fixed_values as fv
from outings.operators.sizes import fits_broadcast
from outings.schemas import SHOW_TO_WORK, WORKS, conform
from outings.session import materialize

KEY = "source_url"
_ALWAYS = ("title", "section")
DATA = [c for c in WORKS.names if c not in ("id", KEY, "created_at", "updated_at")]


def shows_to_batch(shows: DataFrame) -> DataFrame:
    """Validated shows in the catalog's columns and types (extra columns are kept)."""
    extra = [c for c in shows.columns if c not in SHOW_TO_WORK and c != "crawled_at"]
    return shows.select(
        *[F.col(s).cast(WORKS[w].dataType).alias(w) for s, w in SHOW_TO_WORK.items()], *extra)


def fold_batch(batch: DataFrame, order: str) -> DataFrame:
    """One row per source url with the effect of merging the rows one by one in ``order``:
    title and section of the last row, for the rest the last value that is not null."""
    return _fold(batch, F.col(order))


def last_values(columns: list[str], order) -> list:
    """Aggregates: title and section of the last row in ``order``, of other columns the last value that is not null."""
    return [
        F.max_by(F.col(c), order).alias(c) if c in _ALWAYS else F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
        for c in columns
    ]


def _fold(batch: DataFrame, order) -> DataFrame:
    return batch.groupBy(KEY).agg(*last_values([c for c in DATA if c in batch.columns], order))


def folded(batch: DataFrame) -> DataFrame:
    """``fold_batch`` in the order of the batch's column ``_order`` or, without one, of the rows' values."""
    return _fold(batch, F.col("_order") if "_order" in batch.columns else F.struct(*[c for c in DATA if c in batch.columns]))


def upsert_works(works: DataFrame, batch: DataFrame, now: datetime,
                 update_cols: list[str] | None = None) -> DataFrame:
    """Merge a batch into the catalog.

    A batch that repeats a url is folded first (see ``folded``), so the catalog's key stays unique whatever comes in.
    The folded batch is stored once, then measured and joined from there.
    New urls are inserted whole. Known urls take title and section always, other columns
    only where the batch has a value; id and created_at stay, updated_at moves.

    A batch whose measured size is under the session's broadcast threshold is sent to the catalog, which
    is then never shuffled; a larger one meets it in one full outer join on the (unique) key.
    """
    return merge_folded(works, materialize(folded(batch), "batch"), now, update_cols)


def merge_folded(works: DataFrame, batch: DataFrame, now: datetime, update_cols: list[str] | None = None) -> DataFrame:
    """``upsert_works`` of a stored batch with one row per url."""
    update_cols = DATA if update_cols is None else update_cols
    stamp = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    old = conform(works, WORKS, {"section": fv.DEFAULT_SECTION})
    new = batch.withColumn("_hit", F.lit(True))
    hit, known = F.col("n._hit").isNotNull(), F.col("o.id").isNotNull()

    def value(c: str):
        incoming = F.col(f"n.{c}") if c in batch.columns else F.lit(None).cast(WORKS[c].dataType)
        if c not in update_cols:
            return F.when(known, F.col(f"o.{c}")).otherwise(incoming)
        if c in _ALWAYS:
            return F.when(hit, incoming).otherwise(F.col(f"o.{c}"))
        return F.coalesce(incoming, F.col(f"o.{c}"))

    key = F.coalesce(F.col(f"o.{KEY}"), F.col(f"n.{KEY}"))
    columns = {
        "id": F.coalesce(F.col("o.id"), F.sha2(key, 256)), KEY: key,
        "created_at": F.when(known, F.col("o.created_at")).otherwise(stamp),
        "updated_at": F.when(hit, stamp).otherwise(F.col("o.updated_at")),
        **{c: value(c) for c in DATA},
    }
    on = F.col(f"o.{KEY}") == F.col(f"n.{KEY}")
    if fits_broadcast(batch):
        seen = old.select(KEY).join(F.broadcast(new.select(KEY)), KEY, "left_semi")
        fresh = new.join(seen, KEY, "left_anti")
        joined = old.alias("o").join(F.broadcast(new).alias("n"), on, "left").select("o.*", F.struct("n.*").alias("n"))
        added = fresh.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in WORKS.fields],
                             F.struct(*new.columns).alias("n"))
        joined = joined.unionByName(added).select(F.struct(*WORKS.names).alias("o"), "n")
    else:
        joined = old.alias("o").join(new.alias("n"), on, "full_outer")
    return joined.select(*[columns[c].cast(WORKS[c].dataType).alias(c) for c in WORKS.names])


def default_seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.SEED_WORKS), "title string, section string, category string, source_url string")


def seed_works(works: DataFrame, seeds: DataFrame, now: datetime) -> DataFrame:
    """Insert the seed rows; known ones get title, section and category only."""
    return upsert_works(works, seeds, now, update_cols=["title", "section", "category"])
