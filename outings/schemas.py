"""Table schemas and the site description. Nothing is inferred at run time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings import fixed_values as fv

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


PAGES = _struct(("page_id", T.LongType()), ("url", _S), ("html", _S))

SHOWS = _struct(
    ("url", _S), ("title", _S), ("section", _S), ("category", _S), ("venue", _S),
    ("address", _S), ("date_start", _S), ("date_end", _S), ("duration_min", _I),
    ("price_min_eur", _D), ("price_max_eur", _D), ("image", _S), ("description", _S),
    ("crawled_at", _S),
)

WORKS = _struct(
    ("id", _S), ("title", _S), ("section", _S), ("category", _S), ("venue", _S),
    ("address", _S), ("description", _S), ("start_date", T.DateType()),
    ("end_date", T.DateType()), ("duration_min", _I), ("price_min", _D), ("price_max", _D),
    ("image_url", _S), ("source_url", _S),
    ("created_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
)

CARD_COLUMNS = [
    "id", "title", "section", "image_url", "category", "venue", "address", "description",
    "start_date", "end_date", "duration_min", "price_min", "price_max", "source_url",
]

REACTION_EVENTS = _struct(
    ("user_id", _S), ("work_id", _S), ("status", _S),
    ("ts", T.TimestampNTZType()), ("seq", T.LongType()),
)

IMPORT_JOBS = _struct(("source", _S), ("imported", T.LongType()), ("created_at", T.TimestampNTZType()))

# show column -> works column
SHOW_TO_WORK = {
    "title": "title", "section": "section", "category": "category", "venue": "venue",
    "address": "address", "description": "description", "date_start": "start_date",
    "date_end": "end_date", "duration_min": "duration_min", "price_min_eur": "price_min",
    "price_max_eur": "price_max", "image": "image_url", "url": "source_url",
}


@dataclass(frozen=True)
class Site:
    """Where pages come from and which paths are shows, venues and listings."""

    base_url: str = "https://listings.example"
    detail_paths: dict[str, str] = field(default_factory=lambda: dict(fv.DETAIL_PATHS))
    venue_paths: dict[str, str] = field(default_factory=lambda: dict(fv.VENUE_PATHS))
    listing_paths: dict[str, str] = field(default_factory=lambda: dict(fv.LISTING_PATHS))


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select exactly ``schema`` (and ``keep``); columns an older table lacks become a default or null."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.select(*[
        (F.coalesce(F.col(f.name), F.lit(defaults.get(f.name))) if f.name in have
         else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ], *keep)
