"""Cleaning, quality gates and reject tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings import fixed_values as fv
from outings.functions import urls
from outings.functions.dates import real_day
from outings.functions.stages import compute_once
from outings.functions.text import blank_to_null, clean, utf16_length
from outings.schemas import SHOWS, Site


def infer_section_by_path(df: DataFrame) -> DataFrame:
    """Collector rule; fills a missing section only."""
    return df.withColumn("section", F.coalesce(blank_to_null(F.col("section")), urls.section_by_path(F.col("url"))))


def infer_section_by_contains(df: DataFrame) -> DataFrame:
    """Import rule with its default; fills a missing section only."""
    return df.withColumn("section", F.coalesce(
        F.col("section"), urls.section_by_contains(F.col("url")), F.lit(fv.DEFAULT_SECTION)))


def _swap_reversed(df: DataFrame, low: str, high: str) -> DataFrame:
    """Put a reversed pair in order; a pair with a null stays as it is."""
    reversed_ = F.col(high) < F.col(low)
    return df.select(*[
        F.when(reversed_, F.col(high)).otherwise(F.col(low)).alias(low) if c == low
        else F.when(reversed_, F.col(low)).otherwise(F.col(high)).alias(high) if c == high
        else F.col(c)
        for c in df.columns
    ])


def check_shows(shows: DataFrame) -> DataFrame:
    """Repair what can be repaired and add ``reason`` (null = the show is accepted)."""
    texts = ["title", "section", "category", "venue", "address", "image", "description"]
    df = compute_once(shows, {
        **{c: clean(F.col(c)) for c in texts},
        "date_start": real_day(F.col("date_start")),
        "date_end": real_day(F.col("date_end")),
        "_section": urls.section_by_path(F.col("url")),
    })
    df = df.withColumn("section", F.coalesce("section", "_section")).drop("_section").withColumns({
        "category": F.coalesce("category", F.when(F.col("section") == "theatre", fv.DEFAULT_CATEGORIES["theatre"])),
        "image": F.when(F.col("image").rlike("^https?://"), F.col("image")),
        "duration_min": F.when(F.col("duration_min").between(1, fv.DURATION_MAX), F.col("duration_min")),
        "price_min_eur": F.when(F.col("price_min_eur") >= 0, F.col("price_min_eur")),
        "price_max_eur": F.when(F.col("price_max_eur") >= 0, F.col("price_max_eur")),
    })
    df = _swap_reversed(_swap_reversed(df, "date_start", "date_end"), "price_min_eur", "price_max_eur")
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("venue", "date_start", "description")), F.lit(1))
    return df.withColumn(
        "reason",
        F.when(F.col("title").isNull(), "missing_title")
        .when(~F.coalesce(F.col("section").isin(*fv.SECTIONS), F.lit(False)), "invalid_section")
        .when(filled <= 1, "insufficient"),
    )


def validate_shows(shows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted shows, rejected shows with a reason)."""
    checked = check_shows(shows)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


# --- import gate ------------------------------------------------------------------


_SEPARATOR = "\u0001"
_ISSUES_AT_ONCE = 8
_FIELDS_AT_ONCE = 8
_VALUES_AT_ONCE = 4


def _in_parts(df: DataFrame, columns: dict[str, Column], at_once: int) -> DataFrame:
    """``compute_once`` a few columns at a time: Java never compiles a method of over 8,000 bytes and runs it many times slower."""
    todo = list(columns.items())
    for i in range(0, len(todo), at_once):
        df = compute_once(df, dict(todo[i:i + at_once]))
    return df


def _issue(field: str, bad: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), f"{field}: {message}")


def _longer(text: Column, most: int) -> Column:
    """More than ``most`` UTF-16 units; no text has more of them than bytes in UTF-8, so few are encoded for it."""
    return (F.octet_length(text) > most) & (utf16_length(text) > most)


def validate_import(lines: DataFrame, site: Site = Site(), line: str = "line") -> DataFrame:
    """JSON lines -> typed record columns plus ``issues``, the array of everything wrong.

    The line is read as a variant, so a number sent as text (or the reverse) is told
    apart from a right one. Unknown keys are dropped.
    """
    names = ["url", "title", "section", "category", "venue", "address", "arrondissement", "date_start",
             "date_end", "duration_min", "price_min_eur", "price_max_eur", "image", "description", "crawled_at"]
    numeric = ("duration_min", "price_min_eur", "price_max_eur")

    # one pass over the text gives every field as a small variant of its own
    fields = ", ".join(f"{n} variant" for n in names)
    text = F.trim(F.col(line))
    # an object that is never closed is no JSON: the parsers would only throw, which costs more than all the rest
    readable = ~(text.startswith("{") & ~text.contains("}"))
    df = compute_once(lines, {
        "_readable": readable,
        "_object": text.startswith("{"),
        "_closed": text.endswith("}"),
    })
    df = compute_once(df, {"_r": F.from_json(F.when(F.col("_readable"), F.col(line)), f"{fields}, _bad string",
                                             {"columnNameOfCorruptRecord": "_bad"})})
    df = _in_parts(df, {
        "_object": F.col("_object") & F.col("_closed") & F.col("_r").isNotNull() & F.col("_r._bad").isNull(),
        "_json": ~F.col("_object") & F.col("_readable") & F.try_parse_json(F.col(line)).isNotNull(),
        **{f"_t_{n}": F.schema_of_variant(F.col(f"_r.{n}")) for n in names},
    }, _FIELDS_AT_ONCE)
    # reading a number as text builds a cast for every row; written as JSON it is the same digits
    df = _in_parts(df, {
        f"_s_{n}": F.when(F.col(f"_t_{n}") == "STRING", F.try_variant_get(F.col(f"_r.{n}"), "$", "string"))
        .when(F.lit(n in numeric), F.to_json(F.col(f"_r.{n}"))) for n in names
    }, _FIELDS_AT_ONCE).drop("_r", "_readable", "_closed")
    is_object = F.col("_object")
    issues: list[Column] = [
        _issue("root", ~is_object & ~F.col("_json"), "invalid JSON"),
        _issue("root", ~is_object & F.col("_json"), "expected object"),
    ]

    def kind(n: str) -> Column:
        return F.coalesce(F.col(f"_t_{n}"), F.lit("VOID"))

    def is_text(n: str) -> Column:
        return kind(n) == "STRING"

    def is_null(n: str) -> Column:
        return kind(n) == "VOID"

    values: dict[str, Column] = {}
    for n in names:
        if n == "url":
            values[n] = F.when(is_text(n), F.col("_s_url"))
        elif n in numeric:
            is_number = reduce(Column.__or__, [kind(n).startswith(t) for t in ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")])
            values[n] = F.when(is_number, F.col(f"_s_{n}").try_cast("double"))
        else:
            values[n] = F.when(is_text(n), clean(F.col(f"_s_{n}")))
    df = _in_parts(df, values, _VALUES_AT_ONCE)

    def col(n: str) -> Column:
        return F.col(n)

    def wrong_type(n: str) -> Column:
        if n in numeric:
            empty = is_text(n) & (F.col(f"_s_{n}") == "")
            return is_object & ~is_null(n) & ~empty & col(n).isNull()
        return is_object & ~is_null(n) & ~is_text(n)

    prefix = site.base_url.rstrip("/") + "/"
    issues += [
        _issue("url", is_object & ~is_text("url"), "expected string"),
        _issue("url", ~col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S"), "invalid URL"),
        _issue("url", _longer(col("url"), fv.URL_MAX), f"longer than {fv.URL_MAX}"),
        _issue("url", ~col("url").startswith(prefix), "unexpected site"),
        _issue("title", is_object & col("title").isNull(), "expected string"),
        _issue("title", _longer(col("title"), fv.TITLE_MAX), f"longer than {fv.TITLE_MAX}"),
        _issue("section", wrong_type("section") | ~col("section").isin(*fv.SECTIONS), "unknown section"),
    ]
    for n, most in fv.IMPORT_TEXT_MAX.items():
        issues += [_issue(n, wrong_type(n), "expected string"),
                   _issue(n, _longer(col(n), most), f"longer than {most}")]
    for n in ("date_start", "date_end"):
        shaped = col(n).rlike(r"^\d{4}-\d{2}-\d{2}$")
        issues += [_issue(n, wrong_type(n), "expected string"),
                   _issue(n, ~shaped, "expected YYYY-MM-DD"),
                   _issue(n, shaped & real_day(col(n)).isNull(), "no such day")]
    whole = col("duration_min") == F.floor("duration_min")
    issues += [
        _issue("duration_min", wrong_type("duration_min"), "expected number"),
        _issue("duration_min", ~whole, "expected whole number"),
        _issue("duration_min", (col("duration_min") <= 0) | (col("duration_min") > fv.DURATION_MAX),
               f"outside 1..{fv.DURATION_MAX}"),
    ]
    for n in ("price_min_eur", "price_max_eur"):
        issues += [_issue(n, wrong_type(n), "expected number"),
                   _issue(n, (col(n) < 0) | (col(n) > fv.IMPORT_PRICE_MAX), f"outside 0..{fv.IMPORT_PRICE_MAX}")]
    issues += [
        _issue("image", wrong_type("image"), "expected string"),
        _issue("image", ~col("image").rlike(r"^https?://[^/?#\s]+"), "expected HTTP URL"),
        _issue("image", _longer(col("image"), fv.URL_MAX), f"longer than {fv.URL_MAX}"),
        _issue("crawled_at", wrong_type("crawled_at"), "expected string"),
        _issue("crawled_at", col("crawled_at").isNotNull() & col("crawled_at").try_cast("timestamp").isNull(),
               "invalid datetime"),
    ]
    kept = [c for c in lines.columns if c not in names]
    # a few at a time, so that every generated method stays small enough to be compiled
    parts = [issues[i:i + _ISSUES_AT_ONCE] for i in range(0, len(issues), _ISSUES_AT_ONCE)]
    for i, part in enumerate(parts):
        df = compute_once(df, {f"_i{i}": blank_to_null(F.concat_ws(_SEPARATOR, *part))})
    df = compute_once(df, {"_all": F.concat_ws(_SEPARATOR, *[F.col(f"_i{i}") for i in range(len(parts))])})
    df = df.withColumn("issues", F.when(F.col("_all") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("_all", _SEPARATOR)))
    return df.select(
        *kept, *[F.when(F.col(n) == F.floor(n), F.col(n)).try_cast("int").alias(n) if n == "duration_min"
                 else F.col(n) for n in names], "issues")


def normalize_import(records: DataFrame) -> DataFrame:
    """Section default, reversed dates and prices swapped, legacy column dropped."""
    df = infer_section_by_contains(records)
    df = _swap_reversed(_swap_reversed(df, "date_start", "date_end"), "price_min_eur", "price_max_eur")
    extra = [c for c in records.columns if c not in SHOWS.names and c not in ("arrondissement", "issues")]
    return df.select(*extra, *SHOWS.names)


def duplicate_url_check(records: DataFrame, order: str = "line_no", scope: list[str] | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """(first record of every url, later ones with ``first_line``) within ``scope`` (say, a file).

    The first line per url is a map-side combined minimum. Rows then meet it in an
    equi-join, whose hot partitions adaptive execution splits; no url is gathered in one task.
    """
    keys = [*(scope or []), "url"]
    firsts = records.groupBy(*keys).agg(F.min(order).alias("first_line"))
    joined = records.join(firsts, keys)
    return (joined.where(F.col(order) == F.col("first_line")).drop("first_line"),
            joined.where(F.col(order) > F.col("first_line")))


def non_empty_check(df: DataFrame, what: str = "records") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def reaction_domain_check(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with known status and both ids, the others)."""
    ok = F.coalesce(
        F.col("status").isin(*fv.STATUSES) & (F.length("user_id") > 0) & (F.length("work_id") > 0), F.lit(False))
    return events.where(ok), events.where(~ok)
