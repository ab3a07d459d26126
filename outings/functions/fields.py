"""Prices, durations, addresses, rubrics and venues out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outings import fixed_values as fv
from outings.functions.text import clean, contains_any, group, groups, let
from outings.functions.urls import path_of


def parse_prices(text: Column) -> Column:
    """``struct(low, high)``: a range first, else the extremes of all amounts."""

    def amount(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit(".")).cast("double")

    def pair(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    ranged = let(
        group(text, fv.PRICE_RANGE, 0),
        lambda m: F.when(m.isNotNull(), pair(amount(F.regexp_extract(m, fv.PRICE_RANGE, 1)),
                                             amount(F.regexp_extract(m, fv.PRICE_RANGE, 2)))),
    )
    single = let(
        F.transform(groups(text, fv.PRICE, 1), amount),
        lambda all_: pair(F.array_min(all_), F.array_max(all_)),
    )
    return F.coalesce(ranged, single)


def parse_duration(text: Column) -> Column:
    """Minutes of the first duration token."""

    def minutes(m: Column) -> Column:
        hours, rest, plain = (group(m, fv.DURATION, i).try_cast("int") for i in (1, 2, 3))
        return F.coalesce(plain, hours * 60 + F.coalesce(rest, F.lit(0)))

    return let(F.regexp_extract(F.lower(text), fv.DURATION, 0), minutes)


def looks_like_duration(text: Column, hour_is_enough: bool = False) -> Column:
    def telling(low: Column) -> Column:
        hour = low.rlike(fv.DURATION_HOUR_TOKEN)
        if not hour_is_enough:
            hour = hour & low.rlike(fv.DURATION_CONTEXT)
        return low.rlike(fv.DURATION_MINUTES_TOKEN) | hour

    return let(F.lower(text), telling)


def parse_iso8601_duration(text: Column) -> Column:
    def minutes(m: Column) -> Column:
        hours, rest = (F.coalesce(group(m, fv.ISO8601_DURATION, i).try_cast("int"), F.lit(0)) for i in (1, 2))
        return F.nullif(hours * 60 + rest, F.lit(0))

    return let(F.trim(text), lambda t: F.when(t.rlike(fv.ISO8601_DURATION), minutes(t)))


def parse_address(text: Column) -> Column:
    return clean(F.regexp_extract(text, fv.ADDRESS, 0))


def rubric_category(description: Column) -> Column:
    """Category named by the "rubrique" sentence of a theatre description."""

    def category(rubric: Column) -> Column:
        low = F.lower(rubric)
        return (
            F.when(rubric.isNull(), fv.DEFAULT_CATEGORIES["theatre"])
            .when(low.contains("humour"), "humour")
            .when(low.contains("musical"), "spectacle musical")
            .when(contains_any(low, ("théâtre", "theatre")), "théâtre")
            .otherwise(rubric)
        )

    return F.when(F.length(description) > 0,
                  let(clean(F.regexp_extract(description, fv.RUBRIC, 1)), category))


def looks_like_venue(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.coalesce(
        ~contains_any(low, fv.NOT_A_VENUE_WORDS)
        & ~text.rlike(r"(?U)\d") & ~text.rlike("[€%]")
        & text.rlike(r"(?U)\S\s+\S") & text.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]")
        & ~low.isin(*fv.NOT_A_VENUE) & ~low.startswith(fv.NOT_A_VENUE_START),
        F.lit(False),
    )


def venue_from_url(url: Column) -> Column:
    """Second path segment of a theatre URL as a name."""

    def name(parts: Column) -> Column:
        slug = F.regexp_replace(F.get(parts, F.lit(1)), r"-\d+$", "")
        words = F.array_join(F.filter(F.split(slug, "-"), lambda w: w != ""), " ")
        return F.when(F.get(parts, F.lit(0)) == "theatre", clean(F.initcap(words)))

    return let(F.split(F.regexp_replace(path_of(url), "^/+|/+$", ""), "/"), name)
