"""Show fields out of detail pages: column rules over the ``dom_pass`` table.

Every rule fills only what is still missing, unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings import fixed_values as fv
from outings.functions import dates, fields, urls
from outings.functions.text import blank_to_null, clean, contains_any, group, groups, let
from outings.operators.dom import dom_pass, first_node, json_ld, node_text, outer_texts
from outings.operators.sizes import fits_broadcast
from outings.schemas import SHOWS, Site, conform

_HEADINGS = ("h2", "h3", "h4")


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _both_dates() -> Column:
    return ~_missing("date_start") & ~_missing("date_end")


def _fill(df: DataFrame, name: str, value: Column, rows: Column | None = None) -> DataFrame:
    """Set ``name`` where it is missing, on ``rows`` only."""
    return df.withColumn(name, F.when(_on(rows) & _missing(name), value).otherwise(F.col(name)))


def _on(rows: Column | None) -> Column:
    return F.lit(True) if rows is None else rows


# --- fields of both sections ----------------------------------------------------


def extract_description(dom: DataFrame) -> DataFrame:
    """Text under the first telling heading, else the meta description."""

    def under(heading: Column) -> Column:
        # siblings after this heading and before the next heading on the same level
        later = F.filter(
            F.transform(F.col("nodes"), lambda n, i: F.struct(i.alias("pos"), n.alias("n"))),
            lambda x: (x["pos"] > heading["pos"]) & (x["n"]["parent"] == heading["n"]["parent"]),
        )
        stop = F.array_min(F.transform(F.filter(later, lambda x: x["n"]["tag"].isin(*_HEADINGS)), lambda x: x["pos"]))
        parts = F.transform(
            F.filter(later, lambda x: x["n"]["tag"].isin("p", "div", "section")
                     & (stop.isNull() | (x["pos"] < stop))),
            lambda x: node_text(x["n"]),
        )
        return F.array_join(F.filter(parts, lambda t: F.length(t) > fv.DESCRIPTION_MIN_CHARS), " ")

    headings = F.filter(
        F.transform(F.col("nodes"), lambda n, i: F.struct(i.alias("pos"), n.alias("n"))),
        lambda x: x["n"]["tag"].isin(*_HEADINGS)
        & contains_any(F.lower(node_text(x["n"])), fv.DESCRIPTION_HEADINGS),
    )
    sections = F.filter(F.transform(headings, under), lambda t: t != "")
    meta = first_node(lambda n: (n["tag"] == "meta") & (n["name"] == "description"))
    return _fill(dom, "description", F.coalesce(
        _first(sections), F.when(F.length(meta["content"]) > 0, F.trim(meta["content"]))))


def extract_core(dom: DataFrame) -> DataFrame:
    """Title from the first h1, image from ``og:image`` made absolute on the page."""
    heading = first_node(lambda n: n["tag"] == "h1")
    image = first_node(lambda n: (n["tag"] == "meta") & (n["property"] == "og:image"))["content"]
    df = _fill(dom, "title", F.when(heading.isNotNull(), node_text(heading)))
    return _fill(df, "image", urls.resolve(F.col("url"), blank_to_null(image)))


# --- theatre ----------------------------------------------------------------------


def venue_from_url(shows: DataFrame, rows: Column | None = None) -> DataFrame:
    return _fill(shows, "venue", fields.venue_from_url(F.col("url")), rows)


def venue_from_breadcrumb(dom: DataFrame, site: Site = Site(), rows: Column | None = None) -> DataFrame:
    """Last breadcrumb that points to a venue and reads like one; replaces the URL's venue."""

    def venue(n: Column) -> Column:
        path = urls.path_of(urls.resolve(F.lit(site.base_url), n["href"]))
        name = let(node_text(n), lambda t: F.when(fields.looks_like_venue(t), t))
        return F.when(path.rlike(site.venue_paths["theatre"]), name)

    crumbs = F.filter(F.col("nodes"), lambda n: n["crumb"] & (n["tag"] == "a") & n["href"].isNotNull())
    names = F.filter(F.transform(crumbs, venue), lambda v: v.isNotNull())
    last = F.when(_on(rows), F.try_element_at(names, F.lit(-1)))
    return dom.withColumn("venue", F.coalesce(last, F.col("venue")))


def extract_address(dom: DataFrame, rows: Column | None = None) -> DataFrame:
    """First address among the likely elements, else the first in the whole page text."""
    candidates = F.concat(*[outer_texts(s) for s in fv.ADDRESS_SELECTORS])
    hits = F.filter(F.transform(candidates, fields.parse_address), lambda a: a.isNotNull())
    return _fill(dom, "address", F.coalesce(_first(hits), fields.parse_address(F.col("text"))), rows)


def _first_texts(texts: Column, most: int | None) -> Column:
    return F.array_join(texts if most is None else F.slice(texts, 1, most), " • ")


def theatre_dates(dom: DataFrame, rows: Column | None = None, most: int | None = None) -> DataFrame:
    """Dates of the candidate texts; what they give replaces what was there.

    ``most`` bounds the texts that are read (``DATE_TEXT_CANDIDATES`` is a usual bound); without it all are.
    """
    texts = F.filter(F.concat(*[outer_texts(s) for s in fv.DATE_SELECTORS]),
                     lambda t: F.length(t) > fv.DATE_TEXT_MIN_CHARS)
    span = dates.parse_date_range(_first_texts(texts, most))
    df = dom.withColumn("_span", F.when(_on(rows) & ~_both_dates(), span))
    return df.withColumns({
        "date_start": F.coalesce(F.col("_span.start"), F.col("date_start")),
        "date_end": F.coalesce(F.col("_span.end"), F.col("date_end")),
    }).drop("_span")


def jsonld_dates(dom: DataFrame, rows: Column | None = None) -> DataFrame:
    """Widen to the earliest and latest structured day while an end is missing."""
    found = F.flatten(F.transform(json_ld(), lambda b: groups(b, fv.JSONLD_RUN, 1)))
    df = dom.withColumn("_days", F.when(_on(rows) & ~_both_dates(), F.transform(found, dates.iso_prefix)))
    return df.withColumns({
        "date_start": F.least(F.col("date_start"), F.array_min("_days")),
        "date_end": F.greatest(F.col("date_end"), F.array_max("_days")),
    }).drop("_days")


def theatre_category(shows: DataFrame, rows: Column | None = None) -> DataFrame:
    return _fill(shows, "category", fields.rubric_category(F.col("description")), rows)


def extract_prices(dom: DataFrame, rows: Column | None = None) -> DataFrame:
    """First amounts found in an element that directly holds a ticket word."""

    def amounts(t: Column) -> Column:
        holder = F.get(F.col("nodes"), t["node"])
        return fields.parse_prices(F.when(holder.isNotNull(), node_text(holder)).otherwise(F.col("text")))

    telling = F.filter(F.col("texts"), lambda t: t["word"].rlike(fv.TICKET_WORDS))
    found = F.filter(F.transform(telling, amounts), lambda p: p["low"].isNotNull())
    df = dom.withColumn("_price", F.when(_on(rows) & F.col("price_min_eur").isNull(), _first(found)))
    return df.withColumns({
        "price_min_eur": F.coalesce(F.col("_price.low"), F.col("price_min_eur")),
        "price_max_eur": F.coalesce(F.col("_price.high"), F.col("price_max_eur")),
    }).drop("_price")


def _no_duration() -> Column:
    return F.coalesce(F.col("duration_min"), F.lit(0)) == 0


def extract_duration(dom: DataFrame, rows: Column | None = None, most: int | None = None) -> DataFrame:
    """First token of the texts that speak of a duration.

    ``most`` bounds the texts that are read (``DURATION_TEXT_CANDIDATES`` is a usual bound); without it all are.
    """

    def telling(selector: str, hour_is_enough: bool) -> Column:
        return F.filter(outer_texts(selector), lambda t: fields.looks_like_duration(t, hour_is_enough))

    texts = F.concat(*[telling(*rule) for rule in fv.DURATION_SELECTORS])
    joined = _first_texts(texts, most)
    return dom.withColumn("duration_min",
                          F.when(_on(rows) & _no_duration(), fields.parse_duration(joined)).otherwise(F.col("duration_min")))


# --- cinema -----------------------------------------------------------------------


def cinema_category(dom: DataFrame, rows: Column | None = None) -> DataFrame:
    """Structured genre (a text or a list), else the text after a genre label."""

    def genre(match: Column) -> Column:
        items = F.filter(
            F.transform(groups(F.lower(F.regexp_extract(match, fv.JSONLD_GENRE, 2)), '"([^"]+)"', 1), clean),
            lambda x: x.isNotNull(),
        )
        single = group(match, fv.JSONLD_GENRE, 1)
        return F.struct(
            single.isNotNull().alias("single"),
            F.when(single.isNotNull(), clean(F.lower(single)))
            .when(F.size(items) > 0, F.array_join(items, ", ")).alias("value"),
        )

    found = F.filter(
        F.transform(F.flatten(F.transform(json_ld(), lambda b: groups(b, fv.JSONLD_GENRE, 0))), genre),
        lambda g: g["single"] | g["value"].isNotNull(),
    )
    labelled = clean(F.lower(F.regexp_extract("text", fv.GENRE_LABEL, 1)))
    return _fill(dom, "category", F.when(F.size(found) > 0, _first(found)["value"]).otherwise(labelled), rows)


def cinema_release_date(dom: DataFrame, rows: Column | None = None) -> DataFrame:
    """First structured day that reads as one, else the day after a release label. Start only."""
    structured = F.flatten(F.transform(json_ld(), lambda b: groups(b, fv.JSONLD_RELEASE, 1)))
    days = F.filter(F.transform(structured, dates.parse_single_day), lambda d: d.isNotNull())
    labelled = dates.parse_single_day(dates.release_day_text(F.col("text")))
    return _fill(dom, "date_start", F.coalesce(_first(days), labelled), rows)


def cinema_duration(dom: DataFrame, rows: Column | None = None) -> DataFrame:
    structured = F.flatten(F.transform(json_ld(), lambda b: groups(b, fv.JSONLD_DURATION, 1)))
    minutes = F.filter(F.transform(structured, fields.parse_iso8601_duration), lambda m: m.isNotNull())
    labelled = fields.parse_duration(F.regexp_extract("text", fv.CINEMA_DURATION_LABEL, 1))
    return dom.withColumn(
        "duration_min",
        F.when(_on(rows) & _no_duration(), F.coalesce(_first(minutes), labelled)).otherwise(F.col("duration_min")),
    )


# --- the whole job -------------------------------------------------------------------


def with_show_columns(dom: DataFrame) -> DataFrame:
    """Give a dom table the show columns the rules fill (null unless already there)."""
    return dom.withColumns({
        f.name: F.lit(None).cast(f.dataType) for f in SHOWS.fields if f.name not in dom.columns
    })


def _latest_page(shows: DataFrame) -> DataFrame:
    """One row per url: the page stored last, by page_id."""
    alone = F.when(F.col("url").isNull(), F.col("page_id"))
    return shows.groupBy("url", alone.alias("_alone")).agg(
        F.max_by(F.struct(*[n for n in SHOWS.names if n != "url"]), "page_id").alias("s")).select("url", "s.*").select(*SHOWS.names)


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, reason) of pages without body or whose markup the parser refuses."""
    empty = pages.where(F.col("html").isNull()).select("page_id", "url", F.lit("no body").alias("reason"))
    return empty.unionByName(dom_pass(pages).where("NOT parsed").select("page_id", "url", F.lit("unreadable").alias("reason")))


def extract_shows(pages: DataFrame, seeds: DataFrame | None = None, site: Site = Site()) -> DataFrame:
    """Detail pages -> shows, one row per url, or one per seed when seeds are given.

    Pages are parsed and reduced to show fields before they meet each other or the seeds, so
    neither html nor an element table is ever shuffled. Of pages that share a url the one with
    the largest page_id counts; a page without url stays by itself. Seeds come as a stored table: when its
    urls, measured, may be broadcast, only wanted pages are parsed; otherwise all are, which costs
    less than moving html. A seed whose page is missing or unreadable keeps what it knows; what a
    seed knows is never replaced. ``unreadable_pages`` names the pages that give no show.
    """
    if seeds is not None and fits_broadcast(seeds.select("url")):
        pages = pages.join(F.broadcast(seeds.select("url")), "url", "left_semi")
    dom = with_show_columns(dom_pass(pages)).where("parsed")
    dom = dom.withColumn("section", urls.section_by_path(F.col("url")))
    cinema = F.coalesce(F.col("section") == "cinema", F.lit(False))
    theatre = ~cinema

    df = extract_description(extract_core(dom))
    df = venue_from_breadcrumb(venue_from_url(df, theatre), site, theatre)
    df = jsonld_dates(theatre_dates(extract_address(df, theatre), theatre), theatre)
    df = extract_duration(extract_prices(theatre_category(df, theatre), theatre), theatre)
    df = cinema_duration(cinema_release_date(cinema_category(df, cinema), cinema), cinema)
    found = _latest_page(conform(df, SHOWS, keep=("page_id",)))
    if seeds is None:
        return found
    known = conform(seeds, SHOWS).alias("s")
    columns = [
        F.coalesce(F.nullif(F.col(f"s.{n}"), F.lit("")) if found.schema[n].dataType.simpleString() == "string"
                   else F.col(f"s.{n}"), F.col(f"p.{n}")).alias(n)
        for n in SHOWS.names if n != "url"
    ]
    joined = known.join(found.alias("p"), F.col("s.url") == F.col("p.url"), "left").select("s.url", *columns)
    return joined.withColumn("section", F.coalesce("section", urls.section_by_path(F.col("url"))))
