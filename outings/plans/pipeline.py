"""Whole jobs: stored pages to shows, show files to the catalog."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outings import fixed_values as fv
from outings.functions.text import blank_to_null
from outings.operators import frontier as fr
from outings.operators.extract import extract_shows
from outings.operators.merge import shows_to_batch, upsert_works
from outings.operators.quality import check_shows
from outings.schemas import SHOWS, Site
from outings.session import materialize
from outings.sources.catalog import append_import_job, scan_works, write_works
from outings.sources.shows import read_shows_strict


@dataclass
class Collected:
    shows: DataFrame
    rejected: DataFrame
    stats: DataFrame


def collect_shows(listings: DataFrame, details: DataFrame, cache: DataFrame, as_of: datetime,
                  hours: int = fv.DEFAULT_REFRESH_HOURS, sections: list[str] | None = None,
                  site: Site = Site()) -> Collected:
    """listings(page_id, url, html, section, page), details(page_id, url, html), cache -> shows.

    A listing without html is a page that failed to load. The only tables shuffled are
    links and shows; html stays where it is read. The plan of urls is written once, because
    what is fetched, reused and placed comes from it (and its size is then known); so are the
    checked shows, because page counts, shows, rejects and counters come from them.
    """
    order = fr.section_order(sections)
    listings = listings.where(F.col("section").isin(*order))
    places = listings.select("page_id", "section", "page", F.col("html").isNotNull().alias("ok"))
    links = fr.extract_links(listings).join(places.select("page_id", "section", "page"), "page_id")
    seeds = fr.first_seen_links(fr.normalize_show_url(links, site), order).withColumn(
        "title", blank_to_null(F.col("text")))
    planned = materialize(fr.refresh_plan(seeds, cache, as_of, hours, large_cache=True), "planned")

    fetch = planned.where("action = 'fetch'").withColumn("crawled_at", F.lit(as_of.isoformat()))
    found = extract_shows(details, fetch.select("url", "title", "section", "crawled_at"), site)
    known = planned.where("action = 'reuse'")
    reused = fr.merge_seed_cache(known, fr.cache_of(known, cache))
    where_seen = planned.select("url", F.col("section").alias("list_section"), "page", "action")
    checked = materialize(check_shows(found.unionByName(reused)).join(where_seen, "url"), "checked")

    new_per_page = checked.groupBy(F.col("list_section").alias("section"), "page").agg(
        F.count_if(F.col("reason").isNull()).alias("n_new"))
    counts = places.join(new_per_page, ["section", "page"], "left").fillna(0, ["n_new"])
    pages = fr.pagination_cutoff(counts)
    kept = checked.join(pages.select(F.col("section").alias("list_section"), "page"),
                        ["list_section", "page"], "left_semi")
    outcomes = kept.select("action", F.col("reason").isNull().alias("valid"))
    return Collected(
        shows=kept.where("reason IS NULL").select(*SHOWS.names),
        rejected=kept.where("reason IS NOT NULL").select(*SHOWS.names, "reason"),
        stats=fr.crawl_stats(pages, outcomes, cache),
    )


def import_shows(spark: SparkSession, path: str, works_root: str, jobs_root: str, now: datetime,
                 site: Site = Site()) -> int:
    """Check a whole show file, merge it, publish the new catalog, then log the import.

    Returns the number of imported records. Any bad line stops the job before anything is written.
    """
    records, _ = read_shows_strict(spark, path, site)
    batch = materialize(shows_to_batch(records.select(*SHOWS.names)), "import")
    write_works(upsert_works(scan_works(spark, works_root), batch, now), works_root)
    imported = batch.count()
    append_import_job(spark, jobs_root, path, imported, now)
    return imported
