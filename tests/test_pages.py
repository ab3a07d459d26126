"""HTML pass, extraction rules, frontier."""

from datetime import UTC, datetime, timedelta

import pytest

from outings.operators import extract as ex
from outings.operators import frontier as fr
from outings.operators.dom import dom_pass
from outings.plans.pipeline import collect_shows
from outings.schemas import PAGES, SHOWS

BASE = "https://listings.example"
CINEMA = """<!doctype html><title>nichts</title><div id=fiche><dl><dt>Genre :</dt><dd>policier</dd> <dt>Durée :</dt> <dd>2h05</dd>
<dt>Date de sortie :</dt><dd>8 novembre 2023</dd></dl><h1>Nuits <i>de craie</i></h1><h1>Un autre titre</h1>
<script type="application/ld+json">{"datePublished": "2023-11-09", "genre": ["Drame", "Polar"], "duration": "PT95M"}</script>
<h3>Notre avis</h3><p>Trop long pour ce qu'il raconte, mais on y revient volontiers.</p></div>"""


def shows(spark, *pages, seeds=None):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], PAGES)
    return {r.url: r for r in ex.extract_shows(df, seeds).collect()}


def test_text_is_kept_once_and_sliced(spark):
    html = "<div id=a>un <b>deux</b><script>var x='<p>'</script><!-- c -->trois<p>quatre<p>cinq</div>six</nope>"
    row = dom_pass(spark.createDataFrame([(1, "u", html)], PAGES)).first()
    assert row.text == "un deux trois quatre cinq six"
    text = {n.id or n.tag: row.text[n.start:n.stop] for n in row.nodes}
    assert text["a"] == "un deux trois quatre cinq" and text["b"] == "deux" and text["script"] == ""
    assert [row.text[t.start:t.stop] for t in row.texts] == ["un", "deux", "trois", "quatre", "cinq", "six"]


def test_unreadable_page_is_flagged(spark):
    pages = [(1, "u", "<![bad"), (2, "v", "<p>ok"), (3, "w", None)]
    got = {r.page_id: r.parsed for r in dom_pass(spark.createDataFrame(pages, PAGES)).collect()}
    assert got[2] is True and 3 not in got


def test_cinema_page(spark):
    """What is structured counts before the labels, a list of genres whole; the first heading is the title."""
    url = f"{BASE}/cinema/evenement/craie-5.html"
    show = shows(spark, (url, CINEMA))[url].asDict()
    assert {k: v for k, v in show.items() if v is not None and k != "description"} == {
        "url": url, "title": "Nuits de craie", "section": "cinema", "category": "drame, polar", "date_start": "2023-11-09", "duration_min": 95}


def test_cinema_labels_without_structured_data(spark):
    url = f"{BASE}/cinema/evenement/x-1.html"
    page = CINEMA.replace("application/ld+json", "text/plain")
    show = shows(spark, (url, page))[url]
    assert (show.category, show.date_start, show.duration_min) == ("policier", "2023-11-08", 125)


def test_theatre_page(spark):
    url = f"{BASE}/theatre/theatre-du-nord-12/le-cid-33.html"
    page = """<nav class="breadcrumb"><a href="/theatre/nord-12">Théâtre du Grand Nord</a><a href="/theatre/x-1">Pièces de théâtre</a></nav>
    <h1>Le <b>Cid</b></h1><div class="venue-address">8 quai des Brumes 76600 Le Havre</div><time>du 7 septembre au 12 octobre 2025</time>
    <div>Tarif : <b>99 €</b> 12,50 - 20&nbsp;€</div><p>Représentation à 20h30</p><p>Durée : 1h30</p>
    <h3>Présentation</h3><p>court</p><p>À lire dans la rubrique Danse.</p><h3>Autre</h3><p>Pas cette partie.</p>"""
    show = shows(spark, (url, page))[url]
    assert (show.venue, show.address) == ("Théâtre du Grand Nord", "8 quai des Brumes 76600 Le Havre")
    assert (show.date_start, show.date_end, show.duration_min) == ("2025-09-07", "2025-10-12", 90)
    assert (show.price_min_eur, show.price_max_eur) == (50.0, 20.0)  # put in order by the gate
    assert (show.title, show.category, show.description) == (
        "Le Cid", "Danse", "À lire dans la rubrique Danse.")


def test_structured_dates_widen(spark):
    url = f"{BASE}/theatre/t-1/p-2.html"
    page = """<script type="application/ld+json">{"startDate":"2025-10-01","endDate":"2025-12-31T20:00"}</script>
    <p class=dates>jusqu'au 5 novembre 2025</p>"""
    show = shows(spark, (url, page))[url]
    assert (show.date_start, show.date_end) == ("2025-10-01", "2025-12-31")


def test_seeds_keep_what_they_know(spark):
    url, lost = f"{BASE}/cinema/evenement/x-1.html", f"{BASE}/theatre/a-1/b-2.html"
    seeds = spark.createDataFrame([(url, "Titre du lien"), (lost, None)], "url string, title string")
    got = shows(spark, (url, CINEMA), (f"{BASE}/other", CINEMA), seeds=seeds)
    assert got[url].title == "Titre du lien" and set(got) == {url, lost}
    assert got[lost].section == "theatre" and got[lost].description is None


def test_section_order():
    assert fr.section_order([" Cinema", "theatre", "CINEMA"]) == ["cinema", "theatre"]
    assert fr.section_order() == ["theatre", "cinema"]
    for wrong in (["opera"], [" "]):
        with pytest.raises(ValueError):
            fr.section_order(wrong)


def test_listing_urls(spark):
    asked = spark.createDataFrame([("theatre", 3), ("cinema", 0)], "section string, max_pages int")
    got = [(r.section, r.page, r.url) for r in fr.listing_urls(asked).orderBy("section", "page").collect()]
    assert got[0][2].endswith("arrondissment=&arrondissment=&GenreCinema=") and len(got) == 4
    assert got[3] == ("theatre", 3, BASE + "/theatre/programme.html?npage=3")
    many = spark.createDataFrame([("theatre", 10_000)], "section string, max_pages int")
    assert fr.listing_urls(many).count() == 10_000 and fr.listing_urls(many, most=199).count() == 199


def test_page_numbers_are_not_links(spark):
    page = '<a href="/a">12</a><a href="">x</a><a>y</a><a href="/b"><b>Le</b> Cid</a><a href="/c"><img src=i></a>'
    got = fr.extract_links(spark.createDataFrame([(1, "u", page)], PAGES)).orderBy("pos").collect()
    assert [(r.href, r.text) for r in got] == [("/b", "LeCid"), ("/c", "")]


def test_first_link_wins_even_without_text(spark):
    links = spark.createDataFrame(
        [("cinema", 1, 1, "u", "c"), ("theatre", 2, 0, "u", "b"), ("theatre", 1, 5, "u", ""), ("theatre", 1, 6, "u", "a")],
        "section string, page int, pos int, url string, text string")
    row = fr.first_seen_links(links).first()
    assert (row.section, row.page, row.pos, row.text) == ("theatre", 1, 5, "")


def test_pagination(spark):
    counts = spark.createDataFrame(
        [("theatre", 1, True, 0), ("theatre", 2, False, 0), ("theatre", 3, True, 4), ("theatre", 4, True, 0), ("theatre", 5, True, 9),
         ("cinema", 1, True, 1)], "section string, page int, ok boolean, n_new long")
    got = {(r.section, r.page) for r in fr.pagination_cutoff(counts).collect()}
    assert got == {("theatre", 1), ("theatre", 2), ("theatre", 3), ("theatre", 4), ("cinema", 1)}


def test_refresh_plan(spark):
    now = datetime(2026, 3, 12, 10, tzinfo=UTC)

    def cached(url, hours=2, zone=True, **changes):
        at = (now - timedelta(hours=hours)).isoformat() if zone else (now - timedelta(hours=hours)).replace(tzinfo=None).isoformat()
        row = dict.fromkeys(SHOWS.names) | dict(
            url=url, title="t", section="theatre", category="c", venue="v", description="d", crawled_at=at) | changes
        return tuple(row[n] for n in SHOWS.names)

    cache = spark.createDataFrame([
        cached("fresh"), cached("edge", 72), cached("stale", 96), cached("no venue", venue=""), cached("film", section="cinema", venue=None, category=None),
        cached("bad time", crawled_at="hier"), cached("no zone", zone=False)], SHOWS)
    seeds = spark.createDataFrame([(r.url,) for r in cache.collect()] + [("new",)], "url string")

    def fetched(hours):
        return {r.url for r in fr.refresh_plan(seeds, cache, now, hours).collect() if r.action == "fetch"}

    assert fetched(72) == {"stale", "no venue", "bad time", "new"}
    assert fetched(0) == fetched(-5) == {"no venue", "new"}


def test_collect(spark):
    def listing(i, section, page, *hrefs):
        html = None if hrefs == (None,) else "".join(f'<a href="{h}">Lien {h[-6:-5]}</a>' for h in hrefs)
        return (i, "", html, section, page)

    listings = spark.createDataFrame([
        listing(1, "theatre", 1, "/theatre/a-1/p-1.html", "/theatre/a-1/p-1.html?x", "/aide"), listing(2, "theatre", 2, None),
        listing(3, "theatre", 3, "/theatre/a-1/p-1.html"), listing(4, "theatre", 4, "/theatre/a-1/p-4.html"),
        listing(5, "cinema", 1, "/cinema/evenement/f-5.html", "/cinema/evenement/f-6.html"),
    ], "page_id long, url string, html string, section string, page int")
    detail = "<h2>Synopsis</h2><p>Un texte assez long pour compter.</p>"
    details = spark.createDataFrame([(i, u, detail) for i, u in enumerate(
        [f"{BASE}/theatre/a-1/p-1.html", f"{BASE}/theatre/a-1/p-4.html", f"{BASE}/cinema/evenement/f-5.html"])], PAGES)
    cache = spark.createDataFrame([tuple((dict.fromkeys(SHOWS.names) | dict(
        url=f"{BASE}/cinema/evenement/f-6.html", title="Vieux", description="d", crawled_at="2026-03-12T09:00:00Z"))[n] for n in SHOWS.names)], SHOWS)
    now = datetime(2026, 3, 12, 10, tzinfo=UTC)
    got = collect_shows(listings, details, cache, now)
    shows_ = {r.url[-8:]: r for r in got.shows.collect()}
    assert set(shows_) == {"p-1.html", "f-5.html"} | {"f-6.html"} and shows_["f-6.html"].title == "Vieux"
    assert shows_["f-6.html"].crawled_at == "2026-03-12T09:00:00Z" and shows_["p-1.html"].crawled_at == now.isoformat()
    stats = got.stats.first().asDict()
    assert stats == dict(pages_crawled=3, pages_failed=1, shows_extracted=3, shows_completed=2, invalid_shows=0,
                         cached_loaded=1, cached_reused=1, detail_fetches=2)


def test_no_candidate_is_dropped(spark):
    """Forty texts without a date come before the one that has it, twelve without a duration before it."""
    url = f"{BASE}/theatre/t-1/p-2.html"
    page = "".join(f"<time>pas encore {i}</time>" for i in range(40)) + "<time>le 5 novembre 2025</time>"
    page += "".join(f"<p>durée inconnue, tarif min {i}</p>" for i in range(12)) + "<p>Durée : 1h15</p>"
    show = shows(spark, (url, page))[url]
    assert (show.date_start, show.duration_min) == ("2025-11-05", 75)
    dom = ex.with_show_columns(dom_pass(spark.createDataFrame([(1, url, page)], PAGES)))
    assert ex.theatre_dates(dom, most=30).first().date_start is None


def test_a_page_stored_twice_gives_one_show(spark):
    url = f"{BASE}/cinema/evenement/x-1.html"
    pages = spark.createDataFrame([(7, url, "<h1>neu</h1>"), (3, url, "<h1>alt</h1>"), (8, None, "<h1>a</h1>"), (9, None, "<h1>b</h1>"), (5, "gone", None)], PAGES)
    assert sorted(r.title for r in ex.extract_shows(pages).collect()) == ["a", "b", "neu"]
    assert [(r.page_id, r.reason) for r in ex.unreadable_pages(pages).collect()] == [(5, "no body")]
    seeds = spark.createDataFrame([(url,)], "url string")
    assert [r.title for r in ex.extract_shows(pages, seeds).collect()] == ["neu"]


def test_a_cache_that_repeats_a_url_counts_once(spark):
    def entry(title, at):
        return tuple((dict.fromkeys(SHOWS.names) | dict(url="u", section="cinema", title=title, description="d", crawled_at=at))[n] for n in SHOWS.names)

    cache = spark.createDataFrame([entry("alt", "2026-03-01T00:00:00Z"), entry("neu", "2026-03-12T09:00:00Z"), entry("früher", None)], SHOWS)
    seeds = spark.createDataFrame([("u", "cinema", "t")], "url string, section string, title string")
    assert [r.title for r in fr.merge_seed_cache(seeds, cache).collect()] == ["neu"]
    plan = fr.refresh_plan(seeds, cache, datetime(2026, 3, 12, 10, tzinfo=UTC)).collect()
    assert [r.action for r in plan] == ["reuse"]


def test_work_grows_with_the_page(spark):
    """Twenty thousand unclosed paragraphs take about ten times as long as two thousand."""
    import time

    took = []
    for n in (400, 2000, 20_000):
        page = spark.createDataFrame([(1, f"{BASE}/theatre/t-1/p-2.html", "<section>" * (n // 100) + "<p>Durée libre, tarif " * n)], PAGES)
        start = time.time()
        ex.extract_shows(page).collect()
        took.append(time.time() - start)
    assert took[2] < 12 * max(took[1], 1)


def test_a_batch_is_parsed_in_small_lots():
    """A worker holds the elements of one lot, not of the whole batch that it was sent."""
    import pyarrow as pa

    from outings.operators import dom
    html = ["<p>a</p>" * (dom._LOT // 16)] * 8 + ["", "<a href=x>b</a>"]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(10)), "url": ["u"] * 10, "html": html})
    lots = list(dom._parse_batches(iter([batch])))
    assert len(lots) > 3 and max(lot.num_rows for lot in lots) <= 3
    rows = [row for lot in lots for row in lot.to_pylist()]
    assert [row["page_id"] for row in rows] == list(range(10))
    assert rows[8]["nodes"] == [] and rows[9]["nodes"][0]["href"] == "x" and rows[9]["texts"][0]["word"] == "b"
