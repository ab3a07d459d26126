"""One case per text rule, and one per known oddity."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from outings.functions import dates, fields, labels, urls
from outings.functions.text import clean

SPANS = [
    ("du 05/10/2025 au 12-11-25", ("2025-10-05", "2025-11-12")),
    ("Du 30 décembre 2025 au 3 janvier 2026", ("2025-12-30", "2026-01-03")),
    ("du 7 sept. au 12 OCTOBRE 2025", ("2025-09-07", "2025-10-12")),
    ("du 5 au 12 août 2025", ("2025-08-05", "2025-08-12")),
    ("À partir du 1 févr. 2026", ("2026-02-01", None)),
    ("jusqu'au 9 déc. 2025", (None, "2025-12-09")),
    ("Jusqu’au 9 décembre 2025", (None, "2025-12-09")),
    ("le 3 mars 2025, le 1 mars 2025 et le 02/05/2025", ("2025-03-01", "2025-05-02")),
    ("le 3 mars 2025", ("2025-03-03", "2025-03-03")),
    ("sans date", (None, None)),
    ("", (None, None)),
    (None, (None, None)),
    ("du 5 au\n12 mai 2025", ("2025-05-05", "2025-05-12")),
    # the year at the end holds for both ends
    ("du 20 décembre au 5 janvier 2026", ("2026-12-20", "2026-01-05")),
    # an ordinal is not a day
    ("1er octobre 2025", (None, None)),
    # a numeric bound is not a bound, just a day
    ("jusqu'au 12/11/2025", ("2025-11-12", "2025-11-12")),
    # parts are not checked here; three-digit years pass
    ("le 05/13/2025", ("2025-13-05", "2025-13-05")),
    ("le 05/12/202", ("0202-12-05", "0202-12-05")),
    # the most specific wording wins wherever it stands
    ("le 1 mai 2024, du 5 au 12 octobre 2025", ("2025-10-05", "2025-10-12")),
]


def test_date_ranges(values):
    got = values([t for t, _ in SPANS], dates.parse_date_range)
    assert [(v.start, v.end) for v in got] == [want for _, want in SPANS]


def test_single_days(values):
    texts = ["12 mars 2026", "12/03/26", "2026-03-12T20:00", "le 12 mars 2026", " 12  mars 2026 ", None]
    assert values(texts, dates.parse_single_day) == [
        "2026-03-12", "2026-03-12", "2026-03-12", None, "2026-03-12", None]


def test_real_days(values):
    texts = ["2025-02-28", "2025-02-30", "2025-1-5", "2025-13-01", "0000-01-01", "hier", None]
    assert values(texts, dates.real_day) == ["2025-02-28", None, "2025-1-5", None, None, None, None]


PRICES = [
    ("Tarif : 22 - 83 €", (22.0, 83.0)), ("22–83€", (22.0, 83.0)), ("12,50 €", (12.5, 12.5)),
    ("30 €, 12.5 € ou 18 €", (12.5, 30.0)), ("gratuit", (None, None)),
    ("12,50 - 20 €", (50.0, 20.0)),  # the range starts at the digits next to the dash
]


def test_prices(values):
    got = values([t for t, _ in PRICES], fields.parse_prices)
    assert [(v.low, v.high) if v else (None, None) for v in got] == [want for _, want in PRICES]


def test_durations(values):
    texts = ["Durée : 1h30", "2H", "95 min", "75mn", "environ", None, "20h30, durée 1h30"]
    assert values(texts, fields.parse_duration) == [90, 120, 95, 75, None, None, 1230]
    texts = ["PT1H29M", "pt45m", "PT2H", "PT", "P1D", "PT0M", None]
    assert values(texts, fields.parse_iso8601_duration) == [89, 45, 120, None, None, None, None]


def test_duration_guard(values):
    texts = ["Représentation à 20h30", "Durée : 1h30", "DURÉE 1h", "90 min", "durée libre"]
    assert values(texts, fields.looks_like_duration) == [False, True, True, True, False]
    assert values(["1h30"], lambda c: fields.looks_like_duration(c, True)) == [True]


def test_addresses(values):
    texts = ["au 6 bis chemin des Dunes 59240 Dunkerque, gare", "21 place de l’Étang 33000 Bordeaux", "Paris 75010"]
    assert values(texts, fields.parse_address) == [
        "6 bis chemin des Dunes 59240 Dunkerque", "21 place de l’Étang 33000 Bordeaux", None]


def test_rubrics(values):
    texts = ["Voir notre rubrique Humour & Shows .", "rubrique Spectacle musical.", "Rubrique Pièces de théâtre.",
             "rubrique Danse.", "rien", "", None]
    assert values(texts, fields.rubric_category) == [
        "humour", "spectacle musical", "théâtre", "Danse", "théâtre", None, None]


def test_venue_texts(values):
    texts = ["Théâtre Antoine", "Pièces de théâtre", "Théâtre", "Salle 12", "Billetterie en ligne",
             "Le spectacle du soir", "-20% ici", "", None]
    assert values(texts, fields.looks_like_venue) == [True] + [False] * 8


def test_venue_from_url(values):
    texts = ["https://x.example/theatre/theatre-montparnasse-2825/piece-1.html", "https://x.example/cinema/a-1/b-2.html",
             "https://x.example/theatre", None]
    assert values(texts, fields.venue_from_url) == ["Theatre Montparnasse", None, None, None]


def test_clean(values):
    assert values(["  a  \n b ", " \t ", "", None], clean) == ["a b", None, None, None]


def test_resolve(values):
    cases = {
        "/a/b.html?x=1#t": "https://s.example/a/b.html?x=1#t", "//h.example/p": "https://h.example/p",
        "http://o.example/q": "http://o.example/q", "c.html": "https://s.example/d/c.html",
        "../c.html": "https://s.example/c.html", "./": "https://s.example/d/", "#t": "https://s.example/d/e.html?q=1#t",
        "?q=2": "https://s.example/d/e.html?q=2", "mailto:a@b.example": "mailto:a@b.example",
    }
    got = values(list(cases), lambda c: urls.resolve(F.lit("https://s.example/d/e.html?q=1"), c))
    assert got == list(cases.values())


def test_detail_urls(values):
    base = "https://listings.example"
    paths = {"cinema": r"^/cinema/evenement/[^/]+-\d+\.html$", "theatre": r"^/theatre/[^/]+-\d+/[^/]+-\d+\.html$"}

    def of(section):
        return lambda c: urls.detail_url(c, F.lit(section), base, paths)

    assert values(["/cinema/evenement/carmen-45189.html?foo=1#bar", "/cinema/carmen.html", "", None], of("cinema")) == [
        base + "/cinema/evenement/carmen-45189.html", None, None, None]
    assert values(["/theatre/lieu-1/piece-2.html", "/cinema/evenement/carmen-45189.html"], of("theatre")) == [
        base + "/theatre/lieu-1/piece-2.html", None]


def test_query_param(values):
    texts = ["https://s.example/p?a=&b=1&b=2&npage=7#t", "https://s.example/p"]
    assert values(texts, lambda c: urls.with_query_param(c, "npage", F.lit("3"))) == [
        "https://s.example/p?a=&b=1&b=2&npage=3#t", "https://s.example/p?npage=3"]


def test_section_rules_differ(values):
    texts = ["https://s.example/theatre/x", "https://s.example/a/cinema/x", "https://s.example/theatre/cinema/x"]
    assert values(texts, urls.section_by_path) == ["theatre", None, "theatre"]
    assert values(texts, urls.section_by_contains) == ["theatre", "cinema", "cinema"]


@pytest.mark.parametrize("low, high, label", [
    (20.0, 20.0, "20 €"), (20.4, 35.5, "20 € - 36 €"), (12.5, None, "Dès 13 €"),
    (None, 1234.0, "Jusqu’à 1 234 €"), (None, None, "Tarifs non communiqués"),
])
def test_price_labels(spark, low, high, label):
    df = spark.createDataFrame([(low, high)], "a double, b double")
    assert df.select(labels.price_label(F.col("a"), F.col("b"))).first()[0] == label


def test_date_and_duration_labels(spark):
    rows = [(date(2026, 3, 2), date(2026, 3, 2), 0), (date(2026, 2, 1), date(2026, 8, 9), 45), (None, date(2026, 5, 1), 120),
            (date(2026, 12, 1), None, 95), (None, None, None)]
    df = spark.createDataFrame(rows, "s date, e date, m int").coalesce(1)
    got = df.select(labels.date_label(F.col("s"), F.col("e")), labels.duration_label(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [
        ("02 mars 2026", None), ("01 févr. 2026 → 09 août 2026", "45 min"), ("01 mai 2026", "2 h"),
        ("01 déc. 2026", "1 h 35"), ("Dates à venir", None)]


def test_searched_texts_are_worked_out_once(spark):
    """A text that is built for a search is written once into the expression, not once a word."""
    from pyspark.sql import functions as F

    from outings.functions import fields, text
    cell = F.regexp_replace("t", "x", "y")
    for expression in (text.contains_any(cell, ("a.b", "c d", "é")), fields.looks_like_duration(cell)):
        assert str(expression).count("regexp_replace") == 1
    df = spark.createDataFrame([("xa.bx",), ("acb",), ("c d",), ("dé",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.contains_any(F.col("t"), ("a.b", "c d", "é"))).collect()] == [True, False, True, True, None, False]
