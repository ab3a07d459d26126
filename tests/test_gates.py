"""Quality gates, readers, import."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from outings.operators import quality as qu
from outings.plans.pipeline import import_shows
from outings.schemas import SHOWS
from outings.sources import catalog
from outings.sources import shows as sh

BASE = "https://listings.example"
NOW = datetime(2026, 3, 12, 7)


def show(**fields):
    row = dict.fromkeys(SHOWS.names) | dict(url=f"{BASE}/theatre/t-1/p-2.html", title="Titre", venue="Lieu") | fields
    return tuple(row[n] for n in SHOWS.names)


def checked(spark, **fields):
    return qu.check_shows(spark.createDataFrame([show(**fields)], SHOWS)).first()


def test_ranges_are_put_in_order_and_gaps_filled(spark):
    row = checked(spark, date_start="2024-06-30", date_end="2024-02-03", price_min_eur=61.0, price_max_eur=18.0)
    assert (row.section, row.category, row.reason) == ("theatre", "théâtre", None)
    assert (row.date_start, row.date_end, row.price_min_eur, row.price_max_eur) == ("2024-02-03", "2024-06-30", 18.0, 61.0)


@pytest.mark.parametrize("fields, reason", [
    (dict(title="  "), "missing_title"), (dict(section="opera"), "invalid_section"),
    (dict(url=f"{BASE}/x"), "invalid_section"), (dict(venue=None), "insufficient"),
    (dict(venue=None, date_start="2025-02-30"), "insufficient"), (dict(venue=None, description="d"), None),
])
def test_rejections(spark, fields, reason):
    assert checked(spark, **fields).reason == reason


def test_repairs(spark):
    row = checked(spark, image="ftp://x", duration_min=601, price_min_eur=-1.0, date_end="2025-13-01", title="  a \n b ")
    assert (row.image, row.duration_min, row.price_min_eur, row.date_end, row.title) == (None, None, None, None, "a b")
    again = qu.check_shows(qu.check_shows(spark.createDataFrame([show(date_start="2024-06-30", date_end="2024-02-03")], SHOWS)).drop("reason"))
    assert again.first().date_start == "2024-02-03"


def record(**fields):
    return {"url": f"{BASE}/theatre/t-1/p-2.html", "title": "Titre"} | fields


def issues(spark, *lines):
    df = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "line_no long, line string")
    return [r.issues for r in qu.validate_import(df).orderBy("line_no").collect()]


def test_import_issues(spark):
    got = issues(
        spark, record(ignored=True, section=None, duration_min="", price_min_eur=0, duration_max=3), record(url="https://example.com/x", title=""),
        record(duration_min="90"), record(duration_min=60.0), record(duration_min=60.5), record(duration_min=0),
        record(price_max_eur=500.01), record(date_start="2026-02-30", date_end="12/03/2026"), record(image="img.jpg"),
        record(venue=3), record(title="x" * 281), record(title="𝄞" * 141), record(crawled_at="hier"), record(section="opera"),
        "{oops", "[1]", "5", {"title": "t"}, record(address=["a"]), '{"title": "a"} x')
    assert got == [
        [], ["url: unexpected site", "title: expected string"], ["duration_min: expected number"], [],
        ["duration_min: expected whole number"], ["duration_min: outside 1..600"], ["price_max_eur: outside 0..500"],
        ["date_start: no such day", "date_end: expected YYYY-MM-DD"], ["image: expected HTTP URL"], ["venue: expected string"],
        ["title: longer than 280"], ["title: longer than 280"], ["crawled_at: invalid datetime"], ["section: unknown section"],
        ["root: invalid JSON"], ["root: expected object"], ["root: expected object"], ["url: expected string"],
        ["address: expected string"], ["root: invalid JSON"]]


def test_import_normalizes(spark):
    line = json.dumps(record(url=f"{BASE}/cinema/evenement/c-1.html", title="  Le  Cid ", date_start="2024-06-30", date_end="2024-02-03",
                             price_min_eur=61, price_max_eur=18, arrondissement="10e", duration_min=120))
    df = spark.createDataFrame([(1, line)], "line_no long, line string")
    row = qu.normalize_import(qu.validate_import(df).drop("line")).first().asDict()
    assert row["title"] == "Le Cid" and row["section"] == "cinema" and "arrondissement" not in row
    assert (row["date_start"], row["date_end"], row["price_min_eur"], row["price_max_eur"], row["duration_min"]) == (
        "2024-02-03", "2024-06-30", 18.0, 61.0, 120)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    lines = [("" if i % 7 == 0 else f"ligne {i}") for i in range(1, 5001)]
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = sh.numbered_lines(spark, str(path))
        assert {r.line_no: r.line for r in df.collect()} == dict(enumerate(lines, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_strict_reader_names_the_line(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    good = [json.dumps(record(url=f"{BASE}/theatre/t-1/p-{i}.html")) for i in range(50)]
    path.write_text("\n".join(good[:41] + [json.dumps({"url": "https://example.com/x", "title": ""})] + good[41:]))
    with pytest.raises(ValueError, match="Line 42: .*unexpected site"):
        sh.read_shows_strict(spark, str(path))
    path.write_text("\n\n" + good[0] + "\n\n" + good[1] + "\n" + good[0])
    with pytest.raises(ValueError, match="Line 6: .*duplicate of line 3"):
        sh.read_shows_strict(spark, str(path))
    path.write_text("\n \n")
    with pytest.raises(ValueError, match="no records"):
        sh.read_shows_strict(spark, str(path))


def test_lenient_reader(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    rows = [record(title="ancien"), "{oops", "", "[1]", {"url": 5}, {"url": ""}, record(title="neuf", duration_min=90),
            {"url": f"{BASE}/cinema/x", "section": 3, "arrondissement": None}]
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    got = {r.url: r for r in sh.read_shows_lenient(spark, str(path)).collect()}
    assert len(got) == 2 and got[f"{BASE}/cinema/x"].section == "cinema"
    assert (got[record()["url"]].title, got[record()["url"]].duration_min, got[record()["url"]].section) == ("neuf", 90, "theatre")


def test_written_lines_keep_nulls(spark, tmp_path):
    sh.write_shows(spark.createDataFrame([show(title="é")], SHOWS), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert list(json.loads(text)) == SHOWS.names and "é" in text and json.loads(text)["image"] is None


def test_import_job(spark, tmp_path):
    path, root, jobs = tmp_path / "f.jsonl", str(tmp_path / "works"), str(tmp_path / "jobs")
    path.write_text(json.dumps(record()) + "\n" + json.dumps(record(url=f"{BASE}/x-2", venue="V")))
    assert import_shows(spark, str(path), root, jobs, NOW) == 2
    path.write_text(json.dumps(record(title="Neuf")))
    assert import_shows(spark, str(path), root, jobs, NOW) == 1
    assert sorted(r.title for r in catalog.scan_works(spark, root).collect()) == ["Neuf", "Titre"]
    path.write_text("{oops")
    with pytest.raises(ValueError):
        import_shows(spark, str(path), root, jobs, NOW)
    assert [r.imported for r in catalog.scan_import_jobs(spark, jobs).orderBy("imported").collect()] == [1, 2]
    assert catalog.current_version(spark, root) == 2


def test_empty_result_is_not_published(spark, tmp_path):
    root = str(tmp_path / "r")
    rows = spark.range(3)
    assert catalog.publish_snapshot(rows, root, "a") == 1
    with pytest.raises(ValueError):
        catalog.publish_snapshot(rows.where("id > 5"), root, "b")
    assert catalog.read_snapshot(spark, root, rows.schema).count() == 3
    assert catalog.publish_snapshot(rows, root, "a") == 1  # same token: nothing happens
    assert catalog.publish_snapshot(rows.limit(1), root, "c") == 2
    assert catalog.read_snapshot(spark, root, rows.schema).count() == 1


def test_duplicates(spark):
    df = spark.createDataFrame([("f", "u", 1), ("f", "u", 3), ("g", "u", 2), ("f", "v", 2), ("f", "u", 9)], "file string, url string, line_no long")
    first, later = qu.duplicate_url_check(df, scope=["file"])
    assert first.count() == 3 and sorted((r.line_no, r.first_line) for r in later.collect()) == [(3, 1), (9, 1)]
    with pytest.raises(ValueError):
        qu.non_empty_check(df.where(F.lit(False)))


def test_import_check_compiles(spark):
    """Java leaves methods of more than 8,000 bytes uncompiled; an open object that is never closed is told apart unparsed."""
    import re
    df = qu.validate_import(spark.range(1).select(F.lit('{"title": "t"').alias("line"))).where(F.size("issues") == 0)
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000
    big = record(price_min_eur=1e2, price_max_eur=12.345678901234567, duration_min=9007199254740993)
    row = qu.validate_import(spark.createDataFrame([(json.dumps(big),)], "line string")).first()
    assert (row.price_min_eur, row.price_max_eur, row.issues) == (100.0, 12.345678901234567, ["duration_min: outside 1..600"])
