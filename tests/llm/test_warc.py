import base64
import gzip
import hashlib
from pathlib import Path

from outings.llm.warc import deduplicate, read_archives, resolve, resolved, write_archives

PAGES = "page_id long, url string, html string, digest string"


def rows_of(spark, rows, folder, least=0):
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    archives = deduplicate(pages, str(folder), least)
    return archives, resolved(read_archives(archives)).collect()


def case():
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>\r\n\r\né", None) for i in range(20)]
    rows += [(100 + i, "http://h/same", "<p>the same</p>", "d") for i in range(30)]
    return rows + [(200, None, None, None), (201, " a b\r\nc ", "", None), (None, "u", "<p>the same</p>", None), (None, "u", "lone", None)]


def test_every_page_comes_back(spark, tmp_path):
    _, got = rows_of(spark, case(), tmp_path)
    want = case()
    top = {}
    for page, _, html, _ in want:
        if page is not None:
            top[html or ""] = max(page, top.get(html or "", page))
    assert len(got) == len(want)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for page, _, html, _ in want:
        if page is None:
            continue
        data, r = (html or "").encode(), by[page]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = top[html or ""] == page
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", top[html or ""]))
    none = sorted((r.record_type, r.refers_to) for r in got if r.page_id is None)
    assert none == [("response", None), ("revisit", 129)]


def test_small_payloads_stay_responses(spark, tmp_path):
    _, got = rows_of(spark, case(), tmp_path, least=1000)
    assert {r.record_type for r in got} == {"response"}


def test_payloads_are_stored_once(spark, tmp_path):
    archives, _ = rows_of(spark, case(), tmp_path)
    texts = [gzip.decompress(Path(r.path).read_bytes()) for r in archives.collect()]
    assert sum(t.count(b"<p>the same</p>") for t in texts) == 1
    assert sum(t.count(b"WARC/1.1\r\n") for t in texts) == len(case())
    full = {r.page_id: bytes(r.payload) for r in read_archives(archives).where("payload is not null").collect()}
    assert full[5] == "<p>page 5</p>\r\n\r\né".encode()


def test_equal_ids_and_no_pages(spark, tmp_path):
    _, got = rows_of(spark, [(1, "u", "x", None)] * 4, tmp_path / "a")
    assert sorted((r.record_type, r.refers_to) for r in got) == [("response", None)] + [("revisit", 1)] * 3
    archives, got = rows_of(spark, [], tmp_path / "b")
    assert got == [] and archives.count() == 0


def test_long_page(spark, tmp_path):
    _, got = rows_of(spark, [(1, "u", "ab" * 3_000_000, None), (2, "u", "ab" * 3_000_000, None)], tmp_path)
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in got) == [(1, 6_000_000, 2), (2, 6_000_000, None)]


def test_headers_decide_without_payloads(spark, tmp_path):
    heads = write_archives(spark.createDataFrame(case(), PAGES), str(tmp_path))
    assert "html" not in heads.columns and resolve(heads).where("of_path is not null").count() == 31
