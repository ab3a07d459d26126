"""Streams give what one batch gives, also after they were killed and started again."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from outings.operators.reactions import fold_reactions
from outings.schemas import WORKS
from outings.sources import catalog
from outings.streaming.ingest import check_files, checked_rows, ingest_run, ingested_works, rejected_lines
from outings.streaming.reactions import STORE, current_reactions, reaction_stream
from tests.test_catalog import events

NOW, LATER = datetime(2026, 3, 12, 7), datetime(2026, 3, 13, 7)
BASE = "https://listings.example"


def rows(df):
    return sorted(map(str, df.collect()))


def test_reactions(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    log = events(spark, 600)
    for part in (2, 0, 1):  # out of time order
        log.where(f"seq % 3 = {part}").repartition(2).write.mode("append").parquet(source)
        reaction_stream(spark, [source], checkpoint, files_per_batch=1).awaitTermination()
        assert rows(current_reactions(spark, checkpoint)) == rows(fold_reactions(log.where({2: "seq % 3 = 2", 0: "seq % 3 <> 1", 1: "true"}[part])))
    reaction_stream(spark, [source], checkpoint).awaitTermination()  # nothing new
    assert rows(current_reactions(spark, checkpoint)) == rows(fold_reactions(log))
    assert all(spark.conf.get(k, None) != v or k not in STORE for k, v in STORE.items())  # the session is as it was


def test_a_killed_stream_goes_on(spark, tmp_path):
    """Stopped in the middle of its batches, again and again; every event counts once."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    log = events(spark, 500)
    log.repartition(6).write.parquet(source)
    for wait in (0.5, 2.5, 4.0):
        query = reaction_stream(spark, [source], checkpoint, files_per_batch=1)
        time.sleep(wait)
        query.stop()
    reaction_stream(spark, [source], checkpoint, files_per_batch=1).awaitTermination()
    assert rows(current_reactions(spark, checkpoint)) == rows(fold_reactions(log))


def test_two_folders_feed_one_state(spark, tmp_path):
    checkpoint, log = str(tmp_path / "check"), events(spark, 400)
    folders = [str(tmp_path / f"in{part}") for part in range(2)]
    for drop in (0, 1):
        for part, folder in enumerate(folders):
            log.where(f"seq % 2 = {part} AND floor(seq / 2) % 2 = {drop}").repartition(2).write.mode("append").parquet(folder)
        reaction_stream(spark, folders, checkpoint, files_per_batch=1).awaitTermination()
    assert rows(current_reactions(spark, checkpoint)) == rows(fold_reactions(log))


def test_rows_held_are_not_counted(spark, tmp_path):
    """Their number would cost a look-up for each row written, so the store reports none; the state is whole all the same."""
    source, checkpoint, log = str(tmp_path / "in"), str(tmp_path / "check"), events(spark, 400)
    log.repartition(2).write.parquet(source)
    query = reaction_stream(spark, [source], checkpoint, files_per_batch=1)
    query.awaitTermination()
    assert all(p["stateOperators"][0]["numRowsTotal"] <= 0 for p in query.recentProgress if p["stateOperators"])
    assert rows(current_reactions(spark, checkpoint)) == rows(fold_reactions(log))


def line(i, **fields):
    return json.dumps({"url": f"{BASE}/theatre/t-1/p-{i}.html", "title": f"T{i}"} | fields)


def test_ingest(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "works")
    source.mkdir()

    def run(now=NOW):
        version = ingest_run(spark, {"a": str(source)}, root, now, files_per_batch=1)
        return version, {r.title: (r.venue, r.created_at, r.updated_at) for r in catalog.scan_works(spark, root).collect()}

    (source / "b.jsonl").write_text(line(3) + "\n{oops")
    assert ingest_run(spark, {"a": str(source)}, root, NOW) is None
    (source / "a.jsonl").write_text(line(1, venue="V") + "\r\n\n" + line(2))
    assert run() == (1, {"T1": ("V", NOW, NOW), "T2": (None, NOW, NOW)})
    (source / "c.jsonl").write_text(line(1) + "\n" + line(4))
    want = {"T1": ("V", NOW, LATER), "T2": (None, NOW, NOW), "T4": (None, LATER, LATER)}
    assert run(LATER)[1] == want == run(LATER)[1]
    rejected = rejected_lines(checked_rows(spark, [f"{root}-ingest/checked/a"])).collect()
    assert [(r.line_no, r.issues) for r in rejected] == [(2, ["root: invalid JSON"])]


def test_two_folders_feed_one_catalog(spark, tmp_path):
    """Nothing of either is lost, rejects name their files; a url that a file repeats refuses the file."""
    root, folders = str(tmp_path / "works"), {}
    for name, i in (("a", 1), ("b", 2)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.jsonl").write_text(line(i, title=name))
        (folder / "bad.jsonl").write_text("{oops " + name)
        (folder / "twice.jsonl").write_text(line(9) + "\n" + line(9))
        folders[name] = str(folder)
        ingest_run(spark, folders, root, NOW)
    assert {r.title for r in catalog.scan_works(spark, root).collect()} == {"a", "b"}
    rejected = rejected_lines(checked_rows(spark, [f"{root}-ingest/checked/{n}" for n in folders]))
    assert sorted((r.file.rsplit("/", 1)[1], r.line_no) for r in rejected.collect()) == [("bad.jsonl", 1)] * 2 + [("twice.jsonl", 2)] * 2


def test_a_catalog_before_the_stream_is_kept(spark):
    """Its ids and times stay, its values where the files have none."""
    stamp = datetime(2025, 1, 1)
    old = {"id": "7", "title": "Alt", "section": "cinema", "venue": "Haus", "source_url": f"{BASE}/theatre/t-1/p-1.html", "created_at": stamp, "updated_at": stamp}
    other = old | {"id": "8", "source_url": "u"}
    base = spark.createDataFrame([tuple(r.get(c) for c in WORKS.names) for r in (old, other)], WORKS)
    files = spark.createDataFrame([("f", line(1)), ("g", line(1, title="Neu", category="K"))], "file string, value string")
    found = {r.id: r for r in ingested_works(check_files(files, NOW), base).collect()}
    assert set(found) == {"7", "8"} and (found["8"].title, found["8"].updated_at) == ("Alt", stamp)
    assert (found["7"].title, found["7"].venue, found["7"].category, found["7"].created_at, found["7"].updated_at) == ("Neu", "Haus", "K", stamp, NOW)


@pytest.mark.parametrize("count", [0, 3])
def test_checked_rows_of_odd_files(spark, count):
    """Blank files and missing folders give no rows."""
    files = spark.createDataFrame([(f"f{i}", " \n\t\r\n") for i in range(count)], "file string, value string")
    assert check_files(files, NOW).count() == 0
    assert ingested_works(checked_rows(spark, ["/tmp/none-of-this-name"])).select(F.count("*")).first()[0] == 0
