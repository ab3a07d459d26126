"""Merges, reactions, friends, read queries: worked cases and brute force."""

import random
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from outings.operators import friends as fo
from outings.operators import merge as mg
from outings.operators import reactions as re_
from outings.operators.quality import reaction_domain_check
from outings.plans import common as cm
from outings.plans import discover as di
from outings.plans import likes as li
from outings.schemas import REACTION_EVENTS, WORKS

NOW = datetime(2026, 3, 12, 10, tzinfo=UTC)
LATER = datetime(2026, 3, 13, 7)


def work(i, **fields):
    row = dict.fromkeys(WORKS.names) | dict(
        id=f"w{i}", title=f"Titre {i}", section="theatre", source_url=f"u{i}",
        created_at=datetime(2026, 1, 1), updated_at=datetime(2026, 1, 1)) | fields
    return tuple(row[n] for n in WORKS.names)


def works(spark, *rows):
    return spark.createDataFrame(list(rows), WORKS)


def batch(spark, *rows):
    return spark.createDataFrame(
        [(r.get("source_url"), r.get("title", "T"), r.get("section", "theatre"), r.get("venue"), r.get("address")) for r in rows],
        "source_url string, title string, section string, venue string, address string")


@pytest.mark.parametrize("threshold", ["10485760", "-1"])  # sent to the catalog / one full outer join
def test_upsert(spark, threshold):
    old = works(spark, work(1, venue="V", address="A", category="c"), work(2))
    new = batch(spark, dict(source_url="u1", title="Neuf", section="cinema", address="B"), dict(source_url="u3", title="Trois"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        once = mg.upsert_works(old, new, LATER)
        got = {r.source_url: r for r in once.collect()}
        twice = mg.upsert_works(once, new, LATER)
        assert sorted(map(str, twice.collect())) == sorted(map(str, got.values()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one, two, three = got["u1"], got["u2"], got["u3"]
    assert (one.id, one.title, one.section, one.venue, one.address, one.category) == ("w1", "Neuf", "cinema", "V", "B", "c")
    assert (one.created_at, one.updated_at) == (datetime(2026, 1, 1), LATER)
    assert two.updated_at == datetime(2026, 1, 1) and len(got) == 3
    assert (three.created_at, three.updated_at, three.venue, len(three.id)) == (LATER, LATER, None, 64)


def test_older_catalog_without_sections(spark):
    got = mg.upsert_works(works(spark, work(1)).drop("section", "duration_min"), batch(spark, dict(source_url="u9")), LATER)
    assert {r.source_url: r.section for r in got.collect()} == {"u1": "theatre", "u9": "theatre"}


def test_fold_batch_is_merging_one_by_one(spark):
    rows = [dict(source_url="u1", title="a", venue="V"), dict(source_url="u1", title="b", address="A"), dict(source_url="u1", title="c")]
    full = mg.shows_to_batch(spark.createDataFrame(
        [(r["source_url"], r["title"], r.get("venue"), r.get("address"), i) for i, r in enumerate(rows)],
        "url string, title string, venue string, address string, n int").withColumns({
            c: F.lit(None).cast("string") for c in ("section", "category", "description", "date_start", "date_end", "image")}).withColumns({
                "duration_min": F.lit(None).cast("int"), "price_min_eur": F.lit(None).cast("double"), "price_max_eur": F.lit(None).cast("double")}))
    row = mg.fold_batch(full, "n").first()
    assert (row.title, row.venue, row.address) == ("c", "V", "A")


def test_seeds(spark):
    old = works(spark, work(1, source_url="seed://le-cid", venue="V", title="x"))
    got = {r.source_url: r for r in mg.seed_works(old, mg.default_seeds(spark), LATER).collect()}
    assert len(got) == 3 and (got["seed://le-cid"].title, got["seed://le-cid"].venue) == ("Le Cid", "V")


def events(spark, n=4000, seed=1, users=20, wks=40):
    """Half of all rows belong to one pair of user and work."""
    rnd = random.Random(seed)
    rows = [("u0", "w0") if rnd.random() < 0.5 else (f"u{rnd.randrange(users)}", f"w{rnd.randrange(wks)}") for _ in range(n)]
    return spark.createDataFrame(
        [(u, w, rnd.choice(["LIKE", "DISLIKE", "SEEN"]), datetime(2026, 1, 1 + rnd.randrange(20), rnd.randrange(24)), i)
         for i, (u, w) in enumerate(rows)], REACTION_EVENTS)


def test_fold_follows_time_not_arrival(spark):
    log = events(spark)
    want = {}
    for r in sorted(log.collect(), key=lambda r: (r.ts, r.seq)):
        first = want.get((r.user_id, r.work_id), (None, r.ts))[1]
        want[r.user_id, r.work_id] = (r.status, first, r.ts)
    late_first = re_.fold_reactions(log.where("seq % 3 <> 0"), re_.fold_reactions(log.where("seq % 3 = 0")))
    for state in (re_.fold_reactions(log), late_first):
        assert {(r.user_id, r.work_id): (r.status, r.created_at, r.updated_at) for r in state.collect()} == want


def test_transitions(spark):
    log = events(spark)
    last, want = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r.ts, r.seq)):
        before = last.get((r.user_id, r.work_id))
        want[r.seq] = (before, before == r.status)
        last[r.user_id, r.work_id] = r.status
    for stretch in ("day", "hour", "year"):
        assert {r.seq: (r.previous, r.already) for r in re_.reaction_transitions(log, stretch).collect()} == want


def test_commands_and_domain(spark):
    log = spark.createDataFrame([("POST", "u", "w", "SEEN", datetime(2026, 1, 1), 1), ("DELETE", "u", "w", None, datetime(2026, 1, 2), 2),
                                 ("POST", "u", "", None, datetime(2026, 1, 2), 3)],
                                "op string, user_id string, work_id string, status string, ts timestamp_ntz, seq long")
    assert [r.status for r in re_.like_commands(log).orderBy("seq").collect()] == ["LIKE", "DISLIKE"]
    rows = spark.createDataFrame([("u", "w", "LIKE"), ("u", "w", "like"), ("", "w", "LIKE"), ("u", None, "SEEN"), ("u", "w", None)],
                                 "user_id string, work_id string, status string")
    good, bad = reaction_domain_check(rows)
    assert (good.count(), bad.count()) == (1, 4)


def test_friend_requests(spark):
    users = spark.createDataFrame([("me", "me@x.example"), ("f", "friend@x.example")], "user_id string, email string")
    asked = spark.createDataFrame([
        ("me", "me@x.example", "me", None), ("me", "me@x.example", "f", None), ("me", "me@x.example", "nobody", None),
        ("me", "me@x.example", None, " Friend@X.example "), ("me", "me@x.example", None, "ME@x.example"), ("me", "me@x.example", None, None)],
        "user_id string, user_email string, friend_user_id string, friend_email string")
    got = fo.resolve_friend_requests(asked, users)
    assert sorted((r.friend_user_id or "", r.friend_email or "", r.outcome, r.friend_id) for r in got.collect()) == [
        ("", "", "friend_not_found", None), ("", " Friend@X.example ", "ok", "f"), ("", "ME@x.example", "cannot_add_self", None),
        ("f", "", "ok", "f"), ("me", "", "cannot_add_self", None), ("nobody", "", "friend_not_found", None)]
    edges = spark.createDataFrame([("me", "f"), ("a", "b")], "user_id string, friend_id string")
    added = fo.add_friendships(edges, got.where("outcome = 'ok'"))
    want = {("me", "f"), ("f", "me"), ("a", "b")}
    assert {tuple(r) for r in added.collect()} == want and added.count() == 3
    assert fo.add_friendships(added, got.where("outcome = 'ok'")).count() == 3


def test_calendar_day():
    assert di.calendar_day(datetime(2026, 3, 12, 23, 30, tzinfo=UTC)) == date(2026, 3, 13)
    assert di.calendar_day(datetime(2026, 3, 12, 10)) == date(2026, 3, 12)


def test_discover(spark):
    rows = works(spark, work(1, end_date=date(2026, 3, 11)), work(2, end_date=date(2026, 3, 12)), work(3), work(4), work(5, section="cinema"),
                 work(6, created_at=datetime(2026, 2, 1)))
    seen = spark.createDataFrame([("me", "w3", "SEEN"), ("other", "w4", "LIKE")], "user_id string, work_id string, status string")
    got = di.discover(rows, seen, "me", NOW)
    assert [r.id for r in got.collect()] == ["w6", "w2", "w4", "w5"] and len(got.columns) == 14
    assert [r.id for r in di.discover(rows, seen, "me", NOW, per=1).collect()] == ["w6"]
    assert [r.id for r in di.discover(rows, seen, None, NOW, section="cinema").collect()] == ["w5"]
    assert di.discover_total(rows, seen, "me", NOW).first().total == 4
    assert [r.id for r in di.discover(rows, seen, "me", NOW, since=datetime(2026, 1, 15)).collect()] == ["w6"]
    for wrong in (dict(per=0), dict(per=201), dict(section="opera"), dict(category=" ")):
        with pytest.raises(ValueError):
            di.discover(rows, seen, "me", NOW, **wrong)


@pytest.mark.parametrize("head", [5000, 7, 0])
def test_decks_match_brute_force(spark, head):
    """Some users reacted to almost everything, so their decks reach past a short head."""
    rnd = random.Random(3)
    n = 60
    rows = [work(i, created_at=datetime(2026, 1, 1 + i % 5), end_date=date(2026, 3, 1 + i % 28)) for i in range(n)]
    current = sorted((r for r in rows if r[WORKS.names.index("end_date")] >= date(2026, 3, 12)),
                     key=lambda r: (-r[WORKS.names.index("created_at")].timestamp(), r[0]))
    share = {"none": 0, "few": 0.1, "half": 0.5, "most": 0.9, "all": 1}
    seen = {u: {f"w{i}" for i in range(n) if rnd.random() < p} for u, p in share.items()}
    users = spark.createDataFrame([(u,) for u in share], "user_id string")
    reactions = spark.createDataFrame([(u, w) for u, ws in seen.items() for w in ws], "user_id string, work_id string")
    got = di.discover_all_users(works(spark, *rows), reactions, users, NOW, per=5, head=head)
    want = {(u, i + 1, r[0]) for u in share for i, r in enumerate([r for r in current if r[0] not in seen[u]][:5])}
    assert {tuple(r) for r in got.select("user_id", "rank", "work_id").collect()} == want
    totals = di.discover_totals_all_users(works(spark, *rows), reactions, users, NOW)
    assert {r.user_id: r.total for r in totals.collect()} == {u: sum(r[0] not in seen[u] for r in current) for u in share}


def test_decks_of_an_empty_offer(spark):
    users = spark.createDataFrame([("u",)], "user_id string")
    none = spark.createDataFrame([], "user_id string, work_id string")
    assert di.discover_all_users(works(spark, work(1, end_date=date(2020, 1, 1))), none, users, NOW).count() == 0


def test_likes(spark):
    rows = works(spark, work(1, end_date=date(2026, 3, 30)), work(2, end_date=date(2026, 3, 11)), work(3))
    reactions = spark.createDataFrame(
        [("me", "w1", "LIKE", datetime(2026, 1, 1)), ("me", "w2", "LIKE", datetime(2026, 1, 3)), ("me", "w3", "SEEN", datetime(2026, 1, 4)),
         ("me", "gone", "LIKE", datetime(2026, 1, 2)), ("x", "w3", "LIKE", datetime(2026, 1, 2))],
        "user_id string, work_id string, status string, created_at timestamp_ntz")
    liked = li.liked_works(reactions, rows, "me")
    assert [(r.work_id, r.title) for r in liked.collect()] == [("w2", "Titre 2"), ("gone", None), ("w1", "Titre 1")]
    assert {r.work_id: r.view for r in li.likes_by_view(liked, NOW).collect()} == {"w1": "active", "w2": "archived", "gone": "active"}
    counts = {r.user_id: (r.total, r.active, r.archived) for r in li.likes_counts(li.liked_rows(reactions, rows), NOW).collect()}
    assert counts == {"me": (3, 2, 1), "x": (1, 1, 0)}


def test_common_likes(spark):
    rows = works(spark, work(1), work(2, created_at=datetime(2026, 2, 1)), work(3))
    reactions = spark.createDataFrame(
        [(u, w, "LIKE") for u, w in [("a", "w1"), ("a", "w2"), ("b", "w1"), ("b", "w2"), ("b", "w3")]] + [("a", "w3", "SEEN")],
        "user_id string, work_id string, status string")
    edges = spark.createDataFrame([("a", "b")], "user_id string, friend_id string")
    assert [r.id for r in cm.common_likes(edges, reactions, rows, "a", "b").collect()] == ["w2", "w1"]
    assert cm.common_likes(edges, reactions, rows, "b", "a").count() == 0
    with pytest.raises(PermissionError):
        cm.common_likes(edges, reactions, rows, "b", "a", strict=True)


def test_common_likes_of_all_pairs_match_brute_force(spark):
    """One user holds a third of the likes and is a friend of everybody."""
    rnd = random.Random(5)
    users = [f"u{i}" for i in range(30)]
    likes = {u: {f"w{i}" for i in range(60) if rnd.random() < (0.9 if u == "u0" else 0.05)} for u in users}
    edges = {(a, b) for a in users for b in users if a != b and (a == "u0" or rnd.random() < 0.2)}
    rows = works(spark, *[work(i) for i in range(55)])
    reactions = spark.createDataFrame([(u, w, "LIKE") for u, ws in likes.items() for w in ws], "user_id string, work_id string, status string")
    got = cm.common_likes_all_pairs(spark.createDataFrame(list(edges), "user_id string, friend_id string"), reactions, rows)
    want = {(a, b, w) for a, b in edges for w in likes[a] & likes[b] if int(w[1:]) < 55}
    result = [tuple(r) for r in got.collect()]
    assert set(result) == want and len(result) == len(want)
    counts = {(r.user_id, r.friend_id): r.common for r in cm.common_likes_counts(got).collect()}
    assert sum(counts.values()) == len(want)
