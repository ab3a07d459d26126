"""Every operator as a query over given tables, with the same question in SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLES[name]`` is SQL over the
same parquet tables. Days and times leave as text so that both sides compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.functions import urls
from outings.functions.labels import card_labels
from outings.functions.text import clean_text
from outings.operators import extract as ex
from outings.operators import friends as fo
from outings.operators import frontier as fr
from outings.operators import merge as mg
from outings.operators import quality as qu
from outings.operators import reactions as re_
from outings.operators.counters import CrawlCounters
from outings.operators.dom import dom_pass
from outings.plans import common as cm
from outings.plans import discover as di
from outings.plans import likes as li
from outings.plans.pipeline import collect_shows
from outings.schemas import CARD_COLUMNS, SHOWS, WORKS, Site
from outings.session import materialize, scratch_dir, spread
from outings.sources import buckets, catalog, histories
from outings.sources import shows as sh
from outings.sources.pages import scan_pages
from outings.sources.seen import SeenLinks
from outings.standin import sql
from outings.standin import tables as st
from outings.streaming.ingest import ingest_run
from outings.streaming.reactions import current_reactions, reaction_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

USER, FRIEND = "7", "1"
CACHE_HOURS = 1440
SHOW_COLUMNS = ", ".join(SHOWS.names)


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: as_text(build(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return register


def as_text(df: DataFrame) -> DataFrame:
    """Days as YYYY-MM-DD, times as YYYY-MM-DD HH:MM:SS, the rest as it is."""

    def shown(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def _sql_text(names: list[str], prefix: str = "") -> str:
    """SQL select list matching ``as_text`` for catalog columns."""
    day = "CAST({0} AS VARCHAR) AS {1}"
    time = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"
    shape = {"start_date": day, "end_date": day, "created_at": time, "updated_at": time, "ts": time, "liked_at": time}
    return ", ".join(shape.get(n, "{0} AS {1}").format(prefix + n, n) for n in names)


CARDS = _sql_text(CARD_COLUMNS)
WORK_COLUMNS = _sql_text(WORKS.names)
CURRENT = f"(end_date IS NULL OR end_date >= {sql.TODAY})"


def _reactions(spark, d):
    return re_.fold_reactions(st.reaction_events(spark, d))


def _with(*parts: str) -> str:
    """Join CTE lists, naming every CTE once."""
    seen, kept = set(), []
    for part in parts:
        for cte in _split(part):
            name = cte.split(" AS (", 1)[0].strip()
            if name not in seen:
                seen.add(name)
                kept.append(cte)
    return "WITH " + ",\n".join(kept) + "\n"


def _split(part: str) -> list[str]:
    out, depth, quoted, last = [], 0, False, 0
    for i, ch in enumerate(part):
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(part[last:i].strip())
                last = i + 1
    return [*out, part[last:].strip()]


# --- reading the catalog -----------------------------------------------------------------


@query("discover", _with(sql.WORKS, sql.REACTIONS) + f"""
SELECT {CARDS} FROM works w WHERE {CURRENT}
  AND NOT EXISTS (SELECT 1 FROM reactions r WHERE r.user_id = '{USER}' AND r.work_id = w.id)
ORDER BY w.created_at DESC, w.id LIMIT 100""")
def _(spark, d):
    return di.discover(st.works(spark, d), _reactions(spark, d), USER, st.AS_OF)


@query("discover_filtered", _with(sql.WORKS, sql.REACTIONS) + f"""
SELECT {CARDS} FROM works w WHERE {CURRENT} AND section = 'cinema' AND category = 'PROMO'
  AND w.created_at >= TIMESTAMP '1995-02-01'
  AND NOT EXISTS (SELECT 1 FROM reactions r WHERE r.user_id = '{USER}' AND r.work_id = w.id)
ORDER BY w.created_at DESC, w.id LIMIT 200""")
def _(spark, d):
    return di.discover(st.works(spark, d), _reactions(spark, d), USER, st.AS_OF, per=200,
                       since=datetime(1995, 2, 1), category=" PROMO ", section="cinema")


@query("discover_total", _with(sql.WORKS, sql.REACTIONS) + f"""
SELECT count(*) AS total FROM works w WHERE {CURRENT}
  AND NOT EXISTS (SELECT 1 FROM reactions r WHERE r.user_id = '{USER}' AND r.work_id = w.id)""")
def _(spark, d):
    return di.discover_total(st.works(spark, d), _reactions(spark, d), USER, st.AS_OF)


@query("discover_all_users", _with(sql.WORKS, sql.REACTIONS, sql.USERS) + f"""
, open_ AS (SELECT id, created_at FROM works WHERE {CURRENT}),
newest AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS nth FROM open_),
reach AS (SELECT u.user_id, count(r.work_id) AS n FROM users u LEFT JOIN reactions r USING (user_id) GROUP BY 1),
free AS (
  SELECT c.user_id, n.id, n.nth FROM reach c JOIN newest n ON n.nth <= 20 + c.n
  WHERE NOT EXISTS (SELECT 1 FROM reactions r WHERE r.user_id = c.user_id AND r.work_id = n.id)
), ranked AS (SELECT user_id, id AS work_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY nth) AS INTEGER) AS rank FROM free)
SELECT user_id, rank, work_id FROM ranked WHERE rank <= 20""")
def _(spark, d):
    return di.discover_all_users(st.works(spark, d), _reactions(spark, d), st.users(spark, d), st.AS_OF, per=20)


@query("discover_all_users_deep", ORACLES["discover_all_users"])
def _(spark, d):
    """Decks that reach past the newest works: none but the first ten is looked up by broadcast."""
    return di.discover_all_users(st.works(spark, d), _reactions(spark, d), st.users(spark, d), st.AS_OF, per=20, head=10)


@query("discover_totals_all_users", _with(sql.WORKS, sql.REACTIONS, sql.USERS) + f"""
, open_ AS (SELECT id FROM works WHERE {CURRENT}),
seen AS (SELECT user_id, count(*) AS n FROM reactions WHERE work_id IN (SELECT id FROM open_) GROUP BY 1)
SELECT user_id, (SELECT count(*) FROM open_) - coalesce(n, 0) AS total FROM users LEFT JOIN seen USING (user_id)""")
def _(spark, d):
    return di.discover_totals_all_users(st.works(spark, d), _reactions(spark, d), st.users(spark, d), st.AS_OF)


@query("filter_current", _with(sql.WORKS) + f"SELECT id, section, CAST(end_date AS VARCHAR) AS end_date FROM works WHERE {CURRENT}")
def _(spark, d):
    return di.filter_current(st.works(spark, d), st.AS_OF).select("id", "section", "end_date")


@query("filter_since", _with(sql.WORKS) + f"""
SELECT {_sql_text(['id', 'created_at'])} FROM works WHERE created_at >= TIMESTAMP '1995-03-01'""")
def _(spark, d):
    return di.filter_since(st.works(spark, d), datetime(1995, 3, 1)).select("id", "created_at")


@query("filter_category", _with(sql.WORKS) + "SELECT id, category FROM works WHERE category = 'SMALL'")
def _(spark, d):
    return di.filter_category(st.works(spark, d), "SMALL").select("id", "category")


@query("filter_section", _with(sql.WORKS) + "SELECT id, section FROM works WHERE section = 'cinema'")
def _(spark, d):
    return di.filter_section(st.works(spark, d), "cinema").select("id", "section")


@query("card_projection", _with(sql.WORKS) + f"SELECT {CARDS} FROM works")
def _(spark, d):
    return di.card_projection(st.works(spark, d))


@query("scan_works", _with(sql.WORKS) + f"SELECT {WORK_COLUMNS} FROM works WHERE section = 'theatre'")
def _(spark, d):
    root = scratch_dir(spark, "works")
    catalog.write_works(st.works(spark, d), root)
    return di.filter_section(catalog.scan_works(spark, root), "theatre")


LIKED = f"""
, liked AS (
  SELECT r.user_id, r.work_id, r.created_at AS liked_at, w.* EXCLUDE (created_at, updated_at)
  FROM reactions r LEFT JOIN works w ON w.id = r.work_id WHERE r.status = 'LIKE'
), viewed AS (SELECT *, CASE WHEN end_date < {sql.TODAY} THEN 'archived' ELSE 'active' END AS "view" FROM liked)"""
LIKED_COLUMNS = ["user_id", "work_id", "liked_at", *[c for c in CARD_COLUMNS if c != "id"]]


@query("liked_works", _with(sql.WORKS, sql.REACTIONS) + LIKED + f"""
SELECT {_sql_text(LIKED_COLUMNS)} FROM liked WHERE user_id = '{USER}'""")
def _(spark, d):
    return li.liked_works(_reactions(spark, d), st.works(spark, d), USER)


@query("liked_works_by_user", ORACLES["liked_works"])
def _(spark, d):
    """The reactions lie clustered by user; of them the user's row groups are read."""
    path, reactions = scratch_dir(spark, "by-user"), _reactions(spark, d)
    histories.write_by_user(reactions, path, then="work_id")
    return li.liked_works(histories.read_by_user(spark, path, reactions.schema), st.works(spark, d), USER)


@query("likes_by_view", _with(sql.WORKS, sql.REACTIONS) + LIKED + """
SELECT user_id, work_id, title, CAST(end_date AS VARCHAR) AS end_date, "view" FROM viewed""")
def _(spark, d):
    liked = li.liked_rows(_reactions(spark, d), st.works(spark, d), ["id", "title", "end_date"])
    return li.likes_by_view(liked, st.AS_OF).drop("liked_at")


@query("likes_counts", _with(sql.WORKS, sql.REACTIONS) + LIKED + """
SELECT user_id, count(*) AS total, count(*) FILTER ("view" = 'active') AS active,
       count(*) FILTER ("view" = 'archived') AS archived FROM viewed GROUP BY 1""")
def _(spark, d):
    return li.likes_counts(li.liked_rows(_reactions(spark, d), st.works(spark, d), ["id", "end_date"]), st.AS_OF)


@query("friends_list", _with(sql.FRIENDS, sql.USERS) + """
SELECT f.user_id, f.friend_id, u.email FROM friendships f JOIN users u ON u.user_id = f.friend_id""")
def _(spark, d):
    return cm.friends_list(st.friendships(spark, d), st.users(spark, d))


@query("friends_list_one", _with(sql.FRIENDS, sql.USERS) + f"""
SELECT f.friend_id, u.email FROM friendships f JOIN users u ON u.user_id = f.friend_id WHERE f.user_id = '{USER}'""")
def _(spark, d):
    return cm.friends_list(st.friendships(spark, d), st.users(spark, d), USER)


@query("common_likes", _with(sql.WORKS, sql.REACTIONS, sql.FRIENDS) + f"""
SELECT {CARDS} FROM works w
WHERE EXISTS (SELECT 1 FROM friendships WHERE user_id = '{USER}' AND friend_id = '{FRIEND}')
  AND id IN (SELECT work_id FROM reactions WHERE status = 'LIKE' AND user_id = '{USER}')
  AND id IN (SELECT work_id FROM reactions WHERE status = 'LIKE' AND user_id = '{FRIEND}')""")
def _(spark, d):
    return cm.common_likes(st.friendships(spark, d), _reactions(spark, d), st.works(spark, d), USER, FRIEND)


COMMON = """
, common AS (
  SELECT f.user_id, f.friend_id, a.work_id FROM friendships f
  JOIN reactions a ON a.user_id = f.user_id AND a.status = 'LIKE'
  JOIN reactions b ON b.user_id = f.friend_id AND b.work_id = a.work_id AND b.status = 'LIKE'
)"""


@query("common_likes_all_pairs", _with(sql.WORKS, sql.REACTIONS, sql.FRIENDS) + COMMON + """
SELECT c.user_id, c.friend_id, c.work_id, w.title FROM common c JOIN works w ON w.id = c.work_id""")
def _(spark, d):
    works = st.works(spark, d)
    pairs = cm.common_likes_all_pairs(st.friendships(spark, d), _reactions(spark, d), works)
    return di.with_cards(pairs, works, ["title"])


@query("common_likes_counts", _with(sql.REACTIONS, sql.FRIENDS) + COMMON + """
SELECT user_id, friend_id, count(*) AS common FROM common GROUP BY 1, 2""")
def _(spark, d):
    return cm.common_likes_counts(
        cm.common_likes_all_pairs(st.friendships(spark, d), _reactions(spark, d), st.works(spark, d)))


@query("common_likes_counts_words", ORACLES["common_likes_counts"])
def _(spark, d):
    """The same counts from words of 64 works each, without a row per common work."""
    return cm.common_likes_counts_all_pairs(st.friendships(spark, d), _reactions(spark, d), st.works(spark, d))


@query("discover_all_users_blocks", ORACLES["discover_all_users"])
def _(spark, d):
    """Blocks so small that every user's history fills several."""
    return di.discover_all_users(st.works(spark, d), _reactions(spark, d), st.users(spark, d), st.AS_OF, per=20, block=20)


@query("reaction_lookup", _with(sql.REACTIONS) + """
SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey % 200 AS VARCHAR) AS work_id, r.status
FROM orders LEFT JOIN reactions r ON r.user_id = CAST(o_custkey AS VARCHAR) AND r.work_id = CAST(o_orderkey % 200 AS VARCHAR)""")
def _(spark, d):
    keys = st.table(spark, d, "orders").select(
        st.text_of("o_custkey").alias("user_id"), st.text_of(F.col("o_orderkey") % 200).alias("work_id"))
    return re_.reaction_lookup(_reactions(spark, d), keys)


# --- merges ----------------------------------------------------------------------------------


@query("fold_reactions", _with(sql.REACTIONS) + f"""
SELECT user_id, work_id, status, {_sql_text(['created_at', 'updated_at'])}, last_seq FROM reactions""")
def _(spark, d):
    return _reactions(spark, d)


@query("fold_reactions_incremental", ORACLES["fold_reactions"])
def _(spark, d):
    events = st.reaction_events(spark, d)
    state = re_.fold_reactions(events.where("seq % 3 = 0"))
    return re_.fold_reactions(events.where("seq % 3 <> 0"), state)


@query("reaction_transitions", _with(sql.EVENTS) + f"""
, moved AS (SELECT *, lag(status) OVER (PARTITION BY user_id, work_id ORDER BY ts, seq, status) AS previous FROM events_)
SELECT user_id, work_id, status, {_sql_text(['ts'])}, seq, previous, coalesce(previous = status, false) AS already FROM moved""")
def _(spark, d):
    return re_.reaction_transitions(st.reaction_events(spark, d))


@query("like_commands", _with(sql.EVENTS) + f"""
SELECT user_id, work_id, CASE WHEN seq % 10 = 1 THEN 'DISLIKE' ELSE 'LIKE' END AS status, {_sql_text(['ts'])}, seq
FROM events_ WHERE seq % 10 <> 2""")
def _(spark, d):
    op = F.when(F.col("seq") % 10 == 1, "DELETE").otherwise("POST")
    log = st.reaction_events(spark, d).withColumn("op", op).withColumn(
        "work_id", F.when(F.col("seq") % 10 == 2, "").otherwise(F.col("work_id")))
    return re_.like_commands(log)


@query("reaction_domain_check", _with(sql.EVENTS) + """
SELECT user_id, status, count(*) AS n, false AS accepted FROM (
  SELECT user_id, CASE WHEN seq % 10 = 1 THEN 'MAYBE' ELSE status END AS status FROM events_) WHERE status = 'MAYBE' GROUP BY 1, 2
UNION ALL SELECT user_id, status, count(*), true FROM events_ WHERE seq % 10 <> 1 GROUP BY 1, 2""")
def _(spark, d):
    events = st.reaction_events(spark, d).withColumn(
        "status", F.when(F.col("seq") % 10 == 1, "MAYBE").otherwise(F.col("status")))
    good, bad = qu.reaction_domain_check(events)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("user_id", "status", "accepted").agg(F.count("*").alias("n"))


def _requests(spark, d):
    """Every customer asks for another one by address, by id, for themselves, or for nobody known."""
    key = F.col("c_custkey")
    target = st.text_of(F.floor(key / 2).cast("bigint"))
    email = F.concat(F.lit(" CUSTOMER#"), F.lpad(target, 9, "0"), F.lit("@people.example "))
    return st.table(spark, d, "customer").select(
        st.text_of("c_custkey").alias("user_id"),
        F.concat(F.lower("c_name"), F.lit("@people.example")).alias("user_email"),
        F.when(key % 3 == 0, F.when(key % 4 == 0, st.text_of("c_custkey")).otherwise(target)).alias("friend_user_id"),
        F.when(key % 3 == 1, email).when(key % 3 == 2, "nobody@people.example").alias("friend_email"))


REQUESTS = """requests AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_custkey AS k,
         CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 THEN c_custkey
              ELSE c_custkey // 2 END AS target FROM customer
), resolved AS (
  SELECT user_id, CASE WHEN target = k THEN 'cannot_add_self' WHEN c_custkey IS NULL THEN 'friend_not_found' ELSE 'ok' END AS outcome,
         CASE WHEN target <> k THEN CAST(c_custkey AS VARCHAR) END AS friend_id
  FROM requests LEFT JOIN customer ON c_custkey = target
)"""


@query("resolve_friend_requests", _with(REQUESTS) + "SELECT user_id, friend_id, outcome FROM resolved")
def _(spark, d):
    return fo.resolve_friend_requests(_requests(spark, d), st.users(spark, d)).select("user_id", "friend_id", "outcome")


@query("add_friendships", _with(REQUESTS, sql.FRIENDS) + """
SELECT user_id, friend_id FROM friendships
UNION SELECT user_id, friend_id FROM resolved WHERE outcome = 'ok'
UNION SELECT friend_id, user_id FROM resolved WHERE outcome = 'ok'""")
def _(spark, d):
    resolved = fo.resolve_friend_requests(_requests(spark, d), st.users(spark, d))
    return fo.add_friendships(st.friendships(spark, d), resolved.where("outcome = 'ok'").select("user_id", "friend_id"))


MERGED = f"""
, existing AS (SELECT * FROM works WHERE p_partkey % 5 <> 0),
incoming AS (
  SELECT title || ' (reprise)' AS title, section, category, CASE WHEN duration_min % 2 <> 0 THEN venue END AS venue,
         address, description, start_date, CAST(end_date + 30 AS DATE) AS end_date,
         CASE WHEN duration_min % 5 <> 0 THEN duration_min + 1 END AS duration_min,
         price_min, price_max, image_url, source_url FROM works WHERE p_partkey % 3 <> 1
), merged AS (
  SELECT coalesce(o.id, sha256(n.source_url)) AS id, coalesce(n.title, o.title) AS title, coalesce(n.section, o.section) AS section,
         coalesce(n.category, o.category) AS category, coalesce(n.venue, o.venue) AS venue,
         coalesce(n.address, o.address) AS address, coalesce(n.description, o.description) AS description,
         coalesce(n.start_date, o.start_date) AS start_date, coalesce(n.end_date, o.end_date) AS end_date,
         coalesce(n.duration_min, o.duration_min) AS duration_min, coalesce(n.price_min, o.price_min) AS price_min,
         coalesce(n.price_max, o.price_max) AS price_max, coalesce(n.image_url, o.image_url) AS image_url,
         coalesce(o.source_url, n.source_url) AS source_url,
         coalesce(o.created_at, TIMESTAMP '2001-09-08 07:00:00') AS created_at,
         CASE WHEN n.source_url IS NULL THEN o.updated_at ELSE TIMESTAMP '2001-09-08 07:00:00' END AS updated_at
  FROM existing o FULL OUTER JOIN incoming n ON o.source_url = n.source_url
)
SELECT {WORK_COLUMNS} FROM merged"""


@query("upsert_works", _with(sql.WORKS) + MERGED)
def _(spark, d):
    return mg.upsert_works(st.existing_works(spark, d), st.incoming_works(spark, d), st.NOW)


@query("upsert_works_bucketed", ORACLES["upsert_works"])
def _(spark, d):
    """The catalog lies in buckets of its urls; the batch comes in two halves, each of which replaces the buckets it touches."""
    root, new = scratch_dir(spark, "buckets"), st.incoming_works(spark, d)
    buckets.replace_buckets(st.existing_works(spark, d), root, 64)
    for half in (0, 1):
        buckets.merge_buckets(spark, root, new.where(F.pmod(F.xxhash64("source_url"), F.lit(64)) % 2 == half), st.NOW, 64)
    return buckets.scan_buckets(spark, root, 64)


@query("fold_batch", _with(sql.WORKS, "rows_ AS (SELECT *, o_orderkey AS k FROM works JOIN (SELECT o_orderkey, o_custkey FROM orders) ON p_partkey = o_custkey)") + """
SELECT source_url, arg_max(title || k, k) AS title, arg_max(section, k) AS section,
       arg_max(category, k) FILTER (k % 3 = 0) AS category, arg_max(duration_min + k, k) FILTER (k % 2 = 0) AS duration_min
FROM rows_ GROUP BY 1""")
def _(spark, d):
    orders = st.table(spark, d, "orders").select("o_orderkey", st.text_of("o_custkey").alias("id"))
    k = F.col("o_orderkey")
    batch = st.works(spark, d).join(orders, "id").withColumns({
        "title": F.concat("title", st.text_of("o_orderkey")), "category": F.when(k % 3 == 0, F.col("category")),
        "duration_min": F.when(k % 2 == 0, F.col("duration_min") + k)})
    return mg.fold_batch(batch, "o_orderkey").select("source_url", "title", "section", "category", "duration_min")


@query("seed_works", _with(sql.WORKS) + f"""
, seeds AS (SELECT * FROM (VALUES ('Le Cid', 'seed://le-cid'), ('Dom Juan', 'seed://dom-juan'),
                                  ('Le Misanthrope', 'seed://misanthrope')) s(title, source_url)
  UNION ALL SELECT title || ' (seed)', source_url FROM works WHERE p_partkey % 9 = 0)
SELECT coalesce(w.id, sha256(s.source_url)) AS id, coalesce(s.title, w.title) AS title,
       CASE WHEN s.title IS NULL THEN w.section ELSE 'theatre' END AS section,
       CASE WHEN s.title IS NULL THEN w.category ELSE 'théâtre' END AS category, w.venue, w.duration_min,
       coalesce(w.source_url, s.source_url) AS source_url
FROM works w FULL OUTER JOIN seeds s ON s.source_url = w.source_url""")
def _(spark, d):
    works = st.works(spark, d)
    again = works.where("CAST(id AS BIGINT) % 9 = 0").select(
        F.concat("title", F.lit(" (seed)")).alias("title"), F.lit("theatre").alias("section"),
        F.lit("théâtre").alias("category"), "source_url")
    seeds = mg.default_seeds(spark).unionByName(again)
    return mg.seed_works(works, seeds, st.NOW).select("id", "title", "section", "category", "venue", "duration_min", "source_url")


# --- frontier -----------------------------------------------------------------------------------

FIRSTS = """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY section = 'cinema', page, pos) AS rn FROM links),
firsts AS (SELECT section, page, pos, url, text FROM numbered WHERE rn = 1)"""

# Pages that gave links, as counted from their first-seen links.
COUNTS = """
, counts AS (
  SELECT l.section, l.page, true AS ok, count(DISTINCT f.url) AS n_new
  FROM (SELECT DISTINCT section, page FROM links) l LEFT JOIN firsts f USING (section, page) GROUP BY 1, 2
), stops AS (SELECT section, min(page) AS stop FROM counts WHERE page > 1 AND n_new = 0 GROUP BY 1)"""


@query("first_seen_links", _with(sql.LINKS) + FIRSTS + "SELECT section, page, pos, url, text FROM firsts")
def _(spark, d):
    return fr.first_seen_links(st.frontier_links(spark, d))


@query("first_seen_links_over_runs", _with(sql.LINKS) + FIRSTS + "SELECT section, page, pos, url, text FROM firsts")
def _(spark, d):
    """Two crawls, of odd and of even pages, the second one run twice, add to a set in buckets."""
    links = st.frontier_links(spark, d)
    seen = SeenLinks(spark, scratch_dir(spark, "seen"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for run in (1, 0, 0):
        seen.add(links.where(F.col("page") % 2 == run), f"run {run}")
    return seen.links()


@query("unseen_links", _with(sql.LINKS) + FIRSTS + """
SELECT section, page, pos, url, text FROM firsts WHERE url NOT IN (SELECT url FROM links WHERE page <= 10 AND url IS NOT NULL)""")
def _(spark, d):
    """What a crawl of all pages finds that one of the first ten pages of each section had not."""
    links = st.frontier_links(spark, d)
    seen = SeenLinks(spark, scratch_dir(spark, "seen"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen.add(links.where(F.col("page") <= 10), "first pages")
    return seen.add(links, "all pages")


def _page_counts(spark, d):
    links = st.frontier_links(spark, d)
    new = fr.first_seen_links(links).groupBy("section", "page").agg(F.count("*").alias("n_new"))
    pages = links.select("section", "page").distinct().withColumn("ok", F.lit(True))
    return pages.join(new, ["section", "page"], "left").fillna(0, ["n_new"])


@query("pagination_cutoff", _with(sql.LINKS) + FIRSTS + COUNTS + """
SELECT section, page, ok, n_new FROM counts LEFT JOIN stops USING (section) WHERE stop IS NULL OR page <= stop""")
def _(spark, d):
    return fr.pagination_cutoff(_page_counts(spark, d))


@query("listing_urls", _with(sql.LINKS) + f"""
, asked AS (SELECT section, greatest(1, least(max(page), 199)) AS n FROM links GROUP BY 1),
pages_ AS (SELECT section, CAST(unnest(generate_series(1, n)) AS INTEGER) AS page FROM asked)
SELECT section, page, CASE WHEN section = 'theatre' THEN '{sql.BASE}/theatre/programme.html' || CASE WHEN page > 1 THEN '?npage=' || page ELSE '' END
  ELSE '{sql.BASE}/cinema/programme.html?rubrique=cinema&origine=homepage_rubrique&DateDebut=&DateFin=&NbDay=&arrondissment=&arrondissment=&GenreCinema='
       || CASE WHEN page > 1 THEN '&npage=' || page ELSE '' END END AS url FROM pages_""")
def _(spark, d):
    asked = st.frontier_links(spark, d).groupBy("section").agg(F.max("page").alias("max_pages"))
    return fr.listing_urls(asked)


STALE = f"(epoch(TIMESTAMP '2001-09-07 22:30:00' - CAST(c.crawled_day AS TIMESTAMP)) > {CACHE_HOURS} * 3600)"
COMPLETE = "(c.title <> '' AND c.description <> '' AND (c.section = 'cinema' OR (c.category <> '' AND c.venue <> '')))"
PLAN = f"CASE WHEN c.url IS NULL OR NOT coalesce({COMPLETE}, false) OR {STALE} THEN 'fetch' ELSE 'reuse' END"


def _frontier(spark, d):
    return fr.first_seen_links(st.frontier_links(spark, d)).withColumnRenamed("text", "title")


@query("refresh_plan", _with(sql.LINKS, sql.CACHE) + FIRSTS + f"""
SELECT f.url, f.section, f.text AS title, {PLAN} AS action FROM firsts f LEFT JOIN cache c ON c.url = f.url""")
def _(spark, d):
    seeds = _frontier(spark, d).select("url", "section", "title")
    return fr.refresh_plan(seeds, st.cache(spark, d), st.AS_OF, CACHE_HOURS)


@query("refresh_plan_large_cache", ORACLES["refresh_plan"])
def _(spark, d):
    """The cache holds four older entries of every url and of as many urls that nobody asks for."""
    seeds, cache = _frontier(spark, d).select("url", "section", "title"), st.cache(spark, d)
    old = cache.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumns({
        "crawled_at": F.lit("1970-01-01T00:00:00Z"), "title": F.lit("ancien")})
    others = old.withColumn("url", F.concat("url", F.lit("?autre="), st.text_of("n")))
    return fr.refresh_plan(seeds, cache.unionByName(old.drop("n")).unionByName(others.drop("n")), st.AS_OF, CACHE_HOURS, large_cache=True)


@query("merge_seed_cache", _with(sql.LINKS, sql.CACHE) + FIRSTS + f"""
SELECT {", ".join("c." + n for n in SHOWS.names if n != "title")},
       CASE WHEN p_partkey % 10 = 1 THEN f.text ELSE c.title END AS title
FROM firsts f JOIN (SELECT cache.*, p_partkey FROM cache JOIN works ON source_url = url) c ON c.url = f.url""")
def _(spark, d):
    gap = F.regexp_extract("url", r"-(\d+)\.html$", 1).cast("bigint") % 10 == 1
    cache = st.cache(spark, d).withColumns({
        "title": F.when(~gap, F.col("title")), "section": F.when(gap, "").otherwise(F.col("section"))})
    return fr.merge_seed_cache(_frontier(spark, d), cache)


@query("crawl_stats", _with(sql.LINKS, sql.CACHE) + FIRSTS + COUNTS + f"""
, planned AS (SELECT {PLAN} AS action, f.pos % 5 <> 0 AS valid FROM firsts f LEFT JOIN cache c ON c.url = f.url)
SELECT (SELECT count(*) FROM counts WHERE page % 7 <> 0) AS pages_crawled, (SELECT count(*) FROM counts WHERE page % 7 = 0) AS pages_failed,
       count(*) FILTER (valid) AS shows_extracted, count(*) FILTER (action = 'fetch') AS shows_completed,
       count(*) FILTER (NOT valid) AS invalid_shows, (SELECT count(*) FROM cache) AS cached_loaded,
       count(*) FILTER (action = 'reuse') AS cached_reused, count(*) FILTER (action = 'fetch') AS detail_fetches FROM planned""")
def _(spark, d):
    pages = st.frontier_links(spark, d).select("section", "page").distinct().withColumn("ok", F.col("page") % 7 != 0)
    cache = st.cache(spark, d)
    plan = fr.refresh_plan(_frontier(spark, d), cache, st.AS_OF, CACHE_HOURS)
    return fr.crawl_stats(pages, plan.select("action", (F.col("pos") % 5 != 0).alias("valid")), cache)


@query("crawl_stats_observed", ORACLES["crawl_stats"])
def _(spark, d):
    """The same counters, taken while the three tables are written."""
    pages = st.frontier_links(spark, d).select("section", "page").distinct().withColumn("ok", F.col("page") % 7 != 0)
    cache, counters = st.cache(spark, d), CrawlCounters()
    plan = fr.refresh_plan(_frontier(spark, d), cache, st.AS_OF, CACHE_HOURS).withColumn("valid", F.col("pos") % 5 != 0)
    for name, table in (("pages", counters.of_pages(pages)), ("plan", counters.of_outcomes(plan)), ("cache", counters.of_cache(cache))):
        table.write.parquet(scratch_dir(spark, f"crawl-{name}"))
    return counters.row(spark)


# --- stored pages ------------------------------------------------------------------------------


def _stored(spark, d):
    return scan_pages(spark, f"{d}/pages.parquet")


@query("scan_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages WHERE html <> ''")
def _(spark, d):
    return _stored(spark, d).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


LINK_SQL = """WITH found AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 2)) AS raw FROM pages
), links AS (SELECT page_id, href, replace(raw, '&amp;', '&') AS text FROM found)
"""


@query("extract_links", LINK_SQL + "SELECT page_id, href, text FROM links WHERE NOT regexp_full_match(text, '[0-9]+')")
def _(spark, d):
    return fr.extract_links(_stored(spark, d)).drop("pos")


WEB = Site(base_url="https://www.example.com", detail_paths={"theatre": r"^/[a-zà-ÿ]{3,6}$", "cinema": r"^/[A-ZÀ-Ý][^/]*$"})


@query("normalize_show_url", LINK_SQL + r"""
, both_ AS (SELECT *, unnest(['theatre', 'cinema']) AS section FROM links)
SELECT page_id, href, section, CASE
  WHEN section = 'theatre' AND regexp_full_match(href, '/[a-zà-ÿ]{3,6}') THEN 'https://www.example.com' || href
  WHEN section = 'cinema' AND regexp_full_match(href, '/[A-ZÀ-Ý][^/?#;]*') THEN 'https://www.example.com' || href END AS url
FROM both_ WHERE NOT regexp_full_match(text, '[0-9]+')""")
def _(spark, d):
    links = fr.extract_links(_stored(spark, d)).withColumn(
        "section", F.explode(F.array(F.lit("theatre"), F.lit("cinema"))))
    return fr.normalize_show_url(links, WEB).drop("pos", "text")


@query("page_urls", """
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean_url,
       regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+', '') AS path,
       regexp_replace(url, '[?#].*$', '') || '?' || CASE WHEN url LIKE '%?%' THEN regexp_replace(regexp_replace(url, '^[^?]*[?]', ''), 'page=2&', '') || '&' ELSE '' END
         || 'page=' || page_id || CASE WHEN url LIKE '%#%' THEN regexp_replace(url, '^[^#]*', '') ELSE '' END AS next_url FROM pages""")
def _(spark, d):
    return _stored(spark, d).select(
        "page_id", urls.without_query(F.col("url")).alias("clean_url"), urls.path_of(F.col("url")).alias("path"),
        urls.with_query_param(F.col("url"), "page", st.text_of("page_id")).alias("next_url"))


@query("dom_pass", """
SELECT page_id, CAST((length(html) - length(replace(html, '<a href', ''))) // 7 AS INTEGER) AS n_links,
  CAST((length(html) - length(replace(html, '<h1>', ''))) // 4 AS INTEGER) AS n_headings, true AS parsed FROM pages""")
def _(spark, d):
    def count(tag):
        return F.size(F.filter("nodes", lambda n: n["tag"] == tag))
    return dom_pass(_stored(spark, d)).select("page_id", count("a").alias("n_links"), count("h1").alias("n_headings"), "parsed")


# --- detail pages --------------------------------------------------------------------------------


def _dom(spark, d, section: str | None = None):
    dom = ex.with_show_columns(dom_pass(st.rendered_pages(spark, d)))
    dom = dom.withColumn("section", urls.section_by_path(F.col("url")))
    return dom if section is None else dom.where(F.col("section") == section)


RENDERED = _with(sql.RENDERED)


def _extracted(name: str, step: str, columns: list[str], select: str | None = None, where: str = "true", section=None):
    shown = select or ", ".join(columns)

    @query(name, RENDERED + f"SELECT p_partkey AS page_id, {shown} FROM rendered WHERE {where}")
    def _(spark, d):
        return getattr(ex, step)(_dom(spark, d, section)).select("page_id", *columns)


_T, _C = dict(where="NOT cinema", section="theatre"), dict(where="cinema", section="cinema")
_extracted("extract_core", "extract_core", ["title", "image"])
_extracted("extract_description", "extract_description", ["description"])
_extracted("venue_from_url", "venue_from_url", ["venue"],
           "'Lieu De ' || upper(split_part(url, '-', 3)[1]) || split_part(url, '-', 3)[2:] AS venue", **_T)
_extracted("venue_from_breadcrumb", "venue_from_breadcrumb", ["venue"],
           "CASE WHEN p_partkey % 2 = 0 THEN venue END AS venue", **_T)
_extracted("extract_address", "extract_address", ["address"], **_T)
_extracted("theatre_dates", "theatre_dates", ["date_start", "date_end"], "s AS date_start, e AS date_end", **_T)
_extracted("jsonld_dates", "jsonld_dates", ["date_start", "date_end"], """
  CASE WHEN p_partkey % 14 >= 7 THEN strftime(d1, '%Y-%m-%d') END AS date_start,
  CASE WHEN p_partkey % 14 >= 7 THEN strftime(d2, '%Y-%m-%d') END AS date_end""", **_T)
_extracted("extract_prices", "extract_prices", ["price_min_eur", "price_max_eur"], **_T)
_extracted("extract_duration", "extract_duration", ["duration_min"], **_T)
_extracted("cinema_category", "cinema_category", ["category"], **_C)
_extracted("cinema_release_date", "cinema_release_date", ["date_start"], **_C)
_extracted("cinema_duration", "cinema_duration", ["duration_min"], **_C)


@query("theatre_category", RENDERED + "SELECT p_partkey AS page_id, category FROM rendered WHERE NOT cinema")
def _(spark, d):
    return ex.theatre_category(ex.extract_description(_dom(spark, d, "theatre"))).select("page_id", "category")


@query("parse_date_range", RENDERED + "SELECT p_partkey AS page_id, s AS start, e AS \"end\" FROM rendered WHERE NOT cinema")
def _(spark, d):
    from outings.functions.dates import parse_date_range
    dom = _dom(spark, d, "theatre").select("page_id", F.explode("nodes").alias("n"), "text").where("n.class = 'dates'")
    text = F.substr("text", F.col("n.start") + 1, F.col("n.stop") - F.col("n.start"))
    return dom.select("page_id", parse_date_range(text).alias("r")).select("page_id", "r.start", "r.end")


@query("extract_shows", RENDERED + f"SELECT {SHOW_COLUMNS.replace('crawled_at', 'CAST(NULL AS VARCHAR) AS crawled_at')} FROM rendered")
def _(spark, d):
    return ex.extract_shows(st.rendered_pages(spark, d))


@query("extract_shows_recrawled", ORACLES["extract_shows"])
def _(spark, d):
    """Every page is stored twice, an older version with another title before it."""
    pages = st.rendered_pages(spark, d)
    old = pages.withColumns({"page_id": F.col("page_id") - (1 << 40), "html": F.replace("html", F.lit("<h1>"), F.lit("<h1>Ancien "))})
    return ex.extract_shows(pages.unionByName(old))


@query("given_titles", r"""
SELECT page_id, nullif(trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""")
def _(spark, d):
    """The given pages, none of which this package wrote."""
    return ex.extract_core(ex.with_show_columns(dom_pass(st.table(spark, d, "pages")))).select("page_id", "title")


@query("collect_shows", RENDERED + """
, swapped AS (
  SELECT *, CASE WHEN date_end < date_start THEN date_end ELSE date_start END AS a,
         CASE WHEN date_end < date_start THEN date_start ELSE date_end END AS b
  FROM (SELECT * REPLACE (
          CASE WHEN try_cast(date_start AS DATE) IS NULL THEN NULL ELSE date_start END AS date_start,
          CASE WHEN try_cast(date_end AS DATE) IS NULL THEN NULL ELSE date_end END AS date_end) FROM rendered)
)
SELECT url, 'Fiche ' || p_partkey AS title, section, category, venue, address, a AS date_start, b AS date_end, duration_min,
       price_min_eur, price_max_eur, image, description FROM swapped""")
def _(spark, d):
    """Listing pages of fifty links each are rendered from the parts, then read with their detail pages."""
    details = st.rendered_pages(spark, d)
    anchor = F.concat(F.lit('<a href="'), "url", F.lit('?x=1#top">Fiche '), st.text_of("page_id"), F.lit("</a>"))
    listings = (
        details.select(st.section_of("page_id").alias("section"), (F.floor(F.col("page_id") / 50) + 1).cast("int").alias("page"),
                       anchor.alias("a"))
        .groupBy("section", "page").agg(F.array_join(F.collect_list("a"), " ").alias("links"))
        .select("section", "page", (F.col("page") * 2 + (F.col("section") == "cinema").cast("int")).cast("bigint").alias("page_id"),
                F.lit("").alias("url"), F.concat(F.lit("<html><body>"), "links", F.lit('<a href="?npage=2">2</a></body></html>')).alias("html"))
    )
    none = spark.createDataFrame([], SHOWS)
    return collect_shows(listings, details, none, st.AS_OF).shows.drop("crawled_at")


# --- gates -----------------------------------------------------------------------------------------


@query("clean_text", r"""
SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM documents""")
def _(spark, d):
    return clean_text(spread(st.table(spark, d, "documents")).select("doc_id", "text"), ["text"])


@query("infer_section_by_path", _with(sql.DIRTY) + "SELECT url, coalesce(given_section, path_section) AS section FROM dirty")
def _(spark, d):
    return qu.infer_section_by_path(st.dirty_shows(spark, d).select("url", "section"))


@query("infer_section_by_contains", _with(sql.DIRTY) + "SELECT url, coalesce(given_section, path_section, 'theatre') AS section FROM dirty")
def _(spark, d):
    return qu.infer_section_by_contains(st.dirty_shows(spark, d).select("url", "section"))


@query("validate_shows", _with(sql.DIRTY) + f"SELECT {SHOW_COLUMNS} FROM judged WHERE reason IS NULL")
def _(spark, d):
    return qu.validate_shows(st.dirty_shows(spark, d))[0]


@query("validate_shows_rejected", _with(sql.DIRTY) + f"SELECT {SHOW_COLUMNS}, reason FROM judged WHERE reason IS NOT NULL")
def _(spark, d):
    return qu.validate_shows(st.dirty_shows(spark, d))[1]


@query("validate_import", _with(sql.IMPORT) + "SELECT file, line_no, issues FROM judged")
def _(spark, d):
    return qu.validate_import(st.import_lines(spark, d)).select("file", "line_no", F.array_join("issues", "; ").alias("issues"))


@query("normalize_import", _with(sql.IMPORT) + """
SELECT file, line_no, url, title, section, category, CASE WHEN d2 < d1 THEN d2 ELSE d1 END AS date_start,
       CASE WHEN d2 < d1 THEN d1 ELSE d2 END AS date_end, minutes AS duration_min, least(p1, 20.5) AS price_min_eur,
       greatest(p1, 20.5) AS price_max_eur FROM judged WHERE issues = ''""")
def _(spark, d):
    good = qu.validate_import(st.import_lines(spark, d)).where(F.size("issues") == 0)
    return qu.normalize_import(good.drop("line")).select(
        "file", "line_no", "url", "title", "section", "category", "date_start", "date_end", "duration_min",
        "price_min_eur", "price_max_eur")


@query("duplicate_url_check", f"""
WITH r AS (SELECT {sql.url('l_partkey')} AS url, l_orderkey * 10 + l_linenumber AS line_no, l_returnflag AS file FROM lineitem),
f AS (SELECT file, url, min(line_no) AS first_line FROM r GROUP BY 1, 2)
SELECT file, url, line_no, first_line FROM r JOIN f USING (file, url) WHERE line_no > first_line""")
def _(spark, d):
    rows = st.table(spark, d, "lineitem").select(
        st.source_url("l_partkey").alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        F.col("l_returnflag").alias("file"))
    return qu.duplicate_url_check(rows, scope=["file"])[1]


# --- labels ------------------------------------------------------------------------------------------

DAY = ("strftime({0}, '%d') || ' ' || ['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', "
       "'oct.', 'nov.', 'déc.'][month({0})] || ' ' || year({0})")
MONEY = ("CASE WHEN round({0}) >= 1000 THEN (CAST(round({0}) AS BIGINT) // 1000) || chr(8239) || "
         "lpad(CAST(CAST(round({0}) AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST(round({0}) AS BIGINT) AS VARCHAR) END || chr(160) || '€'")


@query("card_labels", _with(sql.WORKS) + f"""
, w AS (SELECT id, section, duration_min * 7 AS minutes,
  CASE WHEN p_partkey % 5 <> 1 THEN start_date END AS s, CASE WHEN p_partkey % 7 <> 1 THEN CASE WHEN p_partkey % 4 = 0 THEN start_date ELSE end_date END END AS e,
  CASE WHEN p_partkey % 5 <> 2 THEN price_min END AS lo, CASE WHEN p_partkey % 7 <> 2 THEN CASE WHEN p_partkey % 4 = 0 THEN price_min ELSE price_max + 100 END END AS hi FROM works)
SELECT id, CASE WHEN s IS NULL AND e IS NULL THEN 'Dates à venir' WHEN s IS NULL THEN {DAY.format('e')}
    WHEN e IS NULL OR s = e THEN {DAY.format('s')} ELSE {DAY.format('s')} || ' → ' || {DAY.format('e')} END AS date_label,
  CASE WHEN lo IS NULL AND hi IS NULL THEN 'Tarifs non communiqués' WHEN hi IS NULL THEN 'Dès ' || {MONEY.format('lo')}
    WHEN lo IS NULL THEN 'Jusqu’à ' || {MONEY.format('hi')} WHEN lo = hi THEN {MONEY.format('lo')}
    ELSE {MONEY.format('lo')} || ' - ' || {MONEY.format('hi')} END AS price_label,
  CASE WHEN minutes < 60 THEN minutes || ' min' WHEN minutes % 60 = 0 THEN (minutes // 60) || ' h'
    ELSE (minutes // 60) || ' h ' || (minutes % 60) END AS duration_label,
  CASE section WHEN 'cinema' THEN 'Cinéma' ELSE 'Théâtre' END AS section_label FROM w""")
def _(spark, d):
    k = F.col("id").cast("bigint")
    w = st.works(spark, d).withColumns({
        "end_date": F.when(k % 7 != 1, F.when(k % 4 == 0, F.col("start_date")).otherwise(F.col("end_date"))),
        "start_date": F.when(k % 5 != 1, F.col("start_date")),
        "price_max": F.when(k % 7 != 2, F.when(k % 4 == 0, F.col("price_min")).otherwise(F.col("price_max") + 100)),
        "price_min": F.when(k % 5 != 2, F.col("price_min")), "duration_min": F.col("duration_min") * 7})
    return card_labels(w).select("id", "date_label", "price_label", "duration_label", "section_label")


# --- files and streams --------------------------------------------------------------------------------


@query("write_shows", _with(sql.SHOWS) + f"SELECT {SHOW_COLUMNS} FROM shows")
def _(spark, d):
    path = scratch_dir(spark, "shows")
    sh.write_shows(st.shows(spark, d), path)
    return spark.read.schema(SHOWS).json(path)


@query("read_shows_lenient", _with(sql.SHOWS) + f"SELECT {SHOW_COLUMNS} FROM shows")
def _(spark, d):
    """Each record is written twice, an old version before it, between blank and broken lines."""
    path = scratch_dir(spark, "lines")
    record = F.to_json(F.struct(*SHOWS.names), {"ignoreNullFields": "false"})
    old = F.to_json(F.struct("url", F.lit("ancien").alias("title")))
    lines = F.array(old, F.lit("  "), F.lit("{broken"), F.lit('{"url": 5}'), F.lit("[1]"), record)
    st.shows(spark, d).select(F.array_join(lines, "\n").alias("value")).write.text(path)
    return sh.read_shows_lenient(spark, path)


@query("read_shows_strict", _with(sql.SHOWS) + """
, priced AS (SELECT *, price_min_eur * 0.52 AS p FROM shows)
SELECT title, section, count(*) AS n, 1 AS odd FROM priced WHERE p <= 500 GROUP BY 1, 2
UNION ALL SELECT 'rejected', issues, n, 1 FROM (
  SELECT 'price_min_eur: outside 0..500' AS issues, count(*) AS n FROM priced WHERE p > 500) WHERE n > 0""")
def _(spark, d):
    """A blank line follows every record, so records stand on odd lines."""
    path = scratch_dir(spark, "strict")
    priced = st.shows(spark, d).withColumns({"price_min_eur": F.col("price_min_eur") * 0.52, "price_max_eur": F.lit(None).cast("double")})
    record = F.to_json(F.struct(*SHOWS.names), {"ignoreNullFields": "false"})
    priced.select(F.concat(record, F.lit("\n")).alias("value")).write.text(path)
    records, rejects = sh.read_shows_strict(spark, path, strict=False)
    odd = (F.min(F.col("line_no") % 2)).cast("int").alias("odd")
    good = records.groupBy("title", "section").agg(F.count("*").alias("n"), odd)
    bad = rejects.groupBy(F.lit("rejected").alias("title"), F.array_join("issues", "; ").alias("section")).agg(
        F.count("*").alias("n"), odd)
    return good.unionByName(bad)


@query("read_shows_folder", _with(sql.SHOWS) + """
, priced AS (SELECT p_partkey, title, price_min_eur * 0.52 AS p FROM shows)
SELECT 'kept' AS outcome, title, count(*) AS n FROM priced WHERE p <= 500 GROUP BY 2
UNION ALL SELECT 'b repeats a', title, count(*) FROM priced WHERE p <= 500 AND p_partkey % 5 = 0 GROUP BY 2
UNION ALL SELECT 'too dear', title, n FROM (
  SELECT NULL AS title, sum(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END) AS n FROM priced WHERE p > 500) WHERE n > 0""")
def _(spark, d):
    """All works in several part files of folder a, every fifth again in folder b; both are one input."""
    path = scratch_dir(spark, "folder")
    record = F.to_json(F.struct(*SHOWS.names), {"ignoreNullFields": "false"}).alias("value")
    rows = st.shows(spark, d).withColumns({"price_min_eur": F.col("price_min_eur") * 0.52, "price_max_eur": F.lit(None).cast("double")})
    rows.repartition(3).select(record).write.text(f"{path}/part=a")
    rows.where(F.regexp_extract("url", r"oeuvre-(\d+)", 1).cast("bigint") % 5 == 0).repartition(2).select(record).write.text(f"{path}/part=b")
    records, rejects = sh.read_shows_strict(spark, path, strict=False)
    titles = spark.read.schema(SHOWS).json(path).select("url", "title").distinct()
    lines = sh.numbered_lines(spark, path).select("file", "line_no", F.get_json_object("line", "$.title").alias("title"))
    issue = F.col("issues")[0]
    part = F.regexp_extract("file", "part=(.)", 1)
    repeat = issue.rlike("^url: duplicate of line [0-9]+ of .*part=a/")
    bad = rejects.join(lines, ["file", "line_no"]).select(
        F.when(repeat, F.concat(part, F.lit(" repeats a"))).otherwise("too dear").alias("outcome"), F.when(repeat, F.col("title")).alias("title"))
    good = records.join(titles, ["url", "title"]).select(F.lit("kept").alias("outcome"), "title")
    return good.unionByName(bad).groupBy("outcome", "title").agg(F.count("*").alias("n"))


@query("publish_snapshot", _with(sql.WORKS) + MERGED)
def _(spark, d):
    """First version published, then merged and published again; the merged one is read back."""
    root = scratch_dir(spark, "catalog")
    catalog.write_works(st.existing_works(spark, d), root)
    merged = mg.upsert_works(catalog.scan_works(spark, root), st.incoming_works(spark, d), st.NOW)
    catalog.write_works(merged, root)
    return catalog.scan_works(spark, root)


@query("append_import_job", "SELECT 'part' AS source, count(*) AS imported, '2001-09-08 07:00:00' AS created_at FROM part")
def _(spark, d):
    root = scratch_dir(spark, "jobs")
    catalog.append_import_job(spark, root, "part", st.table(spark, d, "part").count(), st.NOW)
    return catalog.scan_import_jobs(spark, root)


@query("non_empty_check", "SELECT count(*) AS n FROM part")
def _(spark, d):
    return qu.non_empty_check(st.table(spark, d, "part")).agg(F.count("*").alias("n"))


@query("reaction_stream", ORACLES["fold_reactions"])
def _(spark, d):
    """The event log as files of two folders, streamed in batches; half of it arrives after the stream has ended and is started again."""
    events, checkpoint = materialize(st.reaction_events(spark, d), "log"), scratch_dir(spark, "checkpoint")
    folders = {even: scratch_dir(spark, "events") for even in (True, False)}
    for drop in (0, 1):
        for even, folder in folders.items():
            events.where(f"(seq % 2 = 0) = {even} AND floor(seq / 10) % 2 = {drop}").repartition(4).write.mode("append").parquet(folder)
        reaction_stream(spark, list(folders.values()), checkpoint, files_per_batch=2).awaitTermination()
    return current_reactions(spark, checkpoint)


@query("ingest_stream", _with(sql.WORKS) + """
SELECT sha256(source_url) AS id, title, section, category, venue, duration_min, CAST(start_date AS VARCHAR) AS start_date,
       source_url FROM works WHERE category <> 'PROMO'""")
def _(spark, d):
    """Two folders of files of lines; every PROMO file holds a bad line and is refused whole. The second is read in a later run."""
    w = st.works(spark, d).select(
        F.col("source_url").alias("url"), "title", "section", "category", "venue", "address",
        st.text_of("start_date").alias("date_start"), "duration_min", F.col("image_url").alias("image"), "description")
    line = F.to_json(F.struct(*w.columns), {"ignoreNullFields": "false"})
    line = F.when(F.col("category") == "PROMO", F.concat(line, F.lit("\n{broken"))).otherwise(line)
    root, folders = scratch_dir(spark, "ingested"), {}
    for cinema in (True, False):
        source = scratch_dir(spark, "drop")
        w.where((F.col("section") == "cinema") == cinema).select(line.alias("value"), F.col("category").alias("kind")).repartition(
            6, "kind").write.partitionBy("kind").text(source)
        folders["cinema" if cinema else "theatre"] = f"{source}/*"
        ingest_run(spark, folders, root, st.NOW, files_per_batch=3)
    return catalog.scan_works(spark, root).select("id", "title", "section", "category", "venue", "duration_min", "start_date", "source_url")
