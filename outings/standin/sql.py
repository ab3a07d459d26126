"""The stand-in rules of ``tables.py`` as SQL, for checking against another engine."""

from __future__ import annotations

BASE = "https://listings.example"
TODAY = "DATE '2001-09-08'"

SALES = "sales AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def url(key: str) -> str:
    return (f"CASE WHEN {key} % 3 = 0 THEN '{BASE}/cinema/evenement/oeuvre-' || {key} || '.html' "
            f"ELSE '{BASE}/theatre/lieu-' || ({key} % 100) || '/oeuvre-' || {key} || '.html' END")


def section(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN 'cinema' ELSE 'theatre' END"


WORKS = SALES + f""", facts AS (
  SELECT l_partkey, min(l_shipdate) first_ship, max(l_shipdate) last_ship,
         min(o_orderdate) first_order, max(o_orderdate) last_order FROM sales GROUP BY 1
), works AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey, p_name AS title, {section('p_partkey')} AS section,
         p_type AS category, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS venue,
         CASE WHEN p_partkey % 3 <> 0 THEN p_size || ' rue des Arts 75010 Paris' END AS address,
         CASE WHEN p_size % 7 <> 0 THEN p_name || ' / ' || p_type END AS description,
         CAST(first_ship AS DATE) AS start_date, CAST(last_ship AS DATE) AS end_date,
         p_size AS duration_min, p_retailprice AS price_min, p_retailprice AS price_max,
         CASE WHEN p_size % 2 = 0 THEN 'https://img.example/' || p_partkey || '.jpg' END AS image_url,
         {url('p_partkey')} AS source_url,
         coalesce(first_order, TIMESTAMP '1990-01-01') AS created_at,
         coalesce(last_order, TIMESTAMP '1990-01-01') AS updated_at
  FROM part LEFT JOIN facts ON p_partkey = l_partkey
)"""

EVENTS = """events_ AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS work_id,
         CASE l_returnflag WHEN 'R' THEN 'LIKE' WHEN 'A' THEN 'DISLIKE' ELSE 'SEEN' END AS status,
         o_orderdate AS ts, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

REACTIONS = EVENTS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, work_id ORDER BY ts DESC, seq DESC, status DESC) AS rn,
         min(ts) OVER (PARTITION BY user_id, work_id) AS created_at
  FROM events_
), reactions AS (
  SELECT user_id, work_id, status, created_at, ts AS updated_at, seq AS last_seq FROM numbered WHERE rn = 1
)"""

USERS = """users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, lower(c_name) || '@people.example' AS email FROM customer
)"""

FRIENDS = """pairs AS (
  SELECT a.c_custkey AS a, b.c_custkey AS b
  FROM (SELECT c_custkey, unnest(generate_series(1, 12)) AS step FROM customer) a
  JOIN customer b ON b.c_custkey = a.c_custkey + a.step
), friendships AS (
  SELECT CAST(a AS VARCHAR) AS user_id, CAST(b AS VARCHAR) AS friend_id FROM pairs
  UNION ALL SELECT CAST(b AS VARCHAR), CAST(a AS VARCHAR) FROM pairs
)"""

LINKS = f"""links AS (
  SELECT {section('l_partkey')} AS section, CAST(l_orderkey // 100 + 1 AS INTEGER) AS page,
         CAST(l_orderkey % 100 * 10 + l_linenumber AS INTEGER) AS pos,
         {url('l_partkey')} AS url, 'oeuvre ' || l_partkey AS text
  FROM lineitem
)"""

SHOWS = WORKS + """, shows AS (
  SELECT p_partkey, source_url AS url, title, section, category, venue, address,
         CAST(start_date AS VARCHAR) AS date_start, CAST(end_date AS VARCHAR) AS date_end, duration_min,
         price_min AS price_min_eur, price_max AS price_max_eur, image_url AS image, description,
         CAST(end_date AS VARCHAR) || 'T00:00:00Z' AS crawled_at, end_date AS crawled_day
  FROM works
)"""

CACHE = SHOWS + """, cache AS (SELECT * EXCLUDE (p_partkey) FROM shows WHERE p_partkey % 4 <> 0)"""

DIRTY = SALES + f""", dirty AS (
  SELECT '{BASE}' || CASE WHEN l_linenumber = 7 THEN '/autre/' WHEN l_partkey % 3 = 0 THEN '/cinema/' ELSE '/theatre/' END
           || 'lieu-1/oeuvre-' || (l_orderkey * 10 + l_linenumber) || '.html' AS url,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 3 = 0 THEN 'cinema' ELSE 'theatre' END AS path_section,
         CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN NULL ELSE 'oeuvre ' || l_partkey END AS title,
         CASE WHEN l_suppkey % 10 = 0 THEN 'opera' END AS given_section,
         CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS given_category,
         CASE WHEN l_suppkey % 2 = 0 THEN 'lieu ' || l_suppkey END AS venue,
         CASE WHEN l_linenumber NOT IN (4, 5) THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS d1,
         CASE WHEN l_linenumber <> 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d2,
         CAST(l_quantity * 20 - 100 AS INTEGER) AS minutes,
         l_extendedprice AS p1, CASE WHEN l_extendedprice - 20000.0 >= 0 THEN l_extendedprice - 20000.0 END AS p2,
         CASE WHEN l_linenumber % 3 = 1 THEN 'https://img.example/b.jpg' END AS image,
         CASE WHEN l_partkey % 2 = 0 THEN 'texte ' || l_returnflag END AS description
  FROM sales
), checked AS (
  SELECT url, title, coalesce(given_section, path_section) AS section,
         coalesce(given_category, CASE WHEN coalesce(given_section, path_section) = 'theatre' THEN 'théâtre' END) AS category,
         venue, CAST(NULL AS VARCHAR) AS address,
         CASE WHEN d2 < d1 THEN d2 ELSE d1 END AS date_start, CASE WHEN d2 < d1 THEN d1 ELSE d2 END AS date_end,
         CASE WHEN minutes BETWEEN 1 AND 600 THEN minutes END AS duration_min,
         CASE WHEN p2 < p1 THEN p2 ELSE p1 END AS price_min_eur, CASE WHEN p2 < p1 THEN p1 ELSE p2 END AS price_max_eur,
         image, description, CAST(NULL AS VARCHAR) AS crawled_at
  FROM dirty
), judged AS (
  SELECT *, CASE WHEN title IS NULL THEN 'missing_title'
                 WHEN section IS NULL OR section NOT IN ('theatre', 'cinema') THEN 'invalid_section'
                 WHEN venue IS NULL AND date_start IS NULL AND description IS NULL THEN 'insufficient' END AS reason
  FROM checked
)"""

IMPORT = SALES + f""", raw AS (
  SELECT l_returnflag AS file, l_orderkey * 10 + l_linenumber AS line_no, l_suppkey % 10 AS s, l_linenumber AS n,
         CASE WHEN l_linenumber = 7 THEN 'https://elsewhere.example' ELSE '{BASE}' END
           || CASE WHEN l_partkey % 3 = 0 THEN '/cinema/evenement/oeuvre-' ELSE '/lieu/oeuvre-' END
           || (l_orderkey * 10 + l_linenumber) || '.html' AS url,
         CASE WHEN l_suppkey % 10 <> 1 THEN 'oeuvre ' || l_partkey END AS title,
         CASE WHEN l_suppkey % 10 = 2 THEN 'opera' WHEN l_partkey % 3 = 0 THEN 'cinema' ELSE 'theatre' END AS section,
         l_linestatus AS category,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d1, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d2,
         CAST(l_quantity * 20 - 100 AS INTEGER) AS minutes, l_extendedprice / 200 AS p1
  FROM sales
), judged AS (
  SELECT *, CASE WHEN s = 3 THEN 'root: invalid JSON' ELSE concat_ws('; ',
      CASE WHEN n = 7 THEN 'url: unexpected site' END,
      CASE WHEN s = 1 THEN 'title: expected string' END,
      CASE WHEN s = 2 THEN 'section: unknown section' END,
      CASE WHEN n = 1 THEN 'category: longer than 120' END,
      CASE WHEN n = 2 THEN 'date_end: expected YYYY-MM-DD' END,
      CASE WHEN n = 3 THEN 'date_end: no such day' END,
      CASE WHEN s = 4 THEN 'duration_min: expected number' END,
      CASE WHEN s <> 4 AND (minutes <= 0 OR minutes > 600) THEN 'duration_min: outside 1..600' END,
      CASE WHEN p1 > 500 THEN 'price_min_eur: outside 0..500' END,
      CASE WHEN n = 4 THEN 'image: expected HTTP URL' END) END AS issues
  FROM raw
)"""

_WORD = "split_part(p_name, ' ', 2)"
_START = "CAST(DATE '2025-01-05' + CAST(p_partkey % 300 AS INTEGER) AS DATE)"
_END = f"CAST({_START} + CAST(p_size + 1 AS INTEGER) AS DATE)"

# What the rendered detail page of every part says, computed from the part alone.
RENDERED = f"""base AS (
  SELECT *, {_WORD} AS word, {_START} AS d1, {_END} AS d2, p_partkey % 7 AS form,
         p_partkey % 14 >= 7 AS structured, p_partkey % 3 = 0 AS cinema, p_size * 7 AS minutes,
         floor(p_retailprice) AS price FROM part
), told AS (
  SELECT *,
    CASE form WHEN 2 THEN strftime(d2, '%Y') || strftime(d1, '-%m-%d') WHEN 3 THEN strftime(d2, '%Y-%m') || strftime(d1, '-%d')
              WHEN 5 THEN NULL ELSE strftime(d1, '%Y-%m-%d') END AS s,
    CASE form WHEN 4 THEN NULL ELSE strftime(d2, '%Y-%m-%d') END AS e
  FROM base
), rendered AS (
  SELECT p_partkey,
    CASE WHEN cinema THEN '{BASE}/cinema/evenement/oeuvre-' || p_partkey || '.html'
         ELSE '{BASE}/theatre/lieu-de-' || word || '-' || (p_partkey % 100) || '/oeuvre-' || p_partkey || '.html' END AS url,
    p_name || ' ' || p_partkey AS title, {section('p_partkey')} AS section,
    CASE WHEN cinema AND p_partkey % 4 = 1 THEN lower(p_type)
         WHEN cinema AND p_partkey % 2 = 0 THEN lower(p_type)
         WHEN cinema THEN lower(p_type) || ', ' || word
         WHEN p_type = 'PROMO' THEN 'humour' WHEN p_type = 'LARGE' THEN 'spectacle musical'
         WHEN p_type = 'SMALL' THEN 'théâtre' ELSE 'Danse ' || p_type END AS category,
    CASE WHEN cinema THEN NULL WHEN p_partkey % 2 = 0 THEN 'Théâtre du ' || word
         ELSE 'Lieu De ' || upper(word[1]) || word[2:] END AS venue,
    CASE WHEN NOT cinema THEN p_size || ' boulevard de ' || word || ' 75010 Paris' END AS address,
    CASE WHEN cinema THEN strftime(d1, '%Y-%m-%d')
         WHEN form IN (4, 5) AND structured THEN least(coalesce(s, '9999'), strftime(d1, '%Y-%m-%d')) ELSE s END AS date_start,
    CASE WHEN cinema THEN NULL
         WHEN form IN (4, 5) AND structured THEN greatest(coalesce(e, ''), strftime(d2, '%Y-%m-%d')) ELSE e END AS date_end,
    CASE WHEN cinema AND p_partkey % 4 = 1 AND minutes < 60 THEN NULL ELSE CAST(minutes AS INTEGER) END AS duration_min,
    CASE WHEN cinema THEN NULL ELSE CAST(p_size AS DOUBLE) END AS price_min_eur,
    CASE WHEN cinema THEN NULL WHEN p_partkey % 3 = 1 THEN price ELSE price + 0.5 END AS price_max_eur,
    CASE WHEN p_partkey % 2 = 0 THEN '{BASE}/img/' || p_partkey || '.jpg'
         ELSE 'https://img.example/' || p_partkey || '.jpg' END AS image,
    CASE WHEN cinema THEN 'Fiche de ' || p_name
         ELSE 'Le spectacle est référencé dans notre rubrique ' || CASE WHEN p_type = 'PROMO' THEN 'Humour & Shows'
           WHEN p_type = 'LARGE' THEN 'Spectacle musical' WHEN p_type = 'SMALL' THEN 'Pièces de théâtre'
           ELSE 'Danse ' || p_type END || '.' END AS description,
    s, e, d1, d2, cinema
  FROM told
)"""
