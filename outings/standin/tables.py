"""The catalog's tables read out of a star schema of orders and text.

Lets every query run on given data at any scale. Each function has a twin in
``sql.py`` that states the same rule for an independent SQL engine.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.session import spread

AS_OF = datetime(2001, 9, 7, 22, 30, tzinfo=UTC)  # already the 8th where the events take place
NOW = datetime(2001, 9, 8, 7, 0)
BASE = "https://listings.example"
FRIEND_STEPS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def section_of(key: str) -> Column:
    return F.when(F.col(key) % 3 == 0, "cinema").otherwise("theatre")


def source_url(key: str) -> Column:
    k = text_of(key)
    return F.when(
        F.col(key) % 3 == 0, F.concat(F.lit(f"{BASE}/cinema/evenement/oeuvre-"), k, F.lit(".html"))
    ).otherwise(F.concat(F.lit(f"{BASE}/theatre/lieu-"), text_of(F.col(key) % 100), F.lit("/oeuvre-"), k, F.lit(".html")))


def sales(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Lines with their order; ``heavy`` when costly row work follows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem")
    lines = spread(lines) if heavy else lines
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    facts = sales(spark, sf_dir).groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    theatre = F.col("p_partkey") % 3 != 0
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    return part.join(facts, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        text_of("p_partkey").alias("id"), F.col("p_name").alias("title"), section_of("p_partkey").alias("section"),
        F.col("p_type").alias("category"), F.when(theatre, F.col("p_brand")).alias("venue"),
        F.when(theatre, F.concat(text_of("p_size"), F.lit(" rue des Arts 75010 Paris"))).alias("address"),
        F.when(F.col("p_size") % 7 != 0, F.concat("p_name", F.lit(" / "), "p_type")).alias("description"),
        F.to_date("first_ship").alias("start_date"), F.to_date("last_ship").alias("end_date"),
        F.col("p_size").alias("duration_min"), F.col("p_retailprice").alias("price_min"),
        F.col("p_retailprice").alias("price_max"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://img.example/"), text_of("p_partkey"), F.lit(".jpg")))
        .alias("image_url"),
        source_url("p_partkey").alias("source_url"),
        F.coalesce("first_order", start).alias("created_at"), F.coalesce("last_order", start).alias("updated_at"),
    )


def reaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.when(F.col("l_returnflag") == "R", "LIKE").when(F.col("l_returnflag") == "A", "DISLIKE")
              .otherwise("SEEN"))
    return sales(spark, sf_dir).select(
        text_of("o_custkey").alias("user_id"), text_of("l_partkey").alias("work_id"), status.alias("status"),
        F.col("o_orderdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        text_of("c_custkey").alias("user_id"),
        F.concat(F.lower("c_name"), F.lit("@people.example")).alias("email"))


def friendships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and the twelve with the next keys, both ways."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    steps = customer.select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(FRIEND_STEPS))).alias("step"))
    steps = steps.select("c_custkey", (F.col("c_custkey") + F.col("step")).alias("next"))
    pairs = steps.join(customer.select(F.col("c_custkey").alias("next")), "next")
    both = F.array(F.struct(F.col("c_custkey").alias("a"), F.col("next").alias("b")),
                   F.struct(F.col("next").alias("a"), F.col("c_custkey").alias("b")))
    return pairs.select(F.explode(both).alias("e")).select(
        text_of("e.a").alias("user_id"), text_of("e.b").alias("friend_id"))


def frontier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        section_of("l_partkey").alias("section"),
        (F.floor(F.col("l_orderkey") / 100) + 1).cast("int").alias("page"),
        (F.col("l_orderkey") % 100 * 10 + F.col("l_linenumber")).cast("int").alias("pos"),
        source_url("l_partkey").alias("url"), F.concat(F.lit("oeuvre "), text_of("l_partkey")).alias("text"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Show records of three works out of four: what a frontier meets partly filled."""
    return shows(spark, sf_dir, works(spark, sf_dir).where("CAST(id AS BIGINT) % 4 <> 0"))


def shows(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Show records of works (all of them), crawled at their last shipping day."""
    w = works(spark, sf_dir) if of is None else of
    return w.select(
        F.col("source_url").alias("url"), "title", "section", "category", "venue", "address",
        text_of("start_date").alias("date_start"), text_of("end_date").alias("date_end"), "duration_min",
        F.col("price_min").alias("price_min_eur"), F.col("price_max").alias("price_max_eur"),
        F.col("image_url").alias("image"), "description",
        F.concat(text_of("end_date"), F.lit("T00:00:00Z")).alias("crawled_at"))


def existing_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where("CAST(id AS BIGINT) % 5 <> 0")


def incoming_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir).where("CAST(id AS BIGINT) % 3 <> 1")
    return w.select(
        F.concat("title", F.lit(" (reprise)")).alias("title"), "section", "category",
        F.when(F.col("duration_min") % 2 != 0, F.col("venue")).alias("venue"), "address", "description",
        "start_date", F.date_add("end_date", 30).alias("end_date"),
        F.when(F.col("duration_min") % 5 != 0, F.col("duration_min") + 1).alias("duration_min"),
        "price_min", "price_max", "image_url", "source_url")


def dirty_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as show records with reversed dates and prices, wild durations, blanks and junk."""
    line = F.col("l_linenumber")
    k = text_of(F.col("l_orderkey") * 10 + line)
    path = F.when(line == 7, "/autre/").when(F.col("l_partkey") % 3 == 0, "/cinema/").otherwise("/theatre/")
    return sales(spark, sf_dir, heavy=True).select(
        F.concat(F.lit(BASE), path, F.lit("lieu-1/oeuvre-"), k, F.lit(".html")).alias("url"),
        F.when((line == 6) & (F.col("l_returnflag") == "A"), " \t ")
        .otherwise(F.concat(F.lit("  oeuvre \n "), text_of("l_partkey"), F.lit(" "))).alias("title"),
        F.when(F.col("l_suppkey") % 10 == 0, "opera").alias("section"),
        F.when(line % 2 == 0, F.col("l_linestatus")).alias("category"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("lieu  "), text_of("l_suppkey"))).alias("venue"),
        F.lit(None).cast("string").alias("address"),
        F.when(line == 5, "2025-02-30").when(line != 4, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date_start"),
        F.when(line != 3, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_end"),
        (F.col("l_quantity") * 20 - 100).cast("int").alias("duration_min"),
        F.col("l_extendedprice").alias("price_min_eur"), (F.col("l_extendedprice") - 20000.0).alias("price_max_eur"),
        F.when(line % 3 == 0, "ftp://img.example/a.jpg").when(line % 3 == 1, " https://img.example/b.jpg ").alias("image"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("texte\t"), "l_returnflag")).alias("description"),
        F.lit(None).cast("string").alias("crawled_at"),
    )


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line): sales as JSON lines, some of them wrong in one way or several."""
    line = F.col("l_linenumber")
    number = F.col("l_orderkey") * 10 + line
    site = F.when(line == 7, "https://elsewhere.example").otherwise(BASE)
    path = F.when(F.col("l_partkey") % 3 == 0, "/cinema/evenement/oeuvre-").otherwise("/lieu/oeuvre-")
    minutes = (F.col("l_quantity") * 20 - 100).cast("int")
    common = [
        F.concat(site, path, text_of(number), F.lit(".html")).alias("url"),
        F.when(F.col("l_suppkey") % 10 == 1, F.lit("")).otherwise(F.concat(F.lit(" oeuvre  "), text_of("l_partkey"))).alias("title"),
        F.when(F.col("l_suppkey") % 10 == 2, "opera").alias("section"),
        F.when(line == 1, F.repeat(F.lit("x"), 121)).otherwise(F.col("l_linestatus")).alias("category"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_start"),
        F.when(line == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).when(line == 3, "2025-02-30")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_end"),
        (F.col("l_extendedprice") / 200).alias("price_min_eur"), F.lit(20.5).alias("price_max_eur"),
        F.when(line == 4, "img.example/a.jpg").otherwise("https://img.example/a.jpg").alias("image"),
        F.lit("2026-03-11T10:00:00.000Z").alias("crawled_at"), F.lit(True).alias("ignored"),
    ]
    options = {"ignoreNullFields": "false"}
    as_text = F.to_json(F.struct(*common, text_of(minutes).alias("duration_min")), options)
    as_number = F.to_json(F.struct(*common, minutes.alias("duration_min")), options)
    text = F.when(F.col("l_suppkey") % 10 == 3, "{not json").when(F.col("l_suppkey") % 10 == 4, as_text).otherwise(as_number)
    return sales(spark, sf_dir, heavy=True).select(F.col("l_returnflag").alias("file"), number.alias("line_no"), text.alias("line"))


# --- rendered detail pages ------------------------------------------------------------


def run_days() -> tuple[Column, Column]:
    """First and last day of a part's run, from its key and size."""
    start = F.date_add(F.lit("2025-01-05").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    return start, F.date_add(start, F.col("p_size") + 1)


def detail_url() -> Column:
    k, word = text_of("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(2))
    return F.when(
        F.col("p_partkey") % 3 == 0, F.concat(F.lit(f"{BASE}/cinema/evenement/oeuvre-"), k, F.lit(".html"))
    ).otherwise(F.concat(F.lit(f"{BASE}/theatre/lieu-de-"), word, F.lit("-"), text_of(F.col("p_partkey") % 100),
                         F.lit("/oeuvre-"), k, F.lit(".html")))


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML detail page per part, with a different wording by key."""
    months = F.array(*[F.lit(m) for m in (
        "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
        "septembre", "octobre", "novembre", "décembre")])
    start, end = run_days()
    key, k = F.col("p_partkey"), text_of("p_partkey")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))

    def words(day: Column, year: bool = True) -> Column:
        parts = [F.dayofmonth(day).cast("string"), F.element_at(months, F.month(day))]
        return F.concat_ws(" ", *parts, *([F.year(day).cast("string")] if year else []))

    def numbers(day: Column) -> Column:
        return F.date_format(day, "dd/MM/yyyy")

    form = key % 7
    run = (
        F.when(form == 0, F.concat(F.lit("du "), numbers(start), F.lit(" au "), numbers(end)))
        .when(form == 1, F.concat(F.lit("Du "), words(start), F.lit(" au "), words(end)))
        .when(form == 2, F.concat(F.lit("du "), words(start, False), F.lit(" au "), words(end)))
        .when(form == 3, F.concat(F.lit("du "), F.dayofmonth(start).cast("string"), F.lit(" au "), words(end)))
        .when(form == 4, F.concat(F.lit("À partir du "), words(start)))
        .when(form == 5, F.concat(F.lit("jusqu’au "), words(end)))
        .otherwise(F.concat(F.lit("les "), words(end), F.lit(" et "), numbers(start)))
    )
    price = F.floor("p_retailprice").cast("int").cast("string")
    tarif = F.when(key % 3 == 1, F.concat(F.lit("Tarif : "), text_of("p_size"), F.lit(" - "), price, F.lit("&nbsp;€"))).otherwise(
        F.concat(F.lit("Billets "), price, F.lit(",5 € ou "), text_of("p_size"), F.lit(" €")))
    minutes = F.col("p_size") * 7
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    duration = F.when(minutes < 60, F.concat(rest, F.lit(" min"))).otherwise(F.concat(hours, F.lit("h"), F.lpad(rest, 2, "0")))
    rubric = (F.when(F.col("p_type") == "PROMO", "Humour &amp; Shows").when(F.col("p_type") == "LARGE", "Spectacle musical")
              .when(F.col("p_type") == "SMALL", "Pièces de théâtre").otherwise(F.concat(F.lit("Danse "), "p_type")))
    crumb = F.when(key % 2 == 0, F.concat(F.lit("Théâtre du "), word)).otherwise("Pièces de théâtre")
    image = F.when(key % 2 == 0, F.concat(F.lit("/img/"), k, F.lit(".jpg"))).otherwise(
        F.concat(F.lit("https://img.example/"), k, F.lit(".jpg")))
    structured = F.when(key % 14 >= 7, F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Event","startDate":"'), start.cast("string"),
        F.lit('T20:00","endDate":"'), end.cast("string"), F.lit('"}</script>'))).otherwise("")
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta property="og:image" content="'), image,
                    F.lit('"><meta name="description" content=" Fiche de '), "p_name", F.lit(' ">'))
    theatre = F.concat(
        head, structured, F.lit('</head><body><nav class="breadcrumb"><a href="/">Accueil</a> <a href="/theatre/lieu-'),
        text_of(key % 100), F.lit('">'), crumb, F.lit("</a></nav><h1>"), "p_name", F.lit(" <em>"), k,
        F.lit('</em></h1><div class="venue-address">'), text_of("p_size"), F.lit(" boulevard de "), word,
        F.lit(' 75010 Paris</div><p class="dates">'), run, F.lit("</p><p>"), tarif, F.lit("</p><p>Durée : "), duration,
        F.lit("</p><h2>Présentation</h2><p>Le spectacle est référencé dans notre rubrique "), rubric,
        F.lit(". </p><p>court</p><h2>Avis</h2><p>Rien à ajouter pour le moment.</p></body></html>"))
    genre = F.when(key % 2 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise(
        F.concat(F.lit('["'), "p_type", F.lit('", "'), word, F.lit('"]')))
    movie = F.concat(
        F.lit('<script type="application/ld+json">{"genre": '), genre, F.lit(', "duration": "PT'), hours, F.lit("H"), rest,
        F.lit('M", "datePublished": "'), start.cast("string"), F.lit('"}</script>'))
    labels = F.concat(F.lit('<section class="meta">Genre : '), "p_type", F.lit(" Durée : "), duration,
                      F.lit(" Date de sortie : "), numbers(start), F.lit("</section>"))
    cinema = F.concat(
        head, F.when(key % 4 != 1, movie).otherwise(""), F.lit("</head><body><h1>"), "p_name", F.lit(" <em>"), k,
        F.lit("</em></h1>"), F.when(key % 4 == 1, labels).otherwise(""), F.lit("<p>Sans titre de partie</body></html>"))
    return spread(table(spark, sf_dir, "part")).select(
        key.alias("page_id"), detail_url().alias("url"), F.when(key % 3 == 0, cinema).otherwise(theatre).alias("html"))
