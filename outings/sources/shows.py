"""Show records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outings.functions import urls
from outings.functions.stages import compute_once
from outings.functions.text import blank_to_null
from outings.operators.quality import duplicate_url_check, normalize_import, validate_import
from outings.schemas import SHOWS, Site, conform
from outings.session import materialize


def with_place(text: DataFrame) -> DataFrame:
    """file, block (offset of the input split) and line of a text source."""
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"))


def with_line_order(text: DataFrame) -> DataFrame:
    """Adds row, increasing within a block."""
    return with_place(text).withColumn("row", F.monotonically_increasing_id())


def number_lines(rows: DataFrame) -> DataFrame:
    """(file, block, row, line) -> (file, line_no, line) with every physical line counted, blank ones too.

    Lines are counted per input split; a split's first number is the sum of the splits
    before it in its file. No task sees more than one split of lines.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        .select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return rows.join(splits, ["file", "block"]).select(
        "file", (F.col("offset") + F.col("row") - F.col("first") + 1).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return number_lines(with_line_order(spark.read.text(path)))


def parse_lenient(lines: DataFrame) -> DataFrame:
    """Show columns of every line that is an object with a non-empty text url; others are skipped."""
    told = {"url": "variant", "section": "variant"}
    fields = ", ".join(f"{f.name} {told.get(f.name, f.dataType.simpleString())}" for f in SHOWS.fields)
    parsed = compute_once(lines, {"_r": F.from_json("line", fields)})
    kept = [c for c in lines.columns if c != "line"]

    def value(name: str):
        c = F.col(f"_r.{name}")
        return (F.try_variant_get(c, "$", "string") if name in told else c).alias(name)

    def is_text(name: str):
        return F.schema_of_variant(F.col(f"_r.{name}")) == "STRING"

    shows = (
        parsed.where(is_text("url"))
        .select(*kept, *[value(n) for n in SHOWS.names], is_text("section").alias("_section_ok"))
        .where(F.col("url") != "")
    )
    section = F.when(F.col("_section_ok"), blank_to_null(F.col("section")))
    return shows.withColumn("section", F.coalesce(section, urls.section_by_path(F.col("url")))).drop("_section_ok")


def read_shows_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Cache load: bad lines are skipped, the last line of a url wins."""
    shows = parse_lenient(with_line_order(spark.read.text(path)))
    last = F.max_by(F.struct(*SHOWS.names), F.struct("file", "block", "row")).alias("s")
    return shows.groupBy("url").agg(last).select("s.*")


def check_lines(lines: DataFrame, site: Site = Site(), scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(file, line_no, line) -> (normalized records, rejects(file, line_no, issues)).

    A url may occur once in the whole input, in order of file and line, or once in each ``scope`` (say, a file).
    Checked lines are written once: records, rejects and the search for repeats all come
    from them, and every line is parsed a single time.
    """
    full = lines.where(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")) != "")
    checked = materialize(validate_import(full, site).drop("line"), "checked-lines")
    bad = checked.where(F.size("issues") > 0).select("file", "line_no", "issues")
    good = normalize_import(checked.where(F.size("issues") == 0))
    placed = good.withColumn("_at", F.struct("file", "line_no"))
    records, repeats = duplicate_url_check(placed, "_at", list(scope))
    elsewhere = F.when(F.col("first_line.file") != F.col("file"), F.concat(F.lit(" of "), F.col("first_line.file"))).otherwise("")
    repeated = repeats.select("file", "line_no", F.array(F.concat(
        F.lit("url: duplicate of line "), F.col("first_line.line_no").cast("string"), elsewhere)).alias("issues"))
    return records.drop("_at"), bad.unionByName(repeated)


def read_shows_strict(spark: SparkSession, path: str, site: Site = Site(), strict: bool = True
                      ) -> tuple[DataFrame, DataFrame]:
    """Import read of a file or a folder: (records, rejects). Strict mode raises on the first bad line or an empty input.

    A url seen earlier anywhere in the input is a bad line.
    """
    records, rejects = check_lines(numbered_lines(spark, path), site)
    if strict:
        first = rejects.orderBy("file", "line_no").limit(1).collect()
        if first:
            raise ValueError(f"Line {first[0].line_no}: invalid record ({'; '.join(first[0].issues)}) in {first[0].file}")
        if records.isEmpty():
            raise ValueError(f"no records found in {path}")
    return records, rejects


def write_shows(df: DataFrame, path: str) -> None:
    """All columns on every line, nulls included."""
    conform(df, SHOWS).write.option("ignoreNullFields", "false").json(path)
