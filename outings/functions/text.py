"""Native column expressions for text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def collapse(c: Column) -> Column:
    """Every run of white space (no-break spaces too) becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    return blank_to_null(collapse(c))


def clean_text(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({name: clean(F.col(name)) for name in cols})


def group(c: Column, pattern: str, index: int) -> Column:
    """One group of the first match, null where there is no match."""
    return blank_to_null(F.regexp_extract(c, pattern, index))


def groups(c: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(index))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the measure the import limits are stated in."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """One search for all words, so that ``c`` is worked out once."""
    return c.rlike("|".join(re.escape(word) for word in words))
