"""French date text to ISO days, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outings import fixed_values as fv
from outings.functions.text import blank_to_null, clean, collapse, group, groups, let


def _month_alternation() -> str:
    words = [(w, "") for w in fv.MONTH_NAMES] + [(w, r"\.?") for w in fv.MONTH_ABBREVIATIONS]
    words.sort(key=lambda pair: -len(pair[0]))
    return "(?:" + "|".join(word + tail for word, tail in words) + ")"


MONTH = _month_alternation()


def _with_months(pattern: str) -> str:
    return pattern.replace("MONTH", MONTH)


NUMERIC_SPAN = _with_months(fv.NUMERIC_SPAN)
TWO_YEAR_SPAN = _with_months(fv.TWO_YEAR_SPAN)
ONE_YEAR_SPAN = _with_months(fv.ONE_YEAR_SPAN)
ONE_MONTH_SPAN = _with_months(fv.ONE_MONTH_SPAN)
FROM_DAY = _with_months(fv.FROM_DAY)
UNTIL_DAY = _with_months(fv.UNTIL_DAY)
WORD_DAY = _with_months(fv.WORD_DAY)
RELEASE = _with_months(fv.RELEASE)

SPAN_TYPE = "struct<start:string,end:string>"


_MONTH_MAP = "map(" + ", ".join(
    f"'{word}', '{number:02d}'" for word, number in {**fv.MONTH_NAMES, **fv.MONTH_ABBREVIATIONS}.items()) + ")"


def _month_number(name: Column) -> Column:
    return F.try_element_at(F.expr(_MONTH_MAP), F.replace(F.lower(name), F.lit("."), F.lit("")))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _word_iso(day: Column, month: Column, year: Column) -> Column:
    century = F.when(year.startswith("00"), F.concat(F.lit("20"), F.substring(year, 3, 2))).otherwise(year)
    return _iso(century, _month_number(month), day)


def _numeric_iso(day: Column, month: Column, year: Column) -> Column:
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return _iso(full, month, day)


def _pick(c: Column, pattern: str, *indexes: int) -> list[Column]:
    return [F.regexp_extract(c, pattern, i) for i in indexes]


def _days_in(text: Column) -> Column:
    words = F.transform(groups(text, WORD_DAY, 0), lambda m: _word_iso(*_pick(m, WORD_DAY, 1, 2, 3)))
    numbers = F.transform(groups(text, fv.NUMERIC_DATE, 0), lambda m: _numeric_iso(*_pick(m, fv.NUMERIC_DATE, 1, 2, 3)))
    return F.concat(words, numbers)


def parse_date_range(text: Column) -> Column:
    """``struct(start, end)`` of ISO day strings; the most specific wording wins.

    The whole match is taken from the text once per wording; its parts are then
    read from that short match. Days are not checked here (the quality gate does).
    """

    def span(start: Column | None, end: Column | None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            (none if start is None else start).alias("start"),
            (none if end is None else end).alias("end"),
        )

    def read(t: Column) -> Column:
        def when_found(pattern: str, build) -> Column:
            return let(group(t, pattern, 0), lambda m: F.when(m.isNotNull(), build(m)))

        def numeric(m):
            p = _pick(m, NUMERIC_SPAN, 1, 2, 3, 4, 5, 6)
            return span(_numeric_iso(*p[:3]), _numeric_iso(*p[3:]))

        def two_years(m):
            p = _pick(m, TWO_YEAR_SPAN, 1, 2, 3, 4, 5, 6)
            return span(_word_iso(*p[:3]), _word_iso(*p[3:]))

        def one_year(m):
            d1, m1, d2, m2, y = _pick(m, ONE_YEAR_SPAN, 1, 2, 3, 4, 5)
            return span(_word_iso(d1, m1, y), _word_iso(d2, m2, y))

        def one_month(m):
            d1, d2, mo, y = _pick(m, ONE_MONTH_SPAN, 1, 2, 3, 4)
            return span(_word_iso(d1, mo, y), _word_iso(d2, mo, y))

        return F.coalesce(
            when_found(NUMERIC_SPAN, numeric),
            when_found(TWO_YEAR_SPAN, two_years),
            when_found(ONE_YEAR_SPAN, one_year),
            when_found(ONE_MONTH_SPAN, one_month),
            when_found(FROM_DAY, lambda m: span(_word_iso(*_pick(m, FROM_DAY, 1, 2, 3)), None)),
            when_found(UNTIL_DAY, lambda m: span(None, _word_iso(*_pick(m, UNTIL_DAY, 1, 2, 3)))),
            let(_days_in(t), lambda d: span(F.array_min(d), F.array_max(d))),
        )

    return let(F.lower(collapse(F.coalesce(text, F.lit("")))), read)


def parse_single_day(text: Column) -> Column:
    """A text that is exactly one day, in words, in numbers, or starting as ISO."""
    whole_word = f"^(?:{WORD_DAY})$"
    whole_number = f"^{fv.NUMERIC_DATE}$"
    return let(
        clean(text),
        lambda t: F.when(t.rlike(whole_word), _word_iso(*_pick(t, whole_word, 1, 2, 3)))
        .when(t.rlike(whole_number), _numeric_iso(*_pick(t, whole_number, 1, 2, 3)))
        .otherwise(iso_prefix(t)),
    )


def iso_prefix(text: Column) -> Column:
    return group(text, fv.ISO_PREFIX, 1)


def real_day(text: Column) -> Column:
    """The text if it names an existing calendar day (one-digit parts allowed), else null."""
    shaped = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & ~text.startswith("0000")
    return F.when(shaped & text.try_cast("date").isNotNull(), text)


def instant(text: Column) -> Column:
    """Timestamp of an ISO text; without a zone it is UTC whatever the session's zone is."""
    zoned = (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$"), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return zoned.try_cast("timestamp")


def release_day_text(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, RELEASE, 1))
