"""French card labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings import fixed_values as fv


def day_label(day: Column) -> Column:
    months = F.array(*[F.lit(m) for m in fv.MONTH_LABELS])
    return F.concat_ws(
        " ", F.lpad(F.dayofmonth(day).cast("string"), 2, "0"),
        F.element_at(months, F.month(day)), F.year(day).cast("string"),
    )


def date_label(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() & end.isNull(), fv.NO_DATE_LABEL)
        .when(start.isNull(), day_label(end))
        .when(end.isNull() | (start == end), day_label(start))
        .otherwise(F.concat(day_label(start), F.lit(" → "), day_label(end)))
    )


def euros(amount: Column) -> Column:
    whole = F.format_number(F.round(amount, 0), 0)
    grouped = F.replace(whole, F.lit(","), F.lit(fv.THOUSANDS_SEPARATOR))
    return F.concat(grouped, F.lit(fv.CURRENCY_SUFFIX))


def price_label(low: Column, high: Column) -> Column:
    return (
        F.when(low.isNull() & high.isNull(), fv.NO_PRICE_LABEL)
        .when(high.isNull(), F.concat(F.lit("Dès "), euros(low)))
        .when(low.isNull(), F.concat(F.lit("Jusqu’à "), euros(high)))
        .when(low == high, euros(low))
        .otherwise(F.concat(euros(low), F.lit(" - "), euros(high)))
    )


def duration_label(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    return (
        F.when(minutes.isNull() | (minutes == 0), None)
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(hours, F.lit(" h")))
        .otherwise(F.concat(hours, F.lit(" h "), rest.cast("string")))
    )


def section_label(section: Column) -> Column:
    return F.when(section == "cinema", fv.SECTION_LABELS["cinema"]).otherwise(fv.SECTION_LABELS["theatre"])


def card_labels(works: DataFrame) -> DataFrame:
    return works.withColumns({
        "date_label": date_label(F.col("start_date"), F.col("end_date")),
        "price_label": price_label(F.col("price_min"), F.col("price_max")),
        "duration_label": duration_label(F.col("duration_min")),
        "section_label": section_label(F.col("section")),
    })
