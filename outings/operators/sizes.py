"""Measured sizes that decide whether a side may be broadcast."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_BYTES = 64  # what a row takes beside its texts
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows, counted. Meant for stored tables: ``df`` is read for it."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    row = sum(texts, F.lit(ROW_BYTES + 8 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).first().n


def broadcast_limit(spark: SparkSession) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()).groups()
    return int(number) * _UNITS[unit]


def fits_broadcast(df: DataFrame) -> bool:
    return measured_bytes(df) <= broadcast_limit(df.sparkSession)
