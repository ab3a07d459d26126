"""Keep the optimizer from computing a costly expression more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results later filters and projections read but never inline.

    A filter on a plain derived column is pushed below the projection with the whole
    expression copied into it. A one-row generator stays in the same codegen stage, costs
    no shuffle, and is a point nothing is copied through.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
