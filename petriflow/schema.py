"""Schemas of the relations that operators work on, and the check of required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_D = T.DoubleType()

CELLS = T.StructType(
    [T.StructField("cell_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("time", T.IntegerType())]
    + [T.StructField(c, _D) for c in ("x", "y", "intden", "area")]
)
CELL_CSV = T.StructType([T.StructField(c, _D) for c in ("X", "Y", "Labels", "Time", "IntDen", "Area")])
TILE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("tile", "crop_lo", "crop_hi", "stitch_lo", "stitch_hi", "inner_lo", "inner_hi")])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a ValueError that lists the missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
