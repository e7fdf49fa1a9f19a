"""Size checks that stand before every broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side that is broadcast. Beyond it the operators shuffle.
BROADCAST_BYTES = 32 << 20

# A group beyond either bound does not go through one task.
HOT_ROWS = 5_000_000
HOT_BYTES = 256 << 20

# Groups beyond each bound are at most so many, whatever the data: their list is collected
# or broadcast.
MOST_HOT = 100_000

# Cost of one row and of one field in a broadcast hash table, generously.
_ROW_BYTES = 64
_FIELD_BYTES = 16


def row_bytes(df: DataFrame) -> Column:
    """Upper estimate of what a row of ``df`` takes in a broadcast."""
    size = F.lit(_ROW_BYTES + _FIELD_BYTES * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return size


def measured(df: DataFrame) -> tuple[int, int]:
    """The rows of ``df``, and the bytes they take in a broadcast, by one aggregation."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return rows, size or 0


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if all of ``df`` takes ``max_bytes`` at most.

    Runs one aggregation over ``df`` and brings back one row. ``max_bytes=0`` answers no
    without running anything.
    """
    return max_bytes > 0 and measured(df)[1] <= max_bytes


def hot_bounds(rows: int, size: int, hot_rows: int, hot_bytes: int) -> tuple[int, int]:
    """Rows and bytes beyond which a group of a table of so many does not go through one
    task: those asked for, but no more than ``MOST_HOT`` groups can be beyond either."""
    return max(hot_rows, rows // MOST_HOT), max(hot_bytes, size // MOST_HOT)
