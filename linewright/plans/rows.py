"""Whole rows as single values that can be compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_orderable(kind: T.DataType) -> bool:
    """Whether Spark can sort values of this type."""
    if isinstance(kind, T.ArrayType):
        return is_orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(is_orderable(field.dataType) for field in kind.fields)
    return not isinstance(
        kind, (T.MapType, T.VariantType, T.CalendarIntervalType, T.UserDefinedType)
    )


def _packed(schema: T.StructType, order: Sequence[str]) -> tuple[Column, bool]:
    """A struct of all columns, those of ``order`` first, and whether it can be sorted."""
    rest = [name for name in schema.names if name not in order]
    row = F.struct(*[F.col(f"`{name}`") for name in (*order, *rest)])
    return row, is_orderable(schema)


def last_row(schema: T.StructType, order: Sequence[str]) -> Column:
    """Aggregate: the last row by ``order``, as a struct.

    Where the types allow, the other columns break ties, so that a task run again gives
    the same row. One struct in the buffer is also less to sort and shuffle than the row
    and its order side by side.
    """
    row, orderable = _packed(schema, order)
    return F.max(row) if orderable else F.max_by(row, _order(order))


def first_row(schema: T.StructType, order: Sequence[str]) -> Column:
    """Aggregate: the first row by ``order``, as a struct."""
    row, orderable = _packed(schema, order)
    return F.min(row) if orderable else F.min_by(row, _order(order))


def _order(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{name}`") for name in order])
