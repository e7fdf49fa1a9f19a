"""Keys of one or more columns, compared null-safely."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def quoted(names: Sequence[str]) -> list[str]:
    """Column names as expressions, so that dots in them are not read as field access."""
    return [f"`{name}`" for name in names]


def key_struct(key: str | Sequence[str]) -> Column:
    """The key as one struct.

    A struct is never ``NULL`` itself and equals another whose fields are ``NULL`` in the
    same places. Joining on it is therefore null-safe, and unlike ``<=>`` it is one hash
    key: a join right after a ``groupBy`` of it needs no second shuffle.
    """
    return F.struct(*[f"`{name}`" for name in key_names(key)])


def key_known(key: str | Sequence[str]) -> Column:
    """True where no part of the key is ``NULL``; a filter Parquet takes too."""
    known = [F.col(f"`{name}`").isNotNull() for name in key_names(key)]
    return reduce(Column.__and__, known)
