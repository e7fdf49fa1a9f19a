"""Operators over keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.plans.keys import key_known, key_names, key_struct, quoted
from linewright.plans.pruning import keys_worth_comparing
from linewright.plans.rows import first_row, last_row
from linewright.plans.sizing import BROADCAST_BYTES, row_bytes
from linewright.plans.sketch import SKETCH_BYTES


def latest_per_key(
    df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]
) -> DataFrame:
    """The row of each key that comes last by ``order``, which must leave no ties.

    Each task keeps one row per key before the shuffle, so a key holding most of the
    rows costs the shuffle no more than any other. ``NULL`` orders come first.
    """
    names = key_names(key)
    last = last_row(df.schema, key_names(order)).alias("__row")
    rows = df.groupBy(*quoted(names)).agg(last).select("__row.*")
    return rows.select(*quoted(df.columns))


def rows_to_append(
    base: DataFrame,
    incoming: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    *,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    max_sketch_bytes: int = SKETCH_BYTES,
) -> DataFrame:
    """The rows of ``incoming`` whose key ``base`` does not have, one per key.

    Of several rows with one key the first by ``order`` counts, which must leave no ties.
    ``NULL`` is a key like any other, so a second run finds nothing to add.

    Only keys of ``base`` are read, reduced to distinct ones before they are shuffled.
    They are not shuffled at all where the keys of ``incoming`` are few: one aggregation
    over these checks that first. Where these are too many to broadcast but a Bloom sketch of
    them is not, keys of ``base`` that it rules out are not shuffled.
    """
    names = key_names(key)
    keys, few = keys_worth_comparing(
        base, incoming, names, max_broadcast_bytes, max_sketch_bytes
    )
    present = keys.select(key_struct(names).alias("__present")).distinct()
    if not few:
        # Else Spark may broadcast after all, by its own estimate of the size.
        present = present.hint("merge")
    first = first_row(incoming.schema, key_names(order)).alias("__row")
    candidates = incoming.groupBy(key_struct(names).alias("__key")).agg(first)
    absent = candidates.join(
        present, F.col("__key") == F.col("__present"), "left_anti"
    )
    return absent.select("__row.*").select(*quoted(base.columns))


def append_if_absent(
    base: DataFrame,
    incoming: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    *,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    max_sketch_bytes: int = SKETCH_BYTES,
) -> DataFrame:
    """``base`` as it is, followed by ``rows_to_append``. Existing rows always win.

    To add to a stored table, append ``rows_to_append`` alone.
    """
    return base.unionByName(
        rows_to_append(
            base,
            incoming,
            key,
            order,
            max_broadcast_bytes=max_broadcast_bytes,
            max_sketch_bytes=max_sketch_bytes,
        )
    )


def lookup_with_default(
    df: DataFrame,
    dim: DataFrame,
    key: str | Sequence[str],
    default: Any,
    *,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with the other columns of ``dim`` looked up by ``key``.

    Unknown and ``NULL`` keys get ``default``: one value for all looked-up columns, or a
    mapping from column to value, cast to the column's type. A ``NULL`` that ``dim`` holds
    for a known key stays. A key that ``dim`` repeats is an error.

    One aggregation over ``dim`` checks both its keys and its size. A small ``dim`` is
    broadcast; a big one meets ``df`` in a sort-merge join, whose hot keys Spark's
    adaptive execution splits.
    """
    names = key_names(key)
    values = [name for name in dim.columns if name not in names]
    clash = sorted(set(values) & set(df.columns))
    if clash:
        raise ValueError(f"columns in both inputs: {clash}")
    defaults = default if isinstance(default, Mapping) else dict.fromkeys(values, default)
    if lacking := sorted(set(values) - set(defaults)):
        raise ValueError(f"no default for: {lacking}")

    dim = dim.where(key_known(names))
    per_key = dim.groupBy(*quoted(names)).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(row_bytes(dim)).alias("__bytes")
    )
    most, size = per_key.agg(F.max("__rows"), F.sum("__bytes")).first()
    if (most or 0) > 1:
        raise ValueError(f"{names} is not unique in the lookup table")

    small = (size or 0) <= max_broadcast_bytes
    known = dim.withColumn("__known", F.lit(True))
    joined = df.join(F.broadcast(known) if small else known.hint("merge"), names, "left")

    def looked_up(name: str) -> Column:
        value = F.lit(defaults[name]).cast(dim.schema[name].dataType)
        unknown = F.col("__known").isNull()
        return F.when(unknown, value).otherwise(F.col(f"`{name}`")).alias(name)

    return joined.select(
        *[F.col(f"`{name}`") for name in df.columns],
        *[looked_up(name) for name in values],
    )
