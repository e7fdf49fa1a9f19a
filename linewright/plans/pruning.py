"""Cutting the large side of a key comparison down before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.keys import key_names, key_struct, quoted
from linewright.plans.sizing import BROADCAST_BYTES, measured
from linewright.plans.sketch import (
    SKETCH_BYTES,
    blocks_for,
    can_sketch,
    passing,
    sketch,
    sketch_bytes,
)


def with_keys_of(df: DataFrame, few: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key ``few``, which must be known to be small, has too."""
    wanted = F.broadcast(few.select(key_struct(key).alias("__wanted")))
    return df.join(wanted, key_struct(key) == F.col("__wanted"), "left_semi")


def keys_worth_comparing(
    large: DataFrame,
    small: DataFrame,
    key: str | Sequence[str],
    max_broadcast_bytes: int = BROADCAST_BYTES,
    max_sketch_bytes: int = SKETCH_BYTES,
) -> tuple[DataFrame, bool]:
    """Keys of ``large``, without all or most of those that ``small`` does not have, and
    whether it was all.

    One aggregation measures ``small``. If it proves small, its keys are broadcast into the
    scan of ``large``; if a Bloom sketch of them does, that is, and strangers that pass it are
    left to the caller's exact comparison. Beyond both all keys come back, and with
    ``max_broadcast_bytes=0`` nothing is measured.
    """
    names = key_names(key)
    keys, wanted = large.select(*quoted(names)), small.select(*quoted(names))
    if max_broadcast_bytes <= 0:
        return keys, False
    rows, size = measured(wanted)
    if size <= max_broadcast_bytes:
        return with_keys_of(keys, wanted, names), True
    if sketch_bytes(rows) <= max_sketch_bytes and can_sketch(keys, wanted, names):
        blocks = blocks_for(rows)
        return passing(keys, sketch(wanted, names, blocks), names, blocks), False
    return keys, False
