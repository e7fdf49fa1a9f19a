"""Operators over text lines.

``text`` columns hold whole texts or single lines; the work is per line either way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import has_marker, matching_lines, neutralised
from linewright.plans.durable import durable, require_durable
from linewright.plans.keys import key_struct, quoted
from linewright.plans.sizing import (
    BROADCAST_BYTES,
    HOT_BYTES,
    HOT_ROWS,
    fits_broadcast,
    hot_bounds,
    row_bytes,
)


def count_matching_lines(df: DataFrame, id: str, text: str, needle: str) -> DataFrame:
    """Rows ``(id, n)``: how many lines of each text contain ``needle``.

    One row per input row, no shuffle. For a file spread over rows see
    ``count_matching_rows``.
    """
    return df.select(id, matching_lines(text, needle).alias("n"))


def count_matching_rows(df: DataFrame, id: str, text: str, needle: str) -> DataFrame:
    """Rows ``(id, n)``: matching lines over all rows of each ``id``.

    For rows of ``read_lines``. Each task counts its part of a file first, so a file that
    makes up most of the data is still counted by many tasks.
    """
    return df.groupBy(id).agg(F.sum(matching_lines(text, needle)).alias("n"))


def having_marker(df: DataFrame, text: str, needle: str) -> DataFrame:
    """The rows with at least one line containing ``needle``."""
    return df.where(has_marker(text, needle))


def neutralise_lines(
    df: DataFrame, text: str, needle: str, mark: str = "#"
) -> DataFrame:
    """``df`` with the lines matching ``needle`` commented out by ``mark``."""
    return df.withColumn(text, neutralised(text, needle, mark))


def _header_array(
    df: DataFrame,
    group: str,
    text: str,
    marker: str,
    header: Sequence[str | Mapping[str, Any]],
) -> Column:
    """The header rows as an array literal of structs typed like ``df``."""
    rows = [{text: row} if isinstance(row, str) else dict(row) for row in header]
    others = [field for field in df.schema.fields if field.name != group]
    unknown = {name for row in rows for name in row} - {f.name for f in others}
    if unknown:
        raise ValueError(f"header names unknown columns: {sorted(unknown)}")
    if not any(marker in (row.get(text) or "") for row in rows):
        raise ValueError(f"no header row contains the marker {marker!r}")
    return F.array(
        *[
            F.struct(
                *[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in others]
            )
            for row in rows
        ]
    )


def _group_facts(df: DataFrame, group: str, text: str, marker: str) -> DataFrame:
    """Per group: its key, its size, and whether any of its texts has the marker."""
    return df.groupBy(key_struct(group).alias("__group")).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.sum(row_bytes(df)).alias("__bytes"),
        F.bool_or(F.coalesce(has_marker(text, marker), F.lit(False))).alias("__marked"),
    )


def _header_for(facts: DataFrame, group: str, array: Column) -> DataFrame:
    bare = facts.where(~F.col("__marked"))
    rows = bare.select(f"__group.`{group}`", F.explode(array).alias("__row"))
    return rows.select(f"`{group}`", "__row.*")


def header_rows(
    df: DataFrame,
    group: str,
    text: str,
    marker: str,
    header: Sequence[str | Mapping[str, Any]],
) -> DataFrame:
    """The header, once for each group of ``df`` without the marker.

    These are all the rows that ``ensure_header`` changes: written with
    ``replace_groups`` they bring a stored table up to date and leave the groups that
    have the marker untouched on disk.
    """
    array = _header_array(df, group, text, marker, header)
    facts = _group_facts(df, group, text, marker)
    return _header_for(facts, group, array).select(*quoted(df.columns))


def ensure_header(
    df: DataFrame,
    group: str,
    text: str,
    marker: str,
    header: Sequence[str | Mapping[str, Any]],
    *,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """``df`` with each group that lacks ``marker`` replaced by ``header``.

    A group is kept whole or replaced whole. ``header`` holds texts, or mappings from
    column to value; columns it leaves out become ``NULL``. One of its rows must contain
    the marker, else the next run would replace the group again.

    Texts are not shuffled while the list of groups is small enough to broadcast, which
    one pass over the group column checks. With more groups, those above ``hot_rows``
    rows or ``hot_bytes`` of whole rows still meet a broadcast. The bounds grow where the
    data does, so that there are never more than 2 * ``MOST_HOT`` such groups. The rest
    shuffles, no group of it above the bounds; what is known of the groups is kept on
    shared storage, so that the texts are searched once.
    """
    if hot_rows < 1 or hot_bytes < 1:
        raise ValueError("hot_rows and hot_bytes must be positive")
    require_durable(df)
    array = _header_array(df, group, text, marker, header)
    facts = _group_facts(df, group, text, marker)
    same_group = key_struct(group) == F.col("__group")

    if fits_broadcast(df.select(f"`{group}`").distinct(), max_broadcast_bytes):
        marked = facts.where("__marked").select("__group")
        kept = df.join(F.broadcast(marked), same_group, "left_semi")
        return kept.unionByName(_header_for(facts, group, array))

    facts = durable(facts)
    rows, size = facts.agg(F.sum("__rows"), F.sum("__bytes")).first()
    most_rows, most_bytes = hot_bounds(rows or 0, size or 0, hot_rows, hot_bytes)
    is_hot = (F.col("__rows") > most_rows) | (F.col("__bytes") > most_bytes)
    hot = facts.where(is_hot).select("__group", "__marked")
    hot_marked = hot.where("__marked").select("__group")
    cold_marked = facts.where(~is_hot & F.col("__marked")).select("__group")
    kept_hot = df.join(F.broadcast(hot_marked), same_group, "left_semi")
    cold = df.join(F.broadcast(hot.select("__group")), same_group, "left_anti")
    kept_cold = cold.join(cold_marked.hint("merge"), same_group, "left_semi")
    return (
        kept_hot.unionByName(kept_cold).unionByName(_header_for(facts, group, array))
    )
