"""Running sums and maxima over groups of any size.

A window over a group runs in one task. Here rows are sorted into range pieces, which cut a
group that holds most of them as often as needed; a window runs within each piece of a group,
and what the pieces before add up to, a row per piece and group, is joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.plans.durable import durable
from linewright.plans.keys import quoted
from linewright.plans.sizing import fits_broadcast

_PIECE_BITS = 33  # of monotonically_increasing_id(), below the partition's number


def in_pieces(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``__at``, their place by ``group`` and ``order``, and ``__piece``.

    Pieces are written to shared storage: their borders are sampled, and would be others if a
    task ran again.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = quoted([group, *order])
    placed = (
        rows.repartitionByRange(tasks, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    return durable(placed.withColumn("__piece", F.shiftright("__at", _PIECE_BITS)))


def _met(pieces: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    named = runs.withColumnsRenamed({"__piece": "__run_piece", group: "__run_group"})
    named = F.broadcast(named) if fits_broadcast(named) else named.hint("merge")
    same = (F.col("__piece") == F.col("__run_piece")) & (
        F.col(f"`{group}`") == F.col("__run_group")
    )
    return pieces.join(named, same).drop("__run_piece", "__run_group")


def _before(group: str) -> Window:
    return (
        Window.partitionBy(f"`{group}`")
        .orderBy("__piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def ranked(pieces: DataFrame, group: str, name: str) -> DataFrame:
    """``pieces`` with their rank, from 0, in the group; groups are not null."""
    runs = pieces.groupBy("__piece", group).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    shift = F.coalesce(F.sum("__rows").over(_before(group)), F.lit(0)) - F.col("__first")
    met = _met(pieces, runs.select("__piece", group, shift.alias("__shift")), group)
    return met.withColumn(name, F.col("__at") + F.col("__shift")).drop("__shift")


def sum_before(pieces: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """``pieces`` with the sum of ``value`` over the rows before in the group; 0 at first."""
    return _running(pieces, group, value, name, F.sum, lambda a, b: a + b, F.lit(0))


def max_before(pieces: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """``pieces`` with the maximum of ``value`` over the rows before in the group, or null."""
    return _running(pieces, group, value, name, F.max, F.greatest, F.lit(None))


def _running(pieces, group, value, name, total, both, none) -> DataFrame:
    rows = pieces.withColumn("__value", value.cast("long"))
    runs = rows.groupBy("__piece", group).agg(total("__value").alias("__run"))
    carry = total("__run").over(_before(group))
    runs = runs.select("__piece", group, F.coalesce(carry, none.cast("long")).alias("__carry"))
    here = (
        Window.partitionBy("__piece", f"`{group}`")
        .orderBy("__at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.coalesce(total("__value").over(here), none.cast("long"))
    met = _met(rows.withColumn("__here", within), runs, group)
    return met.withColumn(name, both(F.col("__here"), F.col("__carry"))).drop(
        "__value", "__here", "__carry"
    )
