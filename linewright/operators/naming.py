"""Operators over names and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from linewright.functions import path_stem
from linewright.plans.durable import durable, require_durable
from linewright.plans.keys import key_names
from linewright.plans.pruning import with_keys_of
from linewright.plans.rows import is_orderable
from linewright.plans.sizing import (
    BROADCAST_BYTES,
    HOT_BYTES,
    HOT_ROWS,
    MOST_HOT,
    row_bytes,
)


def stem_counts(df: DataFrame, path: str, default: str) -> DataFrame:
    """Rows ``(stem, n)``: how many paths share each base name without extension."""
    stem = path_stem(path, default).alias("stem")
    return df.groupBy(stem).agg(F.count(F.lit(1)).alias("n"))


# What a number is written with.
_DIGITS = "0123456789"

# Fixed pattern of a name that can be handed out: its base ends in no digit, its number
# has no leading zeros and at most 18 digits.
_NAME = r"[^0-9]([1-9][0-9]{0,17})?\z"

_HOT = "__hot string, __size bigint, __asked boolean"


def _without_number(name: Column) -> Column:
    return F.rtrim(name, F.lit(_DIGITS))


def taken_numbers(taken: DataFrame) -> DataFrame:
    """``(__base, __number)`` of each taken name; 0 stands for the bare base.

    Left out are names that cannot be asked for: numbers alone or with leading zeros.
    """
    if len(taken.columns) != 1:
        raise ValueError(f"taken must have one column, not {taken.columns}")
    name = F.col(f"`{taken.columns[0]}`")
    base = _without_number(name)
    digits = F.substring(name, F.length(base) + 1, F.length(name))
    number = F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("bigint"))
    # One pattern as the filter: Catalyst would work out base and number once more for
    # each condition on them.
    return taken.where(name.rlike(_NAME)).select(
        base.alias("__base"), number.cast("bigint").alias("__number")
    )


def check_bases(asked: DataFrame) -> int:
    """Raise on a base that is empty or ends in a digit; else tell the size of them all."""
    name = F.col("__base")
    valid = (name != "") & (name == _without_number(name))
    invalid = ~F.coalesce(valid, F.lit(False))
    found = asked.agg(
        F.bool_or(invalid).alias("invalid"),
        F.max(F.when(invalid, name)).alias("example"),
        F.sum(row_bytes(asked.select("__base"))).alias("bytes"),
    ).first()
    if found["invalid"]:
        raise ValueError(
            f"base names must be non-empty and not end in a digit: {found['example']!r}"
        )
    return found["bytes"] or 0


def _hot_bases(
    asked: DataFrame, numbers: DataFrame, hot_rows: int, hot_bytes: int
) -> list[tuple[str, int, bool, int]]:
    """Bases whose requests and taken names are beyond a bound, how many these are,
    whether there are requests, and their bytes.

    At most ``MOST_HOT`` entries, the hottest ones: a base left out is above the bounds only
    where all rows together are ``MOST_HOT`` times above them, and then by no more.
    """
    counted = numbers.groupBy("__base").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(row_bytes(numbers)).alias("__bytes")
    )
    per_base = (
        asked.withColumn("__asked", F.lit(True))
        .unionByName(counted.withColumn("__asked", F.lit(False)))
        .groupBy("__base")
        .agg(
            F.sum("__rows").alias("__rows"),
            F.bool_or("__asked").alias("__asked"),
            F.sum("__bytes").alias("__bytes"),
        )
    )
    heat = F.greatest(F.col("__rows") / hot_rows, F.col("__bytes") / hot_bytes)
    hottest = per_base.where(heat > 1).orderBy(heat.desc(), "__base").limit(MOST_HOT)
    return [tuple(row) for row in hottest.collect()]


def allocate_free_names(
    requests: DataFrame,
    taken: DataFrame,
    base: str,
    order: str | Sequence[str],
    *,
    hot_rows: int = HOT_ROWS,
    hot_bytes: int = HOT_BYTES,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``requests`` with a column ``name``: the lowest free of base, base1, base2, ...

    Requests are served by ``order``; every row of the one-column ``taken`` counts.
    Bases must be non-empty and must not end in a digit, so that a base and a number
    give a name no other base can give.

    Among the sorted taken numbers of a base, number ``t`` at index ``j`` has ``t - j``
    free numbers below it. The request of rank ``r`` therefore gets ``r`` plus the count
    of taken numbers with ``t - j <= r``.

    A base goes through one task if its requests and taken numbers are at most ``hot_rows``
    and take at most ``hot_bytes``. Bigger ones are cut into blocks that are numbered in parallel. Taken names of bases
    nobody asks for are dropped before any shuffle, if the list of bases asked for is
    small enough to broadcast. One job checks the bases, a second finds the big ones.
    """
    if "name" in requests.columns:
        raise ValueError("requests already has a column 'name'")
    if hot_rows < 1 or hot_bytes < 1:
        raise ValueError("hot_rows and hot_bytes must be positive")
    require_durable(requests)
    orders = key_names(order)
    # Other columns break ties, so that a task run again repeats itself.
    orders += [
        field.name
        for field in requests.schema.fields
        if field.name not in (base, *orders) and is_orderable(field.dataType)
    ]
    numbers = taken_numbers(taken)
    asked = requests.groupBy(F.col(f"`{base}`").alias("__base")).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(row_bytes(requests)).alias("__bytes")
    )
    if check_bases(asked) <= max_broadcast_bytes:
        numbers = with_keys_of(numbers, asked, "__base")
    hot = _hot_bases(asked, numbers, hot_rows, hot_bytes)
    if not hot:
        return _serve_whole_bases(requests, numbers, base, orders)

    spark = requests.sparkSession
    n_rows = sum(rows for _, rows, _, _ in hot)
    widest = max(size / rows for _, rows, _, size in hot)
    block = max(1, min(hot_rows, int(hot_bytes / widest)), n_rows // MOST_HOT)
    hot_bases = F.broadcast(
        spark.createDataFrame([entry[:3] for entry in hot], _HOT)
    )
    is_hot_request = F.col(f"`{base}`") == F.col("__hot")
    is_hot_number = F.col("__base") == F.col("__hot")
    whole = _serve_whole_bases(
        requests.join(hot_bases, is_hot_request, "left_anti"),
        numbers.join(hot_bases, is_hot_number, "left_anti"),
        base,
        orders,
    )
    split = _serve_split_bases(
        requests.join(hot_bases, is_hot_request, "left_semi"),
        # A number as high as all requests and taken names together is out of reach.
        numbers.join(hot_bases, is_hot_number)
        .where("__asked AND __number < __size")
        .select("__base", "__number")
        .distinct(),
        base,
        orders,
        tasks=2 * -(-n_rows // block),
        block=block,
    )
    return whole.unionByName(split)


def _serve_whole_bases(
    requests: DataFrame, numbers: DataFrame, base: str, orders: list[str]
) -> DataFrame:
    """Each base in one task; the shuffle by base serves both windows."""
    asked = requests.select(
        F.col(f"`{base}`").alias("__base"),
        F.lit(1).alias("__kind"),
        F.lit(None).cast("bigint").alias("__number"),
        F.struct("*").alias("__row"),
    )
    rows = numbers.select(
        "__base",
        F.lit(0).alias("__kind"),
        "__number",
        F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"),
    ).unionByName(asked).repartition("__base")

    each_kind = Window.partitionBy("__base", "__kind").orderBy(
        "__number", *_in_row(orders)
    )
    is_taken = F.col("__kind") == 0
    # Of a taken number the free numbers below it, of a request its rank.
    place = F.when(is_taken, F.col("__number") - F.dense_rank().over(each_kind) + 1).otherwise(
        F.row_number().over(each_kind).cast("bigint") - 1
    )
    # Numbers taken repeatedly meet here, so they need no shuffle of their own.
    again = is_taken & (F.lag("__number").over(each_kind) == F.col("__number"))
    merged = (
        Window.partitionBy("__base")
        .orderBy("__place", "__kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.select("*", place.alias("__place"), again.alias("__again"))
        .where(~F.coalesce("__again", F.lit(False)))
        .withColumn("__taken", F.sum(1 - F.col("__kind")).over(merged))
        .where("__kind = 1")
        .select("__row.*", _handed_out())
    )


def _serve_split_bases(
    requests: DataFrame,
    numbers: DataFrame,
    base: str,
    orders: list[str],
    tasks: int,
    block: int,
) -> DataFrame:
    """The same result with no base in one task.

    A rank is the size of the pieces before plus the position within the piece. For
    requests the pieces are range partitions, fixed on shared storage; for numbers, and
    for the merge of both, they are ``block`` consecutive integers. The broadcast sizes
    of pieces are at most ``tasks`` + (all rows / ``block``) + 2 * (hot bases) rows.
    """
    sort = [f"`{name}`" for name in (base, *orders)]
    pieces = durable(
        requests.repartitionByRange(tasks, *sort)
        .sortWithinPartitions(*sort)
        .select(
            F.col(f"`{base}`").alias("__base"),
            F.spark_partition_id().alias("__piece"),
            # Counts up by one within a partition.
            F.monotonically_increasing_id().alias("__position"),
            F.struct("*").alias("__row"),
        )
    )
    starts = pieces.groupBy("__base", "__piece").agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__position").alias("__first")
    )
    ranked = pieces.join(
        F.broadcast(_with_rows_before(starts, "__piece")), ["__base", "__piece"]
    ).select(
        "__base",
        (F.col("__before") + F.col("__position") - F.col("__first")).alias("__place"),
        "__row",
    )

    # What a request needs to know of the taken numbers: how many there are, at each
    # place where their count grows.
    numbers = numbers.withColumn("__piece", F.expr(f"__number div {block}"))
    counts = numbers.groupBy("__base", "__piece").agg(F.count(F.lit(1)).alias("__rows"))
    in_piece = Window.partitionBy("__base", "__piece").orderBy("__number")
    taken_below = F.col("__before") + F.row_number().over(in_piece) - 1
    steps = (
        numbers.join(
            F.broadcast(_with_rows_before(counts, "__piece")), ["__base", "__piece"]
        )
        .withColumn("__below", taken_below)
        .groupBy("__base", (F.col("__number") - F.col("__below")).alias("__place"))
        .agg((F.max("__below") + 1).alias("__taken"))
        .withColumn("__block", F.expr(f"__place div {block}"))
    )

    # Each block starts with the count reached before it. Ranks are dense, so the blocks
    # that requests fall into follow from their number.
    asked_blocks = (
        pieces.groupBy("__base")
        .count()
        .select(
            "__base",
            F.explode(F.expr(f"sequence(0L, (count - 1) div {block})")).alias("__block"),
            F.lit(None).cast("bigint").alias("__taken"),
        )
    )
    reached = F.max("__reached").over(_pieces_before("__block"))
    openings = (
        steps.select("__base", "__block", "__taken")
        .unionByName(asked_blocks)
        .groupBy("__base", "__block")
        .agg(F.max("__taken").alias("__reached"))
        .select(
            "__base",
            (F.col("__block") * block).alias("__place"),
            reached.alias("__taken"),
            "__block",
        )
        .where("__taken is not null")
    )

    known = steps.unionByName(openings).select(
        "__base",
        "__block",
        "__place",
        F.lit(0).alias("__kind"),
        "__taken",
        F.lit(None).cast(ranked.schema["__row"].dataType).alias("__row"),
    )
    asked = ranked.select(
        "__base",
        F.expr(f"__place div {block}").alias("__block"),
        "__place",
        F.lit(1).alias("__kind"),
        F.lit(None).cast("bigint").alias("__taken"),
        "__row",
    )
    so_far = (
        Window.partitionBy("__base", "__block")
        .orderBy("__place", "__kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        known.unionByName(asked)
        .withColumn("__taken", F.coalesce(F.max("__taken").over(so_far), F.lit(0)))
        .where("__kind = 1")
        .select("__row.*", _handed_out())
    )


def _in_row(names: list[str]) -> list[str]:
    return [f"__row.`{name}`" for name in names]


def _handed_out() -> Column:
    """The name a request of place ``__place`` gets, ``__taken`` numbers coming first."""
    number = F.col("__place") + F.col("__taken")
    return (
        F.when(number == 0, F.col("__base"))
        .otherwise(F.concat("__base", number.cast("string")))
        .alias("name")
    )


def _pieces_before(piece: str) -> WindowSpec:
    """Few rows: what it runs over has one row per base and piece."""
    return (
        Window.partitionBy("__base")
        .orderBy(piece)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _with_rows_before(counts: DataFrame, piece: str) -> DataFrame:
    """``counts`` with the sum of ``__rows`` over the earlier pieces of the base."""
    before = F.sum("__rows").over(_pieces_before(piece))
    return counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__rows")
