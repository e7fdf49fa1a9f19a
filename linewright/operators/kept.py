"""Operators over tables that are kept and updated run by run.

The tables are versioned, laid out by buckets of their keys' hash: a run reads and writes the
buckets of its own keys, and is seen whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.operators.keyed import latest_per_key
from linewright.operators.naming import check_bases, taken_numbers
from linewright.plans.durable import durable
from linewright.plans.keys import key_names, quoted
from linewright.plans.rows import is_orderable
from linewright.plans.running import in_pieces, max_before, ranked, sum_before
from linewright.sinks.versions import newest, publish_groups, read_groups

BUCKET = "bucket"
BUCKETS = 256


def _bucket(key: str | Sequence[str], buckets: int) -> Column:
    hashed = F.xxhash64(*quoted(key_names(key)))
    return F.pmod(hashed, F.lit(buckets)).cast("int").alias(BUCKET)


def _buckets_of(df: DataFrame) -> list[int]:
    """The buckets that occur, at most as many as the table has."""
    return sorted(row[0] for row in df.select(BUCKET).distinct().collect())


# -- the latest row of each key ----------------------------------------------------------


def keep_latest(
    batch: DataFrame,
    path: str,
    key: str | Sequence[str],
    order: str | Sequence[str],
    *,
    buckets: int = BUCKETS,
) -> list[int]:
    """Bring the table of latest rows at ``path`` up to date with ``batch``; the buckets
    rewritten come back.

    The table holds for each key what ``latest_per_key`` gives over all batches so far, in
    whatever sequence they come: a batch that is run again, or that is older than what is kept,
    changes nothing. The first batch founds the table, with so many ``buckets``; later ones
    keep to that, to ``key``, ``order`` and the columns. A batch reads and rewrites only the
    buckets that its keys fall into. Of two runs at a time one fails with ``AlreadyThere``.
    """
    names, orders = key_names(key), key_names(order)
    if BUCKET in batch.columns:
        raise ValueError(f"the rows have a column {BUCKET!r} of their own")
    before = newest(batch.sparkSession, path)
    facts = {"key": names, "order": orders, "buckets": buckets}
    if before is not None:
        facts["buckets"] = before.facts.get("buckets")
        if before.facts != facts:
            raise ValueError(f"the table at {path} is kept by {before.facts}")
    new = latest_per_key(batch, names, orders)
    new = durable(new.select("*", _bucket(names, facts["buckets"])))
    touched = _buckets_of(new)
    if before is not None and not touched:
        return []
    rows = new
    if before is not None:
        there = read_groups(batch.sparkSession, path, touched, at=before)
        both = there.unionByName(new).drop(BUCKET)
        rows = latest_per_key(both, names, orders).select("*", _bucket(names, facts["buckets"]))
        rows = rows.select(*quoted(there.columns))
    publish_groups(rows, path, BUCKET, after=before, facts=facts)
    return touched


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each key, as the batches so far have it."""
    return read_groups(spark, path).drop(BUCKET)


# -- free names --------------------------------------------------------------------------


def found_registry(taken: DataFrame, path: str, *, buckets: int = BUCKETS) -> None:
    """A registry of names at ``path`` that starts with those of the one-column ``taken``.

    It holds the free numbers of each base as intervals ``(base, first, last)``, where 0 is the
    base alone and no ``last`` means all from there on. A base it does not hold is free as a
    whole. Names are parsed here and never again.
    """
    spark = taken.sparkSession
    numbers = taken_numbers(taken).distinct().select(
        F.col("__base").alias("base"), F.col("__number").alias("number")
    )
    pieces = in_pieces(numbers, "base", ["number"])
    gaps = max_before(pieces, "base", F.col("number"), "last_taken")
    none = F.lit(None).cast("long").alias("last")
    free = gaps.select(
        "base",
        F.coalesce(F.col("last_taken") + 1, F.lit(0)).alias("first"),
        (F.col("number") - 1).alias("last"),
    ).where("first <= last")
    tails = pieces.groupBy("base").agg((F.max("number") + 1).alias("first"))
    every = free.unionByName(tails.select("base", "first", none))
    rows = every.select("*", _bucket("base", buckets))
    publish_groups(rows, path, BUCKET, after=newest(spark, path), facts={"buckets": buckets})


def free_intervals(spark: SparkSession, path: str) -> DataFrame:
    """``(base, first, last)`` of the registry at ``path``."""
    return read_groups(spark, path).drop(BUCKET)


def reserve_names(
    requests: DataFrame, path: str, base: str, order: str | Sequence[str]
) -> DataFrame:
    """``requests`` with a column ``name``, as ``allocate_free_names`` gives it with every name
    of the registry at ``path`` taken; the names given are taken from then on.

    The registry is updated before the rows come back, as a table in the shared folder. Runs
    one after the other give what one run over all their requests would, if these are ordered
    so; of two at a time one fails with ``AlreadyThere`` and has given nothing. A run killed
    after its update has taken names that nobody got.

    No name is parsed. Of a base's free intervals, one with ``f`` free numbers below it serves
    the requests of rank ``f`` onwards. Ranks, those sums and the meeting of both go by range
    pieces, so that a base may have most of the requests or of the intervals. Only buckets of
    the bases asked for are read and rewritten.
    """
    if "name" in requests.columns:
        raise ValueError("requests already has a column 'name'")
    spark = requests.sparkSession
    before = newest(spark, path)
    if before is None or "buckets" not in before.facts:
        raise FileNotFoundError(f"no registry at {path}")
    buckets = before.facts["buckets"]
    orders = key_names(order)
    orders += [
        field.name
        for field in requests.schema.fields
        if field.name not in (base, *orders) and is_orderable(field.dataType)
    ]
    # A base is checked, ranked and counted as this one table has it.
    asked_rows = requests.select(
        F.col(f"`{base}`").alias("base"),
        *[F.col(f"`{name}`").alias(f"__{at}") for at, name in enumerate(orders)],
        F.struct("*").alias("row"),
    )
    check_bases(asked_rows.select(F.col("base").alias("__base")))
    pieces = in_pieces(asked_rows, "base", [f"__{at}" for at in range(len(orders))])
    asked = durable(
        pieces.groupBy("base").agg(F.count(F.lit(1)).alias("n")).select("*", _bucket("base", buckets))
    )
    touched = _buckets_of(asked)
    there = read_groups(spark, path, touched, at=before)

    known = there.join(asked.select("base", "n"), "base", "left")
    new = asked.join(there.select("base").distinct(), "base", "left_anti")
    none = F.lit(None).cast("long").alias("last")
    every = known.select("base", "first", "last", "n", BUCKET).unionByName(
        new.select("base", F.lit(0).cast("long").alias("first"), none, "n", BUCKET)
    )
    spans = in_pieces(every, "base", ["first"])
    room = F.coalesce(F.col("last") - F.col("first") + 1, F.lit(0))
    spans = durable(sum_before(spans, "base", room, "below").drop("__at", "__piece"))

    left = F.greatest(F.coalesce("n", F.lit(0)) - F.col("below"), F.lit(0))
    updated = spans.select("base", (F.col("first") + left).alias("first"), "last", BUCKET).where(
        "last is null or first <= last"
    )

    rank = ranked(pieces.select("base", "row", "__at", "__piece"), "base", "place")
    row_type = rank.schema["row"].dataType
    steps = spans.where("below < n").select(
        "base",
        F.col("below").alias("place"),
        F.lit(0).alias("kind"),
        (F.col("first") - F.col("below")).alias("shift"),
        F.lit(None).cast(row_type).alias("row"),
    )
    wanted = rank.select(
        "base", "place", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("shift"), "row"
    )
    merged = in_pieces(steps.unionByName(wanted), "base", ["place", "kind"])
    met = max_before(merged, "base", F.col("shift"), "shifted").where("kind = 1")
    number = F.col("place") + F.col("shifted")
    name = F.when(number == 0, F.col("base")).otherwise(F.concat("base", number.cast("string")))
    named = durable(met.select("row.*", name.alias("name")))
    publish_groups(updated.select("base", "first", "last", BUCKET), path, BUCKET, after=before)
    return named
