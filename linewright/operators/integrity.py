"""Operators that compare what is there with what should be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.keys import key_known, key_names, quoted
from linewright.plans.pruning import keys_worth_comparing
from linewright.plans.sizing import BROADCAST_BYTES
from linewright.plans.sketch import SKETCH_BYTES


class IncompleteInputs(RuntimeError):
    """Something expected has not landed."""


def reconcile_digests(
    data: DataFrame,
    manifest: DataFrame,
    key: str | Sequence[str],
    *,
    content: str | None = None,
    digest: str = "md5",
) -> DataFrame:
    """One row ``(key, status)`` for every key of ``data`` or ``manifest``.

    ``ok`` and ``failed`` where both have the key, ``missing`` where only the manifest
    has, ``unlisted`` where only the data has. Both sides carry a column ``digest``;
    with ``content`` the data's is the MD5 of that column instead, strings as UTF-8.
    ``NULL`` keys are one key here, unlike in ``missing_inputs``: both sides can hold it.
    If a key occurs several times, it is ``ok`` only if all its digests are the same.

    Contents are hashed where they are read; only keys and digests are shuffled, reduced
    to one row per key and task before that.
    """
    names = key_names(key)
    found = F.md5(content) if content else F.lower(digest)
    absent = F.lit(None).cast("string")
    # A NULL digest must match nothing, so each side says it in another way.
    sides = data.select(
        *quoted(names),
        F.coalesce(found, F.lit("unreadable")).alias("__found"),
        absent.alias("__listed"),
    ).unionByName(
        manifest.select(
            *quoted(names),
            absent.alias("__found"),
            F.coalesce(F.lower(digest), F.lit("unstated")).alias("__listed"),
        )
    )
    per_key = sides.groupBy(*quoted(names)).agg(
        F.min("__found").alias("__found_low"),
        F.max("__found").alias("__found_high"),
        F.min("__listed").alias("__listed_low"),
        F.max("__listed").alias("__listed_high"),
    )
    one_digest = (
        (F.col("__found_low") == F.col("__found_high"))
        & (F.col("__listed_low") == F.col("__listed_high"))
        & (F.col("__found_low") == F.col("__listed_low"))
    )
    status = (
        F.when(F.col("__found_low").isNull(), "missing")
        .when(F.col("__listed_low").isNull(), "unlisted")
        .when(one_digest, "ok")
        .otherwise("failed")
    )
    return per_key.select(*quoted(names), status.alias("status"))


def missing_inputs(
    expected: DataFrame,
    landed: DataFrame,
    key: str | Sequence[str],
    *,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    max_sketch_bytes: int = SKETCH_BYTES,
) -> DataFrame:
    """The keys of ``expected`` that ``landed`` does not have, each once.

    A key with a ``NULL`` in it names nothing that could land and is always missing.

    One aggregation over both sides, which each task reduces to distinct keys before the
    shuffle. Few expected keys, which one aggregation over them checks first, are
    broadcast to ``landed`` so that it is not shuffled; of more keys, a Bloom sketch if that
    is small, so that few landed keys are shuffled that nobody expects.
    """
    names = key_names(key)
    nameable = landed.where(key_known(names))
    there, _ = keys_worth_comparing(
        nameable, expected, names, max_broadcast_bytes, max_sketch_bytes
    )
    both = expected.select(*quoted(names), F.lit(False).alias("__landed")).unionByName(
        there.select(*quoted(names), F.lit(True).alias("__landed"))
    )
    per_key = both.groupBy(*quoted(names)).agg(
        F.bool_or(~F.col("__landed")).alias("__expected"),
        F.bool_or("__landed").alias("__landed"),
    )
    return per_key.where("__expected AND NOT __landed").select(*quoted(names))


def assert_complete(
    expected: DataFrame,
    landed: DataFrame,
    key: str | Sequence[str],
    *,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    max_sketch_bytes: int = SKETCH_BYTES,
) -> None:
    """Raise ``IncompleteInputs`` if any key of ``expected`` has not landed."""
    missing = missing_inputs(
        expected,
        landed,
        key,
        max_broadcast_bytes=max_broadcast_bytes,
        max_sketch_bytes=max_sketch_bytes,
    )
    example = missing.first()
    if example is not None:
        raise IncompleteInputs(f"not landed, among others: {example.asDict()}")
