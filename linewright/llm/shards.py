"""Shards of near equal bytes by Karmarkar-Karp differencing.

Groups of equal texts are not divided. A partial partition is a tuple of shard sums; the two
with the largest spread are combined again and again, the largest sum of one with the
smallest of the other, until one tuple is left.

That takes one heap, so a level takes at most ``MOST_ITEMS`` items at a time: while there
are more, they are dealt by hash to chunks, and each chunk is differenced into ``BUNDLES``
bundles that the next level takes as items. Items above a fixed share of all bytes (no more
than ``shards * HEAVY`` can be) and a hashed share of the small ones stay single to the
last level, where they even out what the bundles leave. A group above a shard's fair share
has its shard to itself, as it may not be cut.

Null texts are empty and have size 8. Repeated rows keep a row each. ``slot`` counts rows
within a shard by hashed blocks, so no task numbers a whole shard.
"""

from __future__ import annotations

import heapq
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.plans.durable import durable

OVERHEAD = 8
MOST_ITEMS = 20_000
BUNDLES = 96
HEAVY = 64
BLOCK_ROWS = 50_000


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item."""
    if not sizes:
        return []
    # A node is a leaf's number, or two nodes and, per slot, the slots that it joins.
    nodes: list = list(range(len(sizes)))
    heap = [(-size, at, [size] + [0] * (shards - 1)) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right), strict=True)]
        order = sorted(range(shards), key=lambda slot: -sums[slot])
        least = sums[order[-1]]
        joined = [sums[slot] - least for slot in order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-joined[0], len(nodes) - 1, joined))
    found = [0] * len(sizes)
    stack = [(len(nodes) - 1, list(range(shards)))]
    while stack:
        at, shard_of = stack.pop()
        if isinstance(nodes[at], int):
            found[nodes[at]] = shard_of[0]
            continue
        a, b, order = nodes[at]
        of_left, of_right = [0] * shards, [0] * shards
        for slot, joined in enumerate(order):
            of_left[joined] = shard_of[slot]
            of_right[shards - 1 - joined] = shard_of[slot]
        stack += [(a, of_left), (b, of_right)]
    return found


def _differenced(items: DataFrame, chunk: str, shards: int, prefix: str) -> DataFrame:
    """``(item, part)``, each chunk on its own; the part's name holds prefix and chunk."""

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "item"])
        parts = differencing(frame["bytes"].tolist(), shards)
        names = [f"{prefix}{key[0]}-{part}" for part in parts]
        return pd.DataFrame({"item": frame["item"].to_numpy(), "part": names})

    return items.groupBy(chunk).applyInPandas(run, "item string, part string")


def assign(groups: DataFrame, shards: int, most_items: int = MOST_ITEMS) -> DataFrame:
    """``(item, shard)`` for each of the distinct ``(item, bytes)``."""
    if most_items < 4 * (shards * HEAVY + BUNDLES):
        # Each level must leave fewer items than it takes.
        raise ValueError(f"most_items is too small for {shards} shards: {most_items}")
    items, levels = durable(groups), []
    while True:
        n, total = items.agg(F.count(F.lit(1)), F.sum("bytes")).first()
        if n <= most_items:
            break
        heavy = F.col("bytes") * shards * HEAVY > F.lit(total)
        lot = F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(1_000_000))
        single = heavy | (lot < int(1_000_000 * most_items / 4 / n))
        chunk = F.pmod(F.xxhash64(F.lit(len(levels)), "item"), F.lit(-(-n // most_items)))
        small = items.where(~single).withColumn("chunk", chunk)
        bundled = durable(_differenced(small, "chunk", BUNDLES, f"{len(levels)}-"))
        levels.append(bundled)
        sums = small.join(bundled, "item").groupBy("part").agg(F.sum("bytes").alias("bytes"))
        sums = sums.select(F.col("part").alias("item"), "bytes")
        items = durable(items.where(single).unionByName(sums))
    last = _differenced(items.withColumn("chunk", F.lit("")), "chunk", shards, "")
    found = last.select("item", F.expr("int(substr(part, 2))").alias("shard"))
    for bundled in reversed(levels):
        inner = bundled.join(found.withColumnRenamed("item", "part"), "part")
        found = found.unionByName(inner.select("item", "shard"))
    return found


def sharded(
    df: DataFrame,
    shards: int,
    doc_id: str = "doc_id",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row of ``df``."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = durable(
        df.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.sha2(body.cast("binary"), 256).alias("item"),
        )
    )
    groups = rows.groupBy("item").agg(F.sum("size").alias("bytes"))
    found = assign(groups, shards)
    n_blocks = rows.count() // (shards * block_rows) + 1
    block = F.pmod(F.xxhash64("doc_id", "item"), F.lit(n_blocks))
    placed = durable(rows.join(found, "item").withColumn("block", block))
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "item")
    numbered = placed.withColumn("number", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("number") - 1 + F.col("offset")).cast("long").alias("slot"),
    )
