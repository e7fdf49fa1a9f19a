"""Exact top-k by inner product over a bit-sliced index.

The index keeps, per block of vectors, one bitmap per component and bit: bit i says whether
the block's i-th vector has that bit of that component, counted from the block's least
value. For a query, the slices of all components, each as often as its own weight's bits say,
are added by carry-save adders on whole bitmaps; of negative weights the distance from the
largest value counts. The slices of the sums are the scores of all rows of the block at once,
but for a constant. Walked from the most significant one down they split the rows into those
above the k-th score and those equal to it; of the latter, the boundary, the smallest ids are
taken. No vector is put together again and no product is made of one.

Queries and blocks meet as blocks: groups of ``QUERY_ROWS`` queries with blocks of
``BLOCK_ROWS`` vectors; each meeting keeps k rows a query. Vectors that are null or hold a
null or non-finite component take no part, nor do null ids. Components that a shorter
vector lacks count as zero. Repeated rows are candidates
each, and one query together. Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import batch, slices
from linewright.plans.durable import durable
from linewright.plans.sizing import BROADCAST_BYTES, fits_broadcast

SCALE = 1024.0
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
BLOCKS_A_TASK = 64


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, parts)`` of the vectors that take part."""
    sound = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    parts = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(vec_id).cast("long").alias("vec_id"), parts.alias("parts")
    )


def _matrix(lists: list[list[int]]) -> np.ndarray:
    width = max(map(len, lists), default=0)
    found = np.zeros((len(lists), width), np.int64)
    for at, parts in enumerate(lists):
        found[at, : len(parts)] = parts
    return found


class Block:
    """A block's ids, and as bitmaps the bits of its components above their least values."""

    def __init__(self, ids: np.ndarray, low: list[int], slices_: list[list[int]]) -> None:
        self.ids, self.low, self.slices = ids, low, slices_
        self.all = (1 << len(ids)) - 1

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Block:
        low = rows.min(0) if len(rows) else np.zeros(rows.shape[1], np.int64)
        # Unsigned, as the range of two longs may be no long.
        spread = rows.astype(np.uint64) - low.astype(np.uint64)
        found = []
        for d in range(rows.shape[1]):
            bits = int(spread[:, d].max(initial=0)).bit_length()
            places = [(spread[:, d] >> np.uint64(b) & np.uint64(1)).astype(bool) for b in range(bits)]
            found.append(
                [int.from_bytes(np.packbits(one, bitorder="little"), "little") for one in places]
            )
        return cls(ids, low.tolist(), found)

    def packed(self) -> tuple[bytes, list[int], list[int], bytes]:
        """``(ids, least values, bits per component, slices)``, as they are stored."""
        size = -(-len(self.ids) // 8)
        flat = b"".join(one.to_bytes(size, "little") for own in self.slices for one in own)
        return self.ids.tobytes(), self.low, list(map(len, self.slices)), flat

    @classmethod
    def stored(cls, ids: bytes, low: list[int], bits: list[int], flat: bytes) -> Block:
        ids_ = np.frombuffer(ids, np.int64)
        size, at, found = -(-len(ids_) // 8), 0, []
        for n in bits:
            cuts = [at + size * b for b in range(n)]
            found.append([int.from_bytes(flat[cut : cut + size], "little") for cut in cuts])
            at += size * n
        return cls(ids_, low, found)

    def scores(self, query: list[int]) -> tuple[list[int], int]:
        """Slices of all rows' scores, lowest first, and the constant that these lack."""
        levels: list[list[int]] = [[]]
        lacking = 0
        for low, own, weight in zip(self.low, self.slices, query, strict=False):
            lacking += weight * low
            if weight < 0:
                lacking += weight * ((1 << len(own)) - 1)
            size = abs(weight)
            for c in range(size.bit_length()):
                if size >> c & 1:
                    while len(levels) < c + len(own):
                        levels.append([])
                    for b, bitmap in enumerate(own, c):
                        levels[b].append(bitmap if weight > 0 else bitmap ^ self.all)
        sums, at = [], 0
        while at < len(levels):
            pending = levels[at]
            while len(pending) > 1:
                x, y = pending.pop(), pending.pop()
                z = pending.pop() if pending else 0
                half = x ^ y
                pending.append(half ^ z)
                if at + 1 == len(levels):
                    levels.append([])
                levels[at + 1].append(x & y | z & half)
            sums.append(pending[0] if pending else 0)
            at += 1
        return sums, lacking

    def split(self, sums: list[int], k: int) -> tuple[int, int]:
        """Rows above the k-th score, and those equal to it."""
        above, even = 0, self.all
        for bitmap in reversed(sums):
            high = above | even & bitmap
            if high.bit_count() >= k:
                even &= bitmap
            else:
                above = high
                even &= ~bitmap
        return above, even

    def places(self, rows: int) -> np.ndarray:
        octets = np.frombuffer(rows.to_bytes(-(-len(self.ids) // 8), "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(octets, bitorder="little", count=len(self.ids)))

    def top(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """The k best ``(score, vec_id)`` but the query's own id, ties to smaller ids."""
        own = int((self.ids == query_id).sum())
        sums, lacking = self.scores(query)
        above, even = self.split(sums, min(k + own, len(self.ids)))
        sure, equal = self.places(above), self.places(even)
        equal = equal[np.argsort(self.ids[equal], kind="stable")]
        # Of equal rows the smallest ids, and enough of them if the query itself is one.
        rows = np.concatenate([sure, equal[: k + own]])
        found = []
        for row, vec_id in zip(rows.tolist(), self.ids[rows].tolist(), strict=True):
            if vec_id != query_id:
                score = sum((bitmap >> row & 1) << at for at, bitmap in enumerate(sums))
                found.append((-(score + lacking), vec_id))
        return [(-score, vec_id) for score, vec_id in sorted(found)[:k]]


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(ids, low, bits, slices)``: blocks of vectors as bitmaps, stored."""
    schema = pa.schema(
        [
            ("ids", pa.binary()),
            ("low", pa.list_(pa.int64())),
            ("bits", pa.list_(pa.int32())),
            ("slices", pa.binary()),
        ]
    )

    def packed(ids: list[int], lists: list[list[int]]) -> pa.RecordBatch:
        block = Block.of(np.array(ids, np.int64), _matrix(lists))
        return batch(schema, *[[part] for part in block.packed()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = [], []
        for new_ids, new_lists in slices(batches, 1024):
            ids += new_ids
            lists += new_lists
            if len(ids) >= block_rows:
                yield packed(ids, lists)
                ids, lists = [], []
        if ids:
            yield packed(ids, lists)

    return durable(vectors.mapInArrow(run, "ids binary, low array<long>, bits array<int>, slices binary"))


def nearest(
    df: DataFrame,
    is_query,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query_rows: int = QUERY_ROWS,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``df`` that ``is_query`` holds
    for, its k best other rows."""
    vectors = quantised(df, vec_id, vector)
    blocks = build_index(vectors)
    queries = durable(vectors.where(is_query).distinct())
    n_groups = queries.count() // query_rows + 1
    group = F.pmod(F.xxhash64("vec_id"), F.lit(n_groups))
    groups = queries.groupBy(group.alias("group")).agg(
        F.collect_list("vec_id").alias("query_ids"), F.collect_list("parts").alias("queries")
    )
    groups = durable(groups)
    n_blocks = blocks.count()
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)).cast("array<long>"))
    meetings = blocks.withColumn("group", numbers)
    if fits_broadcast(groups, max_broadcast_bytes):
        # Each meeting is long work on few bytes: dealt out one by one.
        conf, context = df.sparkSession.conf, df.sparkSession.sparkContext
        tasks = max(int(conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism)
        meetings = meetings.repartition(max(1, min(n_blocks * n_groups, tasks)))
        meetings = meetings.join(F.broadcast(groups), "group")
    else:
        # A group meets BLOCKS_A_TASK blocks in a task; queries are copied, not blocks.
        salts = max(1, -(-n_blocks // BLOCKS_A_TASK))
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))
        salt = F.pmod(F.xxhash64("ids"), F.lit(salts)).alias("salt")
        meetings = meetings.select("*", salt).join(
            groups.withColumn("salt", copies).hint("merge"), ["group", "salt"]
        )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *parts, query_ids, queries_ in slices(batches, 1):
            block = Block.stored(*[part[0] for part in parts])
            out = [
                (query_id, vec_id_, score)
                for query_id, query in zip(query_ids[0], queries_[0], strict=True)
                for score, vec_id_ in block.top(query_id, query, k)
            ]
            if out:
                yield batch(schema, *zip(*out, strict=True))

    columns = ["ids", "low", "bits", "slices", "query_ids", "queries"]
    partial = meetings.select(columns).mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
