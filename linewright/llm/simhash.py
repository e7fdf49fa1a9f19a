"""SimHash near-duplicates: fingerprints linked by BK-trees.

A BK-tree keeps each child under its integer Hamming distance to the parent, so a search
follows only edges within the radius of its own distance. One tree of all fingerprints
could not be broadcast, so the trees are sharded by bits: two fingerprints that differ in
at most two bits agree in two of four 16-bit blocks, and each pair of blocks names a
shard. Crowded shards are cut again by three blocks of the bits still free, one of which
must agree; after two such cuts at most 15 bits are free, so no tree has over 32,768
fingerprints, whatever the data. Each shard gives a star of links per linked set instead of
all its pairs, and the stars are joined to components by large-star and small-star rounds, whose
joins shuffle both sides, so that a root with very many fingerprints can be split among tasks.

Null texts are empty. Texts without words have fingerprint zero and link as any other.
Repeated rows keep a row each. Null ids never name a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import batch, join_counted, keyed, same_row, slices
from linewright.plans.durable import durable

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
CROWDED = 4096
MOST_SHINGLES = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64 majority bits of the shingles' XXH64, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum()
    ends += np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    spans = zip(
        starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True
    )
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(body[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), MOST_SHINGLES):
        octets = hashes[at : at + MOST_SHINGLES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, fingerprint)``, the fingerprint as a signed long."""
    rows = keyed(df, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values: list[int] = []
            for _, _, texts in slices([part]):
                values += map(fingerprint, texts)
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(signed)],
                names=["doc_id", "text_key", "fingerprint"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, text_key long, fingerprint long")


class BKTree:
    """Integers under their Hamming distances."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` bits from ``value``."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> None:
        """Adds a value that the tree does not have."""
        here = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != here:
            edge = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(edge, here)


def star_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A link from each of the distinct values to the first of its linked set."""
    parent = list(range(len(values)))

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    tree = BKTree()
    for at, value in enumerate(values):
        for other in tree.within(value, radius):
            a, b = root(at), root(other)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(values[at], values[root(at)]) for at in range(len(values)) if root(at) != at]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(free: list[int], pieces: int) -> list[int]:
    """Masks of the given bit positions in pieces of about equal length."""
    cuts = [len(free) * at // pieces for at in range(pieces + 1)]
    return [
        sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)
    ]


def _masks() -> list[dict[int, list[int]]]:
    """For each level, the masks of a shard and the finer masks that it is cut by."""
    blocks = _parts(list(range(64)), BLOCKS)
    level = [a | b for a, b in combinations(blocks, BLOCKS - RADIUS)]
    levels = [{0: level}]
    for _ in range(2):
        finer = {
            mask: [
                mask | part
                for part in _parts([b for b in range(64) if not mask >> b & 1], RADIUS + 1)
            ]
            for mask in level
        }
        levels.append(finer)
        level = sorted({mask for masks in finer.values() for mask in masks})
    return levels


def _bucketed(rows: DataFrame, finer: dict[int, list[int]]) -> DataFrame:
    """One row of ``(mask, bits, fingerprint)`` for each finer mask."""
    options = F.create_map(
        *[
            part
            for mask, masks in finer.items()
            for part in (
                F.lit(_signed(mask)).cast("long"),
                F.array(*[F.lit(_signed(m)).cast("long") for m in masks]),
            )
        ]
    )
    masks = rows.select("fingerprint", F.explode(options[F.col("mask")]).alias("mask"))
    bits = F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bits")
    return masks.select("mask", bits, "fingerprint").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: enough links to connect all ``fingerprint``s within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for (shards,) in slices(batches):
            found = [
                (_signed(a), _signed(b))
                for shard in shards
                for a, b in star_links(sorted(v & (1 << 64) - 1 for v in shard), RADIUS)
            ]
            yield batch(schema, [a for a, _ in found], [b for _, b in found])

    rows = distinct.select(F.lit(0).cast("long").alias("mask"), "fingerprint")
    stars = []
    levels = _masks()
    for at, finer in enumerate(levels):
        shards = _bucketed(rows, finer)
        cold = shards
        if at + 1 < len(levels):
            crowds = shards.groupBy("mask", "bits").count().where(F.col("count") > CROWDED)
            crowds = durable(crowds.select("mask", "bits"))
            cold = shards.join(crowds, ["mask", "bits"], "left_anti")
        lists = cold.groupBy("mask", "bits").agg(F.collect_list("fingerprint").alias("shard"))
        shared = lists.where(F.size("shard") > 1).select("shard")
        stars.append(shared.mapInArrow(run, "a long, b long"))
        if at + 1 < len(levels):
            if crowds.isEmpty():
                break
            rows = shards.join(crowds, ["mask", "bits"], "left_semi").drop("bits")
    every = stars[0]
    for star in stars[1:]:
        every = every.unionByName(star)
    return every


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: each node of the links ``(a, b)`` but the roots, and the smallest
    node that it reaches."""
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    now = durable(edges.where("a != b").select(larger.alias("a"), smaller.alias("b")).distinct())
    known = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = join_counted(both, least, "a").where("b > a").select(F.col("b").alias("a"), "m")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("m").alias("low"))
        small = join_counted(large, low, "a").select("a", "low", "m")
        now = durable(
            small.select("a", F.col("low").alias("b"))
            .unionByName(small.select(F.col("m").alias("a"), F.col("low").alias("b")))
            .where("a != b")
            .distinct()
        )
        state = now.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")
        ).first()
        if state == known:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = state


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, text_key, fingerprint, root, component_id)`` per row of ``df``; the root
    is the fingerprint that stands for the component, its id the smallest ``doc_id``."""
    marked = durable(fingerprints(df, doc_id, text))
    distinct = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct))
    rooted = distinct.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "root", "component_id")
    return marked.join(named, "fingerprint").select(
        "doc_id", "text_key", "fingerprint", "root", "component_id"
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their component: smallest id, then text hash; one
    of fully repeated rows."""
    marked = near_duplicates(df, doc_id, text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = marked.groupBy("root").agg(F.min(order).alias("kept")).select(
        F.col("kept.doc_id").alias("doc_id"), F.col("kept.text_key").alias("text_key")
    )
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(
        F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(body).alias("text_key"),
    )
    chosen = rows.join(kept, same_row(rows, kept), "left_semi")
    return chosen.dropDuplicates(["doc_id", "text_key"]).select("row.*")
