"""Centroid clustering over bit planes: exact integer dot products by popcounts.

A vector's 64 components, as integers ``floor(1024 * x)`` in two's complement, are stored as
bit planes: bit j of plane i is bit i of component j, so a plane of all components is one
64-bit word, and a vector of 12-bit components is 12 words. With planes weighted by powers of
two, the last of them negative, the dot product of two vectors is the weighted sum of the
popcounts of the ANDs of their planes; a squared distance is made of three such products.
Sums of a cluster's vectors come from the same planes, by counting each bit.

The vectors are packed once and stored. Each round reads the planes, assigns every vector to
its nearest centroid, and brings one row per cluster, component and 32-bit limb to the
driver: sums of limbs are exact, however large the components. A round that changes no
centroid is the last that runs, as all later ones would repeat it. Planes are as many as the
widest component of a slice of rows needs, so one wild value widens its own slice only;
where 64-bit sums could overflow, Python's integers take over.

Only vectors of exactly 64 components, none null or non-finite, take part; others give no
row. Null ids take part but are the last to become a first centroid; of repeated ids the
smaller vector becomes one first. Repeated rows keep a row each. Fewer vectors than centroids
leave fewer centroids; none leave an empty result. A distance or sum that a long cannot hold
is null, and the cluster is right all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.durable import durable

WIDTH = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SALT = "3:"
ROWS = 2048
LIMB = 32
MOST_LONG = (1 << 63) - 1


def kept(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, vector)`` of the vectors that take part, components as doubles."""
    parts = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    sound = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), parts.alias("vector"))
    return rows.where((F.size("vector") == WIDTH) & sound)


def quantised(x: float) -> int:
    """``floor(SCALE * x)``, also where the product is no double."""
    return math.floor(SCALE * x) if abs(x) < 2.0**53 else SCALE * int(x)


def planes_of(parts: list[int]) -> np.ndarray:
    """The bit planes of one vector of integers of any size."""
    width = 1 + max(max(part, ~part).bit_length() for part in parts)
    words = [sum((part >> bit & 1) << at for at, part in enumerate(parts)) for bit in range(width)]
    return np.array(words, np.uint64)


def packed(values: np.ndarray) -> list[np.ndarray]:
    """Bit planes of rows of doubles, ``rows x planes`` words, one array per width."""
    small = (np.abs(values) < 2.0**50).all(1)
    parts = np.floor(np.where(small[:, None], values, 0) * SCALE).astype(np.int64)
    width = 1 + max(int(parts.max()).bit_length(), int(~parts.min()).bit_length())
    found = np.empty((len(values), width), np.uint64)
    for bit in range(width):
        octets = np.packbits((parts >> bit & 1).astype(np.uint8), axis=1, bitorder="little")
        found[:, bit] = octets.view("<u8")[:, 0]
    rows = list(found)
    for at in np.flatnonzero(~small).tolist():
        rows[at] = planes_of([quantised(x) for x in values[at].tolist()])
    return rows


def weights(planes: int) -> list[int]:
    return [1 << bit for bit in range(planes - 1)] + [-(1 << planes - 1)]


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of vectors given as planes, with leading dimensions as numpy pairs them."""
    a, b = left.shape[-1], right.shape[-1]
    exact = np.int64 if a + b + 6 <= 62 else object
    scale = np.array(weights(b), object).astype(exact)
    total = 0
    for bit, weight in enumerate(weights(a)):
        ones = np.bitwise_count(left[..., bit, None] & right).astype(exact)
        total = total + weight * (ones * scale).sum(-1)
    return total


class Centroids:
    """Centroids as integers and as planes of one width."""

    def __init__(self, parts: list[list[int]]) -> None:
        self.parts = parts
        rows = [planes_of(one) for one in parts]
        width = max(map(len, rows), default=0)
        # More planes of a number repeat its sign.
        self.planes = np.array(
            [np.concatenate([row, np.repeat(row[-1:], width - len(row))]) for row in rows]
        )
        self.norms = np.array([sum(x * x for x in one) for one in parts], object)

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the nearest centroid, ties to the first, and the squared distance
        less the vector's own squared length."""
        products = dots(planes[:, None, :], self.planes[None])
        norms = self.norms.astype(products.dtype) if int(self.norms.max()) < 1 << 62 else self.norms
        rest = norms[None] - 2 * products
        best = rest.argmin(1)
        return best, np.take_along_axis(rest, best[:, None], 1)[:, 0]


def _stacked(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, planes)`` of stored rows, those of equal width together."""
    words = [np.frombuffer(row, "<u8") for row in rows.to_pylist()]
    sizes = np.array([len(row) for row in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.array([words[i] for i in at])


def pack(vectors: DataFrame) -> DataFrame:
    """``(vec_id, planes)`` of kept vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False)
                words = [row.astype("<u8").tobytes() for row in packed(values.reshape(-1, WIDTH))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.binary())], names=["vec_id", "planes"]
                )

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {id_type}, planes binary")


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as numbers of ``LIMB`` bits, the last of them signed."""
    limb = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield limb, value & (1 << LIMB) - 1
        value >>= LIMB
        limb += 1
    yield limb, value


def sums(planes: DataFrame, centroids: Centroids) -> tuple[list[int], list[list[int]]]:
    """Of each centroid the number of its vectors, and their sum by component."""
    k = len(centroids.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, WIDTH + 1), object)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                for _, words in _stacked(whole.slice(start, ROWS).column(0)):
                    best, _ = centroids.nearest(words)
                    octets = words.astype("<u8").view(np.uint8).reshape(*words.shape, 8)
                    bits = np.unpackbits(octets, axis=2, bitorder="little")
                    scale = np.array(weights(words.shape[1]), object)
                    for cluster in np.unique(best).tolist():
                        mine = bits[best == cluster]
                        ones = mine.sum(0, dtype=np.int64).astype(object)
                        total[cluster, :WIDTH] += (scale[:, None] * ones).sum(0)
                        total[cluster, WIDTH] += len(mine)
        rows = [
            (cluster, component, limb, value)
            for cluster in range(k)
            for component in range(WIDTH + 1)
            for limb, value in _limbs(int(total[cluster, component]))
            if value
        ]
        names = ["cluster", "component", "limb", "value"]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    partial = planes.select("planes").mapInArrow(
        run, "cluster int, component int, limb int, value long"
    )
    # At most CENTROIDS * (WIDTH + 1) sums, of a few limbs each.
    summed = partial.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value"))
    counts, totals = [0] * k, [[0] * WIDTH for _ in range(k)]
    for cluster, component, limb, value in summed.collect():
        if component == WIDTH:
            counts[cluster] += value << LIMB * limb
        else:
            totals[cluster][component] += value << LIMB * limb
    return counts, totals


def assigned(planes: DataFrame, centroids: Centroids) -> DataFrame:
    """``(vec_id, cluster, distance)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                cluster = np.zeros(part.num_rows, np.int32)
                distance = np.zeros(part.num_rows, object)
                for at, words in _stacked(part.column(1)):
                    best, rest = centroids.nearest(words)
                    cluster[at] = best
                    distance[at] = rest.astype(object) + dots(words, words).astype(object)
                fitting = [int(d) if d <= MOST_LONG else None for d in distance]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cluster), pa.array(fitting, pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    id_type = planes.schema["vec_id"].dataType.simpleString()
    return planes.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` kept vectors whose salted id has the smallest hash."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(k)
    return [[quantised(x) for x in row["vector"]] for row in chosen.select("vector").collect()]


def fit(
    vectors: DataFrame, planes: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT
) -> Centroids | None:
    """The centroids after ``rounds`` rounds; none if there are no vectors."""
    parts = first_centroids(vectors, k, salt)
    if not parts:
        return None
    for _ in range(rounds):
        counts, totals = sums(planes, Centroids(parts))
        moved = [
            [total // count for total in own] if count else old
            for count, own, old in zip(counts, totals, parts, strict=True)
        ]
        if moved == parts:
            break
        parts = moved
    return Centroids(parts)


def clustered(
    df: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    salt: str = SALT,
) -> tuple[DataFrame, Centroids | None]:
    """``(vec_id, cluster, distance)`` of every vector that takes part, kept as a table, and
    the centroids."""
    vectors = kept(df, vec_id, vector)
    planes = durable(pack(vectors))
    centroids = fit(vectors, planes, k, rounds, salt)
    if centroids is None:
        none = planes.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none, None
    return durable(assigned(planes, centroids)), centroids


def digests(found: DataFrame, centroids: Centroids | None) -> DataFrame:
    """The rows with the inertia of their cluster and of all, and the centroid's digest."""
    if centroids is None:
        centroids = Centroids([])
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    total = F.when(F.count("distance") == F.count(F.lit(1)), whole).alias("total")
    # A row for each centroid.
    per_cluster = {row["cluster"]: row["total"] for row in found.groupBy("cluster").agg(total).collect()}

    def fitting(value) -> int | None:
        return int(value) if value is not None and value <= MOST_LONG else None

    every = None if None in per_cluster.values() else fitting(sum(per_cluster.values()))
    rows = [
        (cluster, fitting(value), every, sha256(",".join(map(str, centroids.parts[cluster])).encode()).hexdigest())
        for cluster, value in per_cluster.items()
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    facts = found.sparkSession.createDataFrame(rows, schema)
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
