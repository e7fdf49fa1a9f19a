"""Quality by the votes of the nearest labelled neighbours in a latent semantic space.

A text's terms are its hashed byte pairs, and one term for how many of its words repeat a
word of the eight before; their square-rooted counts are weighted by rarity among all
documents. The space is the leading right singular directions of at most ``TRAIN_ROWS``
labelled texts, those with the smallest hash of their id. Its labelled vectors, at most
``TRAIN_ROWS`` x ``DIMENSIONS`` floats, go to every task, which computes the exact cosines of
its documents with all of them, block by block, and lets the ``NEIGHBOURS`` nearest vote
with weights that grow with similarity.

Null texts are empty; they and texts without neighbours score the share of good labels, or
0.5 if nothing is labelled. An id with several labels counts with their mean. Null ids and
labels train nothing. Repeated rows keep a row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import keyed, slices

TRAIN_ROWS = 4000
DIMENSIONS = 64
NEIGHBOURS = 10
SHARPNESS = 4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

PAIR_TERMS = 2048
REPEAT_TERMS = 9
REPEAT_WEIGHT = 0.05
REACH = 8
TERMS = PAIR_TERMS + REPEAT_TERMS
CHUNK = 1 << 20


def counts(text: bytes) -> np.ndarray:
    """Counts of a text's terms."""
    found = np.zeros(TERMS, np.float32)
    octets = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(octets) - 1), CHUNK):
        part = octets[at : at + CHUNK + 1].astype(np.uint32)
        pairs = part[:-1] * np.uint32(256) + part[1:]
        hashed = (pairs * np.uint32(2654435761)) >> np.uint32(21)
        found[:PAIR_TERMS] += np.bincount(hashed, minlength=PAIR_TERMS)
    tokens = text.split()
    if len(tokens) > REACH:
        ids = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
        repeats = np.zeros(len(ids), bool)
        for lag in range(1, REACH + 1):
            repeats[lag:] |= ids[lag:] == ids[:-lag]
        share = int(repeats.mean() * (REPEAT_TERMS - 1))
        found[PAIR_TERMS + share] = REPEAT_WEIGHT * len(text)
    return found


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the terms
    directions: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled texts x dimensions, of length 1
    labels: np.ndarray

    def place(self, term_counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.sqrt(term_counts) * self.weights) @ self.directions)

    def scores(self, term_counts: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(term_counts), prior)
        cosines = self.place(term_counts) @ self.vectors.T
        near = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
        votes = np.take_along_axis(cosines, nearest, 1).clip(0).astype(np.float64) ** SHARPNESS
        total = votes.sum(1)
        score = (votes * self.labels[nearest]).sum(1) / np.where(total > 0, total, 1)
        return np.where(total > 0, score, prior).clip(0, 1).round(6)


def held_out(doc_id: str = "doc_id"):
    remainder = F.crc32(F.col(doc_id).cast("string")) % FOLDS
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def rarity(rows: DataFrame) -> np.ndarray:
    """The terms' weights, from the documents that hold them, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(TERMS, np.int64), 0
        for (texts,) in slices(batches):
            for text in texts:
                held += counts(text) > 0
            total += len(texts)
        terms = pa.array(np.arange(TERMS + 1), pa.int64())
        sums = pa.array(np.append(held, total), pa.int64())
        yield pa.RecordBatch.from_arrays([terms, sums], names=["term", "held"])

    partial = rows.select("text").mapInArrow(run, "term long, held long")
    sums = dict(partial.groupBy("term").agg(F.sum("held")).collect())  # TERMS + 1 rows
    held = np.array([sums.get(term, 0) for term in range(TERMS)], np.float64)
    return (np.log((1 + sums.get(TERMS, 0)) / (1 + held)) + 1).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    rows = keyed(docs, "doc_id", "text").select("doc_id", "text")
    weights = rarity(rows)
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where(
        "doc_id is not null and quality is not null"
    )
    usable = usable.where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    present = usable.join(rows.select("doc_id"), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, label, texts in slices(batches):
            vectors = [counts(text).tobytes() for text in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(label, pa.float64()), pa.array(vectors, pa.binary())],
                names=["doc_id", "label", "vector"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, label double, vector binary"
    # One row per chosen id, also where a document is repeated.
    sample = (
        texts.mapInArrow(run, schema)
        .groupBy("doc_id")
        .agg(F.max(F.struct("label", "vector")).alias("row"))
        .select("doc_id", "row.*")
        .collect()
    )
    sample.sort(key=lambda row: row["doc_id"])
    labels_ = np.array([row["label"] for row in sample], np.float64)
    weighted = np.zeros((len(sample), TERMS), np.float32)
    for at, row in enumerate(sample):
        weighted[at] = np.sqrt(np.frombuffer(row["vector"], np.float32)) * weights
        weighted[at] /= np.linalg.norm(weighted[at]) or 1
    del sample
    _, directions = np.linalg.eigh(weighted.T @ weighted)
    directions = np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS])
    return Model(weights, directions, _unit(weighted @ directions), labels_)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, text_key, score)`` per row of ``docs``."""
    rows = keyed(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            scores = [
                shared.value.scores(np.stack([counts(text) for text in texts]))
                for _, _, texts in slices([part])
            ]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores, pa.float64())],
                names=["doc_id", "text_key", "score"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, text_key long, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, fit(docs, labels))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        found = [
            shared.value.scores(
                np.stack([counts((t or "").encode()) for t in texts.iloc[at : at + 256]])
            )
            for at in range(0, len(texts), 256)
        ]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.where(score(F.col(f"`{text}`")) >= THRESHOLD)
