"""Shared helpers: tables, row keys, and streams of rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one slice of an Arrow batch that a task has in Python's memory at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, text_key, text)``; a null text is empty.

    Rows that agree in id and text are alike to every operator, so the id and a hash of the
    text are key enough where ids are null or repeated.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = df.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    return named.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Joins on ``doc_id`` and ``text_key``, null ids included."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (
        left["text_key"] == right["text_key"]
    )


def join_counted(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with an aggregation of them by ``key``.

    The aggregation leaves its result partitioned by ``key``, and Spark would join it where
    it lies; adaptive execution splits a key with very many rows only where both sides are
    shuffled for the join itself. The second condition, true of equal keys, brings that about.
    """
    named = counted.withColumnRenamed(key, "__key")
    equal = (F.col(key) == F.col("__key")) & (F.hash(key) == F.hash("__key"))
    return rows.join(named, equal).drop("__key")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[list]:
    """Lists of columns of at most ``rows`` rows; text columns come as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [
                column.cast(pa.binary()).to_pylist()
                if pa.types.is_string(column.type)
                else column.to_pylist()
                for column in part.columns
            ]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(key, rows)`` of a stream sorted by its first column; rows are an iterator."""
    rows = (row for part in slices(batches) for row in zip(*part, strict=True))
    return groupby(rows, key=lambda row: row[0])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
