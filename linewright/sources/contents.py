"""Contents of listed files, read by tasks: whole texts, digests, digests of ranges.

A digest is read in pieces of ``PIECE_BYTES``, so a file of any size takes that much memory. One
file's digest is one task's work, as MD5 runs from the first byte to the last; ranges of a file
are digested by as many tasks as there are ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.plans.sizing import BROADCAST_BYTES, fits_broadcast
from linewright.sources.listing import handle, list_files

PIECE_BYTES = 8 << 20
CHUNK_BYTES = 256 << 20

# A task's share of files to read: so many bytes, of which each file counts as some at least.
TASK_BYTES = 128 << 20
OPEN_BYTES = 1 << 20

# Largest text that is one value, and bytes of texts that a task hands over at a time.
TEXT_BYTES = (1 << 31) - 64
BATCH_BYTES = 32 << 20


def parted(uri: str) -> tuple:
    """A file's handle, and its path there."""
    scheme, rest = uri.split("://", 1)
    authority, path = rest.split("/", 1)
    system, base = handle(f"{scheme}://{authority}")
    return system, f"{base}/{path}"


def deal_out(
    rows: DataFrame, length: str, task_bytes: int = TASK_BYTES, open_bytes: int = OPEN_BYTES
) -> DataFrame:
    """``rows`` dealt to tasks, of about ``task_bytes`` each, to which a row adds ``open_bytes``;
    no fewer tasks than cores, as far as there are rows."""
    work = F.sum(F.col(length) + F.lit(open_bytes))
    n, total = rows.agg(F.count(F.lit(1)), work).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(min(n, max(cores, -(-(total or 0) // task_bytes))), 1))


def range_md5(uri: str, offset: int, length: int | None = None) -> str:
    """The MD5 of a range of a file, to its end if no length is given."""
    digest, left = hashlib.md5(usedforsecurity=False), length
    system, path = parted(uri)
    with system.open_input_file(path) as source:
        source.seek(min(offset, source.size()))
        while left is None or left > 0:
            piece = source.read(PIECE_BYTES if left is None else min(left, PIECE_BYTES))
            if not piece:
                break
            digest.update(piece)
            left = None if left is None else left - len(piece)
    return digest.hexdigest()


def digest_files(
    spark: SparkSession, path: str | list[str], *, hidden: str = "error"
) -> DataFrame:
    """Rows ``(key, md5)``, one per file under ``path``, empty ones included.

    ``key`` is the path below ``path``. Files of any size are streamed. Names that begin with
    ``.`` or ``_`` are an error, as in ``read_lines``, unless ``hidden="read"``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [range_md5(uri, 0) for uri in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests)], ["key", "md5"])

    files = list_files(spark, path, hidden=hidden)
    dealt = deal_out(files, "length").select("file", "uri")
    return dealt.mapInArrow(run, "key string, md5 string")


def _digested(ranges: DataFrame) -> DataFrame:
    """``(key, offset, length, md5)`` of rows ``(key, uri, offset, length)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, uri, offset, length = batch.columns
            where = zip(uri.to_pylist(), offset.to_pylist(), length.to_pylist(), strict=True)
            digests = pa.array([range_md5(*one) for one in where], pa.string())
            names = ["key", "offset", "length", "md5"]
            yield pa.RecordBatch.from_arrays([key, offset, length, digests], names)

    dealt = deal_out(ranges, "length").select("key", "uri", "offset", "length")
    return dealt.mapInArrow(run, "key string, offset long, length long, md5 string")


def digest_chunks(
    spark: SparkSession,
    path: str | list[str],
    chunk_bytes: int = CHUNK_BYTES,
    *,
    hidden: str = "error",
) -> DataFrame:
    """Rows ``(key, offset, length, md5)``: a manifest of files cut every ``chunk_bytes``.

    The last chunk of a file is what is left; an empty file is one empty chunk. Chunks are
    dealt to tasks evenly, so that one huge file is digested by all of them.
    """
    if chunk_bytes < 1:
        raise ValueError("a chunk has a byte at least")
    files = list_files(spark, path, hidden=hidden)
    starts = F.expr(f"sequence(0L, greatest(length - 1, 0L), {chunk_bytes}L)")
    cut = files.select(F.col("file").alias("key"), "uri", "length", F.explode(starts).alias("offset"))
    size = F.least(F.col("length") - F.col("offset"), F.lit(chunk_bytes)).cast("long")
    return _digested(cut.select("key", "uri", "offset", size.alias("length")))


def _uncovered(listed: DataFrame, files: DataFrame) -> DataFrame:
    """``(key, offset, length)``: what of ``files`` the ranges ``listed`` do not cover."""
    end = F.col("offset") + F.col("length")
    # The end of a file counts as a range of its own, so that the gap before it is seen.
    marks = listed.select("key", "offset", end.alias("end"), F.lit(None).cast("long").alias("size"))
    size = F.col("size")
    marks = marks.unionByName(files.select("key", size.alias("offset"), size.alias("end"), "size"))
    of_file = Window.partitionBy("key")
    before = of_file.orderBy("offset", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = marks.select(
        "key",
        F.least("offset", F.max("size").over(of_file)).alias("stop"),
        F.coalesce(F.max("end").over(before), F.lit(0)).alias("reached"),
        F.max("size").over(of_file).alias("size"),
        F.count(F.lit(1)).over(of_file).alias("ranges"),
    )
    bare = (F.col("stop") > F.col("reached")) | ((size == 0) & (F.col("ranges") == 1))
    length = (F.col("stop") - F.col("reached")).alias("length")
    return gaps.where(bare).select("key", F.col("reached").alias("offset"), length)


def reconcile_chunks(
    spark: SparkSession,
    path: str | list[str],
    manifest: DataFrame,
    *,
    hidden: str = "error",
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows ``(key, offset, length, status)`` for every chunk of ``manifest``, and for what of
    the files below ``path`` it does not cover.

    ``manifest`` has ``(key, offset, length, md5)``; its chunks may be of any sizes. A chunk is
    ``ok`` or ``failed``; ``missing`` if there is no such file or it ends before the chunk
    does; ``unlisted`` is a range, or an empty file, that no chunk covers. Chunks that say the
    same twice are one; several digests of one range fail.

    Only the ranges that the manifest names are read, each by one task; ``unlisted`` ones are
    not. Names of files meet the manifest's in a broadcast if they are few, else in a merge, of
    which adaptive execution splits a file with very many chunks.
    """
    chunks = manifest.groupBy("key", "offset", "length").agg(
        F.min(F.coalesce(F.lower("md5"), F.lit("unstated"))).alias("low"),
        F.max(F.coalesce(F.lower("md5"), F.lit("unstated"))).alias("high"),
    )
    listed = list_files(spark, path, hidden=hidden)
    files = listed.select(F.col("file").alias("key"), "uri", F.col("length").alias("size"))
    named = F.broadcast(files) if fits_broadcast(files, max_broadcast_bytes) else files.hint("merge")
    met = chunks.join(named, "key", "left")
    whole = F.coalesce(F.col("size") >= F.col("offset") + F.col("length"), F.lit(False))
    digests = _digested(met.where(whole).select("key", "uri", "offset", "length"))
    right = (F.col("low") == F.col("md5")) & (F.col("high") == F.col("md5"))
    status: Column = F.when(F.col("md5").isNull(), "missing").when(right, "ok").otherwise("failed")
    compared = chunks.join(digests, ["key", "offset", "length"], "left").select(
        "key", "offset", "length", status.alias("status")
    )
    known = manifest.where("key is not null").select("key", "offset", "length")
    unlisted = _uncovered(known, files).withColumn("status", F.lit("unlisted"))
    return compared.unionByName(unlisted)


def read_texts(
    spark: SparkSession, path: str | list[str], *, hidden: str = "error"
) -> DataFrame:
    """Rows ``(file, text)``, one per file, its lines in order; empty files included.

    Files are listed and read by tasks, and ones whose name says so are decompressed. ``file``
    is the path below ``path``; hidden names are an error, as in ``read_lines``, unless
    ``hidden="read"``. A file is one value and must be below 2 GB; send big ones to
    ``read_lines``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            texts: list[bytes] = []
            held = 0
            for name, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, where = parted(uri)
                with system.open_input_stream(where) as source:
                    text = source.read(TEXT_BYTES)
                    if len(text) == TEXT_BYTES:
                        raise ValueError(f"{uri} is too big for one value; use read_lines")
                if names and held + len(text) > BATCH_BYTES:
                    yield _texts(names, texts)
                    names, texts, held = [], [], 0
                names.append(name)
                texts.append(text)
                held += len(text)
            if names:
                yield _texts(names, texts)

    files = list_files(spark, path, hidden=hidden)
    dealt = deal_out(files, "length").select("file", "uri")
    read = dealt.mapInArrow(run, "file string, text binary")
    return read.withColumn("text", F.col("text").cast("string"))


def _texts(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts, pa.binary())], ["file", "text"])
