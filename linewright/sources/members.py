"""Lines of gzip files of several members, read by many tasks.

Such a file is gzip files one after the other, as ``cat``, block compressors and rotating logs
write them. Where its members begin is found out once, by one task a file, and kept; from then
on a task reads a range of members, wherever it is in the file. Of lines that cross members
each is read by the task in whose range it begins, which goes on into the next range for the
rest of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.plans.durable import durable
from linewright.plans.running import in_pieces, max_before, sum_before
from linewright.sources.contents import deal_out, parted
from linewright.sources.listing import list_files

READ_BYTES = 1 << 20
RANGE_BYTES = 32 << 20
LINES = 4096
# A task's share of ranges: so many bytes, to which each range adds some for its opening.
TASK_BYTES = RANGE_BYTES
OPEN_BYTES = 256 << 10
_GZIP = 31  # zlib's name for the format


def members(source, offset: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, raw bytes)`` of the members from ``offset`` on, in pieces of bounded size.

    A member without bytes gives one empty piece. Zeros after the last member, with which some
    tools fill blocks, are passed over; anything else there is an error.
    """
    source.seek(offset)
    data = source.read(READ_BYTES)
    while True:
        while not data or data[:1] == b"\0":
            data = data.lstrip(b"\0") or source.read(READ_BYTES)
            if not data:
                return
        begin, member = source.tell() - len(data), zlib.decompressobj(_GZIP)
        some = False
        while not member.eof:
            raw = member.decompress(data, READ_BYTES)
            data = member.unconsumed_tail
            if raw:
                some = True
                yield begin, raw
            if not data and not member.eof:
                data = source.read(READ_BYTES)
                if not data and not raw:
                    raise ValueError(f"the member at {begin} breaks off")
        if not some:
            yield begin, b""
        data = member.unused_data


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "uri", "offset", "size", "raw"]
    for batch in batches:
        for file, uri, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, path = parted(uri)
            rows: list[tuple[int, int]] = []
            with system.open_input_file(path) as source:
                for offset, raw in members(source, 0):
                    if rows and rows[-1][0] == offset:
                        rows[-1] = offset, rows[-1][1] + len(raw)
                        continue
                    if len(rows) > LINES:
                        # The last one may go on.
                        yield _rows(names, file, uri, rows[:-1], rows[-1][0])
                        rows = rows[-1:]
                    rows.append((offset, len(raw)))
            if rows:
                yield _rows(names, file, uri, rows, length)


def _rows(names, file, uri, rows, end) -> pa.RecordBatch:
    offsets = [offset for offset, _ in rows]
    sizes = [b - a for a, b in zip(offsets, [*offsets[1:], end], strict=True)]
    columns = [[file] * len(rows), [uri] * len(rows), offsets, sizes, [raw for _, raw in rows]]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def index_members(
    spark: SparkSession, path: str | list[str], *, hidden: str = "error"
) -> DataFrame:
    """Rows ``(file, uri, offset, size, raw)``, one per member of the gzip files below ``path``,
    kept as a table: where it begins, and its bytes in the file and decompressed.

    Each file is decompressed once by one task, in bounded memory. Store the rows beside the
    files, and later reads do without. Members without bytes are left out.
    """
    files = list_files(spark, path, hidden=hidden).where("length > 0")
    dealt = files.select("file", "uri", "length").repartition(
        spark.sparkContext.defaultParallelism, "uri"
    )
    schema = "file string, uri string, offset long, size long, raw long"
    return durable(dealt.mapInArrow(_indexed, schema).where("raw > 0"))


def _lines(source, before: int | None, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in members of offsets from ``start`` to below ``end``.

    ``before`` is the offset of the member before ``start``, whose last byte tells whether a
    line begins at ``start``; none at the beginning of the file.
    """
    fresh, line = before is None, bytearray()
    last, seen = b"", False
    for offset, raw in members(source, start if before is None else before):
        if offset < start:
            last = raw[-1:] or last
            continue
        if not seen:
            seen, fresh = True, before is None or last == b"\n"
        if not fresh:
            # What is left of a line that begins before.
            if offset >= end:
                return
            cut = raw.find(b"\n")
            if cut < 0:
                continue
            fresh, raw = True, raw[cut + 1 :]
        if offset >= end:
            if not line:
                return
            cut = raw.find(b"\n")
            line += raw if cut < 0 else raw[:cut]
            if cut < 0:
                continue
            yield bytes(line)
            return
        first, *others = raw.split(b"\n")
        line += first
        for one in others:
            yield bytes(line)
            line = bytearray(one)
    if line:
        yield bytes(line)


def read_member_lines(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``(file, value)``, one per ``\\n``-ended line of the files of ``index``, which
    ``index_members`` made: what ``read_lines`` gives, read in ranges of about ``range_bytes``
    of compressed members.

    A task takes ranges of about ``TASK_BYTES`` together, so that small ones, of which there may
    be very many, do not each wait for a task; there are no fewer tasks than cores, as far as
    there are ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, uri, before, start, end in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                system, path = parted(uri)
                with system.open_input_file(path) as source:
                    held: list[bytes] = []
                    size = 0
                    for line in _lines(source, before, start, end):
                        held.append(line)
                        size += len(line)
                        if len(held) == LINES or size > READ_BYTES:
                            yield _values(file, held)
                            held, size = [], 0
                    if held:
                        yield _values(file, held)

    pieces = in_pieces(index.select("file", "uri", "offset", "size"), "uri", ["offset"])
    placed = max_before(
        sum_before(pieces, "uri", F.col("size"), "below"), "uri", F.col("offset"), "before"
    )
    ranges = placed.groupBy("file", "uri", F.expr(f"below div {range_bytes}").alias("range")).agg(
        F.min_by("before", "offset").alias("before"),
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("size")).alias("end"),
    )
    ranges = ranges.withColumn("size", F.col("end") - F.col("start"))
    ranges = durable(ranges.select("file", "uri", "before", "start", "end", "size"))
    dealt = deal_out(ranges, "size", TASK_BYTES, OPEN_BYTES).drop("size")
    read = dealt.mapInArrow(run, "file string, value binary")
    return read.withColumn("value", F.col("value").cast("string"))


def _values(file: str, lines: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array([file] * len(lines)), pa.array(lines, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["file", "value"])
