"""WARC archives with a two-level capture index.

``write_archives`` writes a gzip member per record to files of the shared folder and stores
where each record lies. ``write_index`` sorts the captures by reversed-host URL key and page
id into index files of compressed blocks, each file with a sparse directory of its blocks'
first keys. ``read_captures`` binary-searches the list of files, one file's directory, and
one block, and then reads the record's byte range alone.

Records with equal payloads of at least ``SMALL`` bytes are one response and revisits;
the response is the one with the smallest page id (each, should several rows bear it), and
a null id comes last. A null html is an empty payload, a null URL an empty target. Repeated
rows are records each. Each task names its files afresh, so a task run again after a lost
executor writes new ones, and only those that its stored rows name are read.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import batch, slices
from linewright.plans.durable import durable, fresh_dir
from linewright.plans.sizing import fits_broadcast

SMALL = 100
FILE_BYTES = 64 << 20
BLOCK_LINES = 1000
# Pages carry no time of their own, so all records bear one.
DATE = "1970-01-01T00:00:00Z"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def url_key(url: str | Column) -> Column:
    """Host labels from the last to the first, then path and query; no scheme, port, user
    or fragment."""
    value = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(value, parts, 1))
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    plain = F.regexp_extract(value, "^([^#]*)", 1)
    key = F.concat(
        turned, F.lit(")"), F.when(host != "", F.regexp_extract(value, parts, 2)).otherwise(plain)
    )
    return F.regexp_replace(key, r"[\x00-\x20]", "_")


def capture_key(url: str, page_id: str) -> Column:
    number = F.coalesce(F.col(page_id).cast("string"), F.lit("-"))
    return F.concat(url_key(url), F.lit(" "), number)


def record(page_id, url, payload: bytes, digest: str, revisits: bool, first) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, whose Content-Length is that of
    the full payload."""
    target = re.sub(r"[\x00-\x20]", "_", url or "")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisits else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisits:
        headers += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""

    def fields(part: bytes) -> dict[str, str]:
        lines = part.decode().split("\r\n")[1:]
        return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)

    head, _, rest = data.partition(b"\r\n\r\n")
    headers = fields(head)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, fields(http), payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """``(key, file, offset, length)`` of each row's record in the files written."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    large = rows.where(F.octet_length("payload") >= SMALL)
    firsts = large.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    # Written, so that a join has to shuffle it as well, which lets adaptive execution split a
    # payload that very many pages have; few of them are broadcast, and no payload moves.
    firsts = durable(firsts.where("n > 1 and first is not null").drop("n"))
    firsts = F.broadcast(firsts) if fits_broadcast(firsts) else firsts.hint("merge")
    revisits = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    marked = rows.join(firsts, "digest", "left").select(
        capture_key("url", "page_id").alias("key"),
        "page_id",
        "url",
        "digest",
        (F.col("first").isNotNull() & revisits).alias("revisits"),
        "first",
        "payload",
    )
    schema = pa.schema(
        [("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, name, at = None, "", 0
        for keys, ids, urls, digests_, again, firsts_, payloads in slices(batches, 64):
            names, offsets, lengths = [], [], []
            for page_id, url, digest, revisit, first, body in zip(
                ids, urls, digests_, again, firsts_, payloads, strict=True
            ):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                text = url.decode("utf-8", "replace") if url is not None else None
                data = gzip.compress(
                    record(page_id, text, body, digest.decode(), revisit, first), 4, mtime=0
                )
                out.write(data)
                names.append(name)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield batch(schema, [key.decode() for key in keys], names, offsets, lengths)
        if out is not None:
            out.close()

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return durable(marked.mapInArrow(run, "key string, file string, offset long, length long"))


def write_index(captures: DataFrame, folder: str) -> list[tuple[bytes, str]]:
    """First key and name of each index file, in order: as many as shuffle partitions."""
    schema = pa.schema([("first", pa.binary()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, at, first = f"{uuid.uuid4().hex}.cdx", 0, None
        directory, lines = [], []

        def flush(out) -> int:
            data = zlib.compress(b"\n".join(lines))
            directory.append(b"%s\t%d\t%d" % (lines[0].split(b"\t", 1)[0], at, len(data)))
            out.write(data)
            lines.clear()
            return at + len(data)

        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for keys, files, offsets, lengths in slices(batches, BLOCK_LINES):
                for key, file, offset, length in zip(keys, files, offsets, lengths, strict=True):
                    # A key stays in one block, so that its captures are found together.
                    if len(lines) >= BLOCK_LINES and not lines[-1].startswith(key + b"\t"):
                        at = flush(out)
                    first = key if first is None else first
                    lines.append(b"%s\t%s\t%d\t%d" % (key, file, offset, length))
            if lines:
                at = flush(out)
        if first is not None:
            with store.open_output_stream(f"{root}/{name}.dir", compression=None) as out:
                out.write(b"\n".join(directory))
            yield batch(schema, [first], [name])

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
    files = durable(ordered.mapInArrow(run, "first binary, name string")).collect()
    return sorted((bytes(row["first"]), row["name"]) for row in files)


class CaptureIndex:
    """Reads captures by key; keeps a few directories and blocks at hand."""

    def __init__(self, archives: str, folder: str, files: list[tuple[bytes, str]]) -> None:
        self.archives, self.archive_root = _store(archives)
        self.store, self.root = _store(folder)
        self.firsts = [first for first, _ in files]
        self.names = [name for _, name in files]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(16)(self._block)
        self.open = lru_cache(8)(
            lambda file: self.archives.open_input_file(f"{self.archive_root}/{file}")
        )

    def _directory(self, name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        with self.store.open_input_file(f"{self.root}/{name}.dir") as file:
            entries = [line.rsplit(b"\t", 2) for line in file.read().split(b"\n")]
        return [key for key, _, _ in entries], [(int(at), int(n)) for _, at, n in entries]

    def _block(self, name: str, at: int, length: int) -> tuple[list[bytes], list[list[bytes]]]:
        with self.store.open_input_file(f"{self.root}/{name}") as file:
            lines = zlib.decompress(file.read_at(length, at)).split(b"\n")
        entries = [line.rsplit(b"\t", 3) for line in lines]
        return [entry[0] for entry in entries], entries

    def captures(self, key: bytes) -> Iterator[bytes]:
        """The records of a key."""
        number = bisect_right(self.firsts, key) - 1
        if number < 0:
            return
        name = self.names[number]
        keys, places = self.directory(name)
        at = bisect_right(keys, key) - 1
        if at < 0:
            return
        keys, entries = self.block(name, *places[at])
        for _, file, offset, length in entries[bisect_left(keys, key) : bisect_right(keys, key)]:
            data = self.open(file.decode()).read_at(int(length), int(offset))
            yield gzip.decompress(data)


def read_captures(
    keys: DataFrame, archives: str, folder: str, files: list[tuple[bytes, str]]
) -> DataFrame:
    """The records of the ``key``s, each key once: ``(page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload)``."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def page(urn: str | None) -> int | None:
        number = urn[len("<urn:page:") : -1] if urn else "none"
        return None if number == "none" else int(number)

    def row(data: bytes) -> tuple:
        headers, http, payload = parsed(data)
        kind = headers["WARC-Type"]
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        return (
            page(headers["WARC-Record-ID"]),
            headers["WARC-Target-URI"],
            int(http["Content-Length"]),
            digest,
            kind,
            page(headers.get("WARC-Refers-To")),
            payload if kind == "response" else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(archives, folder, files)
        for (part,) in slices(batches, 64):
            out = [row(data) for key in part for data in index.captures(key)]
            if out:
                yield batch(schema, *zip(*out, strict=True))

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.distinct().repartitionByRange(parts, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives and index, and reads every capture back by its key."""
    spark = pages.sparkSession
    archives, folder = fresh_dir(spark, "warc"), fresh_dir(spark, "captures")
    files = write_index(write_archives(pages, archives), folder)
    keys = pages.select(capture_key("url", "page_id").alias("key"))
    return read_captures(keys, archives, folder, files)
