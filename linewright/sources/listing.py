"""Files below folders, listed by tasks.

Folders are rows. A task lists the folders it is dealt, and what is below them as long as that
is little; folders beyond are written out as rows, to be dealt to all tasks and listed in the
next round. So a deep or broad tree is listed by many tasks, and no list of names passes
through the driver. The entries of a single folder are one list in a task.

Tasks reach files by handles of Arrow's file systems, opened by scheme: local files, HDFS (where
Arrow finds its client library), S3 and GCS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.plans.durable import durable

# Names of the files that Spark writes beside its data.
SPARKS_OWN = r"_SUCCESS|\..*\.crc|_(started|committed)_.*|_temporary"

# Folders that a task lists on behalf of one that it was dealt.
FOLDERS = 200

# Schemes that are another name for one that Arrow knows.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}

_ENTRY = pa.schema(
    [
        ("root", pa.int32()),
        ("path", pa.string()),
        ("depth", pa.int32()),
        ("file", pa.string()),
        ("length", pa.int64()),
        ("modified", pa.timestamp("us", "UTC")),
        ("kind", pa.string()),
    ]
)
_ENTRY_SQL = (
    "root int, path string, depth int, file string, length long, modified timestamp, kind string"
)


@dataclass(frozen=True)
class Root:
    """Where a path begins: its store, the folder before any wildcard, and the names and
    patterns after it. ``is_file`` where the path names one file."""

    store: str
    folder: str
    patterns: tuple[str, ...]
    is_file: bool = False

    @property
    def prefix(self) -> str:
        return self.folder.rstrip("/") + "/"


@lru_cache
def handle(store: str) -> tuple[pafs.FileSystem, str]:
    """A file system, and what stands before paths in it."""
    scheme, rest = store.split("://", 1)
    found, base = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}/")
    return found, base.rstrip("/")


def roots(spark: SparkSession, path: str | list[str]) -> list[Root]:
    """The roots of paths as Spark takes them. A path without wildcards must exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for one in [path] if isinstance(path, str) else path:
        named = hadoop.Path(one)
        system = named.getFileSystem(conf)
        uri = system.makeQualified(named).toUri()
        store = f"{uri.getScheme()}://{uri.getAuthority() or ''}"
        try:
            handle(store)
        except (pa.ArrowInvalid, OSError, NotImplementedError) as error:
            raise ValueError(f"tasks have no handle for files of {store}: {error}") from error
        parts = [part for part in uri.getPath().split("/") if part]
        wild = [at for at, part in enumerate(parts) if re.search(r"[*?\[{\\]", part)]
        is_file = not wild and system.getFileStatus(named).isFile()
        cut = wild[0] if wild else len(parts) - is_file
        found.append(Root(store, "/" + "/".join(parts[:cut]), tuple(parts[cut:]), is_file))
    return found


def pattern(part: str) -> str:
    """A name with wildcards, as a regular expression: ``* ? [a-z] [^a] {a,b}`` and ``\\``."""
    out, at, depth = "", 0, 0
    while at < len(part):
        char = part[at]
        closing = part.find("]", at + 2)
        if char == "\\" and at + 1 < len(part):
            at += 1
            out += re.escape(part[at])
        elif char == "*":
            out += ".*"
        elif char == "?":
            out += "."
        elif char == "[" and closing > 0:
            body = part[at + 1 : closing].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{'^' + body[1:] if body[0] in '!^' else body}]"
            at = closing
        elif char == "{":
            out, depth = out + "(?:", depth + 1
        elif char == "}" and depth:
            out, depth = out + ")", depth - 1
        elif char == "," and depth:
            out += "|"
        else:
            out += re.escape(char)
        at += 1
    if depth:
        raise ValueError(f"unclosed brace in a path: {part!r}")
    return out


def _entries(root: Root, folder: str) -> Iterator[tuple]:
    """``(name, is_folder, length, modified)`` of what a folder holds, or of the root's file."""
    system, base = handle(root.store)
    if root.is_file:
        infos = system.get_file_info([f"{base}{root.prefix}{root.patterns[0]}"])
    else:
        infos = system.get_file_info(pafs.FileSelector((base + folder) or "/"))
    for info in infos:
        is_folder = info.type == pafs.FileType.Directory
        yield info.base_name, is_folder, 0 if is_folder else info.size, info.mtime


def _walked(known: list[Root], folders: int, hidden: str):
    """A task's work: rows of folders to rows of files, and of folders not listed yet."""
    names = [[re.compile(pattern(part)) for part in root.patterns] for root in known]
    own = re.compile(SPARKS_OWN)

    def listed(number: int, path: str, depth: int) -> Iterator[tuple]:
        root, wanted = known[number], names[number]
        for name, is_folder, length, modified in _entries(root, path):
            if depth < len(wanted) and not wanted[depth].fullmatch(name):
                continue
            if not is_folder and depth < len(wanted) - 1:
                continue
            passed_over = name[:1] in ("_", ".") and hidden != "read"
            if passed_over and own.fullmatch(name):
                continue
            whole = f"{path.rstrip('/')}/{name}"
            kind = "hidden" if passed_over else "folder" if is_folder else "file"
            yield number, whole, depth + 1, whole[len(root.prefix) :], length, modified, kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stack, left = [(path, depth)], folders
                while stack and left:
                    left -= 1
                    rows = []
                    for row in listed(number, *stack.pop()):
                        if row[-1] == "folder":
                            stack.append((row[1], row[2]))
                        else:
                            rows.append(row)
                    if rows:
                        yield _batch(rows)
                if stack:
                    yield _batch([(number, p, d, None, None, None, "folder") for p, d in stack])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(list(c), field.type) for c, field in zip(columns, _ENTRY, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ENTRY)


def walk_folders(
    spark: SparkSession, known: list[Root], *, folders: int = FOLDERS, hidden: str = "error"
) -> DataFrame:
    """``(root, path, file, length, modified, kind)`` of all files below ``known``, kept as
    tables; ``file`` is the path below the root.

    ``hidden`` names, which begin with ``.`` or ``_``, have that for kind, and nothing below
    them is listed, or with ``hidden="read"`` are files and folders like any other.
    """
    start = pa.table(
        {
            "root": pa.array(range(len(known)), pa.int32()),
            "path": [root.folder for root in known],
            "depth": pa.array([0] * len(known), pa.int32()),
        }
    )
    level = spark.createDataFrame(start).coalesce(1)
    if hidden != "read":
        for root in known:
            name = root.folder.rsplit("/", 1)[-1]
            if name[:1] in ("_", ".") and not root.patterns:
                raise ValueError(f"Spark's readers pass over: {[root.folder]}")
    found = None
    while True:
        walked = level.select("root", "path", "depth").mapInArrow(
            _walked(known, folders, hidden), _ENTRY_SQL
        )
        rows = durable(walked)
        files = rows.where("kind <> 'folder'").drop("depth")
        found = files if found is None else found.unionByName(files)
        level = rows.where("kind = 'folder'")
        if level.isEmpty():
            return found
        # An exact number, which adaptive execution leaves as it is: names are few bytes.
        level = level.repartition(spark.sparkContext.defaultParallelism, "path")


def list_files(
    spark: SparkSession, path: str | list[str], *, hidden: str = "error"
) -> DataFrame:
    """Rows ``(file, uri, length, modified)``, one per file below ``path``, listed by tasks.

    ``file`` is the path below ``path``, or below what stands before its first wildcard. Names
    that begin with ``.`` or ``_``, which Spark's readers leave out, are an error, other than
    the marks and checksums that Spark itself writes; with ``hidden="read"`` they count.
    """
    known = roots(spark, path)
    found = refused(walk_folders(spark, known, hidden=hidden))
    if any(root.patterns for root in known) and found.isEmpty():
        raise FileNotFoundError(f"no file matches {path!r}")
    stores = F.array(*[F.lit(root.store) for root in known])
    uri = F.concat(stores[F.col("root")], "path").alias("uri")
    return found.select("file", uri, "length", "modified")


def refused(found: DataFrame) -> DataFrame:
    """The files of a listing; an error if Spark's readers would leave any out."""
    names = [row["path"] for row in found.where("kind = 'hidden'").limit(5).collect()]
    if names:
        raise ValueError(f"Spark's readers pass over: {sorted(names)}")
    return found.where("kind = 'file'").drop("kind")
