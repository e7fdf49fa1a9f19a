"""Readers: text files by line or whole, files by digest, digest manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.sources.contents import (
    digest_chunks,
    digest_files,
    read_texts,
    reconcile_chunks,
)
from linewright.sources.listing import list_files, refused, roots, walk_folders
from linewright.sources.members import index_members, read_member_lines

__all__ = [
    "digest_chunks",
    "digest_files",
    "index_members",
    "list_files",
    "read_lines",
    "read_manifest",
    "read_member_lines",
    "read_texts",
    "reconcile_chunks",
]


def _relative(spark: SparkSession, path: str | list[str], encoded: Column) -> Column:
    """The name of a file below the folder it was read from, as plain text.

    Of a path with wildcards, the folder is what stands before the first of them.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = set()
    for one in [path] if isinstance(path, str) else path:
        root = hadoop.Path(one)
        store = root.getFileSystem(conf)
        if re.search(r"[*?\[{]", one):
            while re.search(r"[*?\[{]", root.toString()):
                root = root.getParent()
        elif store.getFileStatus(root).isFile():
            root = root.getParent()
        folders.add(store.makeQualified(root).toUri().getPath().rstrip("/") + "/")
    # A plus sign stands for itself in a path.
    whole = F.url_decode(F.regexp_replace(encoded, r"\+", "%2B"))
    # Without scheme and host.
    name = F.regexp_replace(whole, r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = [
        F.when(F.startswith(name, F.lit(folder)), F.substring(name, len(folder) + 1, 1 << 30))
        for folder in sorted(folders, key=len, reverse=True)
    ]
    return F.coalesce(*below, name)


def read_lines(
    spark: SparkSession, path: str | list[str], *, hidden: str = "error"
) -> DataFrame:
    """Rows ``(file, value)``, one per ``\\n``-ended line; ``\\r`` stays part of the line.

    Uncompressed files are split into tasks by size, so one huge file is read in parallel.
    Subfolders are read too, and ``file`` is the path below ``path``. Spark passes over names
    that begin with ``.`` or ``_``; such a file is an error here, other than the marks and
    checksums that Spark itself writes. Tasks list the folders for that; with
    ``hidden="skip"`` nothing is listed and such files are left out.
    """
    if hidden != "skip":
        refused(walk_folders(spark, roots(spark, path)))
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(path)
    )
    file = _relative(spark, path, F.col("_metadata.file_path"))
    return lines.select(file.alias("file"), "value")


def read_manifest(
    spark: SparkSession, path: str | list[str], *, strict: bool = True
) -> DataFrame:
    """Rows ``(key, md5)`` from checksum lists, of either form that such tools write.

    Lines may end in ``\\r\\n``; blank ones are passed over. A line that is no entry is an
    error when it is read, or passed over if ``strict`` is off.
    """
    # Fixed formats: 32 hex digits, a blank, a blank or "*", the name; or the tagged form.
    entry = r"\A([0-9a-fA-F]{32}) [ *]([^\r]+)\r?\z"
    tagged = r"\AMD5 \(([^\r]+)\) = ([0-9a-fA-F]{32})\r?\z"
    line = F.col("value")
    plain, marked = line.rlike(entry), line.rlike(tagged)
    lines = read_lines(spark, path).where(F.trim(F.regexp_replace(line, r"\r\z", "")) != "")
    if not strict:
        lines = lines.where(plain | marked)

    def part(in_plain: int, in_tagged: int) -> Column:
        other = F.raise_error(F.concat(F.lit("no checksum entry: "), line))
        return (
            F.when(plain, F.regexp_extract(line, entry, in_plain))
            .when(marked, F.regexp_extract(line, tagged, in_tagged))
            .otherwise(other.cast("string"))
        )

    return lines.select(part(2, 1).alias("key"), F.lower(part(1, 2)).alias("md5"))
