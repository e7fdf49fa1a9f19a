"""Tables by group that are replaced whole or not at all.

::

    data/version=<v>/folder=<group>/   the rows of a group, as version v wrote them
    groups/<v>/                        for each group of the table, the version that holds it
    current/<number>                   a pointer: the version, and the columns

A version writes the groups that it replaces, then the list of all groups, then its pointer,
under the next number. The pointer of the largest number counts, as the latest row of a key
does in ``latest_per_key``; whatever no pointer leads to is not read. So readers see the table
before a replacement or after it, and a job killed at any moment leaves it as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import EllipsisType
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.plans.sizing import fits_broadcast
from linewright.sinks import commits
from linewright.sources.listing import handle, list_files, roots

VERSION, FOLDER = "version", "folder"


@dataclass(frozen=True)
class Pointer:
    """What a table's newest pointer says; ``facts`` is what its writers want to remember."""

    number: int
    version: str
    group: str
    schema: T.StructType
    facts: dict[str, Any]


def newest(spark: SparkSession, path: str) -> Pointer | None:
    """The newest pointer of the table at ``path``; none if there is no table."""
    folder = f"{path.rstrip('/')}/current"
    numbers = [name for name in commits.names(spark, folder) if name.isdigit()]
    if not numbers:
        return None
    said = json.loads(commits.read(spark, f"{folder}/{max(numbers)}"))
    schema = T.StructType.fromJson(said["schema"])
    return Pointer(int(max(numbers)), said["version"], said["group"], schema, said["facts"])


def _folder(group: Column) -> Column:
    """A folder's name; Spark has one name for null and for the empty string."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("-"))


def _groups(spark: SparkSession, path: str, pointer: Pointer) -> DataFrame:
    return spark.read.schema(f"{VERSION} string, {FOLDER} string").parquet(
        f"{path.rstrip('/')}/groups/{pointer.version}"
    )


def _stored(spark: SparkSession, path: str, versions: list[str], schema: T.StructType) -> DataFrame:
    data = f"{path.rstrip('/')}/data"
    named = T.StructType(
        [
            *schema.fields,
            T.StructField(VERSION, T.StringType()),
            T.StructField(FOLDER, T.StringType()),
        ]
    )
    folders = [f"{data}/{VERSION}={version}" for version in versions]
    return spark.read.schema(named).option("basePath", data).parquet(*folders)


def publish_groups(
    df: DataFrame,
    path: str,
    group: str,
    *,
    removed: DataFrame | None = None,
    after: Pointer | None | EllipsisType = ...,
    facts: dict[str, Any] | None = None,
) -> str:
    """Put ``df`` in place of those groups of the table at ``path`` that occur in it, or add
    them; groups of ``removed``, a column of that name, leave the table. Returns the version.

    Nothing is seen of it before the last step, one rename. Other groups are neither read nor
    written again. If another job has published meanwhile, this one fails with
    ``AlreadyThere`` and changes nothing; run it again on what is there now. With ``after``,
    meanwhile begins where that pointer was the newest, for rows made of what it leads to.

    Rows are dealt to tasks by group, of which adaptive execution splits big ones and joins
    small ones. ``group`` stays a column of the files, so its type and nulls are kept.
    """
    taken = sorted({VERSION, FOLDER} & set(df.columns))
    if taken:
        raise ValueError(f"columns that a versioned table has itself: {taken}")
    spark, root = df.sparkSession, path.rstrip("/")
    before = newest(spark, path)
    if after is not ... and after != before:
        raise commits.AlreadyThere(f"{root}: published since")
    if before is not None and (before.group, before.schema) != (group, _nullable(df.schema)):
        raise ValueError(
            f"the table at {path} is by {before.group!r}, of {before.schema.simpleString()}"
        )
    version = f"v{(before.number if before else 0) + 1:019d}-{uuid.uuid4().hex[:8]}"
    written = f"{root}/data/{VERSION}={version}"
    rows = df.withColumn(FOLDER, _folder(F.col(f"`{group}`")))
    rows.hint("rebalance", FOLDER).write.partitionBy(FOLDER).parquet(written)

    # The groups written are the folders there are, whatever df would give a second time.
    now = _stored(spark, path, [version], _nullable(df.schema)).select(FOLDER).distinct()
    lists = now.select(F.lit(version).alias(VERSION), FOLDER)
    if before is not None:
        gone = now
        if removed is not None:
            gone = gone.unionByName(removed.select(_folder(F.col(f"`{group}`")).alias(FOLDER)))
        kept = _groups(spark, path, before).join(gone.distinct(), FOLDER, "left_anti")
        lists = kept.select(VERSION, FOLDER).unionByName(lists)
    lists.write.parquet(f"{root}/groups/{version}")
    said = {
        "version": version,
        "group": group,
        "schema": _nullable(df.schema).jsonValue(),
        "facts": facts if facts is not None else before.facts if before else {},
    }
    number = before.number + 1 if before else 1
    commits.create(spark, f"{root}/current/{number:019d}", json.dumps(said))
    return version


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def read_groups(
    spark: SparkSession,
    path: str,
    only: Sequence[Any] | None = None,
    *,
    at: Pointer | None = None,
) -> DataFrame:
    """The rows of the table at ``path``, as its newest pointer has them, or ``at`` another.

    With ``only`` a list of groups, nothing of others is read.

    The driver learns the versions still in use; folders of groups that a later version has
    replaced are left out by a join with the list of groups, which prunes them from the scan
    where the list is small enough to broadcast.
    """
    pointer = at or newest(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no versioned table at {path}")
    groups = _groups(spark, path, pointer)
    if only is not None:
        folders = ["-" if one is None else f"+{one}" for one in only]
        groups = groups.where(F.col(FOLDER).isin(folders))
    versions = [row[0] for row in groups.select(VERSION).distinct().collect()]
    if not versions:
        return spark.createDataFrame([], pointer.schema)
    rows = _stored(spark, path, versions, pointer.schema)
    if only is not None:
        rows = rows.where(F.col(FOLDER).isin(folders))
    wanted = groups.select(F.col(VERSION).alias("__version"), F.col(FOLDER).alias("__folder"))
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted.hint("merge")
    ours = (F.col(VERSION) == F.col("__version")) & (F.col(FOLDER) == F.col("__folder"))
    return rows.join(wanted, ours, "left_semi").drop(VERSION, FOLDER)


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete folders of groups that the table no longer has, and what killed jobs have left;
    returns how many folders. Readers of older versions must be done, and no job publishing.

    Tasks delete what the comparison of folders with the list of groups leaves over.
    """
    pointer = newest(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no versioned table at {path}")
    root = path.rstrip("/")
    there = [
        name.removeprefix(f"{VERSION}=")
        for name in commits.names(spark, f"{root}/data")
        if name.startswith(f"{VERSION}=")
    ]
    groups = _groups(spark, path, pointer)
    live = {row[0] for row in groups.select(VERSION).distinct().collect()}
    dead = set(there) - live
    for version in dead:
        commits.remove(spark, f"{root}/data/{VERSION}={version}")
    for version in commits.names(spark, f"{root}/groups"):
        if version != pointer.version:
            commits.remove(spark, f"{root}/groups/{version}")
    if not live:
        return len(dead)
    data = roots(spark, f"{root}/data")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = handle(data.store)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for one in paths:
                # A task that runs again finds some gone.
                if system.get_file_info(base + one).type == pafs.FileType.Directory:
                    system.delete_dir(base + one)
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)], pa.int64())], ["n"])

    part = rf"^({VERSION}=([^/]*)/{FOLDER}=([^/]*))/"
    # On disk, special characters of a name are written as in a URL.
    plain = F.url_decode(F.regexp_replace(F.regexp_extract("file", part, 3), r"\+", "%2B"))
    held = list_files(spark, f"{root}/data").select(
        F.concat(F.lit(data.prefix), F.regexp_extract("file", part, 1)).alias("path"),
        F.struct(F.regexp_extract("file", part, 2), plain).alias("held"),
    )
    listed = groups.select(F.struct(VERSION, FOLDER).alias("listed"))
    stale = held.distinct().join(listed, F.col("held") == F.col("listed"), "left_anti")
    deleted = stale.select("path").mapInArrow(run, "n long")
    return len(dead) + (deleted.agg(F.sum("n")).first()[0] or 0)
