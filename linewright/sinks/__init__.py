"""Writers: append rows or batches to a table, replace single groups of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.sinks.batches import append_batch, drop_staged, read_batches
from linewright.sinks.commits import AlreadyThere
from linewright.sinks.versions import drop_replaced, publish_groups, read_groups

__all__ = [
    "AlreadyThere",
    "append_batch",
    "append_rows",
    "drop_replaced",
    "drop_staged",
    "publish_groups",
    "read_batches",
    "read_groups",
    "replace_groups",
]


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add ``df`` to the Parquet table at ``path``.

    Each run adds its rows again; pass the result of ``rows_to_append`` where a rerun
    must not, or add the rows as a named batch by ``append_batch``.
    """
    df.write.mode("append").parquet(path, partitionBy=partition_by)


def replace_groups(df: DataFrame, path: str, group: str) -> None:
    """Put ``df`` in place of those groups at ``path`` that occur in it.

    The table is laid out by ``group``; folders of groups absent from ``df`` stay as they
    are, so the rows that did not change are not written again. A job killed on the way may
    leave some groups replaced and others not; ``publish_groups`` does not.

    An error, with nothing written, where that would not replace them: if the table's files
    hold ``group`` themselves, or if a group has no folder of its very name. Folder names
    are text; read the table with ``group`` as a string, or ``01`` comes back as 1.
    """
    spark = df.sparkSession
    files = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if group in files.columns:
        raise ValueError(f"the table at {path} is not laid out by {group!r}")
    as_text = T.StructType([*files.schema.fields, T.StructField(group, T.StringType())])
    folders = spark.read.schema(as_text).parquet(path).select(F.col(f"`{group}`").alias("g"))
    mine = df.select(F.col(f"`{group}`").cast("string").alias("g")).distinct()
    strange = mine.join(folders.distinct(), mine["g"].eqNullSafe(folders["g"]), "left_anti").first()
    if strange is not None:
        raise ValueError(f"the table at {path} has no folder for group {strange['g']!r}")
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(group)
        .parquet(path)
    )
