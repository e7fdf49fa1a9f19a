"""Appending by batch: a batch is added once, however often and wherever its job is run again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from linewright.sinks import commits

BATCH = "batch"
STAGING = "_staging"


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Add ``df`` to the table at ``path`` as the batch of that name; False if it has it already.

    The rows are staged in a folder that Spark's readers pass over, and one rename makes them
    the folder ``batch=<name>``, which is the record of the commit: there is no moment at which
    a batch is there in part, or there without its record. A job killed before the rename has
    added nothing, one killed after it everything; either may be run again. Of two runs at a
    time one adds the batch, and the other's staged rows are dropped.

    Names of batches are letters, digits, ``.``, ``_`` and ``-``, and do not change. Needs a
    file system that renames folders at once, as HDFS does.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"no name for a batch: {batch!r}")
    if BATCH in df.columns:
        raise ValueError(f"the rows have a column {BATCH!r} of their own")
    spark, target = df.sparkSession, f"{path.rstrip('/')}/{BATCH}={batch}"
    if commits.exists(spark, target):
        return False
    staged = f"{path.rstrip('/')}/{STAGING}/{batch}-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    try:
        commits.move(spark, staged, target)
    except commits.AlreadyThere:
        commits.remove(spark, staged)
        return False
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, and ``batch``, the name of each row's."""
    files = spark.read.option("recursiveFileLookup", "true").parquet(path)
    named = T.StructType([*files.schema.fields, T.StructField(BATCH, T.StringType())])
    return spark.read.schema(named).parquet(path)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete what killed jobs have left. No job may be adding a batch meanwhile."""
    commits.remove(spark, f"{path.rstrip('/')}/{STAGING}")
