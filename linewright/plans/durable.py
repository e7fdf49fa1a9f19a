"""Steps kept on shared storage, so that a lost executor does not change them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else given to ``setCheckpointDir``.

    Where there is neither, a local session takes a temporary folder. A cluster must name
    one: its executors share no temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    # local-cluster has executors of its own, as any cluster.
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
    folder = tempfile.mkdtemp(prefix="linewright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def require_durable(df: DataFrame) -> None:
    """Raise now if ``df`` could not be kept, for operators that keep it only when big."""
    shared_dir(df.sparkSession)
    unfit = [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, (T.CalendarIntervalType, T.NullType))
    ]
    if unfit:
        raise TypeError(f"Parquet cannot hold the types of: {unfit}")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to.

    All paths of an application are in one folder of its own, which can be deleted once the
    application has ended.
    """
    own = f"linewright-{spark.sparkContext.applicationId}"
    return f"{shared_dir(spark)}/{own}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written out once as Parquet, for all that follows to read.

    Unlike ``checkpoint()`` this keeps the columns apart, so that a later step reads only
    those it needs.
    """
    spark = df.sparkSession
    folder = fresh_dir(spark, "durable")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
