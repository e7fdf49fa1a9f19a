"""Steps that show all or nothing: one rename to a name that is not taken."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class AlreadyThere(RuntimeError):
    """Another run has taken the name."""


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return named.getFileSystem(conf), named


def exists(spark: SparkSession, path: str) -> bool:
    system, named = _system(spark, path)
    return system.exists(named)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of few; none if there is no folder."""
    system, named = _system(spark, folder)
    if not system.exists(named):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(named))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a file or folder another name, at once and only if nothing has that name yet.

    HDFS and local file systems do so; on a store whose renames are copies this is no commit.
    """
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    system, named = _system(spark, target)
    system.mkdirs(named.getParent())
    files = fs.FileContext.getFileContext(system.getUri(), context._jsc.hadoopConfiguration())
    no_options = context._gateway.new_array(fs.Options.Rename, 0)
    try:
        files.rename(system.makeQualified(fs.Path(source)), system.makeQualified(named), no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise AlreadyThere(target) from error
        raise


def create(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; an error if it is there already."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_{name}-{uuid.uuid4().hex}"
    system, named = _system(spark, draft)
    out = system.create(named, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        move(spark, draft, path)
    except AlreadyThere:
        remove(spark, draft)
        raise


def read(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    system, named = _system(spark, path)
    source = system.open(named)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def remove(spark: SparkSession, path: str) -> None:
    system, named = _system(spark, path)
    system.delete(named, True)
