"""Folders in whatever store Spark writes to, by the file system Spark itself uses."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _open(spark, path)
    return store.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    store, where = _open(spark, path)
    store.mkdirs(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    return [name for name, _, _ in details(spark, path)]


def details(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time of change, in milliseconds, of what is in a folder."""
    store, where = _open(spark, path)
    found = store.listStatus(where) if store.exists(where) else []
    return [(status.getPath().getName(), status.getLen(), status.getModificationTime()) for status in found]


def delete(spark: SparkSession, path: str) -> None:
    store, where = _open(spark, path)
    store.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    store, where = _open(spark, source)
    if not store.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {source} to {target}")


def set_age(spark: SparkSession, path: str, days: float) -> None:
    """Dates a file so many days back."""
    store, where = _open(spark, path)
    store.setTimes(where, int((time.time() - days * 86400) * 1000), -1)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    store, where = _open(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    store, where = _open(spark, path)
    stream = store.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, whole or not at all, over one that is there."""
    _put(spark, path, text, [spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE])


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file, whole or not at all, unless one is there; False if it is."""
    try:
        _put(spark, path, text, [])
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" not in problem.java_exception.getClass().getName():
            raise
        return False
    return True


def _put(spark: SparkSession, path: str, text: str, how: list) -> None:
    """Written aside, then renamed; where the store's rename is atomic, so is this."""
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/_aside-{name}-{uuid.uuid4().hex}"
    _write(spark, aside, text)
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, len(how))
    for at, option in enumerate(how):
        options[at] = option
    source, target = hadoop.Path(aside), hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, options)
    except Py4JJavaError:
        delete(spark, aside)
        raise
