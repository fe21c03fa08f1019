"""Small files and folders of the shared store, through Hadoop's file systems: works wherever Spark's own readers and writers do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, hidden files left out; none if there is no such folder."""
    at, fs = _of(spark, folder)
    found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(x for x in found if not x.startswith("."))


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _of(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that wasn't there, whole or not at all; False if another writer was first."""
    at, fs = _of(spark, path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, no_options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _of(spark, path)
    fs.delete(at, True)


def size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and files below a path."""
    at, fs = _of(spark, path)
    whole = fs.getContentSummary(at)
    return whole.getLength(), whole.getFileCount()
