"""Folder operations through Hadoop's file system, so any shared store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True once the write that produced the folder has committed."""
    return exists(spark, f"{path}/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(jpath))


def source_stamp(spark: SparkSession, path: str) -> str:
    """Length and modification time of a file or folder, to notice a changed source."""
    fs, jpath = _fs(spark, path)
    status = fs.getFileStatus(jpath)
    return f"{status.getLen()}-{status.getModificationTime()}"


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    fs, jpath = _fs(spark, path)
    return fs.getContentSummary(jpath).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; fails if there is one already."""
    fs, jpath = _fs(spark, path)
    stream = fs.create(jpath, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)
