"""Questions to the file system, asked through Hadoop so that they hold for any shared store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers ``n`` of the folders ``{path}/{prefix}{n}``, ascending."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A new folder with one file of text, which appears as a whole or not at all: it is written aside and renamed."""
    fs, p = _at(spark, folder)
    aside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(aside, name))
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(aside, p):
        raise FileExistsError(f"{folder} is there already: another writer is at work.")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
