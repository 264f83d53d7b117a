"""Small-file access through Hadoop's FileSystem, so any shared store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text_atomic(spark: SparkSession, path: str, text: str) -> bool:
    """Write to a side file, then rename; False if ``path`` already exists."""
    side, fs = _fs(spark, path + ".tmp")
    out = fs.create(side, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    target, _ = _fs(spark, path)
    return False if fs.exists(target) else bool(fs.rename(side, target))


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.delete(p, True)
