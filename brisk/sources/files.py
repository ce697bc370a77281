"""Single files in any store that Spark reaches, through its file system API."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

PIECE = 1 << 20


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with this text in place of what is there."""
    fs, where = _open(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """df, in its order, as one CSV file of that name in place of what is there. One task writes it:
    meant for reports and labels, not for events."""
    fs, where = _open(df.sparkSession, path)
    parts = _open(df.sparkSession, f"{path}.parts")[1]
    df.coalesce(1).write.mode("overwrite").option("header", header).csv(f"{path}.parts")
    fs.delete(where, True)
    fs.rename(fs.globStatus(parts.suffix("/part-*"))[0].getPath(), where)
    fs.delete(parts, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def file_record(spark: SparkSession, path: str, with_hash: bool = False) -> dict:
    """Size, time of change and, for a file if asked for, SHA-256 of a path."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return {"path": path, "exists": False}
    status = fs.getFileStatus(where)
    out = {"path": path, "exists": True, "bytes": fs.getContentSummary(where).getLength(), "modified": datetime.fromtimestamp(status.getModificationTime() / 1000, UTC).isoformat()}
    if with_hash and status.isFile():
        digest, stream = hashlib.sha256(), fs.open(where)
        try:
            while part := bytes(stream.readNBytes(PIECE)):
                digest.update(part)
        finally:
            stream.close()
        out["sha256"] = digest.hexdigest()
    return out
