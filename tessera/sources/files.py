"""Files as DataFrames (SRC-1..7, 11, 12, 14, 15, 17; FIL-21; FN-16). Listing reads no bytes; content is read where it is used."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import paths


def listing(spark: SparkSession, root: str, extra_excludes: tuple[str, ...] = (), everything: bool = False) -> DataFrame:
    """(path, length, modified, uri) below a directory; paths are relative. Column pruning leaves the bytes unread."""
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + _literal(root.removeprefix("file://").removeprefix("file:").rstrip("/")) + "/", "")
    out = df.select(paths.normalise(rel).alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("path").alias("uri"), "content")
    return out if everything else out.where(paths.admitted(F.col("path"), extra_excludes))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def decode_lenient(content: Column) -> Column:
    """UTF-8 with invalid bytes dropped. Valid content stays in the JVM; only the rest goes through Python."""

    def drop(raw: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode("utf-8", "ignore") for b in raw], dtype=object)

    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.pandas_udf(drop, StringType())(F.when(~F.is_valid_utf8(content.cast("string")), content)))


def decode_any(content: Column) -> Column:
    """UTF-8 (without a byte-order mark), else Latin-1."""
    s = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(s), s).otherwise(F.decode(content, "ISO-8859-1")), "^﻿", "")


def is_text(content: Column) -> Column:
    """No NUL in the first 1024 bytes."""
    return (F.instr(F.regexp_replace(F.hex(F.substring(content, 1, 1024)), "(..)", "$1 "), "00 ") == 0)


def read_tree(spark: SparkSession, root: str, extra_excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the admitted files below a directory."""
    return listing(spark, root, extra_excludes).select("path", decode_lenient(F.col("content")).alias("content"))


def read_patterns(spark: SparkSession, root: str, patterns: tuple[str, ...] = paths.INGEST_PATTERNS) -> DataFrame:
    """(path, content, error): files that match, with no other filter; files that are not UTF-8 have an error and no content."""
    df = listing(spark, root, everything=True).where(paths.matches_any(F.col("path"), list(patterns)))
    s = F.col("content").cast("string")
    return df.select("path", F.when(F.is_valid_utf8(s), s).alias("content"), F.when(~F.is_valid_utf8(s), "not UTF-8").alias("error"))


def explicit(spark: SparkSession, file_paths: list[str]) -> DataFrame:
    """(path, content, error) of the listed files under their plain names; missing ones are skipped."""
    there = []
    for p in file_paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p if "://" in p or p.startswith("file:") else f"file:{p}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            there.append(at.toString())
    if not there:
        return spark.createDataFrame([], "path string, content string, error string")
    s = F.col("content").cast("string")
    df = spark.read.format("binaryFile").load(there)
    return df.select(paths.basename(F.col("path")).alias("path"), F.when(F.is_valid_utf8(s), s).alias("content"), F.when(~F.is_valid_utf8(s), "not UTF-8").alias("error"))


def inline(spark: SparkSession, files: list[dict]) -> DataFrame:
    """(path, content) of uploaded entries; entries without a path or content are skipped."""
    rows = [(f["path"], f["content"]) for f in files if f.get("path") and f.get("content") is not None]
    return spark.createDataFrame(rows, "path string, content string")


def one(spark: SparkSession, root: str, path: str) -> str:
    """The text of one file; ValueError outside the root or without the file."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"outside the project: {path}")
    row = listing(spark, f"{root.rstrip('/')}", everything=True).where(F.col("path") == path).select(decode_any(F.col("content")).alias("t")).limit(1).collect()
    if not row:
        raise ValueError(f"no such file: {path}")
    return row[0].t


def is_fresh(files: DataFrame, index_time) -> bool:
    """Whether no file is newer than the index."""
    newest = files.agg(F.max("modified")).collect()[0][0]
    return newest is None or newest <= index_time
