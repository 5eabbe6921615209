"""Ingestion end to end: chunk, embed, insert if absent, refresh the project (tools ingest_code_for_search, ingest_code_from_git)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, store
from tessera.operators.embed import hash_embedder
from tessera.session import stage

KEYS = ["project_id", "content_hash"]


def ingest_into(files: DataFrame, path: str, project_id: str, strategy: str = "function", embedder: Callable[[Column], Column] | None = None, dim: int = 64, progress: Callable[[str, dict], None] = lambda message, stats: None) -> dict:
    """Ingest into the chunk table under ``path`` (made where it is missing): a new part of it is written, old parts stay as they are.

    Returns the counts of :func:`ingest_stats`; ``progress`` is told after every stage.
    """
    spark = files.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    existing = spark.read.parquet(path).select(*KEYS) if fs.exists(root) else spark.createDataFrame([], "project_id string, content_hash string")
    progress("chunking", {})
    added = stage(ingest(files, existing, project_id, strategy, embedder, dim), "ingest")
    stats = ingest_stats(files, existing, added, project_id, strategy).collect()[0].asDict()
    progress("embedded", stats)
    added.write.mode("append").parquet(path)
    progress("stored", stats)
    return stats


def ingest(files: DataFrame, existing: DataFrame, project_id: str, strategy: str = "function", embedder: Callable[[Column], Column] | None = None, dim: int = 64) -> DataFrame:
    """The chunks that an ingestion adds to ``existing`` (project_id, content_hash, ...).

    A content stands once in a project: of equal chunks the first by path and line is added, if none is there. Only the chunks
    to be added are embedded: the hashes decide before the vectors are made.
    """
    embedder = embedder or hash_embedder(dim)
    c = chunking.chunk_files(files, strategy).withColumn("project_id", F.lit(project_id))
    mine = existing.where(F.col("project_id") == project_id).select(*KEYS)
    new = store.insert_if_absent(mine, c, KEYS, ["file_path", "line_start", "line_end", "chunk_type", "chunk_name"])
    none = F.lit(None).cast("string")
    body = text.embedding_text(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("chunk_name"), none, F.array().cast("array<string>"), F.col("content"))
    return new.withColumn("embedding", embedder(body))


def ingest_stats(files: DataFrame, existing: DataFrame, added: DataFrame, project_id: str, strategy: str = "function") -> DataFrame:
    """(files_processed, chunks_created, chunks_inserted, chunks_skipped, embeddings_generated), one row."""
    f = files.where("content is not null").agg(F.count("*").alias("files_processed"))
    c = chunking.chunk_files(files, strategy).agg(F.count("*").alias("chunks_created"))
    a = added.agg(F.count("*").alias("chunks_inserted"), F.count("embedding").alias("embeddings_generated"))
    return f.crossJoin(c).crossJoin(a).select("files_processed", "chunks_created", "chunks_inserted", (F.col("chunks_created") - F.col("chunks_inserted")).alias("chunks_skipped"), "embeddings_generated")
