"""Tables as values: inserts, deletes and syncs are functions old, changes -> new (SNK-5..8, MUT-1..6, JOIN-3, 9, SET-5).

Parquet has no row updates. A new table version is written beside the old one and swapped in by :func:`swap`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` that an insert with "on conflict do nothing" adds; null keys conflict with nothing."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    kept = first_wins(new.where(whole), keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*new.columns).unionByName(new.where(~whole))


def insert_counts(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(offered, inserted, skipped), one row."""
    inserted = insert_if_absent(existing, new, keys, order).agg(F.count("*").alias("inserted"))
    return new.agg(F.count("*").alias("offered")).crossJoin(F.broadcast(inserted)).withColumn("skipped", F.col("offered") - F.col("inserted"))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition is not true; null counts as not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def stale(key_match: Column, commit: Column, current: str | None) -> Column:
    """Rows of a file that do not carry the current commit; null differs from every commit but null."""
    return key_match & ~commit.eqNullSafe(F.lit(current))


def delta_sync(chunks: DataFrame, changes: DataFrame, rechunk: Callable[[DataFrame], DataFrame], key: str = "file_path") -> DataFrame:
    """Apply (status, path, new_path): drop chunks of gone and re-read files, then add what ``rechunk`` makes of the paths to read."""
    from tessera.functions import git

    gone = git.to_delete(changes).union(git.to_index(changes)).distinct().withColumnRenamed("path", key)
    return chunks.join(gone, key, "left_anti").unionByName(rechunk(git.to_index(changes)))


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent still exists; children with a null key stay."""
    return children.where(F.col(key).isNull()).unionByName(children.join(parents.select(key).distinct(), key, "left_semi").select(*children.columns))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a unique key: keys that occur more than once, nulls apart."""
    ok = df
    for k in keys:
        ok = ok.where(F.col(k).isNotNull())
    return ok.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def fill_vectors(df: DataFrame, embed: Callable[[Column], Column], text: str = "content", vector: str = "embedding") -> DataFrame:
    """Embed only the rows whose vector is null."""
    return df.withColumn(vector, F.when(F.col(vector).isNull(), embed(F.col(text))).otherwise(F.col(vector)))


def scoped(df: DataFrame, projects: DataFrame, user_id: str, key: str = "project_id") -> DataFrame:
    """Row-level security: rows of the user's projects."""
    return df.join(projects.where(F.col("user_id") == user_id).select(key).distinct(), key, "left_semi")


def project_id(user_id: Column, name: Column) -> Column:
    """Deterministic id of a project."""
    return F.sha2(F.concat_ws("\x1f", user_id, name), 256)


def get_or_create(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, project_name, project_id, created): known projects with their id, others with a new one."""
    known = projects.groupBy("user_id", "project_name").agg(F.min("project_id").alias("known"))
    j = wanted.select("user_id", "project_name").distinct().join(known, ["user_id", "project_name"], "left")
    return j.select("user_id", "project_name", F.coalesce("known", project_id(F.col("user_id"), F.col("project_name"))).alias("project_id"), F.col("known").isNull().alias("created"))


def refresh_stats(projects: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """Projects with totals counted from the chunk table."""
    n = chunks.groupBy("project_id").agg(F.count("*").cast("int").alias("_c"), F.countDistinct("file_path").cast("int").alias("_f"))
    j = projects.join(n, "project_id", "left")
    return j.withColumns({"total_chunks": F.coalesce("_c", F.lit(0)), "total_files": F.coalesce("_f", F.lit(0)), "last_indexed_at": now}).select(*projects.columns)


def schema_gaps(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Required columns that are absent or of another type."""
    have = dict(df.dtypes)
    return sorted(c for c, t in required.items() if have.get(c) != t)


def swap(spark: SparkSession, df: DataFrame, root: str) -> str:
    """Write a new version under ``root`` and point ``CURRENT`` to it; readers of the old version are not disturbed."""
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/CURRENT")
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version ``CURRENT`` points to."""
    return spark.read.parquet(spark.read.schema("path string").json(f"{root.rstrip('/')}/CURRENT").collect()[0].path)
