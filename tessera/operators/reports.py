"""Project, commit and decision-record statistics (AGG-1..8, 10, 11; WIN-1, 2; JOIN-2, 4, 5; UDF-17, 18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import union_all


def project_stats(chunks: DataFrame) -> DataFrame:
    """One row, also for no chunk: totals, distinct files, mean length, and counts by language and chunk type as maps.

    Null languages and types are left out of the maps.
    """

    def counts(column: str, name: str) -> DataFrame:
        by = chunks.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    total = chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("file_path").alias("total_files"), F.avg(F.length("content")).alias("avg_chunk_size"))
    return total.crossJoin(counts("language", "languages")).crossJoin(counts("chunk_type", "chunk_types"))


def counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, value, n): the maps of project_stats as rows."""
    return union_all([df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "value", "n") for c in columns])


def overview(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every project with its chunk, file and language counts and last update; projects without chunks count 0.

    Chunks are aggregated before the join, so one row a project meets the projects.
    """
    n = chunks.groupBy("project_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.countDistinct("language").alias("n_languages"), F.max("updated_at").alias("last_update"))
    return projects.join(n, "project_id", "left").select("project_id", "project_name", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_chunks", "n_files", "n_languages")], "last_update")


def sync_status(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("project_id").agg(F.countDistinct("commit_hash").alias("n_commits"), F.max("commit_timestamp").alias("last_commit"), F.count("*").alias("n_chunks"))
    return projects.join(n, "project_id", "left").select("project_id", "project_name", "current_commit_hash", F.coalesce("n_commits", F.lit(0)).cast("bigint").alias("n_commits"), "last_commit", F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))


def chunk_stats(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per project and chunk type: count and mean number of lines; projects without chunks don't show."""
    n = chunks.groupBy("project_id", "chunk_type").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.col("line_end") - F.col("line_start") + 1), 4).alias("avg_lines"))
    return n.join(projects.select("project_id", "project_name"), "project_id").select("project_name", "chunk_type", "n_chunks", "avg_lines")


def languages_per_project(chunks: DataFrame) -> DataFrame:
    langs = F.array_join(F.array_sort(F.collect_set(F.lower("language"))), ", ")
    return chunks.groupBy("project_id").agg(F.count("*").alias("n_chunks"), langs.alias("languages"))


def files_by_commit(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path", "commit_hash").agg(F.count("*").alias("n_chunks"), F.max("commit_timestamp").alias("last_commit"))


def needing_reindex(chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """Files whose chunks carry another commit than their project's current one; a null commit differs."""
    j = chunks.join(projects.select("project_id", "current_commit_hash"), "project_id").where(~F.lower("commit_hash").eqNullSafe(F.lower("current_commit_hash")))
    return j.groupBy("project_id", "file_path").agg(F.count("*").alias("n_chunks"))


def commit_counts(chunks: DataFrame, k: int) -> DataFrame:
    """Latest commits with their number of chunks: count over the commit, distinct, newest first, k rows."""
    w = Window.partitionBy("commit_hash")
    return chunks.where("commit_hash is not null").select("commit_hash", "commit_timestamp", F.count("*").over(w).alias("n_chunks")).distinct().orderBy(F.desc_nulls_last("commit_timestamp"), "commit_hash").limit(k)


def commit_compare(chunks: DataFrame, old: Column, new: Column) -> DataFrame:
    """Chunks with the same project, file and name on both sides, and whether their content differs."""
    keys = ["project_id", "file_path", "chunk_name"]
    a = chunks.where(old).select(*keys, F.col("content").alias("old_content"), F.col("chunk_id").alias("old_id"))
    b = chunks.where(new).select(*keys, F.col("content").alias("new_content"), F.col("chunk_id").alias("new_id"))
    return a.join(b, keys).select(*keys, "old_id", "new_id", (F.col("old_content") != F.col("new_content")).alias("changed"))


def relationships(adrs: DataFrame) -> DataFrame:
    """(adr_number, other_number, relation) of different records: supersedes before superseded_by before related_to.

    Three equi joins instead of one join on an OR; a pair that several fields name shows once.
    """
    nums = adrs.select(F.col("adr_number").alias("other")).distinct()
    sides = [
        adrs.select("adr_number", F.col("supersedes_adr").alias("other"), F.lit(1).alias("rank")),
        adrs.select("adr_number", F.col("superseded_by_adr").alias("other"), F.lit(2).alias("rank")),
        adrs.select("adr_number", F.explode("related_adrs").alias("other"), F.lit(3).alias("rank")),
    ]
    j = union_all(sides).where("other is not null and other <> adr_number").join(nums, "other").groupBy("adr_number", "other").agg(F.min("rank").alias("rank"))
    name = F.when(F.col("rank") == 1, "supersedes").when(F.col("rank") == 2, "superseded_by").otherwise("related_to")
    return j.select("adr_number", F.col("other").alias("other_number"), name.alias("relation"))


def impacted(adrs: DataFrame, service: str, technology: str | None = None, statuses: tuple[str, ...] = ("accepted", "proposed")) -> DataFrame:
    """Records of a service (and technology) in the given states, newest decision first."""
    hit = F.array_contains("impacted_services", service) & F.lower("status").isin(*statuses)
    if technology is not None:
        hit = hit & F.array_contains("technology_stack", technology)
    return adrs.where(hit).select("adr_number", "title", "status", "decided_at").orderBy(F.desc_nulls_last("decided_at"), "adr_number")


def history(adrs: DataFrame, technology: str | None = None, category: str | None = None) -> DataFrame:
    src = adrs
    if technology is not None:
        src = src.where(F.array_contains("technology_stack", technology))
    if category is not None:
        src = src.where(F.col("decision_category") == category)
    return src.select("adr_number", "title", "decision_category", "decided_at").orderBy(F.desc_nulls_last("decided_at"), "adr_number")


def language_flags(chunks: DataFrame) -> DataFrame:
    """(project_id, flags): per project a map of its languages in lower case to 1; an empty map for one without any."""
    langs = F.array_sort(F.collect_set(F.lower("language")))
    return chunks.groupBy("project_id").agg(langs.alias("l")).select("project_id", F.map_from_arrays("l", F.transform("l", lambda x: F.lit(1))).alias("flags"))


def project_tree(files: DataFrame, depth: int = 3, path: str = "path") -> DataFrame:
    """(prefix, n_files, bytes): files below each prefix of at most ``depth`` parts, in order; ``bytes`` where a length is given."""
    prefix = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    size = F.sum("length") if "length" in files.columns else F.lit(None).cast("bigint")
    return files.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n_files"), size.alias("bytes")).orderBy("prefix")


def counts_beside(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows with the number of rows of equal value for each column, under the given names; nulls are equal to each other.

    Counted before the join, where a window would bring all rows of a value into one task.
    """
    out = df
    for column, name in columns.items():
        n = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias(name))
        out = out.join(n, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")
    return out


def of_scalar(df: DataFrame, column: str, rows: DataFrame, value: str) -> DataFrame:
    """Rows whose column equals a scalar subquery, a table of one row or none; more rows are an error."""
    one = rows.agg(F.when(F.count("*") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.first(value)).alias("_value"))
    return df.join(one, F.col(column) == F.col("_value"), "left_semi")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()])


def idle_report(files: DataFrame, owner: str, at: str, now: Column, max_days: int, dry_run: bool = True) -> DataFrame:
    """(scanned, idle, deleted, skipped), one row: owners with a time, idle ones, those to delete (none in a dry run), owners without any time."""
    last = files.groupBy(owner).agg(F.max(at).alias("last"))
    old = F.col("last") < now - F.make_dt_interval(F.lit(max_days))
    n = last.agg(F.count("last").alias("scanned"), F.count_if(old).alias("idle"), F.count_if(F.col("last").isNull()).alias("skipped"))
    return n.select("scanned", "idle", (F.lit(0).cast("bigint") if dry_run else F.col("idle")).alias("deleted"), "skipped")


def idle(files: DataFrame, owner: str, at: str, now: Column, max_days: int) -> DataFrame:
    """Owners whose newest file is older than ``max_days``, with whole idle days."""
    last = files.groupBy(owner).agg(F.max(at).alias("last_update"), F.count("*").alias("n_files"))
    days = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_update").cast("timestamp"))) / 86400)
    return last.withColumn("idle_days", days.cast("bigint")).where(F.col("last_update") < now - F.make_dt_interval(F.lit(max_days)))
