"""References to records that do not exist.

References and parent keys are co-partitioned by key and sorted together, parents first; one linear pass hands each reference
the validity interval of its parent. Hot keys are split: a reference goes to one of as many partitions of its key as the
session has shuffle partitions, and every parent row is repeated once for each, so no task receives all references of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import norm_key, union_all



def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a valid parent, with ``reason``: missing, deleted (before the reference was made, or
    one of both times is unknown), deleted_later (afterwards) or late.

    ``refs``: (table_name, record_id, field_name, target, ref_key, at); ``parents``: (target, ref_key, valid_from, deleted_at),
    valid_from null for a key that is only known as deleted. A reference is late if its parent began after ``at``; a null
    ``at`` or valid_from tells nothing, so such a reference counts as good where the parent has a row. Repeated references
    (same record, field and key) count once; null keys must be dropped before.
    """
    salts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")
    left = refs.groupBy("table_name", "record_id", "field_name", "target", "ref_key").agg(F.min("at").alias("at")).withColumn("salt", salt).withColumn("is_ref", F.lit(1))
    one = parents.groupBy("target", "ref_key").agg(F.min("valid_from").alias("valid_from"), F.max("deleted_at").alias("deleted_at"), F.max("has_row").alias("has_row"))
    right = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("is_ref", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("target", "ref_key", "salt").orderBy("is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in ("valid_from", "deleted_at", "has_row")}).where("is_ref = 1")
    reason = F.when(F.coalesce("has_row", F.lit(0)) == 0, F.when(F.col("deleted_at") >= F.col("at"), "deleted_later").when(F.col("deleted_at").isNotNull(), "deleted").otherwise("missing")).when(F.col("valid_from") > F.col("at"), "late")
    return seen.withColumn("reason", reason).where("reason is not null").select("table_name", "record_id", "field_name", "ref_key", F.date_format("at", "yyyy-MM").alias("period"), "reason")


def index_references(chunks: DataFrame, adrs: DataFrame) -> DataFrame:
    """All references of code_chunks.project_id, adrs.supersedes_adr and adrs.related_adrs; 0 stands for none in adrs."""
    c = chunks.select(F.lit("code_chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), F.lit("project_id").alias("field_name"), F.lit("project").alias("target"), norm_key(F.col("project_id")).alias("ref_key"), F.col("created_at").alias("at"))
    a = adrs.select(F.lit("adrs").alias("table_name"), F.col("id").alias("record_id"), "supersedes_adr", "related_adrs", F.col("created_at").alias("at"))
    one = a.select("table_name", "record_id", F.lit("supersedes_adr").alias("field_name"), F.lit("adr").alias("target"), F.col("supersedes_adr").alias("n"), "at")
    many = a.select("table_name", "record_id", F.lit("related_adrs").alias("field_name"), F.lit("adr").alias("target"), F.explode("related_adrs").alias("n"), "at")
    numbered = one.unionByName(many).where("n is not null and n <> 0").select("table_name", "record_id", "field_name", "target", F.col("n").cast("string").alias("ref_key"), "at")
    return c.where("ref_key is not null").unionByName(numbered).where("record_id is not null")


def index_parents(projects: DataFrame, adrs: DataFrame, cleanup_log: DataFrame) -> DataFrame:
    """Validity of projects and decision records, with deletions known from the clean-up log."""
    none = F.lit(None).cast("timestamp_ntz")
    p = projects.select(F.lit("project").alias("target"), norm_key(F.col("project_id")).alias("ref_key"), F.col("created_at").alias("valid_from"), none.alias("deleted_at"), F.lit(1).alias("has_row"))
    a = adrs.select(F.lit("adr").alias("target"), F.col("adr_number").cast("string").alias("ref_key"), F.col("created_at").alias("valid_from"), none.alias("deleted_at"), F.lit(1).alias("has_row"))
    d = cleanup_log.where("lower(entity) in ('project', 'adr')").select(F.lower("entity").alias("target"), norm_key(F.col("entity_key")).alias("ref_key"), none.alias("valid_from"), "deleted_at", F.lit(0).alias("has_row"))
    return union_all([p, a, d]).where("ref_key is not null")


def index_orphans(chunks: DataFrame, adrs: DataFrame, projects: DataFrame, cleanup_log: DataFrame) -> DataFrame:
    """Orphan references of the code index, one row per record, field and key."""
    return orphans(index_references(chunks, adrs), index_parents(projects, adrs, cleanup_log))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and month."""
    return found.groupBy("table_name", "field_name", "reason", "period").agg(F.count("*").alias("n_references"))
