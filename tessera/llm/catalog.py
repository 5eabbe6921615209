"""Queries of the training-data operators and, where SQL can state them, the DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import credentials, history, leaks, mixing, neardup, neighbours, origin, quality, splitting, statements
from tessera.session import stage, table, union_all


def p1_found(spark, d):
    return neardup.similar_pairs(table(spark, d, "code_chunks"), "chunk_id", "content")


def p1_groups(spark, d):
    return neardup.similar_groups(table(spark, d, "code_chunks"), "chunk_id", "content")


def p2_found(spark, d):
    return credentials.credential_rows(table(spark, d, "code_chunks"))


def p2_redacted(spark, d):
    return credentials.redacted(table(spark, d, "code_chunks"))


VECTOR_TABLES = (("code_chunks", "chunk_id"), ("adrs", "id"))


def _near(spark, d, name, key, least=0.9, relax=4.0, asked=False):
    v = stage(neighbours.usable(table(spark, d, name), key, "embedding"), "vectors")
    return v, neighbours.neighbours(v, key, 5, least, relax, neighbours.every_twentieth(v, key) if asked else None)


def p4_found(spark, d):
    parts = []
    for name, key in VECTOR_TABLES:
        near = _near(spark, d, name, key)[1]
        parts.append(near.select(F.lit(name).alias("table_name"), F.least(key, "other").alias("id_a"), F.greatest(key, "other").alias("id_b")).distinct())
    return union_all(parts)


def p4_neighbours(spark, d):
    """The 5 most similar records of every record whose id is divisible by 20, whatever their similarity."""
    parts = []
    for name, key in VECTOR_TABLES:
        near = _near(spark, d, name, key, least=None, relax=3.0, asked=True)[1]
        parts.append(near.select(F.lit(name).alias("table_name"), F.col(key).alias("id"), F.col("other").alias("neighbour"), F.round("sim", 4).alias("sim")))
    return union_all(parts)


def p4_recall(spark, d):
    """Missed share against brute force over the stated query set, for links of at least 0.90 and for all 5 nearest."""
    parts = []
    for name, key in VECTOR_TABLES:
        for least, relax, counted in ((0.9, 4.0, 0.9), (None, 3.0, -1.0)):
            v, near = _near(spark, d, name, key, least, relax, asked=True)
            exact = stage(neighbours.exact_neighbours(v, key, neighbours.every_twentieth(v, key)), "exact")
            parts.append(neighbours.recall(near, exact, key, counted).withColumn("table_name", F.lit(name)).withColumn("least_sim", F.lit(counted)))
    return union_all(parts)


def p5_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "code_chunks"))


def p5_found(spark, d):
    return p5_pieces(spark, d).where("piece_no = 1 and n_pieces > 1").select("chunk_id")


def p5_restored(spark, d):
    """The operator checked on its own output: the pieces without their overlaps, joined, and their lengths and line numbers."""
    w = Window.partitionBy("chunk_id").orderBy("piece_no")
    own = F.substring("content", F.col("overlap_chars") + 1, F.length("content"))
    last = F.size(F.split("content", "\n")) - 1 - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    again = F.lag("line_end").over(w) + 1 - F.size(F.split(F.substring("content", 1, F.col("overlap_chars")), "\n")) + 1
    amiss = (F.col("line_end") != F.col("line_start") + last) | (F.abs(F.col("line_start") - again) > 1)
    p = p5_pieces(spark, d).withColumns({"own": own, "amiss": F.coalesce(amiss, F.lit(False))})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    g = p.groupBy("chunk_id").agg(F.sha2(text, 256).alias("restored"), F.min("line_start").alias("first_line"), (F.max(F.length("content")) > splitting.LIMIT).alias("too_long"), F.bool_or("amiss").alias("lines_amiss"))
    return g


def p7_origins(spark, d):
    return origin.origins(table(spark, d, "code_chunks"))


def p7_found(spark, d):
    return p7_origins(spark, d).select("project_id", "file_path")


def p8_found(spark, d):
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark, d):
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_bounds(spark, d):
    """The operator checked on its own output: no source above its budget, no document too often, no shortfall where text is left."""
    docs, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    most = table(spark, d, "mix_targets").select(mixing.norm_source(F.col("source")).alias("source"), "max_repeats").dropDuplicates(["source"])
    often = docs.join(most, "source").groupBy("source").agg(F.max(F.col("copies") + (F.col("cut_tokens") > 0).cast("int") - F.col("max_repeats")).alias("over"))
    r = report.join(most, "source").join(often, "source", "left")
    short = (F.col("shortfall") != 0) & (F.col("used") != F.col("available") * F.col("max_repeats"))
    return r.select("source", (F.col("used") > F.col("budget")).alias("over_budget"), (F.coalesce("over", F.lit(0)) > 0).alias("too_often"), short.alias("short_without_cause"))


def p6_found(spark, d):
    return history.replay(table(spark, d, "code_chunks"), table(spark, d, "ingest_runs")).where("turned_away").select("chunk_id")


def p6_report(spark, d):
    """Per project and run time: chunks brought in, accepted and turned away."""
    r = history.replay(table(spark, d, "code_chunks"), table(spark, d, "ingest_runs"))
    return r.groupBy("project", "at").agg(F.count("*").alias("chunks"), F.count_if(~F.col("turned_away")).alias("accepted"), F.count_if("turned_away").alias("turned_away"))


def p10_stats(spark, d):
    return quality.classify(table(spark, d, "documents"))


def p10_found(spark, d):
    return quality.not_prose(p10_stats(spark, d)).select("doc_id").distinct()


def queries():
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_redacted": p2_redacted, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_restored": p5_restored, "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_origins": p7_origins, "p8_found": p8_found, "p8_report": p8_report, "p9_mix": p9_mix, "p9_report": p9_report, "p9_bounds": p9_bounds, "p10_found": p10_found, "p10_stats": p10_stats}


def oracle_sql():
    return {k: v for k in queries() if isinstance(v := getattr(statements, k.upper(), None), str)}
