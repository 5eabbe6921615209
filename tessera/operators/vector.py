"""Exact vector search (VEC-0..7, 9; JOIN-8; FIL-22, 25; SORT-1, 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero or null vectors and for different lengths."""
    s = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), s)


def similarity(vector: str, query: list[float]) -> Column:
    """Cosine similarity of a vector column to a constant; null for a zero or null vector, another length or a null in it.

    The products are written out, so they are compiled with the rest of the stage, and the query's norm is a constant.
    """
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    if not query or not norm:
        return F.lit(None).cast("double")
    cells = [f"CAST(get(`{vector}`, {i}) AS DOUBLE)" for i in range(len(query))]
    dot_ = " + ".join(f"{c} * {float(q)!r}D" for c, q in zip(cells, query))
    square = " + ".join(f"{c} * {c}" for c in cells)
    return F.expr(f"CASE WHEN size(`{vector}`) = {len(query)} THEN try_divide({dot_}, sqrt({square}) * {norm!r}D) END")


def lookup_vector(df: DataFrame, key: str, value, vector: str) -> list[float]:
    """The vector of one record; ValueError if the record or its vector is missing."""
    row = df.where((F.col(key) == value) & F.col(vector).isNotNull()).select(vector).limit(1).collect()
    if not row:
        raise ValueError(f"no vector for {key} = {value!r}")
    return [float(x) for x in row[0][0]]


def top_k(df: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "vec_id", min_similarity: float | None = None, max_distance: float | None = None, filters: Column | None = None) -> DataFrame:
    """The k rows most similar to the query with ``similarity_score``, ties by ``tie``.

    ``max_distance`` and ``filters`` apply before the limit, ``min_similarity`` after it, so fewer than k rows may come out.
    Rows with a null or zero vector take no part. The plan is one scan and TakeOrderedAndProject: k rows a task move.
    """
    src = df.where(F.col(vector).isNotNull())
    if filters is not None:
        src = src.where(filters)
    src = src.withColumn("similarity_score", similarity(vector, query)).where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    if max_distance is not None:
        src = src.where(1 - F.col("similarity_score") < max_distance)
    best = src.orderBy(F.desc_nulls_last("similarity_score"), tie).limit(k)
    return best if min_similarity is None else best.where(F.col("similarity_score") >= min_similarity)


def hybrid(df: DataFrame, query: list[float], k: int, keyword: str | None, columns: list[str], vector: str = "embedding", tie: str = "vec_id", min_similarity: float = 0.0) -> DataFrame:
    """Over-fetch 2k, keep rows whose columns hold the keyword, raise their score by a tenth up to 1, and take k."""
    found = top_k(df, query, 2 * k, vector, tie, min_similarity)
    if keyword:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False))
        found = found.where(hit).withColumn("similarity_score", F.least(F.lit(1.0), F.col("similarity_score") * 1.1))
    return found.orderBy(F.desc("similarity_score"), tie).limit(k)


def by_name(df: DataFrame, query: list[float], name: str, fuzzy: bool = True, vector: str = "embedding", tie: str = "chunk_id", k: int = 20) -> DataFrame:
    """Functions among the k most similar chunks whose name holds (or equals) the given one."""
    found = top_k(df, query, k, vector, tie).where(F.col("chunk_type") == "function")
    return found.where(F.lower("chunk_name").contains(name.lower()) if fuzzy else F.col("chunk_name") == name)


def similar_to(df: DataFrame, key: str, value, k: int, vector: str = "embedding") -> DataFrame:
    """The k rows most similar to a stored record, itself left out."""
    return top_k(df, lookup_vector(df, key, value, vector), k, vector, key, filters=F.col(key) != value)


def fetch(best: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The stored rows of found keys, with their scores: the second half of a search whose vectors lie in another store."""
    return store.join(best.select(key, "similarity_score"), key)


def search_records(adrs: DataFrame, query: list[float], k: int = 10, category: str | None = None, status: str | None = None, technology: str | None = None) -> DataFrame:
    """Decision records by similarity: category, status and technology filter before the limit; the first 200 characters show."""
    src = adrs
    for column, value in (("decision_category", category), ("status", status)):
        if value is not None:
            src = src.where(F.col(column) == value)
    if technology is not None:
        src = src.where(F.array_contains("technology_stack", technology))
    best = top_k(src, query, k, tie="adr_number")
    return best.select("adr_number", "title", "status", F.col("decision_category").alias("category"), F.substring("content", 1, 200).alias("content_preview"), F.col("technology_stack").alias("technologies"), "similarity_score", "decided_at")


def best_per_group(df: DataFrame, query: list[float], group: str, k: int, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k most similar rows of every group."""
    s = df.where(F.col(vector).isNotNull()).withColumn("similarity_score", similarity(vector, query)).where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    w = Window.partitionBy(group).orderBy(F.desc("similarity_score"), tie)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shaped(df: DataFrame) -> DataFrame:
    """Result rows: line range, score to four places, no null symbols."""
    out = {"similarity_score": F.round("similarity_score", 4)}
    if "line_start" in df.columns:
        out["line_range"] = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    if "symbols" in df.columns:
        out["symbols"] = F.coalesce("symbols", F.lit("{}"))
    return df.withColumns(out)
