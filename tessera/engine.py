"""A façade with the names of the tool surface: an index over one tree of files, and searches over a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import chunking, lexical, symbols, vector
from tessera.operators.embed import hash_vector
from tessera.sources import files as sources


class CodeIndex:
    """``build`` reads a tree; ``save`` keeps files, symbols and chunks as Parquet tables, ``load`` reads files and symbols."""

    def __init__(self, spark: SparkSession, root: str, extra_excludes: tuple[str, ...] = ()):
        self.spark, self.root, self.excludes = spark, root, extra_excludes
        self.files: DataFrame | None = None
        self.symbols: DataFrame | None = None
        self.loaded = False

    def build(self, index_time=None) -> CodeIndex:
        """Read the tree, unless an index is held that no file is newer than."""
        if index_time is not None and self.files is not None and sources.is_fresh(sources.listing(self.spark, self.root, self.excludes), index_time):
            return self
        self.files = sources.read_tree(self.spark, self.root, self.excludes).cache()
        self.symbols = symbols.symbols(self.files)
        return self

    refresh = build

    def save(self, path: str) -> None:
        self.files.write.mode("overwrite").parquet(f"{path}/files")
        self.symbols.write.mode("overwrite").parquet(f"{path}/symbols")
        self.chunks().write.mode("overwrite").parquet(f"{path}/chunks")

    def load(self, path: str) -> CodeIndex:
        self.files, self.symbols = self.spark.read.parquet(f"{path}/files"), self.spark.read.parquet(f"{path}/symbols")
        self.loaded = True
        return self

    def clear(self) -> None:
        if self.files is not None:
            self.files.unpersist()
        self.files = self.symbols = None

    def find_files(self, pattern: str, max_results: int | None = None) -> list[str]:
        """Paths in order, at most ``max_results`` where given; use :meth:`matching_files` for a table of them."""
        found = self.matching_files(pattern).orderBy("path")
        return [r.path for r in (found.limit(max_results) if max_results and max_results > 0 else found).toLocalIterator()]

    def matching_files(self, pattern: str = "*", languages: tuple[str, ...] = (), directories: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> DataFrame:
        """(path) of the files that fit a glob, a language, a directory pattern and no exclude pattern; what is not given takes all."""
        text.validate_glob(pattern)
        p = F.col("path")
        keep = paths.glob_match(p, pattern) & paths.of_language(paths.file_language(p), list(languages)) & paths.in_directories(p, list(directories))
        return self.files.where(keep & paths.not_matching(p, list(excludes))).select("path")

    def search_code_advanced(self, pattern: str, **options) -> DataFrame:
        return lexical.search(self.files, pattern, **options)

    def get_file_summary(self, file_path: str) -> DataFrame:
        """One row: line count, language, imports, exports, package, and the symbols in line order; only this file is parsed."""
        one = self.files.where(F.col("path") == paths.normalise(F.lit(file_path.strip())))
        syms = self.symbols.where(F.col("file") == file_path) if self.loaded else symbols.symbols(one)
        return symbols.file_details(one).join(symbols.file_summary(syms).withColumnRenamed("file", "path"), "path", "left")

    def status(self) -> dict:
        return symbols.rebuild_status(self.root, self.files, self.symbols)

    def chunks(self, strategy: str = "function") -> DataFrame:
        return chunking.chunk_files(self.files, strategy)


def semantic_search_code(chunks: DataFrame, projects: DataFrame, user_id: str, query: str | list[float], project_name: str | None = None, language: str | None = None, top_k: int = 10, min_similarity: float = 0.0, dim: int = 64, use_mock: bool = False) -> DataFrame:
    """Filtered top-k over the user's chunks. A text query is embedded with the deterministic embedder; ``use_mock`` finds nothing."""
    mine = projects.where(F.col("user_id") == user_id)
    if project_name is not None:
        mine = mine.where(F.col("project_name") == project_name)
    c = chunks.where(F.lower("language") == language.lower()) if language else chunks
    c = c.join(mine.select("project_id", "project_name").dropDuplicates(["project_id"]), "project_id")
    if use_mock:
        c = c.limit(0)
    q = [float(x) for x in hash_vector(query, dim)] if isinstance(query, str) else query
    return vector.shaped(vector.top_k(c, q, top_k, tie="chunk_id", min_similarity=min_similarity))


def find_similar_code(chunks: DataFrame, projects: DataFrame, user_id: str, snippet: str | list[float], project_name: str | None = None, language: str | None = None, top_k: int = 5, min_similarity: float = 0.5) -> DataFrame:
    return semantic_search_code(chunks, projects, user_id, snippet, project_name, language, top_k, min_similarity)
