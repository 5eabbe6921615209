"""Git inputs as data: URLs, name-status lines, commit metadata (FN-10..12, SRC-9, SRC-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: host, owner, repository.
_URL = r"^https?://(?:[^@/]+@)?([^/]+)/([^/]+)/([^/]+?)(?:\.git)?$"


def parse_url(url: Column) -> Column:
    """struct(host, owner, repo, platform, normalized_url); null for what is no repository URL."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"^git@([^:]+):", "https://$1/")
    host, owner, repo = (F.regexp_extract(u, _URL, i) for i in (1, 2, 3))
    platform = F.when(host == "github.com", "github").when(host == "gitlab.com", "gitlab").when(host == "bitbucket.org", "bitbucket").otherwise("gitea")
    whole = F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/"), repo, F.lit(".git"))
    return F.when(u.rlike(_URL), F.struct(host.alias("host"), owner.alias("owner"), repo.alias("repo"), platform.alias("platform"), whole.alias("normalized_url")))


def clone_path(url: Column, root: str) -> Column:
    """Where a repository is cloned to: root/platform/owner/repo."""
    u = parse_url(url)
    return F.concat_ws("/", F.lit(root.rstrip("/")), u["platform"], u["owner"], u["repo"])


def with_token(url: Column, token: Column) -> Column:
    """The URL with a token in it; never persist the result."""
    return F.regexp_replace(url, r"^(https?://)", F.concat(F.lit("$1"), token, F.lit("@")))


def name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """(status, path, new_path) of ``git diff --name-status`` lines; only A, M, D and R are changes."""
    parts = F.split(F.col(column), "\t")
    status = F.substring(parts[0], 1, 1)
    out = lines.select(status.alias("status"), F.try_element_at(parts, F.lit(2)).alias("path"), F.when(status == "R", F.try_element_at(parts, F.lit(3))).alias("new_path"))
    return out.where("status in ('A', 'M', 'D') and path is not null or status = 'R' and new_path is not null")


def to_delete(changes: DataFrame) -> DataFrame:
    """Paths that are gone: deleted, and the old names of renames."""
    return changes.where("status in ('D', 'R')").select("path").distinct()


def to_index(changes: DataFrame) -> DataFrame:
    """Paths to read again: added, modified, and the new names of renames."""
    return changes.where("status in ('A', 'M', 'R')").select(F.coalesce("new_path", "path").alias("path")).distinct()


def with_commit(df: DataFrame, commit: str, branch: str, author: str, at: str) -> DataFrame:
    """Commit metadata as constant columns."""
    return df.withColumns({"commit_hash": F.lit(commit), "branch_name": F.lit(branch), "author_name": F.lit(author), "commit_timestamp": F.to_timestamp_ntz(F.lit(at))})
