"""Reading the driver tables and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, lazily; Catalyst prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a folder of our own for a local master (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, True)
        _OWN["dir"] = f"file://{own}"
    return _OWN["dir"]


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage: if an executor is lost, later stages read the files again instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Delete the tables this process has staged, once no result that reads them is needed; their number."""
    for p in _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    n = len(_STAGED)
    _STAGED.clear()
    return n


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def norm_key(col):
    """Project keys are compared trimmed and in lower case; blank keys count as null."""
    c = F.lower(F.trim(col))
    return F.when(c != "", c)
