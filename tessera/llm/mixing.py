"""Problem 9: a mix of sources with target shares of all tokens.

Every document gets a hash-random key. A range sort by (source, key) and running sums within the sorted partitions, plus the
sums of the partitions before, give each document's place in its source's token line. A source is read in whole epochs and
cut at its exact budget; no source is collected anywhere.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The public tokenizer at ``path`` (ranks in base64 lines)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def norm_source(col):
    """Sources are compared trimmed, in lower case, with runs of blanks and hyphens as one underscore; blank is null."""
    c = F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")
    return F.when(c != "", c)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a source and at least one token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [len(enc.encode_ordinary(t)) for t in batch["text"]]})

    kept = docs.select("doc_id", norm_source(F.col("source")).alias("source"), "text").where("doc_id is not null and source is not null and text is not null")
    return kept.mapInPandas(run, "doc_id bigint, source string, tokens bigint").where("tokens > 0").dropDuplicates(["doc_id"])


def place(counts: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, tokens, before): the tokens of the source's documents ahead in hash order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, carry = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not len(batch):
                continue
            total = batch.groupby("source", sort=False)["tokens"].cumsum()
            base = batch["source"].map(lambda s: carry.get(s, 0))
            out = batch[["doc_id", "source", "tokens"]].assign(part=part, inside=(total + base - batch["tokens"]).astype("int64"))
            for s, n in batch.groupby("source", sort=False)["tokens"].sum().items():
                carry[s] = carry.get(s, 0) + int(n)
            yield out

    keyed = counts.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    ranged = keyed.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    inside = stage(ranged.mapInPandas(run, "doc_id bigint, source string, tokens bigint, part int, inside bigint"), "placed")
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = inside.groupBy("source", "part").agg(F.sum("tokens").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0))).select("source", "part", "ahead")
    return inside.join(ahead, ["source", "part"]).select("doc_id", "source", "tokens", (F.col("inside") + F.col("ahead")).alias("before"))


def budgets(counts: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, used) of every target source.

    ``total`` is the size of the mix; null takes the tokens that the target sources hold. ``used`` is the budget, or all
    that max_repeats epochs give; the difference is the shortfall.
    """
    t = targets.select(norm_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    have = t.join(counts.groupBy("source").agg(F.sum("tokens").alias("available")), "source", "left").fillna({"available": 0})
    size = F.lit(total).cast("bigint") if total is not None else F.sum("available").over(Window.partitionBy())
    b = have.withColumn("budget", F.round(F.coalesce("target_share", F.lit(0.0)) * size).cast("bigint"))
    return b.withColumn("used", F.least("budget", F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents, report).

    documents: (doc_id, source, tokens, copies, cut_tokens): whole copies, and the tokens of the one partial copy at the cut
    (0 for all but one document a source). A partial copy counts as a use, so copies + (cut_tokens > 0) <= max_repeats.
    report: (source, target_share, actual_share, budget, used, shortfall, available, documents). Documents of null or
    blank source, or without text, take no part; target sources without text are reported with their whole shortfall.
    """
    counts = stage(token_counts(docs, tokenizer), "counts")
    b = stage(budgets(counts, targets, total), "budgets")
    placed = place(counts.join(b.where("used > 0").select("source"), "source", "left_semi"), seed)
    j = placed.join(b.select("source", "used", "available"), "source")
    epochs = F.expr("used div available")
    rest = F.col("used") - epochs * F.col("available")
    take = F.greatest(F.lit(0), F.least("tokens", rest - F.col("before")))
    j = j.withColumn("take", take).withColumn("copies", (epochs + (F.col("take") == F.col("tokens")).cast("int")).cast("int"))
    out = j.select("doc_id", "source", "tokens", "copies", F.when(F.col("take") < F.col("tokens"), F.col("take")).otherwise(0).cast("bigint").alias("cut_tokens")).where("copies > 0 or cut_tokens > 0")
    out = stage(out, "mix")
    got = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies") + F.col("cut_tokens")).alias("got"), F.count("*").alias("documents"))
    r = b.join(got, "source", "left").fillna({"got": 0, "documents": 0})
    share = F.round(F.try_divide(F.col("got").cast("double"), F.sum("got").over(Window.partitionBy()).cast("double")), 6)
    report = r.select("source", "target_share", share.alias("actual_share"), "budget", F.col("got").alias("used"), (F.col("budget") - F.col("got")).alias("shortfall"), "available", "documents")
    return out, report
