"""Debounce, rate limit and routing of events, in batch and Structured Streaming form (STR-1, 1a, 2, 2a; WIN-5)."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths


def admitted_events(events: DataFrame) -> DataFrame:
    """File events that count: no directories, moves under their new path, admitted and not temporary paths."""
    path = F.when(F.col("event_type") == "moved", F.col("dest_path")).otherwise(F.col("src_path"))
    e = events.where(~F.coalesce("is_directory", F.lit(False))).withColumn("path", path).where(F.col("path").isNotNull())
    return e.where(paths.admitted(F.col("path")) & ~paths.temporary(F.col("path")))


def debounce(events: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """(key, started, fires_at, n_events): each quiet period of ``seconds`` ends a burst; a gap of exactly that merges.

    The same expression serves batches and, after ``withWatermark``, streams.
    """
    w = F.session_window(F.col(at), f"{seconds} seconds")
    return events.groupBy(F.col(key), w).agg(F.count("*").alias("n_events")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("fires_at"), "n_events")


def debounce_stream(events: DataFrame, key: str, at: str, seconds: float, late: str = "10 minutes") -> DataFrame:
    return debounce(events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late), key, at, seconds)


def rate_limit(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """``events`` with ``accepted``: rejected if less than ``seconds`` passed since the key's last accepted event.

    The rows of a key run through in time order; only the last accepted time is held, whatever the key's size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict = {}  # the partition is sorted by key: one entry is enough
        for batch in batches:
            if not len(batch):
                continue
            ok = []
            for k, t in zip(batch["_key"], batch["_us"]):
                before = last.get(k)
                good = before is None or t - before >= seconds * 1_000_000
                if good:
                    last = {k: t}
                ok.append(good)
            yield batch.drop(columns=["_key", "_us"]).assign(accepted=ok)

    keyed = events.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", accepted boolean"
    return keyed.repartition("_key").sortWithinPartitions("_key", "_us", tie).mapInPandas(run, schema)


def rate_limit_stream(events: DataFrame, key: str, at: str, tie: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The streaming form: the last accepted time of a key is its state; events come in time order within a batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "tie"])
        ok = []
        for t in rows["us"]:
            good = last is None or t - last >= seconds * 1_000_000
            last = t if good else last
            ok.append(good)
        state.update((int(last),))
        yield pd.DataFrame({"key": k[0], "tie": rows["tie"], "at": rows["at"], "accepted": ok})

    src = events.select(F.col(key).cast("string").alias("key"), F.col(tie).cast("bigint").alias("tie"), F.col(at).cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return src.groupBy("key").applyInPandasWithState(step, "key string, tie bigint, at timestamp, accepted boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def route(event_type: Column, url: Column, limited: Column) -> Column:
    """Status of a push call: ignored, else error without a URL, else rate_limited, else accepted."""
    return F.when(~event_type.isin("push", "Push Hook"), "ignored").when(F.coalesce(url, F.lit("")) == "", "error").when(limited, "rate_limited").otherwise("accepted")


def signature_valid(payload: bytes, header: str | None, secret: str | None, form: str = "sha256=") -> bool:
    """Whether a push call carries its HMAC-SHA256 as ``form`` + hex (form "" for a bare one); compared in constant time."""
    if not secret or not header or not header.startswith(form):
        return False
    return hmac.compare_digest(hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest(), header[len(form) :])


def signed(payload: Column, header: Column, secret: str) -> Column:
    """Column form of :func:`signature_valid`, without Python: HMAC is two hashes over the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ c for b in key)) for c in (0x36, 0x5C))
    body = payload.cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)
    return F.coalesce(header.startswith("sha256=") & (F.substring(header, 8, 64) == digest) & (F.length(header) == 71), F.lit(False))


def worth_ingesting(changes: DataFrame) -> bool:
    """Whether a pull has changed anything."""
    return bool(changes.limit(1).count())


def watcher_status(query, restarts: int = 0, debounce_seconds: float = 0.0) -> dict:
    """Status of a running stream of file events."""
    last = query.lastProgress if query is not None else None
    return {"active": bool(query is not None and query.isActive), "restarts": restarts, "debounce_seconds": debounce_seconds, "batches": last["batchId"] + 1 if last else 0}


def restarting(start: Callable[[], object], tries: int = 3):
    """Run a stream to its end, starting it again after a failure, at most ``tries`` times; the last failure is raised."""
    for attempt in range(1, tries + 1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:
            if attempt == tries:
                raise
    return None


def repository(payload: Column, platform: Column) -> Column:
    """struct(name, url, branch) of a webhook payload."""
    hub = platform.isin("github", "gitea")
    name = F.when(hub, F.get_json_object(payload, "$.repository.full_name")).otherwise(F.get_json_object(payload, "$.project.path_with_namespace"))
    url = F.when(hub, F.get_json_object(payload, "$.repository.clone_url")).otherwise(F.get_json_object(payload, "$.project.git_http_url"))
    return F.struct(name.alias("name"), url.alias("url"), F.regexp_replace(F.get_json_object(payload, "$.ref"), "^refs/heads/", "").alias("branch"))


def trailing_count(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Number of the key's events in the trailing window, the event itself included."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w))
