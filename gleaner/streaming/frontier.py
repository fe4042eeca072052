"""Streams of discovered and fetched URLs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls as U


def claimed(stream: DataFrame, at: str = "found_at", ttl: str = "24 hours") -> DataFrame:
    """R2 as a stream: each canonical URL of a session once within the time to live; state goes with the watermark."""
    return stream.withColumn("url", U.canonical_url_udf(F.col("url"))).filter("url <> ''").withWatermark(at, ttl).dropDuplicatesWithinWatermark(["session_id", "url"])


def last_success(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(url, last_ok) of a log, merged with such a table from before; a job that appends to the log keeps it."""
    rows = log.filter("status_code = 200").select("url", F.col("scraped_at").alias("last_ok"))
    return (rows if before is None else rows.unionByName(before)).groupBy("url").agg(F.max("last_ok").alias("last_ok"))


def due_stream(stream: DataFrame, log: DataFrame, at: str = "found_at", days: int = 7) -> DataFrame:
    """R1 as a stream against the log's last successes: a log, which every micro-batch aggregates anew, or a table of ``last_success``, which is only joined."""
    last = log if "last_ok" in log.columns else last_success(log)
    rows = stream.join(last, "url", "left")
    return rows.filter(F.col("last_ok").isNull() | (F.col("last_ok") < F.col(at) - F.make_interval(days=F.lit(days)))).drop("last_ok")


def host_rates(stream: DataFrame, at: str = "scraped_at", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Fetches of each domain by window, for late data up to ``late``."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), "domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") == 200).alias("ok"))


def preferred_engines(stream: DataFrame) -> DataFrame:
    """O9 as a stream: the engine of each domain's last success, kept for seven days without one."""
    ttl = 7 * 24 * 3600 * 1000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        best = rows.sort_values(["scraped_at", "engine_used"]).iloc[-1]
        at, engine = best["scraped_at"].value // 1000, best["engine_used"]
        if state.exists and state.get[1] > at:
            engine, at = state.get
        state.update((engine, at))
        state.setTimeoutDuration(ttl)
        yield pd.DataFrame({"domain": [key[0]], "engine": [engine]})

    ok = stream.filter("status_code = 200").select("domain", "engine_used", "scraped_at")
    return ok.groupBy("domain").applyInPandasWithState(update, "domain string, engine string", "engine string, at long", "update", "ProcessingTimeTimeout")
