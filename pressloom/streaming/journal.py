"""The url journal as keyed state, and ticks counted under a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Verdicts that are final at once.
FINAL = ("accepted", "rejected", "non_event")
OUT = "url string, verdict string, attempts int, final boolean"
STATE = "verdict string, attempts int"


def fold(verdict: str | None, attempts: int, new: str) -> tuple[str, int]:
    """Verdict and attempts after one more try; a final verdict stays."""
    if verdict in FINAL or verdict == "short" and attempts >= 2:
        return verdict, attempts
    return new, attempts + 1


def is_final(verdict: str, attempts: int) -> bool:
    return verdict in FINAL or verdict == "short" and attempts >= 2


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    verdict, attempts = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values("n")
    for new in rows["verdict"]:
        verdict, attempts = fold(verdict, attempts, new)
    state.update((verdict, attempts))
    state.setTimeoutDuration(30 * 24 * 3600 * 1000)
    yield pd.DataFrame({"url": [key[0]], "verdict": [verdict], "attempts": [attempts], "final": [is_final(verdict, attempts)]})


def journal(tries: DataFrame) -> DataFrame:
    """Streaming (url, n, verdict), n ascending for each url, to the journal's updates; a url unseen for 30 days is forgotten."""
    return tries.groupBy("url").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def batch_journal(tries: DataFrame) -> DataFrame:
    """The journal of a whole table of tries (url, n, verdict; n ascending and unique for each url): what the stream ends with.

    A url is done at its first try with a final verdict, or with `short` after an earlier try; tries up to there count. All by aggregates, so that a
    url tried without end is never gathered.
    """
    first = tries.groupBy("url").agg(F.min("n").alias("first"))
    t = tries.join(first, "url")
    done = F.col("verdict").isin(*FINAL) | ((F.col("verdict") == "short") & (F.col("n") > F.col("first")))
    end = t.groupBy("url").agg(F.min(F.when(done, F.struct("n", "verdict"))).alias("stop"), F.max(F.struct("n", "verdict")).alias("last"))
    end = end.select("url", F.coalesce("stop.n", "last.n").alias("end"), F.coalesce("stop.verdict", "last.verdict").alias("verdict"), F.col("stop").isNotNull().alias("final"))
    return tries.join(end.withColumnRenamed("verdict", "v"), "url").where("n <= end").groupBy("url").agg(F.first("v").alias("verdict"), F.count(F.lit(1)).cast("int").alias("attempts"), F.first("final").alias("final"))


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming rows less repeats of a url within the watermark."""
    return stream.withWatermark("dump_ts", late).dropDuplicatesWithinWatermark(["url"])


def tick_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of each 15-minute tick."""
    return stream.withWatermark("dump_ts", late).groupBy(F.window("dump_ts", "15 minutes").alias("w"), "stream").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("tick"), "stream", "n")
