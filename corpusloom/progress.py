"""Times of stages, and progress of streams."""

from __future__ import annotations

import os
import sys
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .operators import gsa, matchstats, predecessor, refindex, symbols
from .storage import stored


def busy_seconds(spark: SparkSession) -> float:
    """User and system time of this process, and the time that executors have spent in tasks."""
    own, executors = os.times(), spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return own.user + own.system + sum(executors.apply(k).totalDuration() for k in range(executors.size())) / 1000


@dataclass
class Stages:
    """Wall clock and busy seconds of named stages, also told on standard error if ``verbose``."""

    spark: SparkSession
    verbose: bool = False
    seconds: dict[str, tuple[float, float]] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str):
        wall, busy = time.perf_counter(), busy_seconds(self.spark)
        yield
        self.seconds[name] = time.perf_counter() - wall, busy_seconds(self.spark) - busy
        if self.verbose:
            print(f"{name}: {self.seconds[name][0] * 1000:.0f} ms", file=sys.stderr)


def timed_sort(collection: DataFrame, reference: DataFrame, verbose: bool = False) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The suffix array of a collection by heads, and the seconds (wall, busy) of every stage on the way."""
    told = Stages(collection.sparkSession, verbose)
    with told.stage("augment reference"):
        ref = stored(symbols.augmented(reference, collection, ""), "reference")
    with told.stage("suffix array and LCP"):
        index = stored(refindex.index_by_levels(ref), "index")
    with told.stage("inverse"):
        stored(index.select("ref_id", "pos", "rank"), "inverse")
    with told.stage("PLCP"):
        stored(refindex.with_plcp_max(index), "plcp")
    with told.stage("range minima"):
        refindex.minima(index.select("ref_id", F.col("rank").alias("j"), F.col("lcp").alias("v")))
    with told.stage("matching statistics"):
        ms = stored(matchstats.matching_statistics_by_ranks(collection, ref), "matches")
    with told.stage("heads"):
        head = stored(matchstats.heads(ms, collection, ref), "heads")
    with told.stage("bucket S*"):
        star = stored(gsa.s_star(gsa.types(collection)).where("sym <> ''"), "sstar")
    with told.stage("sort heads"):
        ranks = stored(gsa.anchor_ranks(head, index), "anchor-ranks")
        starts = head.where("not is_end").select("doc_id", F.col("start").alias("idx"))
        stored(gsa.sorted_by_heads(starts, head, index, ranks), "head-order")
    with told.stage("next heads"):
        stored(predecessor.next_heads(head, index), "next-heads")
    with told.stage("sort S*"):
        stored(gsa.sorted_by_heads(star, head, index, ranks), "sstar-order")
    with told.stage("sort all positions"):
        array = stored(gsa.sorted_by_heads(symbols.positions(collection), head, index, ranks).withColumnRenamed("order_no", "rank"), "gsa")
    return array, told.seconds


class Progress(StreamingQueryListener):
    """Tells how many rows a stream has read, each time it passes another ``every``; add it with ``spark.streams.addListener``."""

    def __init__(self, every: int = 100_000_000, out=None):
        self.every, self.out, self.rows = every, out or sys.stderr, {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        before = self.rows.get(key, 0)
        self.rows[key] = now = before + event.progress.numInputRows
        if now // self.every > before // self.every:
            print(f"{event.progress.name or key}: {now} rows", file=self.out, flush=True)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.pop(str(event.id), None)
