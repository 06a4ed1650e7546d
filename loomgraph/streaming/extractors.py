"""Extractors of skills from chunks: a language model behind a function, with rate limit and retries, and a fallback.

An extractor is a function of chunks (source_id, index, text) and nodes that gives source_id, index, skill, weight,
context, and error where a chunk failed.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers
from . import ingest, retry


class RateLimiter:
    """At most rpm calls in any `window` seconds of one task; 0 or less: no limit."""

    def __init__(self, rpm: int, window: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rpm, self.window, self.clock, self.sleep = rpm, window, clock, sleep
        self.calls: deque[float] = deque()

    def acquire(self) -> None:
        if self.rpm <= 0:
            return
        while True:
            now = self.clock()
            while self.calls and now - self.calls[0] >= self.window:
                self.calls.popleft()
            if len(self.calls) < self.rpm:
                self.calls.append(now)
                return
            self.sleep(self.window - (now - self.calls[0]))


def model_extractor(call: Callable[[str], str], rpm: int = 0, most: int = retry.MOST, wait: Callable[[int], float] = retry.delay):
    """call: a chunk's text -> the model's JSON. rpm counts within a task, so divide a quota by the tasks that run at once."""

    def run(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
        def ask(batches):
            limit = RateLimiter(rpm)
            for pdf in batches:
                rows = []
                for source_id, index, text in pdf[["source_id", "index", "text"]].itertuples(index=False):
                    payload, error = None, None
                    for attempt in range(1, most + 1):
                        limit.acquire()
                        try:
                            payload, error = call(text), None
                            break
                        except Exception as e:  # the model is foreign code; what it says decides on another try
                            error = f"{type(e).__name__}: {e}"
                            if not retry.retryable(error) or attempt == most:
                                break
                            time.sleep(wait(attempt))
                    rows.append((source_id, int(index), payload, error))
                yield pd.DataFrame(rows, columns=["source_id", "index", "payload", "call_error"])

        asked = chunks.mapInPandas(ask, "source_id string, index int, payload string, call_error string")
        x = readers.from_payload(asked).withColumn("error", F.coalesce("call_error", "error"))
        return x.select("source_id", "index", "error", F.explode_outer("skills").alias("s")).where("s IS NOT NULL OR error IS NOT NULL").select("source_id", "index", "s.skill", "s.weight", "s.context", "error")

    return run


def with_fallback(primary, default=ingest.gazetteer_extractor):
    """primary; chunks that it fails on are given to default."""

    def run(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
        found = primary(chunks, nodes)
        if "error" not in found.columns:
            return found
        bad = found.where("error IS NOT NULL").select("source_id", "index").distinct()
        again = default(chunks.join(bad, ["source_id", "index"], "left_semi"), nodes)
        return found.where("error IS NULL").drop("error").unionByName(again)

    return run
