"""Extraction of a stream of chunk groups under one quota of calls, with the state of every document in Spark.

Documents are dealt to lanes. A lane is a key of a stateful operator: it holds its documents' open groups, how far each
document is and how often its current group was tried, and the times of its calls in the last window. A document's
groups are called in order; one whose call failed, but may work later, waits by itself under a timer, while the lane goes
on with others. A lane makes at most its share of the quota in any window, and the shares add up to the quota, so all
tasks together stay below it, retries included. Nobody sleeps: what can't be called yet waits for a timer. All of this is
the query's state, so a restart with the same checkpoint goes on at every document's cursor.

Memory: a lane's call times, at most its share, and the numbers of its open groups; their texts are rows of the state store.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.workspace import ship
from . import retry

LANES = 64
#: Finished groups that are given on at once.
ROWS = 4096
OUT = "content_hash string, first_index int, n int, attempt int, error string, payload string"


def shares(rpm: int, lanes: int = LANES) -> list[int]:
    """Calls that each lane may make in a window; no more lanes than calls. rpm 0 or less: no limit."""
    lanes = max(1, min(lanes, rpm) if rpm > 0 else lanes)
    return [rpm // lanes + (i < rpm % lanes) if rpm > 0 else 0 for i in range(lanes)]


class Lane(StatefulProcessor):
    """Rows in: content_hash, first_index, n, text. Rows out (OUT): each group once, when it is done or given up."""

    def __init__(self, call: Callable[[str], str], quota: list[int], most: int = retry.MOST, wait: Callable[[int], float] = retry.delay, window: float = 60.0, clock: Callable[[], float] = time.time):
        self.call, self.quota, self.most, self.wait, self.window, self.clock = call, quota, most, wait, window, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: open groups; of each document the group that is next, its tries, and when it may be tried (milliseconds)
        self.groups = handle.getMapState("groups", "content_hash string, first_index int", "n int, text string")
        self.documents = handle.getMapState("documents", "content_hash string", "cursor int, attempt int, due long")
        self.calls = handle.getValueState("calls", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.stored()
        documents = dict(stored)
        for pdf in rows:
            for x in pdf.itertuples(index=False):
                first = int(x.first_index)
                self.groups.updateValue((x.content_hash, first), (int(x.n), x.text))
                had = documents.get(x.content_hash)
                if had is None or (first < had[0] and not had[1]):
                    documents[x.content_hash] = (first, 0, 0)
        yield from self.work(key[0], stored, documents)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stored = self.stored()
        yield from self.work(key[0], stored, dict(stored))

    def stored(self) -> dict[str, tuple[int, int, int]]:
        return {h: (cursor, attempt, due) for (h,), (cursor, attempt, due) in self.documents.iterator()}

    def work(self, lane: int, stored: dict[str, tuple[int, int, int]], documents: dict[str, tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        """Call what may be called now, and set a timer for the next time that something may. Of documents what differs
        from stored is written at the end."""
        quota, window = self.quota[lane], int(self.window * 1000) + 1  # times are cut to milliseconds
        # without a quota nobody asks when calls were made
        times = deque(self.calls.get()[0] if quota and self.calls.exists() else ())
        after: dict[str, list[int]] = {}
        for h, i in self.groups.keys():
            after.setdefault(h, []).append(i)
        for left in after.values():
            left.sort(reverse=True)
        waiting = [(due, h, cursor, attempt) for h, (cursor, attempt, due) in documents.items()]
        heapq.heapify(waiting)
        out, blocked, now = [], None, int(self.clock() * 1000)
        while waiting:
            due, h, cursor, attempt = waiting[0]
            now = int(self.clock() * 1000)
            while times and now - times[0] >= window:
                times.popleft()
            if due > now or (quota and len(times) >= quota):
                blocked = max(due, now + 1, times[-quota] + window if quota and len(times) >= quota else 0)
                break
            heapq.heappop(waiting)
            n, text = self.groups.getValue((h, cursor))
            if quota:
                times.append(now)
            payload, error = None, None
            try:
                payload = self.call(text)
            except Exception as e:  # the model is foreign code; what it says decides on another try
                error = f"{type(e).__name__}: {e}"
            if error and retry.retryable(error) and attempt + 1 < self.most:
                later = int(self.clock() * 1000 + self.wait(attempt + 1) * 1000)
                documents[h] = (cursor, attempt + 1, later)
                heapq.heappush(waiting, (later, h, cursor, attempt + 1))
                continue
            out.append((h, cursor, n, attempt + 1, error, payload))
            self.groups.removeKey((h, cursor))
            left = after[h]
            left.pop() if left[-1] == cursor else left.remove(cursor)
            if left:
                documents[h] = (left[-1], 0, 0)
                heapq.heappush(waiting, (0, h, left[-1], 0))
            else:
                del documents[h], after[h]
            if len(out) >= ROWS:
                yield self.given(out)
                out = []
        for h in stored.keys() - documents.keys():
            self.documents.removeKey((h,))
        for h, x in documents.items():
            if stored.get(h) != x:
                self.documents.updateValue((h,), x)
        if quota:
            self.calls.update((list(times),))
        # the timer that woke the lane is still listed
        if blocked is not None and not any(now < t <= blocked for t in self.handle.listTimers()):
            self.handle.registerTimer(blocked)
        if out:
            yield self.given(out)

    @staticmethod
    def given(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def extracted(groups: DataFrame, call: Callable[[str], str], rpm: int = 0, lanes: int = LANES, most: int = retry.MOST, wait: Callable[[int], float] = retry.delay, window: float = 60.0, heartbeat: bool = True) -> DataFrame:
    """OUT for a stream of chunk groups (content_hash, first_index, n, text): call gives a group's payload.

    The query's state needs the RocksDB provider, which is set for the session. heartbeat: a row a second, which no lane
    sees, from a source of its own: a restarted query looks at its timers only when some source has something new. Without
    it there are no timers either, and a call that would have to wait ends the query: for queries that end with their
    input, whose calls can't fail.
    """
    spark = groups.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    quota = shares(rpm, lanes)
    lane = F.pmod(F.xxhash64("content_hash"), F.lit(len(quota))).cast("int").alias("lane")
    x = groups.select(lane, "content_hash", F.col("first_index").cast("int").alias("first_index"), F.col("n").cast("int").alias("n"), "text")
    if heartbeat:
        beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
        x = x.unionByName(beat.select(F.lit(0).alias("lane"), F.lit("").alias("content_hash"), F.lit(0).alias("first_index"), F.lit(0).alias("n"), F.lit("").alias("text")))
    return x.groupBy("lane").transformWithStateInPandas(Lane(call, quota, most, wait, window), OUT, "Append", "ProcessingTime" if heartbeat else "None")
