"""Extraction in lanes: order, retries under timers, one quota for all tasks, and restarts."""

import random
import time
from collections import defaultdict

import pandas as pd
import pytest

from loomgraph.streaming import lanes

SCHEMA = "content_hash string, first_index int, n int, text string"


class Held:
    """The state and timers of one key, in memory."""

    def __init__(self):
        self.maps, self.values, self.timers = defaultdict(dict), {}, set()

    def getMapState(self, name, *_):
        held = self.maps[name]

        class Map:
            updateValue, getValue, removeKey = held.__setitem__, held.get, held.__delitem__
            keys = lambda self: iter(list(held))
            iterator = lambda self: iter(list(held.items()))

        return Map()

    def getValueState(self, name, *_):
        values = self.values

        class Value:
            exists = lambda self: name in values
            get = lambda self: values[name]
            update = lambda self, x: values.__setitem__(name, x)

        return Value()

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)


def test_shares_add_up():
    assert lanes.shares(15, 8) == [2] * 7 + [1] and lanes.shares(3, 8) == [1, 1, 1] and lanes.shares(0, 4) == [0] * 4


@pytest.mark.parametrize("seed", range(4))
def test_a_fake_hour(seed):
    """Eight lanes under one quota: never more than it in any 60 seconds, every group once, documents in order."""
    rng = random.Random(seed)
    now, calls, tried = [0.0], [], defaultdict(int)

    def call(text):
        calls.append(now[0])
        now[0] += rng.choice([0, 0.01])
        tried[text] += 1
        if text.endswith("3") and tried[text] < 3 or text.endswith("7"):
            raise TimeoutError("timeout")
        if text.endswith("5"):
            raise PermissionError("invalid api key")
        return "{}"

    quota = lanes.shares(15, 8)
    held = [Held() for _ in quota]
    docs = {f"d{i}": list(range(0, rng.randint(1, 4) * 2, 2)) for i in range(60)}
    made = []

    def lane(i):
        p = lanes.Lane(call, quota, wait=lambda attempt: 2.0**attempt, clock=lambda: now[0])
        p.init(held[i])
        return p

    def take(frames):
        made.extend(r for f in frames for r in f.itertuples(index=False))

    for h, at in docs.items():
        i = hash(h) % len(quota)
        order = rng.sample(at, len(at))
        take(lane(i).handleInputRows((i,), iter([pd.DataFrame([(h, k, 2, f"{h}-{k}") for k in order], columns=["content_hash", "first_index", "n", "text"])]), None))
    while any(h.timers for h in held):  # every wake is a new processor: only the state remains
        at, i = min((min(h.timers), i) for i, h in enumerate(held) if h.timers)
        held[i].timers.discard(at)
        now[0] = max(now[0], at / 1000)
        take(lane(i).handleExpiredTimer((i,), None, None))
    assert sorted((r.content_hash, r.first_index) for r in made) == sorted((h, k) for h, at in docs.items() for k in at)
    by = defaultdict(list)
    for r in made:
        by[r.content_hash].append(r.first_index)
        last = f"{r.content_hash}-{r.first_index}"
        assert (r.error is not None) == last.endswith(("5", "7")) and r.attempt == (4 if last.endswith("7") else 3 if last.endswith("3") else 1)
    assert all(at == sorted(at) for at in by.values())
    assert max(sum(t <= c < t + 60 for c in calls) for t in calls) <= 15


def test_a_restart_goes_on_at_the_cursor(spark, tmp_path):
    """The first run ends while a document waits for its second try; the next one makes that try and no other again."""
    log = tmp_path / "calls"
    log.mkdir()
    flag = tmp_path / "up"

    def call(text):
        (log / f"{text}-{time.time_ns()}").touch()
        if text == "b2" and not flag.exists():
            raise TimeoutError("timeout")
        return f'{{"skills": ["{text}"]}}'

    folder = tmp_path / "in"
    rows = [(h, i, 1, f"{h}{i}") for h in "abc" for i in range(4)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder))

    def run(until):
        source = spark.readStream.schema(SCHEMA).parquet(str(folder))
        out = lanes.extracted(source, call, lanes=2, wait=lambda attempt: 4.0)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()
        end = time.time() + 90
        try:
            while time.time() < end and not until():
                assert q.exception() is None
                time.sleep(0.3)
        finally:
            q.stop()

    done = lambda: {(r["content_hash"], r["first_index"]): r["attempt"] for r in spark.read.schema(lanes.OUT).parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out" / "_spark_metadata").exists() else {}
    run(lambda: len(done()) >= 10)
    assert set(done()) == {(h, i) for h, i, *_ in rows} - {("b", 2), ("b", 3)}
    flag.touch()
    run(lambda: len(done()) >= 12)
    assert done() == {(h, i): 2 if (h, i) == ("b", 2) and len(list(log.glob("b2-*"))) == 2 else done()[h, i] for h, i, *_ in rows}
    tries = defaultdict(int)
    for f in log.iterdir():
        tries[f.name.split("-")[0]] += 1
    assert all(n == 1 for k, n in tries.items() if k != "b2") and 2 <= tries["b2"] <= 4


def test_work_is_in_proportion_to_the_groups():
    """Without a quota no call times are kept, and neither is a document's state written that is done in the same batch."""
    held = Held()
    lane = lanes.Lane(lambda text: text, [0])
    lane.init(held)
    written, put = [], lane.documents.updateValue
    type(lane.documents).updateValue = staticmethod(lambda k, v: written.append(k) or put(k, v))
    rows = pd.DataFrame([(f"d{i % 500}", i // 500, 1, f"t{i}") for i in range(20000)], columns=["content_hash", "first_index", "n", "text"])
    out = pd.concat(lane.handleInputRows((0,), iter([rows]), None))
    assert len(out) == 20000 and all(list(g) == list(range(40)) for _, g in out.groupby("content_hash")["first_index"])
    assert not written and not held.values and not held.maps["groups"] and not held.maps["documents"]
