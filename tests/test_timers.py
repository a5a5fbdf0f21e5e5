"""Keyed state: hits that come late and out of order, pages that repeat."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioloom.streaming import jobs, timers


def test_limits_over_late_hits(spark, tmp_path):
    rng, start, rows = random.Random(4), datetime(2024, 1, 1), []
    for i in range(160):
        at = rng.choice([0, 1, 999, 1000, 1_000_000, 5_000_000, 5_000_001]) + rng.randrange(12) * 5_000_000
        rows.append((f"k{i % 2}", start + timedelta(microseconds=at), i))
    rng.shuffle(rows)
    rows.append(("k0", start + timedelta(days=9), 999))  # moves the watermark past all others
    for n in range(4):
        part = rows[n * 40 : n * 40 + 40 + (n == 3)]
        spark.createDataFrame(part, "key string, ts timestamp, hit_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    hits = spark.readStream.schema("key string, ts timestamp, hit_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.hit_id: r.allowed for r in jobs.drain(timers.rate_limited(hits, "key", 4, 5, "1 day"), "append", f"{tmp_path}/out").collect()}
    want = {}
    for key, at, hit in rows[:-1]:
        mine = [1 for k, t, h in rows if k == key and at - timedelta(seconds=5) < t and (t, h) <= (at, hit)]
        want[hit] = len(mine) <= 4
    assert got == want and len(set(want.values())) == 2


def test_pages_are_entries(spark, tmp_path):
    for n, rows in enumerate(([("a", 1, 3), ("a", 2, 3), ("b", 1, 1)], [("a", 2, 3), ("a", 3, 4), ("b", None, None)])):
        spark.createDataFrame(rows, "document_id string, page_number int, total_pages int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    pages = spark.readStream.schema("document_id string, page_number int, total_pages int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.drain(timers.progress(pages), "update", f"{tmp_path}/out", "document_id")
    assert {r.document_id: (r.pages_done, r.total_pages) for r in got.where(F.lit(True)).collect()} == {"a": (3, 4), "b": (1, 1)}


def test_calls_to_the_state_go_with_keys_not_hits():
    """A day of hits of one key, in any order, is counted by one timer."""
    import pandas as pd

    calls = []

    class Held:
        def __init__(self):
            self.d = {}

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                at = a[0] if name in ("getValue", "updateValue", "removeKey") else ()
                if name in ("update", "updateValue"):
                    self.d[at] = a[-1]
                elif name in ("exists", "containsKey"):
                    return bool(self.d)
                elif name in ("get", "getValue"):
                    return self.d.get(at)
                elif name in ("clear", "removeKey"):
                    self.d.pop(at, None)

            return call

    class Handle:
        due = []
        getMapState = getValueState = lambda self, *a: Held()  # noqa: N815, E731

        def registerTimer(self, ms):  # noqa: N802
            calls.append("timer")
            self.due.append(ms)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    one, n = timers._Limit("key", 3, 5_000), 2_000
    one.init(Handle())
    hits = [(i * 7919 % n * 2_000_000, i) for i in range(n)]
    list(one.handleInputRows(("k",), iter([pd.DataFrame(hits, columns=["us", "hit_id"])]), At(0)))
    got = pd.concat(one.handleExpiredTimer(("k",), At(86_400_000), At(0)))
    assert sorted(got["hit_id"]) == list(range(n)) and got["allowed"].all()  # three in five seconds
    assert len(calls) < 40
