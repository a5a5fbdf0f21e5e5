"""Keyed state with timers: progress by page, and limits of rates over hits that arrive late and out of order.

State lies in RocksDB, an entry a page or a span of time, so that an update reads and writes what it concerns and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """State stores of streams that begin from now on; those that go on from a checkpoint keep what they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Progress(StatefulProcessor):
    """A map entry a page; how many there are, and the largest total."""

    def __init__(self, key: str, hours: float | None):
        self.key, self.ttl = key, None if hours is None else int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "seen boolean", self.ttl)
        self.known = handle.getValueState("known", "done long, total long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:  # noqa: N802, N803 - Spark's names
        import pandas as pd

        done, total = self.known.get() if self.known.exists() else (0, 0)
        for b in rows:
            for page in sorted(set(b["page_number"].dropna().astype(int))):
                if not self.pages.containsKey((page,)):
                    self.pages.updateValue((page,), (True,))
                    done += 1
            total = max([total, *b["total_pages"].dropna().astype(int)])
        self.known.update((int(done), int(total)))
        yield pd.DataFrame({self.key: pd.Series([key[0]], dtype=object), "pages_done": [int(done)], "total_pages": [int(total)]})

    def close(self) -> None:
        pass


def progress(pages: DataFrame, key: str = "document_id", hours: float | None = None) -> DataFrame:
    """key, pages_done, total_pages of page events (key, page_number, total_pages), in update mode: repeats of a page count once. hours: a
    page is forgotten so long after it was last written, by the clock, which then also keeps a stream going that has nothing to do;
    never, if none are given."""
    with_rocksdb(pages.sparkSession)
    out = StructType([StructField(key, StringType()), StructField("pages_done", LongType()), StructField("total_pages", LongType())])
    rows = pages.select(F.col(key).cast("string").alias(key), F.col("page_number").cast("int").alias("page_number"), F.col("total_pages").cast("int").alias("total_pages"))
    return rows.groupBy(key).transformWithStateInPandas(_Progress(key, hours), out, "Update", "None" if hours is None else "ProcessingTime")


class _Limit(StatefulProcessor):
    """Hits wait in buckets, map entries of the span's width or an hour's, until the watermark is past them. A key has one timer, at its
    first hit; when that is due, all hits that the watermark has passed are counted at once, bucket by bucket, with the times of those
    counted before that lie within the span still. So calls to the state go with the keys and buckets of a batch, not with its hits."""

    def __init__(self, key: str, limit: int, span: int):
        self.key, self.limit, self.span = key, limit, span * 1000
        self.width = max(self.span, 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getMapState("hits", "bucket long", "us array<long>, ids array<long>")
        self.recent = handle.getValueState("recent", "us array<long>")
        self.known = handle.getValueState("known", "buckets array<long>, due long, passed long")

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:  # noqa: N802, N803
        buckets, due, passed = self.known.get() if self.known.exists() else ([], 0, None)
        new: dict[int, tuple[list, list]] = {}
        for b in rows:
            for us, hit in zip(b["us"].tolist(), b["hit_id"].tolist(), strict=True):
                if passed is None or us >= passed * 1000:  # else counted already: too late
                    own = new.setdefault(us // self.width, ([], []))
                    own[0].append(us)
                    own[1].append(hit)
        if not new:
            return iter(())
        first = min(min(us) for us, _ in new.values()) // 1000
        for bucket, (us, ids) in new.items():
            old = self.hits.getValue((bucket,)) if bucket in buckets else ([], [])
            self.hits.updateValue((bucket,), ([*old[0], *us], [*old[1], *ids]))
        if not buckets or first < due:
            self.handle.registerTimer(first)
            due = first
        self.known.update((sorted({*buckets, *new}), due, passed))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:  # noqa: N802, N803
        import numpy as np
        import pandas as pd

        if not self.known.exists():
            return
        now = timerValues.getCurrentWatermarkInMs()  # timers before it are due, so are hits
        waiting, stay, next_due = self.known.get()[0], [], []
        recent = np.array(self.recent.get()[0] if self.recent.exists() else [], np.int64)
        for bucket in waiting:  # in order
            if bucket * self.width >= now * 1000:
                stay.append(bucket)
                next_due.append(bucket * self.width // 1000)
                continue
            both = sorted(zip(*self.hits.getValue((bucket,)), strict=True))
            due = [x for x in both if x[0] < now * 1000]
            later = both[len(due) :]
            if later:
                if due:
                    self.hits.updateValue((bucket,), ([u for u, _ in later], [h for _, h in later]))
                stay.append(bucket)
                next_due.append(later[0][0] // 1000)
            else:
                self.hits.removeKey((bucket,))
            if due:
                at = np.array([u for u, _ in due], np.int64)
                seen = np.concatenate([recent, at])
                inside = len(recent) + np.arange(1, len(at) + 1) - np.searchsorted(seen, at - self.span, "right")
                recent = seen[seen > at[-1] - self.span]
                yield pd.DataFrame({self.key: pd.Series([key[0]] * len(due), dtype=object), "hit_id": [h for _, h in due], "allowed": inside <= self.limit})
        recent = recent[recent > now * 1000 - self.span]  # for hits to come
        if not stay and not len(recent):
            self.known.clear()
            self.recent.clear()
            return
        # with nothing waiting, when the last has left the span: so that it leaves even if no more hits come
        at = min(next_due) if stay else int(recent[-1] + self.span) // 1000
        self.handle.registerTimer(max(at, now))
        self.recent.update((recent.tolist(),))
        self.known.update((stay, max(at, now), now))

    def close(self) -> None:
        pass


def rate_limited(hits: DataFrame, key: str, limit: int, seconds: int, late: str) -> DataFrame:
    """key, hit_id, allowed of hits (key, ts, hit_id), in append mode: whether at most limit of the key's hits, refused ones too, lie
    in the last `seconds` up to each. A hit is decided once the watermark, `late` behind the newest, is past it, among all that
    have come by then and in the order of ts and hit_id, however they came; what comes after that is dropped. A batch writes the
    buckets anew that its hits fall in; state grows with the hits that wait and those of a span."""
    with_rocksdb(hits.sparkSession)
    kind = hits.schema[key].dataType
    out = StructType([StructField(key, kind), *StructType.fromDDL("hit_id long, allowed boolean").fields])
    rows = hits.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("us"), F.col("hit_id").cast("long").alias("hit_id"))
    return rows.groupBy(key).transformWithStateInPandas(_Limit(key, limit, seconds * 1000), out, "Append", "EventTime")
