"""Documents that fail alone, wait, and are tried again or given up."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from folioloom.sources import versions
from folioloom.streaming import attempts, jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)  # noqa: UP017


def test_errors_are_caught_a_row(spark):
    def each(r):
        if r["v"] == 1:
            raise KeyError("one")
        return {0: [], 2: [{"x": 1, "s": "a"}, {"x": 2, "s": None}], 3: [{"x": "no number", "s": "b"}]}[r["v"]]

    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "document_id string, v int")
    got = sorted((r.document_id, r.error and r.error.split(":")[0], r.x, r.s) for r in attempts.caught(df, each, "x long, s string").collect())
    assert got[0] == ("a", None, None, None) and got[1] == ("b", "KeyError", None, None)
    assert got[2:4] == [("c", None, 1, "a"), ("c", None, 2, None)]
    assert got[4][0] == "d" and got[4][1] and got[4][2] is None
    assert attempts.caught(df.limit(0), each, "x long").count() == 0


def test_one_bad_file_of_many(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(25):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(f"file {i}".encode())
    clock, bad = [START], [True]

    def handler():
        broken = bad[0]

        def each(r):
            if r["content"] == b"file 7" and broken or r["content"] == b"file 9":
                raise ValueError("cannot read")
            return [{"text": r["content"].decode()}]

        sink = lambda df: versions.Table(spark, f"{tmp_path}/texts").replace(df)
        return attempts.Ingestion(spark, f"{tmp_path}/states", each, "text string", sink, f"{tmp_path}/staging", most=3, now=lambda: clock[0])

    def state():
        return {r.source_filename: (r.status, r.attempts) for r in handler().rows().collect()}

    assert handler().rows().count() == 0
    jobs.each_batch(jobs.uploads(spark, f"{tmp_path}/in"), handler(), f"{tmp_path}/ck1").awaitTermination()
    assert sum(s == ("ready", 1) for s in state().values()) == 23
    assert state()["7.pdf"] == state()["9.pdf"] == ("error", 1)
    assert {r.document_id: r.retry_at for r in handler().rows().where("status = 'error'").collect()} and versions.Table(spark, f"{tmp_path}/texts").read().count() == 23
    clock[0] += timedelta(minutes=4)
    handler().retry()
    assert state()["7.pdf"] == ("error", 1)  # not yet
    clock[0] += timedelta(minutes=2)
    handler().retry()
    assert state()["7.pdf"] == ("error", 2)
    clock[0] += timedelta(minutes=6)
    handler().retry()
    assert state()["7.pdf"] == ("error", 2)  # waits twice as long
    bad[0] = False
    clock[0] += timedelta(minutes=10)
    handler().retry()
    assert state()["7.pdf"] == ("ready", 3) and state()["9.pdf"] == ("given_up", 3)
    assert [r.source_filename for r in handler().given_up().collect()] == ["9.pdf"]
    clock[0] += timedelta(days=9)
    handler().retry()
    jobs.each_batch(jobs.uploads(spark, f"{tmp_path}/in"), handler(), f"{tmp_path}/ck2").awaitTermination()  # all delivered again
    assert state()["9.pdf"] == ("given_up", 3)
    assert sorted(r.text for r in versions.Table(spark, f"{tmp_path}/texts").read().collect()) == sorted(f"file {i}" for i in range(25) if i != 9)


def test_a_failing_handler_is_halved(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for i in range(9):
        (tmp_path / "up" / f"{i}.pdf").write_bytes(str(i).encode())
    seen, told = [], []

    def make(batch):
        if batch.where("content = cast('4' as binary)").take(1):
            raise RuntimeError("four")
        return batch.select(F.col("content").cast("string").alias("c"))

    handler = jobs.ingest(make, lambda s: s.createDataFrame([], "document_id string"), lambda out: seen.extend(r.c for r in out.collect()), lambda df: told.extend((r.document_id, r.status) for r in df.collect()))
    jobs.each_batch(jobs.uploads(spark, f"{tmp_path}/up"), handler, f"{tmp_path}/ck").awaitTermination()
    assert sorted(seen) == list("01235678")
    last = dict(told)
    assert sorted(last.values()) == ["error"] + ["ready"] * 8
