"""Ingestion in which a document fails alone: errors caught a row, attempts counted, times of the next try kept, some given up.

The state of a document is a row of a table in versions (sources.versions), so a batch's states count together or not at all. A document
that fails waits twice as long each time, and is given up after a number of tries. Later batches, and runs without any new file, take
up those whose time has come, from the files where they lie.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from folioloom.sources import versions

STATE = "document_id string, source_filename string, path string, status string, attempts int, retry_at timestamp, error string, at timestamp"


def caught(df: DataFrame, function: Callable[[dict], list[dict]], schema: str, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """keys, error, and the columns of schema: the rows that function makes of each row of df, by themselves. A row on which it raises
    has one row with why in error and nulls; one of which it makes nothing has one without error. No row fails another."""
    made = t.StructType.fromDDL(schema)
    out = t.StructType([*[df.schema[k] for k in keys], t.StructField("error", t.StringType()), *[t.StructField(f.name, f.dataType, True) for f in made.fields]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        known = to_arrow_schema(out)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own = {k: r[k] for k in keys}
                try:
                    got = function(r)
                    # what doesn't fit the schema is this row's failure too
                    pa.Table.from_pylist([own | {"error": None} | x for x in got], schema=known)
                    rows += [own | {"error": None} | x for x in got] or [own | {"error": None}]
                except Exception as e:  # noqa: BLE001 - any failure is the row's own
                    rows.append(own | {"error": f"{type(e).__name__}: {e}"[:500]})
            yield from pa.Table.from_pylist(rows, schema=known).to_batches()

    return df.mapInArrow(run, out)


@dataclass(frozen=True)
class Ingestion:
    """states: the path of the table of states. each: rows of one document ({document_id, source_filename, path, content}), which raises
    where it can't be read. sink: gets (document_id, ...schema) of the documents of a batch that didn't fail; what it writes has to be
    replaced when it's given the same document again."""

    spark: SparkSession
    states: str
    each: Callable[[dict], list[dict]]
    schema: str
    sink: Callable[[DataFrame], None]
    staging: str
    most: int = 3
    wait: timedelta = timedelta(minutes=5)
    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)  # noqa: UP017

    @property
    def table(self) -> versions.Table:
        return versions.Table(self.spark, self.states)

    def rows(self) -> DataFrame:
        """A row a document: ready, error (retry_at says when it's tried again) or given_up."""
        found = self.table.read()
        return self.spark.createDataFrame([], STATE) if found is None else found

    def given_up(self) -> DataFrame:
        return self.rows().where("status = 'given_up'").select("document_id", "source_filename", "path", "attempts", "error")

    def due(self) -> DataFrame:
        """document_id, source_filename, path, content of the failed documents whose time has come, read again; of a file that has
        changed or gone there's none."""
        late = self.rows().where((F.col("status") == "error") & (F.col("retry_at") <= F.lit(self.now())))
        paths = [r.path for r in late.select("path").limit(10_000).collect()]  # the rest with the next batch
        if not paths:
            return self.spark.createDataFrame([], "document_id string, source_filename string, path string, content binary")
        files = self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(self._there(paths) or paths[:1])
        own = files.select(F.sha2("content", 256).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), "path", "content")
        return own.join(late.select("document_id"), "document_id", "left_semi")

    def retry(self) -> None:
        """Takes up what is due, without a new file."""
        self(self.spark.createDataFrame([], "document_id string, source_filename string, path string, content binary"))

    def _there(self, paths: list[str]) -> list[str]:
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        return [p for p in paths if (x := hadoop(p)).getFileSystem(conf).exists(x)]

    def __call__(self, batch: DataFrame, number: int = 0) -> None:
        """A micro-batch of (document_id, source_filename, path, content): what is new in it, and what is due. Delivered again, or run
        again after a crash, it changes nothing that counts."""
        settled = self.rows().select("document_id")
        fresh = batch.dropDuplicates(["document_id"]).join(settled, "document_id", "left_anti")
        tried = fresh.select("document_id", "source_filename", "path", "content").unionByName(self.due())
        before = self.rows().select("document_id", F.col("attempts").alias("_tried"))
        place = f"{self.staging}/batch-{number}-{uuid.uuid4().hex}"
        keys = ("document_id", "source_filename", "path")
        caught(tried, self.each, self.schema, keys).write.parquet(place)  # each document is read once
        made = self.spark.read.parquet(place)
        if made.isEmpty():
            return
        fine = made.where("error is null").select("document_id", *t.StructType.fromDDL(self.schema).names)
        self.sink(fine)
        of = made.groupBy(*keys).agg(F.max("error").alias("error")).join(before, "document_id", "left")
        attempts = F.coalesce("_tried", F.lit(0)) + 1
        failed = F.col("error").isNotNull()
        status = F.when(~failed, "ready").when(attempts >= self.most, "given_up").otherwise("error")
        pause = F.make_dt_interval(secs=F.lit(self.wait.total_seconds()) * F.pow(F.lit(2.0), attempts - 1))
        now = F.lit(self.now())
        self.table.replace(
            of.select(
                "document_id", "source_filename", "path", status.alias("status"), attempts.cast("int").alias("attempts"), F.when(status == "error", now + pause).alias("retry_at"), "error", now.alias("at")
            )
        )
