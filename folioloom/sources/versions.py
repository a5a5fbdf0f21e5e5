"""Tables in whole versions: a write goes to new folders and counts once its pointer file is there.

A table is a folder. `_versions/000000007.json` names, for each bucket of version 7, the folder that holds it and its rows; buckets that a
write doesn't touch stay where they are. The pointer is the last thing written, under a name that only one writer can make, so a
write that dies half-way leaves nothing that a reader sees, and of two writers at once one is told to try again. A reader holds
a version's own folders until clean() removes them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Rows of a bucket, about: there are as many buckets as that takes, a power of two, and more as the table grows.
BUCKET_ROWS = 500_000


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


@dataclass(frozen=True)
class Version:
    """buckets: folder and rows of each bucket that has rows; many: how many buckets there are; facts: what a writer keeps with it."""

    number: int
    many: int
    schema: str
    buckets: dict[int, tuple[str, int]]
    facts: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.buckets.values())


class Table:
    """key: the column whose values are replaced as wholes; buckets go by its hash, or by what bucket says."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.key, self.bucket_rows = spark, path.rstrip("/"), key, bucket_rows

    # ---- files

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _bytes(self, name: str) -> bytes:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _put(self, name: str, content: bytes) -> None:
        fs, p = self._at(name)
        out = fs.create(p, True)
        out.write(content)
        out.close()

    def numbers(self) -> list[int]:
        """The versions that are there, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("_versions") if n.endswith(".json") and n[0].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, the last if none is named; None where there's none."""
        known = self.numbers()
        if not known:
            return None
        got = json.loads(self._bytes(f"_versions/{known[-1] if number is None else number:09d}.json"))
        return Version(got["number"], got["many"], got["schema"], {int(k): (f, n) for k, (f, n) in got["buckets"].items()}, got.get("facts", {}))

    def _commit(self, v: Version) -> Version:
        """Puts the pointer in its place: written aside, then renamed to a name that isn't there yet."""
        name = f"_versions/.{uuid.uuid4().hex}"
        self._put(name, json.dumps({"number": v.number, "many": v.many, "schema": v.schema, "buckets": v.buckets, "facts": v.facts}).encode())
        fs, aside = self._at(name)
        _, place = self._at(f"_versions/{v.number:09d}.json")
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise Conflict(f"{self.path}: version {v.number} is another writer's")
        return v

    # ---- reading

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, or of some buckets of it; None where there's no version."""
        v = self.version(number)
        return None if v is None else self._rows(v, buckets)

    def _rows(self, v: Version, buckets: list[int] | None = None) -> DataFrame:
        own = [f"{self.path}/{f}/bucket={b}" for b, (f, _) in sorted(v.buckets.items()) if buckets is None or b in buckets]
        schema = t.StructType.fromJson(json.loads(v.schema))
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def of(self, values: list, number: int | None = None) -> DataFrame | None:
        """The rows with these keys, from their buckets alone."""
        v = self.version(number)
        if v is None:
            return None
        asked = self.spark.createDataFrame([(x,) for x in values], t.StructType([t.StructField(self.key, t.StructType.fromJson(json.loads(v.schema))[self.key].dataType)]))
        places = {r.b for r in asked.select(self.place(v.many).alias("b")).distinct().collect()}
        return self._rows(v, list(places)).where(F.col(self.key).isin(values))

    # ---- writing

    def place(self, many: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(many)).cast("int")

    def _many(self, rows: int) -> int:
        return 1 << max(0, -(-rows // self.bucket_rows) - 1).bit_length()

    def _written(self, rows: DataFrame, place: Column) -> tuple[str, dict[int, tuple[str, int]]]:
        """A new folder with the rows by bucket: a bucket in one task, but for those that Spark finds too large for one."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("bucket", place).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        names = [n for n in self._names(folder) if n.startswith("bucket=")]
        if not names:
            return folder, {}
        counts = self.spark.read.schema(t.StructType([*rows.schema.fields, t.StructField("bucket", t.IntegerType())])).parquet(f"{self.path}/{folder}").groupBy("bucket").count()
        return folder, {r["bucket"]: (folder, r["count"]) for r in counts.collect()}  # a row a bucket

    def write(self, rows: DataFrame, facts: dict | None = None) -> Version:
        """A version of these rows alone."""
        old = self.version()
        many = self._many(rows.count())
        return self._commit(Version((old.number if old else 0) + 1, many, rows.schema.json(), self._written(rows, self.place(many))[1], facts or {}))

    def replace(self, rows: DataFrame, facts: dict | None = None) -> Version:
        """A version in which the keys of rows have these rows and all others what they had. Only buckets with a new key are written,
        unless the table outgrows its buckets: then all are, twice as many or more. An old row's column that rows hasn't is
        an error, so is a type that differs."""
        old = self.version()
        if old is None:
            return self.write(rows, facts)
        if [(f.name, f.dataType) for f in t.StructType.fromJson(json.loads(old.schema))] != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError(f"{self.path} has other columns: {old.schema}")
        touched = [r.b for r in rows.select(self.place(old.many).alias("b")).distinct().collect()]  # old.many numbers at most
        many = max(old.many, self._many(old.rows + rows.count()))
        grown = many > 2 * old.many
        many = many if grown else old.many
        kept = self._rows(old, None if grown else touched).join(rows.select(self.key).distinct(), self.key, "left_anti")
        _, new = self._written(kept.select(rows.columns).unionByName(rows), self.place(many))
        stay = {} if grown else {b: x for b, x in old.buckets.items() if b not in touched}
        return self._commit(Version(old.number + 1, many, old.schema, stay | new, old.facts | (facts or {})))

    def remove(self, keys: DataFrame) -> Version | None:
        """A version without the keys of keys."""
        old = self.version()
        if old is None:
            return None
        touched = [r.b for r in keys.select(self.place(old.many).alias("b")).distinct().collect()]
        _, new = self._written(self._rows(old, touched).join(keys.select(self.key).distinct(), self.key, "left_anti"), self.place(old.many))
        return self._commit(Version(old.number + 1, old.many, old.schema, {b: x for b, x in old.buckets.items() if b not in touched} | new, old.facts))

    def clean(self, keep: int = 2) -> list[str]:
        """Removes all versions but the last few, and the folders that none of these names, those of writes that died among them. Not
        to be called while another writer is at work."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            fs, p = self._at(f"_versions/{n:09d}.json")
            fs.delete(p, False)
        named = {f for n in numbers[-keep:] for f, _ in self.version(n).buckets.values()}
        gone = [n for n in self._names(".") if n.startswith("data-") and n not in named]
        for n in gone:
            fs, p = self._at(n)
            fs.delete(p, True)
        return gone
