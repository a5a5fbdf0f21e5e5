"""Tables in versions: what readers see while writes fail, meet and grow."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioloom.sources import files, versions


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "document_id string, v long")


def content(df):
    return sorted(((r.document_id, r.v) for r in df.collect()), key=str)


def test_replace_remove_and_old_versions(spark, tmp_path):
    t = versions.Table(spark, f"{tmp_path}/t", bucket_rows=4)
    assert t.read() is None and t.version() is None and t.remove(rows_of(spark, [("a", 1)])) is None
    first = t.write(rows_of(spark, [(f"d{i % 10}", i) for i in range(40)]))
    assert (first.number, first.many, first.rows) == (1, 16, 40)
    second = t.replace(rows_of(spark, [("d3", -1), ("new", -2), (None, -3)]))
    same = [b for b, x in second.buckets.items() if first.buckets.get(b) == x]
    assert same and second.rows == 40 - 4 + 3  # buckets without a new key are the old files
    t.remove(rows_of(spark, [("d4", 0)]))
    assert content(t.read(1)) == sorted([(f"d{i % 10}", i) for i in range(40)], key=str)
    left = [(f"d{i % 10}", i) for i in range(40) if i % 10 not in (3, 4)] + [("d3", -1), ("new", -2), (None, -3)]
    assert content(t.read()) == sorted(left, key=str)
    assert content(t.of(["d5", "d3", "x"])) == sorted([("d3", -1)] + [("d5", i) for i in range(5, 40, 10)], key=str)
    with pytest.raises(ValueError):
        t.replace(spark.createDataFrame([("a", "x")], "document_id string, v string"))


def test_a_write_that_dies_leaves_the_old_rows(spark, tmp_path):
    t = versions.Table(spark, f"{tmp_path}/t", bucket_rows=10)
    t.write(rows_of(spark, [(f"d{i}", i) for i in range(100)]))
    before = content(t.read())
    dies = rows_of(spark, [(f"d{i}", -i) for i in range(100)]).withColumn("v", F.when(F.col("document_id") == "d77", F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("v")))
    reader = t.read()
    with pytest.raises(Exception, match="killed"):
        t.replace(dies)
    assert t.numbers() == [1] and content(t.read()) == before == content(reader)
    orphans = [n for n in os.listdir(f"{tmp_path}/t") if n.startswith("data-")]
    t.replace(rows_of(spark, [("d1", 0)]))
    assert content(reader) == before  # a reader keeps its version
    t.clean(keep=1)
    assert content(t.read()) == sorted([(f"d{i}", i) for i in range(100) if i != 1] + [("d1", 0)], key=str)
    assert t.numbers() == [2] and len(orphans) >= 1


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    a, b = (versions.Table(spark, f"{tmp_path}/t") for _ in range(2))
    a.write(rows_of(spark, [("x", 1)]))
    old = b.version()
    a.replace(rows_of(spark, [("y", 2)]))
    monkeypatch.setattr(b, "version", lambda number=None: old)  # b began before a was done
    with pytest.raises(versions.Conflict):
        b.replace(rows_of(spark, [("z", 3)]))
    assert content(a.read()) == [("x", 1), ("y", 2)]


def test_buckets_grow_with_the_table(spark, tmp_path):
    t = versions.Table(spark, f"{tmp_path}/t", bucket_rows=5)
    many = [t.replace(rows_of(spark, [(f"d{n}-{i}", i) for i in range(n)])).many for n in (3, 12, 40, 90)]
    assert many[0] == 1 and many == sorted(many) and many[-1] >= 16
    assert t.read().count() == 3 + 12 + 40 + 90
    pointer = json.load(open(f"{tmp_path}/t/_versions/000000004.json"))
    assert sum(n for _, n in pointer["buckets"].values()) == 145


def test_empty_tables_and_names_outside(spark, tmp_path):
    t = versions.Table(spark, f"{tmp_path}/t")
    assert t.write(rows_of(spark, [])).rows == 0
    assert t.read().count() == 0
    t.replace(rows_of(spark, [("a", 1)]))
    assert content(t.read()) == [("a", 1)]
    assert files.processed_folder("/root", "a") == "/root/a" and files.processed_folder("/root", "/b/c") == "/b/c"
    for bad in ("../x", "..", "", "a/../../x", "/r/../x"):
        with pytest.raises(ValueError):
            files.processed_folder("/root", bad)
