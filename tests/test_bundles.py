"""Artifact folders as a data source."""

import json

import pytest

from folioloom.sources import bundles

SCHEMA = "document_id string, chunk_id string, page_number int, score double, region_types array<string>, error string"


@pytest.fixture
def root(tmp_path):
    def put(path, content):
        f = tmp_path / "docs" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content if isinstance(content, str) else json.dumps(content))

    put("a/chunks.json", [{"chunk_id": "a1", "page_number": 1, "score": 2, "region_types": ["table"], "other": {}}, {"chunk_id": "a2"}])
    put("a/structured/chunks.json", [{"chunk_id": "not read"}])
    put("b/structured/chunks.json", {"rows": [{"chunk_id": "b1", "page_number": "one"}, {"chunk_id": "b2", "region_types": [3]}, 7, {"chunk_id": "b3", "page_number": 3}]})
    put("c/chunks.json", "{no json")
    put("d/other.json", [])
    put("e/chunks.json", [])
    return f"{tmp_path}/docs"


def test_rows_and_errors(spark, root):
    bundles.register(spark)
    df = spark.read.format("bundles").option("path", root).option("artifact", "chunks").schema(SCHEMA).load()
    got = sorted(((r.document_id, r.chunk_id, r.page_number, r.score, r.region_types, bool(r.error)) for r in df.collect()), key=str)
    assert got == sorted([
        ("a", "a1", 1, 2.0, ["table"], False), ("a", "a2", None, None, None, False), ("b", None, None, None, None, True), ("b", None, None, None, None, True),
        ("b", None, None, None, None, True), ("b", "b3", 3, None, None, False), ("c", None, None, None, None, True),
    ], key=str)
    why = sorted(r.error for r in df.where("document_id = 'b' and error is not null").collect())
    assert why[0].startswith('row 0.page_number: "one" is no int') and why[1].startswith("row 1.region_types[0]: 3") and why[2].startswith("row 2")
    assert df.rdd.getNumPartitions() == 5


def test_filters_choose_folders(spark, root):
    bundles.register(spark)
    df = spark.read.format("bundles").option("path", root).option("artifact", "chunks").schema(SCHEMA).load()
    one = df.where("document_id = 'a' and page_number = 1")
    assert [r.chunk_id for r in one.collect()] == ["a1"] and one.rdd.getNumPartitions() == 1
    assert df.where("document_id in ('a', 'c', 'zz')").rdd.getNumPartitions() == 2
    assert "document_id" not in one._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].split("Filter")[-1]  # the source has it


def test_missing_options(spark):
    bundles.register(spark)
    with pytest.raises(Exception, match="no path"):
        spark.read.format("bundles").schema(SCHEMA).load().collect()


def test_folders_share_partitions(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i:03d}").mkdir()
        (tmp_path / f"d{i:03d}" / "chunks.json").write_text(json.dumps([{"chunk_id": str(i)}]))
    bundles.register(spark)
    df = spark.read.format("bundles").option("path", str(tmp_path)).option("artifact", "chunks").schema(SCHEMA).load()
    assert df.rdd.getNumPartitions() == 60
    assert sorted((r.document_id, r.chunk_id) for r in df.collect()) == [(f"d{i:03d}", str(i)) for i in range(300)]
