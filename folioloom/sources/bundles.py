"""Processed documents as a data source: a folder a document, with its artifacts as JSON, read in place.

    spark.dataSource.register(bundles.Bundles)
    spark.read.format("bundles").option("path", root).option("artifact", "chunks").schema(schema).load()

A partition is some documents' folders, FOLDERS at most. A document's artifact is <name>.json, or else structured/<name>.json, a list of rows or {"rows": [...]}. The
rows are those of the schema, with document_id, the folder's name, if the schema has it, and error: a file that is no JSON, or
a row that doesn't fit, is a row with error and nulls. Filters on document_id choose folders before any is opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

#: Lets Spark hand filters to sources of this kind.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Folders of a partition at most, and partitions that folders are dealt to before they share any.
FOLDERS, SPREAD = 256, 64


def register(spark: SparkSession) -> None:
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Bundles)


def _files(path: str) -> tuple[Any, str]:
    """A file system and a path in it, of any kind that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def fitted(value: Any, kind: t.DataType, where: str) -> Any:
    """value as kind, lists and objects within it too; ValueError where it isn't one. Whole numbers pass as doubles."""
    if value is None:
        return None
    if isinstance(kind, t.ArrayType) and isinstance(value, list):
        return [fitted(v, kind.elementType, f"{where}[{i}]") for i, v in enumerate(value)]
    if isinstance(kind, t.MapType) and isinstance(value, dict):
        return {k: fitted(v, kind.valueType, f"{where}.{k}") for k, v in value.items()}
    if isinstance(kind, t.StructType) and isinstance(value, dict):
        return tuple(fitted(value.get(f.name), f.dataType, f"{where}.{f.name}") for f in kind.fields)
    plain = {t.StringType: str, t.BooleanType: bool, t.LongType: int, t.IntegerType: int, t.DoubleType: float, t.FloatType: float}.get(type(kind))
    if plain is float and type(value) is int:
        return float(value)
    if plain and type(value) is plain:
        return value
    raise ValueError(f"{where}: {json.dumps(value)[:60]} is no {kind.simpleString()}")


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: t.StructType):
        self.root, self.artifact, self.schema = options["path"].rstrip("/"), options["artifact"], schema
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("document_id",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("document_id",):
                self._only(set(f.value))
            elif isinstance(f, IsNotNull) and f.attribute == ("document_id",):
                continue  # a folder has a name
            else:
                yield f

    def _only(self, names: set[str]) -> None:
        self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        files, root = _files(self.root)
        there = [i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
        names = sorted(n for n in there if self.wanted is None or n in self.wanted)
        each = max(1, min(FOLDERS, -(-len(names) // SPREAD)))
        return [Folders(names[i : i + each]) for i in range(0, len(names), each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, root = _files(self.root)
        for name in partition.names:  # type: ignore[attr-defined]
            yield from self._document(files, root, name)

    def _document(self, files: Any, root: str, name: str) -> Iterator[tuple]:
        from pyarrow import fs

        for place in (f"{root}/{name}/{self.artifact}.json", f"{root}/{name}/structured/{self.artifact}.json"):
            if files.get_file_info(place).type == fs.FileType.File:
                break
        else:
            return
        own = {"document_id": name, "error": None}
        try:
            with files.open_input_stream(place) as f:
                found = json.loads(f.read().decode())
            rows = found["rows"] if isinstance(found, dict) and "rows" in found else found
            rows = rows if isinstance(rows, list) else [rows]
        except (ValueError, UnicodeDecodeError) as e:
            yield self._row({}, own | {"error": f"{place.rsplit('/', 1)[1]}: {e}"[:300]})
            return
        for i, r in enumerate(rows):
            try:
                if not isinstance(r, dict):
                    raise ValueError(f"row {i} is no object")
                yield self._row({f.name: fitted(r.get(f.name), f.dataType, f"row {i}.{f.name}") for f in self.schema.fields if f.name not in own}, own)
            except ValueError as e:
                yield self._row({}, own | {"error": str(e)[:300]})

    def _row(self, values: dict, own: dict) -> tuple:
        return tuple(own[f.name] if f.name in own else values.get(f.name) for f in self.schema.fields)


class Bundles(DataSource):
    """Options: path, the folder of document folders; artifact, the name of a JSON file without its suffix."""

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return "document_id string, error string"

    def reader(self, schema: t.StructType) -> DataSourceReader:
        missing = [k for k in ("path", "artifact") if k not in self.options]
        if missing:
            raise ValueError(f"bundles: no {' and no '.join(missing)}")
        return Reader(dict(self.options), schema)


def write(rows: DataFrame, root: str, artifact: str, structured: bool = False) -> int:
    """Each document's rows (document_id, json: an object as text) as root/<document_id>/<artifact>.json, or below structured/, in the
    place of what is there; how many documents. A file is written aside and moved, so a reader sees all of it or none. A document's
    artifact is one file, and so made by one task."""

    def put(table: Any) -> Any:
        import uuid

        import pyarrow as pa

        files, base = _files(root)
        name = table.column("document_id")[0].as_py()
        folder = f"{base.rstrip('/')}/{name}" + ("/structured" if structured else "")
        files.create_dir(folder, recursive=True)
        aside = f"{folder}/.{artifact}-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as f:
            f.write(("[" + ",\n".join(table.column("json").to_pylist()) + "]").encode())
        files.move(aside, f"{folder}/{artifact}.json")
        return pa.table({"document_id": [name]})

    own = rows.where("document_id is not null and json is not null").select("document_id", "json")
    return own.groupBy("document_id").applyInArrow(put, "document_id string").count()
