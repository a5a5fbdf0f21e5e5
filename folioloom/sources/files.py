"""Reading and writing: documents, artifacts, indexes, questions, SQL tables. Paths are any that Spark reads."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from folioloom.sources import versions

#: File suffixes of documents (fixed values).
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")

INDEX = "chunk_id string, text string, document_id string, metadata map<string,string>, embedding array<float>"
QUESTION = "question string, ground_truth string, relevant_chunk_ids array<string>, source_page int"
CHUNK = "chunk_id string, text string, page_content string, page_number int, ordered_block_ids array<string>, item_ids array<string>, source_region_ids array<string>, region_types array<string>, bbox_references array<array<double>>, crop_references array<string>, metadata map<string,string>"


@dataclass(frozen=True)
class Settings:
    """Parameters of the engine; values are those that a deployment without any setting has."""

    top_k: int = 4
    chunk_size: int = 1800
    overlap: int = 200
    relevance_threshold: float = 0.20
    rrf_k: int = 60
    drop_below: float = 0.3
    compression_threshold: float = 0.5
    user_id: str | None = None

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "folioloom.") -> Settings:
        """The session's settings: folioloom.top_k and so on, the values above where it has none."""
        kinds = {"int": int, "float": float}
        found = {f.name: spark.conf.get(prefix + f.name, None) for f in fields(cls)}
        return cls(**{f.name: kinds.get(f.type, str)(found[f.name]) for f in fields(cls) if found[f.name] is not None})

    def folder(self, root: str) -> str:
        """Where a user's own documents and index are; the root itself without a user."""
        return f"{root}/user_id={self.user_id}" if self.user_id else root


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


def _glob(suffixes: tuple[str, ...]) -> str:
    """A pattern of names that end in one of suffixes, in any case."""
    cased = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*{" + ",".join(cased(s) for s in suffixes) + "}"


def documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """document_id (sha256), source_filename, path, content of the files of a folder with one of suffixes, in any case; other
    files are not opened. FileNotFoundError where there's none; rows are in the order of path once sorted by it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffixes)).load(folder)
    if not files.select("path").take(1):
        raise FileNotFoundError(f"no file with a suffix of {', '.join(suffixes)} in {folder}")
    return files.select(F.sha2("content", 256).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), "path", "content")


def one_document(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """documents() of one file; ValueError if its suffix isn't one of suffixes."""
    if not path.lower().endswith(suffixes):
        raise ValueError(f"{path}: not one of {', '.join(suffixes)}")
    return documents(spark, path, suffixes)


def processed_folder(root: str, name_or_path: str) -> str:
    """The folder of a processed document: an absolute path or URI as it is, a name below root; names that lead elsewhere are
    refused."""
    parts = name_or_path.split("/")
    if ".." in parts or name_or_path in ("", "."):
        raise ValueError(f"not a document: {name_or_path!r}")
    if name_or_path.startswith("/") or "://" in name_or_path:
        return name_or_path
    return f"{root}/{name_or_path}"


def artifact(spark: SparkSession, folder: str, name: str, schema: str, required: bool = False) -> DataFrame:
    """folder/name.json, else folder/structured/name.json, else no rows, or FileNotFoundError where it's required."""
    for path in (f"{folder}/{name}.json", f"{folder}/structured/{name}.json"):
        try:
            return spark.read.schema(schema).json(path, multiLine=True)
        except AnalysisException as e:
            if not _missing(e):
                raise
    if required:
        raise FileNotFoundError(f"{name}.json not found in {folder}")
    return spark.createDataFrame([], schema)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions, a JSON object a line; blank lines are passed over."""
    return spark.read.schema(QUESTION).json(path).where("question is not null")


def write_questions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The vector index; no rows where there's none yet."""
    found = versions.Table(spark, path).read()
    return spark.createDataFrame([], INDEX) if found is None else found


def replace(rows: DataFrame, path: str, key: str = "document_id") -> None:
    """Puts the documents of rows in the table at path in place of what it has of them, as a new version of it."""
    versions.Table(rows.sparkSession, path, key).replace(rows)


_RECORD = ("chunk_id", "text", "document_id", "metadata", "embedding")


def write_index(rows: DataFrame, path: str) -> None:
    """Puts the documents of rows in the index in place of what it has of them."""
    replace(rows.select(*_RECORD), path)


def index_documents(rows: DataFrame, path: str) -> DataFrame:
    """write_index(), and document_id, n: how many records each document of rows has now. One without any is passed over: it has no row,
    and keeps what the index has of it."""
    write_index(rows, path)
    return index(rows.sparkSession, path).join(rows.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n"))


def rebuild_index(rows: DataFrame, path: str) -> None:
    """The index of rows alone: what was there goes."""
    versions.Table(rows.sparkSession, path).write(rows.select(*_RECORD))


def export(tables: dict[str, DataFrame], folder: str, by: str = "document_id") -> None:
    """Each table under its name, by document; documents that aren't in it keep what they have."""
    for name, df in tables.items():
        replace(df, f"{folder}/{name}", by)


def exported(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as export() wrote it."""
    found = versions.Table(spark, f"{folder}/{name}").read()
    if found is None:
        raise FileNotFoundError(f"{folder}/{name}")
    return found


def manifest(documents_: DataFrame, tables: dict[str, str], version: str = "1") -> DataFrame:
    """document_id, schema_version, stage, status, artifacts, processing_timestamp of each document."""
    paths = F.map_from_arrays(F.array(*[F.lit(k) for k in tables]), F.array(*[F.lit(v) for v in tables.values()]))
    return documents_.select(
        "document_id",
        F.lit(version).alias("schema_version"),
        F.lit("preprocess").alias("stage"),
        F.lit("complete").alias("status"),
        paths.alias("artifacts"),
        F.current_timestamp().alias("processing_timestamp"),
    )


def write_results(results: DataFrame, summary: DataFrame, folder: str, report: str | DataFrame | None = None) -> None:
    """results and summary as JSON lines, and the report, where there's one, as text: a string, or lines (n, line) in the order of n."""
    results.write.mode("overwrite").json(f"{folder}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    if report is not None:
        spark = results.sparkSession
        lines = spark.createDataFrame([(report,)], "value string").coalesce(1) if isinstance(report, str) else report.orderBy("n").select(F.col("line").alias("value"))
        lines.write.mode("overwrite").text(f"{folder}/report")


def delete_sql(keys: DataFrame, url: str, name: str, column: str, types: str | None = None) -> int:
    """Deletes the rows of a database's table whose column has a value of keys (one column), by one statement, so all or none; how many.
    The keys go to a table of their own beside it first, written in parallel, and gone afterwards; types: as for append_sql()."""
    jvm, doomed = keys.sparkSession._jvm, f"{name}_doomed_{uuid.uuid4().hex[:8]}"
    append_sql(keys.select(F.col(keys.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct(), url, doomed, types)
    quoted = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        statement = connection.createStatement()
        gone = statement.executeUpdate(f"DELETE FROM {name} WHERE {quoted} IN (SELECT {quoted} FROM {doomed})")
        statement.executeUpdate(f"DROP TABLE {doomed}")
        return gone
    finally:
        connection.close()


def sql_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 1, low: int = 0, high: int = 0) -> DataFrame:
    """A table of a database, in parts by ranges of a numeric key where one is given."""
    options = {"url": url, "dbtable": name} | ({"partitionColumn": key, "numPartitions": str(parts), "lowerBound": str(low), "upperBound": str(high)} if key else {})
    return spark.read.format("jdbc").options(**options).load()


def append_sql(df: DataFrame, url: str, name: str, types: str | None = None) -> None:
    """df at the end of a database's table, which is made if there's none; types: those of its columns that aren't to have the
    database's usual one, as "id VARCHAR(64)"."""
    df.write.format("jdbc").options(url=url, dbtable=name, **({"createTableColumnTypes": types} if types else {})).mode("append").save()


USERS = t.StructType([
    t.StructField("id", t.StringType(), False),
    t.StructField("email", t.StringType(), False),
    t.StructField("hashed_password", t.StringType()),
    t.StructField("oauth_provider", t.StringType()),
    t.StructField("oauth_sub", t.StringType()),
    t.StructField("created_at", t.TimestampType()),
    t.StructField("is_active", t.BooleanType()),
])
