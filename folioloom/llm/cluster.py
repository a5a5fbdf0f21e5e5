"""What every operator needs of the cluster: lineage cuts, partition counts, reading tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset: a temporary one on a single machine (tests), else
    ValueError, as other machines couldn't see it."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="folioloom-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there: survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame, name: str, *partition_by: str) -> tuple[str, DataFrame]:
    """(folder, table): df as a Parquet table in the shared folder, by partition_by; its blocks outlive executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/folioloom-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    return stored_at(df, name, *partition_by)[1]


def remove(spark: SparkSession, folder: str) -> None:
    """A table or folder that stored_at() wrote, gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as make it none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, rows: int, most: int, least: int) -> int:
    """Into how many shards rows go: none of more than about most, as many as there are partitions to work side by side,
    none of fewer than about least but for the first rule."""
    return max(1, -(-rows // most), min(partitions(spark), rows // least))


def placed(df: DataFrame, cell: str, cells: int) -> DataFrame:
    """df with each of the cells 0 .. cells - 1 in a partition of its own; more than 20,000 cells share partitions by hash."""
    if cells <= 20_000:
        return df.repartitionById(cells, F.col(cell))
    return df.repartition(max(20_000, partitions(df.sparkSession)), cell)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python; the session's own setting if that's less.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are of BATCH_BYTES at most: two of them and what is made of them are held by
    every task. The setting stays, as df is only run later."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    raw = str(conf.get(key, "67108864b")).lower().removesuffix("b")
    if not raw.isdigit() or not 0 < int(raw) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones: the columns that a scan then reads."""
    return small_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
