"""What several operators of this subpackage share: the scratch folder, written intermediate tables, batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only local sessions without it (tests) get a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing reads any more."""
    for table in tables:
        for at in {f.rpartition("/")[0] for f in table.inputFiles()}:
            fs, path = filesystem(unquote(at))
            fs.delete_dir(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def text_or_empty(name: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_texts(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """df mapped batch by batch; fn is called once per task and gives the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for b in batches:
            if b.num_rows:
                yield step(b)

    return df.mapInArrow(run, schema)


def hash_bucket(column, of: int):
    """A documented, engine-independent split: crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of
