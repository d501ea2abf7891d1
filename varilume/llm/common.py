"""What the operators of this subpackage share: reading, batches, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch carries to Python; with texts up to 1 MB a batch stays within memory.
BATCH_ROWS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the columns named; other columns can't clash later."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply f to each Arrow batch; f must not keep state between batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where unset (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if sc.master.startswith("local[") or sc.master == "local":
            path = tempfile.mkdtemp(prefix="checkpoints-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def release(spark: SparkSession) -> None:
    """Let go of shuffle files behind a cut: they stay while Python or the driver hold garbage that refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df from reliable storage: its lineage ends there, and a lost executor costs nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
