"""Helpers that the training-data operators share: the shared folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two numbers that may be broadcast; beyond it the join is an ordinary shuffled one.
BROADCAST_ROWS = 2_000_000


#: Spark removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def _shuffles_freed(spark: SparkSession):
    was = spark.conf.get(_FREED, None)
    try:
        spark.conf.set(_FREED, "true")
        yield
    finally:
        spark.conf.unset(_FREED) if was is None else spark.conf.set(_FREED, was)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), but as a Parquet table: compact, columnar and with sizes that the optimizer knows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in stashed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch(list):
    """Stashed tables of one operator, deleted together once nothing reads them."""

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        self.append(stash(df, name))
        return self[-1]

    def free(self) -> None:
        discard(*self)
        self.clear()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is. df must be cheap to count (cut or stashed)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(name: str, columns: list[str]) -> str:
    """name, with a number behind it where a column of that name is there already."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(columns)))) if n.lower() not in taken)


def ascii_lower(text):
    """text with A-Z lowered and nothing else; null gives the empty string."""
    text = F.coalesce(text, F.lit(""))
    plain = F.lower(text)  # the same for pure ASCII, and much faster
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: Stands for a null id inside Python workers, where pandas would turn a nullable integer into a float.
NO_ID = -(2**63)


def filled(name: str):
    return F.coalesce(name, F.lit(NO_ID)).alias(name)


def text_slices(batch: pa.RecordBatch, rows: int = 500, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows and about so many bytes of text: what a worker holds stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def text_parts(batch: pa.RecordBatch, rows: int = 500, size: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The slices of text_slices(), each with its texts as a list."""
    for part in text_slices(batch, rows, size):
        yield part, part["text"].to_pylist()
