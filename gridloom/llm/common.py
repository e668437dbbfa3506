"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step looks at; temporaries are about 40 bytes a text byte.
STEP_BYTES = 1 << 20


def checkpoint_dir(spark: SparkSession) -> None:
    """Make the checkpoint folder known.

    The cluster names the shared folder in ``spark.checkpoint.dir``.  Only a
    purely local session that names none gets a temporary folder of its own;
    anywhere else a missing setting is an error, since executors could not see
    the driver's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Scratch:
    """Tables that ``cut`` has written since this began; ``keep`` says which are needed afterwards."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, *frames: DataFrame) -> None:
        self.tables = [t for t in self.tables if not any(t is f for f in frames)]


_open: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """While this is open, tables of ``cut`` are temporary: those that nobody keeps are deleted at its end."""
    _open.append(Scratch())
    try:
        yield _open[-1]
    finally:
        for df in _open.pop().tables:
            discard(df.sparkSession, df._gridloom_path)  # type: ignore[attr-defined]


def _file_system(spark: SparkSession, name: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)  # type: ignore[union-attr]
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def discard(spark: SparkSession, name: str, at_exit: bool = False) -> None:
    """Delete a folder, now or when the application ends."""
    fs, path = _file_system(spark, name)
    if at_exit:
        fs.deleteOnExit(path)
    else:
        fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again, which cuts its lineage.

    Unlike after ``checkpoint()``, the size that Spark assumes is that of the files, not
    the product of all that was joined on the way.  What isn't deleted before goes when
    the application ends.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    name = f"{spark.sparkContext.getCheckpointDir()}/gridloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(name)
    discard(spark, name, at_exit=True)
    out = spark.read.schema(df.schema).parquet(name)
    out._gridloom_path = name  # type: ignore[attr-defined]
    if _open:
        _open[-1].tables.append(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names, with as many underscores before them as make them unlike all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> pa.Array:
    """The column as strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the n + 1 offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)
