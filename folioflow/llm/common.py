"""Shared helpers of the training-data operators: shared scratch tables, batch slicing, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of Python objects held at once inside a worker, whatever the Arrow batch size is.
SLICE_ROWS = 256
#: Bytes of an Arrow batch between Spark and a worker inside of ``small_batches``; the row that reaches them is the batch's last, however long.
BATCH_BYTES = 2 << 20

_WORD = re.compile(r"\w+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A session on one machine that lacks it gets a temporary one; a cluster has to name it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.folioflow.scratch.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.folioflow.scratch.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:02d}-{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` once and return a reader of it; ``path_of`` gives its place for ``drop``."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._folioflow_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for frame in frames:
            remove(self.spark, frame._folioflow_path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside gets Arrow batches of about ``size`` bytes. Spark's own bound of 64 MB holds for each task in the executor and again in its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, held = spark.conf.get(name), spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= size:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = 2048, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts have ``size`` bytes in all, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = min(max(start + 1, int(np.searchsorted(ends, base + size, "right"))), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_words(text: str) -> list[str]:
    """Lower-case alphanumeric words; where there are none, what white space separates."""
    low = text.lower()
    return _WORD.findall(low) or low.split()
