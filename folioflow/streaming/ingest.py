"""Structured Streaming over a folder of documents: each micro-batch is parsed, converted and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import extension, source_format
from ..plans.convert import ConvertOptions, convert
from ..sources.files import extract


def stream_files(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """New files as (doc_id, path, format, content)."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", source_format(extension(F.col("path"))).alias("format"), "content")


def convert_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: ConvertOptions = ConvertOptions(), *, available_now: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Append Markdown of new files to ``out``.

    A batch is written under its own number, so one that is repeated after a failure replaces itself and no document
    comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        convert(extract(batch), options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream_files(spark, folder, files_per_batch=files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
