"""Sinks: Markdown as one text per document, block tables, chunks, warnings, and saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_markdown(results: DataFrame, path: str) -> None:
    """One folder of text per document, ``doc_id=<id>``."""
    results.select("doc_id", F.col("markdown").alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)


def write_dump(docs: DataFrame, path: str) -> None:
    """Parsed documents as tables: blocks, images with their bytes, warnings."""
    docs.select("doc_id", "format", F.inline("blocks")).write.mode("overwrite").parquet(f"{path}/blocks")
    docs.select("doc_id", F.inline("images")).write.mode("overwrite").parquet(f"{path}/images")
    docs.select("doc_id", F.posexplode("warnings").alias("seq", "message")).write.mode("overwrite").parquet(f"{path}/warnings")


def write_debug(chunks: DataFrame, path: str) -> None:
    """What each chunk was rendered from, as JSON lines; a document's chunks stand in one file, in their order."""
    chunks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index").write.mode("overwrite").json(path)


def save_table(results: DataFrame, name: str, *, buckets: int | None = None) -> None:
    """A table of the session's catalog, bucketed by doc_id for later joins if asked."""
    writer = results.write.mode("overwrite")
    (writer.bucketBy(buckets, "doc_id").sortBy("doc_id") if buckets else writer).saveAsTable(name)
