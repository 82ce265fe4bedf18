"""Greedy packing of ordered units into chunks under a token and an image cap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default caps.
MAX_TOKENS, MAX_IMAGES = 20_000, 80


class Packer:
    """The fold itself: feed units in order, get (chunk_index, truncated) for each."""

    def __init__(self, max_tokens: int, max_images: int):
        self.caps = (max_tokens, max_images)
        self.index, self.tokens, self.images, self.sealed = -1, 0, 0, True

    def add(self, tokens: int, images: int) -> tuple[int, bool]:
        big = tokens > self.caps[0] or images > self.caps[1]
        if self.sealed or self.tokens + tokens > self.caps[0] or self.images + images > self.caps[1]:
            self.index, self.tokens, self.images = self.index + 1, 0, 0
        self.tokens, self.images, self.sealed = self.tokens + tokens, self.images + images, big
        return self.index, big


def pack_units(units: DataFrame, *, key: str = "doc_id", order: str = "pos", tokens: str = "tokens", images: str | None = None, max_tokens: int = MAX_TOKENS, max_images: int = MAX_IMAGES) -> DataFrame:
    """Give every unit (key, order) its chunk_index and whether it is truncated (alone over a cap).

    A unit opens a new chunk where it would take the open one over a cap, so each depends on all before it and no window
    can say it. Narrow rows are dealt by key, sorted in the JVM, where they spill, and folded as a stream: a task holds
    one batch and a few counters however many units a key has. Null tokens and images count as 0; null keys are one key.
    """
    imgs = F.col(images) if images else F.lit(0)
    narrow = units.select(F.col(key), F.col(order), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("__t"), F.coalesce(imgs.cast("long"), F.lit(0)).alias("__i"))
    dealt = narrow.repartition(F.col(key)).sortWithinPartitions(key, order)
    schema = T.StructType([*dealt.schema.fields[:2], T.StructField("chunk_index", T.IntegerType()), T.StructField("truncated", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = None, object()
        for batch in batches:
            index, big = [], []
            for k, t, i in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if packer is None or k != at:
                    packer, at = Packer(max_tokens, max_images), k
                c, b = packer.add(t, i)
                index.append(c)
                big.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.int32()), pa.array(big, pa.bool_())], names=schema.names)

    return dealt.mapInArrow(run, schema)


def chunk_report(packed: DataFrame, units: DataFrame, *, key: str = "doc_id", order: str = "pos", tokens: str = "tokens") -> DataFrame:
    """One row per chunk: its range of units, how many, their tokens, and the key's number of chunks."""
    rows = packed.join(units.select(key, order, F.col(tokens).alias("__t")), [key, order])
    chunks = rows.groupBy(key, "chunk_index").agg(F.min(order).alias("unit_start"), F.max(order).alias("unit_end"), F.count("*").alias("n_units"), F.sum("__t").alias("unit_tokens"), F.bool_or("truncated").alias("truncated"))
    return chunks.withColumn("total_chunks", F.count("*").over(Window.partitionBy(key)))


def previous_tail(chunks: DataFrame, *, key: str = "doc_id", order: str = "chunk_index", text: str = "markdown", size: int = 1000) -> DataFrame:
    """The last ``size`` characters of the chunk before, for continuity."""
    return chunks.withColumn("previous_tail", F.lag(F.right(F.col(text), F.lit(size))).over(Window.partitionBy(key).orderBy(order)))


def join_chunks(chunks: DataFrame, *, key: str = "doc_id", order: str = "chunk_index", text: str = "markdown") -> DataFrame:
    """The texts of a key in order, blank ones left out, two line feeds between."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(F.col(order), F.col(text)))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias(text))
