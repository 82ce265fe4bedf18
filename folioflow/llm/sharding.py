"""Two-pass external shuffle into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch


def shard_of(key, shards: int, seed: int):
    """Rendezvous hashing: the shard whose seeded hash with the key is largest.

    Only the key and the number of shards decide. A further shard wins a key or leaves it where it is, so rows move
    only into the new one. All nulls go to one shard.
    """
    scores = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("score"), F.lit(i).alias("shard")) for i in range(shards)])
    return F.array_max(scores)["shard"]


def write_shards(docs: DataFrame, path: str, *, shards: int = 16, seed: int = 20240501, bucket_bytes: int = 16 << 20, total_bytes: int | None = None, columns: tuple[str, ...] = ("text",)) -> None:
    """Scatter the rows into buckets of about ``bucket_bytes`` by seeded hashes, Fisher-Yates shuffle each, write them.

    Pass one sends each row to its shard by ``shard_of`` (the law is `key`) and to one of the shard's buckets by a seeded
    hash of its key, content and position, so that rows that repeat one key or text still spread over the shard's
    buckets. Pass two holds one bucket at a time and permutes it with the built-in ``shuffle``, a Fisher-Yates shuffle of
    an array. The buckets of a task and the rows of a bucket stand in a fixed order before, so the same input, seed and number of
    buckets give the same places again, after a lost executor too.

    Written columns: doc_id, shard, grown_shard (the shard with one more of them), bucket, at (place in the bucket) and
    ``columns`` (whose names must be others), as Parquet. The number of buckets follows ``total_bytes`` (measured if not
    given), so memory per task does not grow with the input. Null keys share a shard; null and empty texts are rows like
    others, a very long text fills a bucket of its own size; an empty table writes an empty folder.
    """
    if clash := {"doc_id", "shard", "grown_shard", "bucket", "at"} & set(columns):
        raise ValueError(f"these columns are written already: {sorted(clash)}")
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in columns), F.lit(16))
    if total_bytes is None:
        total_bytes = docs.agg(F.sum(size).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total_bytes // (bucket_bytes * shards)))
    key = F.col("doc_id").cast("long")
    kept = [F.col(f"`{c}`") for c in columns]
    rows = docs.select(
        key.alias("doc_id"), shard_of(key, shards, seed).alias("shard"), shard_of(key, shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), key, *kept, F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket"), *kept,
    )
    held = F.struct("doc_id", "grown_shard", *columns)
    dealt = rows.repartition(buckets * shards, "shard", "bucket")
    ordered = dealt.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(held)).alias("held")).sortWithinPartitions("shard", "bucket")
    mixed = ordered.select("shard", "bucket", F.shuffle("held", seed).alias("held"))
    out = mixed.select("shard", "bucket", F.posexplode("held").alias("at", "row")).select("row.doc_id", "shard", "row.grown_shard", "bucket", "at", *[F.col(f"row.`{c}`").alias(c) for c in columns])
    out.write.option("compression", "zstd").parquet(path)


def bucket_bases(spark: SparkSession, path: str) -> DataFrame:
    """(shard, bucket, base): where a bucket begins in its shard. One row per bucket, written beside the rows, so that its size is known."""
    counts = spark.read.parquet(path).groupBy("shard", "bucket").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    bases.write.mode("overwrite").parquet(f"{path}-buckets")
    return spark.read.schema(bases.schema).parquet(f"{path}-buckets")


def with_slot(rows: DataFrame, bases: DataFrame) -> DataFrame:
    return rows.join(bases, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("at")).drop("base", "bucket", "at")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``slot``, their gapless place in the shard: buckets stand one after the other."""
    return with_slot(spark.read.parquet(path), bucket_bases(spark, path))


def shard_to_files(spark: SparkSession, docs: DataFrame, **options) -> str:
    """``write_shards`` into a new table of the shared folder; returns its path."""
    path = Scratch(spark, "shards").path("rows")
    write_shards(docs, path, **options)
    return path


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every written row.

    One row per row that was written, repeated ones too. A null text has size 1 and the crc of no bytes, as an empty one; null
    doc_ids stay null; an empty folder gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    # The texts end here: what is joined to the buckets is narrow.
    digests = spark.read.parquet(path).select("doc_id", size.alias("size"), crc.alias("text_crc32"), "shard", "bucket", "at", "grown_shard")
    return with_slot(digests, bucket_bases(spark, path)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
