"""Cleaning of the block table: column expressions and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_ink, is_path_leak

# Metadata keys of PDF files that say nothing about the content.
NOISE_META = ("creator", "producer", "creationDate", "modDate")
CONTAINERS = ("textbox", "blockquote")


def _styled(r: Column) -> Column:
    return r["bold"].isNotNull() | r["italic"].isNotNull() | r["underline"].isNotNull() | r["code"].isNotNull() | r["hyperlink"].isNotNull()


def clean_runs(runs: Column) -> Column:
    """Runs without those of white space only that carry no style; null where none is left."""
    kept = F.filter(runs, lambda r: has_ink(r["text"]) | _styled(r))
    return F.when(F.size(kept) > 0, kept)


def clean_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop empty runs, headings and paragraphs without runs, emptied containers, path leaks in alt texts, unconnected connectors."""
    text_like = F.col("type").isin("heading", "paragraph")
    alt = F.when(is_path_leak(F.col("image.alt_text")) & (F.col("format") == "pptx"), F.lit(None)).otherwise(F.col("image.alt_text"))
    out = blocks.withColumn("runs", F.when(text_like, clean_runs("runs")).otherwise(F.col("runs"))).filter(~text_like | F.col("runs").isNotNull())
    out = out.withColumn("image", F.when(F.col("image").isNotNull(), F.col("image").withField("alt_text", F.when(alt != "", alt))))
    loose = (F.col("type") == "connector") & (F.size("path") == 1) & F.get_json_object("payload", "$.from").isNull() & F.get_json_object("payload", "$.to").isNull() & F.coalesce(F.get_json_object("payload", "$.label"), F.lit("")).eqNullSafe("")
    out = out.filter(~F.coalesce(loose, F.lit(False)))
    return drop_empty_containers(out, key)


def clean_array(blocks: Column, fmt: Column) -> Column:
    """The same over one document's array of blocks, without a shuffle. Emptied containers stay: they render as nothing."""
    text_like = lambda b: b["type"].isin("heading", "paragraph")
    runs = F.transform(blocks, lambda b: b.withField("runs", F.when(text_like(b), clean_runs(b["runs"])).otherwise(b["runs"])))
    kept = F.filter(runs, lambda b: (~text_like(b) | b["runs"].isNotNull()) & ~F.coalesce(_loose(b), F.lit(False)))
    alt = lambda b: b["image"]["alt_text"]
    bad = lambda b: (is_path_leak(alt(b)) & (fmt == "pptx")) | (alt(b) == "")
    return F.transform(kept, lambda b: F.when(F.coalesce(bad(b), F.lit(False)), b.withField("image", b["image"].withField("alt_text", F.lit(None).cast("string")))).otherwise(b))


def _loose(b: Column) -> Column:
    """A connector on a slide that joins nothing and says nothing."""
    part = lambda k: F.get_json_object(b["payload"], f"$.{k}")
    return (b["type"] == "connector") & (F.size(b["path"]) == 1) & part("from").isNull() & part("to").isNull() & (F.coalesce(part("label"), F.lit("")) == "")


def drop_empty_containers(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Containers stay where something other than a container is left below them, at any depth.

    Every leaf names all paths above it once; a container is looked up among them. Without a container in the table the join has no rows to match.
    """
    box = F.col("type").isin(*CONTAINERS)
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    alive = blocks.filter(~box & (F.size("path") > 1)).select(key, F.col("unit_index").alias("__u"), F.explode(above).alias("__p")).distinct()
    boxes = blocks.filter(box)
    kept = boxes.join(alive, (boxes[key] == alive[key]) & boxes["unit_index"].eqNullSafe(alive["__u"]) & (boxes["path"] == alive["__p"]), "left_semi")
    return blocks.filter(~box).unionByName(kept)


def clean_meta(meta: Column) -> Column:
    kept = F.map_filter(meta, lambda k, v: ~k.isin(*NOISE_META) & (v != ""))
    return F.when(F.size(kept) > 0, kept)


def without_unit(bbox: Column) -> Column:
    return bbox.dropFields("unit")
