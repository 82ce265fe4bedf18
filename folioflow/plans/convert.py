"""The whole way from parsed documents to Markdown, as one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import keep_one_h1, scan_pages
from ..functions.passes import postprocess
from ..functions.scalars import stem
from ..operators.clean import clean_array, clean_blocks, clean_meta
from ..operators.layout import with_neighbors
from ..operators.packing import MAX_IMAGES, MAX_TOKENS, Packer, previous_tail
from ..operators.polish import with_title, without_fluff, without_lines
from ..operators.refs import captions_of, collect_refs, first_refs
from ..operators.render import block_text, plain_text, runs_text
from ..sources.files import blocks_of

#: References (doc_id, image_id, relative_path, alt_text, context_text ..., content) -> (doc_id, image_id, caption).
Captioner = Callable[[DataFrame], DataFrame]
#: Chunks (doc_id, chunk_index, markdown, previous_tail) -> the same with another markdown.
Renderer = Callable[[DataFrame], DataFrame]


INFO = "struct<format:string,title:string,meta:map<string,string>,warnings:array<string>,scans:array<int>>"


@dataclass(frozen=True)
class ConvertOptions:
    """What a conversion does. Without a captioner or renderer everything is deterministic and offline."""

    max_chunk_tokens: int = MAX_TOKENS
    max_chunk_images: int = MAX_IMAGES
    image_captions: bool = True
    keep_image_markers: bool = False
    captioner: Captioner | None = None
    renderer: Renderer | None = None
    #: A title where none leads, no running heads and feet (lines that ``repeated`` names: doc_id, lines), no praising adjectives.
    polish: bool = False
    repeated: DataFrame | None = None
    #: Give the cleaned blocks as a column ``blocks``.
    return_blocks: bool = False
    #: A folder for the chunks as they were before the passes, for looking into them.
    debug_workspace: str | None = None
    write_to: str | None = None


def _snippet(get) -> Column:
    """What a block's neighbours see of it."""
    rows = F.array_join(F.transform(F.slice(get("rows"), 1, 2), lambda r: F.array_join(r, " ")), " | ")
    return F.when(get("type").isin("heading", "paragraph", "figure", "text"), plain_text(get("runs"))).when(get("type") == "table", rows).when(get("type") == "code", get("content")).otherwise("")


def prepared_blocks(docs: DataFrame) -> DataFrame:
    """The block table with neighbours, cleaned. Neighbours are those before cleaning, at the top level."""
    raw = blocks_of(docs).withColumn("text", _snippet(F.col))
    near = with_neighbors(raw.filter(F.size("path") == 1), ["doc_id"], "ord")
    return clean_blocks(near.unionByName(raw.filter(F.size("path") > 1), allowMissingColumns=True))


def image_refs(docs: DataFrame) -> DataFrame:
    """The first reference to every image of every document, with its context."""
    blocks = prepared_blocks(docs)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    unit_text = blocks.filter(F.col("format").isin("pptx", "pdf")).groupBy("doc_id", "unit_index").agg(texts.alias("unit_text"))
    return first_refs(collect_refs(blocks.filter("image is not null").join(unit_text, ["doc_id", "unit_index"], "left")), ["doc_id"], "image_id", "ord")


def _caption_maps(docs: DataFrame, captioner: Captioner) -> DataFrame:
    refs = image_refs(docs)
    content = docs.select("doc_id", F.inline("images")).select("doc_id", "relative_path", "content")
    known = captions_of(captioner(refs.join(content, ["doc_id", "relative_path"], "left")), refs, ["doc_id", "image_id"])
    return known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("image_id", "caption"))).alias("captions"))


def rendered_blocks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, pos, md, item, tokens, images, info): every block's Markdown. All within a document's row, without a shuffle.

    ``info`` (JSON of ``INFO``) comes with a document's first row only.
    """
    fmt = F.col("format")
    # A run of white space goes from the blocks where it stands without a style, but it keeps words and lines apart in the text.
    out = docs.withColumn("b", F.transform(F.coalesce("blocks", F.array().cast(docs.schema["blocks"].dataType)), lambda x: x.withField("md_runs", runs_text(x["runs"]))))
    out = out.withColumn("b", clean_array(F.col("b"), fmt))

    def row(x: Column, i: Column) -> Column:
        img = x["image"]
        top = F.get(x["path"], F.lit(0))
        pos = F.when(x["unit_kind"] == "block", top).otherwise(x["unit_index"])
        kind = F.when(fmt == "html", "html_block").when(fmt == "docx", "docx_section").when(fmt == "markdown", "md_section").when(fmt == "pptx", "pptx_slide").when(fmt == "xlsx", "xlsx_sheet").otherwise("pdf_page")
        place = F.when(fmt == "html", x["ord"]).when(fmt.isin("docx", "markdown"), F.coalesce(img["container_index"], F.lit(1))).otherwise(x["unit_index"])
        caption = F.element_at(F.col("captions"), F.coalesce(F.when(img["id"] != "", img["id"]), stem(img["relative_path"]), F.lit("")))
        md = block_text(lambda k: x[k], caption, kind, place)
        md = F.when(x["inside"] == "blockquote", F.regexp_replace(md, r"(?m)^", "> ")).otherwise(md)
        json = F.to_json(F.struct(x["type"].alias("type"), x["level"].alias("level"), x["list_kind"].alias("list_kind"), x["content"].alias("content"), x["runs"].alias("runs"), x["rows"].alias("rows"), img.alias("image"), x["payload"].alias("payload")))
        return F.struct(x["ord"].alias("ord"), pos.alias("pos"), md.alias("md"), x["list_kind"].isNotNull().alias("item"), F.greatest(F.lit(1), F.floor(F.length(json) / 3)).cast("long").alias("tokens"), img.isNotNull().cast("int").alias("images"))

    pdf = F.filter("b", lambda x: fmt == "pdf")
    pages = F.transform(F.array_distinct(F.transform(pdf, lambda x: x["unit_index"])), lambda u: F.struct(
        u.alias("index"), F.aggregate(F.filter(pdf, lambda x: (x["unit_index"] == u) & (x["type"] == "text")), F.lit(0), lambda n, x: n + F.length(F.trim(plain_text(x["runs"])))).alias("chars"),
        F.exists(pdf, lambda x: (x["unit_index"] == u) & x["image"].isNotNull()).alias("has_image")))
    info = F.struct("format", "title", "meta", "warnings", F.when(fmt == "pdf", scan_pages(F.col("meta")["is_scanned"] == "true", pages)).alias("scans"))
    out = out.select("doc_id", info.alias("info"), F.posexplode_outer(F.transform("b", row)).alias("i", "x"))
    return out.select("doc_id", F.coalesce("x.ord", F.lit(0)).alias("ord"), "x.pos", "x.md", "x.item", "x.tokens", "x.images", F.when(F.coalesce("i", F.lit(0)) == 0, F.to_json("info")).alias("info"))


def _scans(info: str | None) -> list[int] | None:
    return (json.loads(info).get("scans") or None) if info else None


def postprocessed(chunks: DataFrame) -> DataFrame:
    """The passes over chunks that come from elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, about = batch.schema.get_field_index("markdown"), batch.schema.get_field_index("info")
            done = [None if md is None else postprocess(md, _scans(info)) for md, info in zip(batch.column(at).to_pylist(), batch.column(about).to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, pa.string()))

    return chunks.mapInArrow(run, chunks.schema)


def pack_and_join(rows: DataFrame, max_tokens: int, max_images: int, passes: bool = False) -> DataFrame:
    """Chunks (doc_id, chunk_index, markdown, truncated, images, info) of rows (doc_id, ord, pos, md, item, tokens, images, info).

    Rows are dealt by doc_id and sorted; a task folds them as a stream and holds one unit and one open chunk. Blocks are
    joined by a blank line, items of one list by a line end. With ``passes`` a chunk goes through the Markdown passes where
    it is made.
    """
    dealt = rows.select("doc_id", "info", "ord", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("md", F.lit("")).alias("md"), F.coalesce("item", F.lit(False)).alias("item"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("images", F.lit(0)).alias("images"))
    dealt = dealt.repartition("doc_id").sortWithinPartitions("doc_id", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "chunk_index", "markdown", "truncated", "images", "info"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string()]
        doc, about, unit, packer, chunk, done, held, scans = object(), None, None, None, None, [], 0, None

        def close_chunk():
            nonlocal chunk, held
            if chunk is not None:
                text = "".join(chunk["parts"])
                text = postprocess(text, scans) if passes else text
                done.append((doc, chunk["index"], text, chunk["big"], chunk["images"], about))
                held += len(text)
            chunk = None

        def close_unit():
            nonlocal unit, chunk
            if unit is None:
                return
            index, big = packer.add(unit["tokens"], unit["images"])
            if chunk is None or index != chunk["index"]:
                close_chunk()
                chunk = {"index": index, "big": big, "images": 0, "parts": [], "item": False}
            chunk["images"] += unit["images"]
            for md, item in unit["md"]:
                if chunk["parts"]:
                    chunk["parts"].append("\n" if item and chunk["item"] else "\n\n")
                chunk["parts"].append(md)
                chunk["item"] = item
            unit = None

        for batch in batches:
            for d, info, pos, md, item, t, i in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7))):
                if packer is None or d != doc:
                    close_unit()
                    close_chunk()
                    doc, about, packer, scans = d, info, Packer(max_tokens, max_images), _scans(info)
                if unit is not None and unit["pos"] != pos:
                    close_unit()
                if unit is None:
                    unit = {"pos": pos, "tokens": 0, "images": 0, "md": []}
                unit["tokens"] += t
                unit["images"] += i
                if md:
                    unit["md"].append((md, item))
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                    done, held = [], 0
        close_unit()
        close_chunk()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return dealt.mapInArrow(run, "doc_id long, chunk_index int, markdown string, truncated boolean, images int, info string")


def convert(docs: DataFrame, options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """One row per document: doc_id, format, title, markdown, warnings, metadata.

    ``docs`` is what ``extract`` gives, parsed once here; with a captioner or renderer it is read more than once and should be a
    written table. Cleaning and rendering happen inside of a document's row; one shuffle by doc_id brings a document's blocks
    together for packing, another its chunks. doc_id must be unique.
    """
    empty = F.create_map().cast("map<string,string>")
    if options.image_captions and options.captioner:
        docs = docs.join(_caption_maps(docs, options.captioner), "doc_id", "left").withColumn("captions", F.coalesce("captions", empty))
    else:
        docs = docs.withColumn("captions", empty)
    narrow = docs.drop("images", "cells", "merged", "extents", "points", "edges")
    rows = rendered_blocks(narrow)
    at_once = not (options.keep_image_markers or options.renderer or options.debug_workspace)
    chunks = pack_and_join(rows, options.max_chunk_tokens, options.max_chunk_images, at_once)
    if options.renderer:
        chunks = options.renderer(previous_tail(chunks)).select("doc_id", "chunk_index", "markdown", "truncated", "images", "info")
    if options.debug_workspace:
        chunks.write.mode("overwrite").parquet(options.debug_workspace)
        chunks = docs.sparkSession.read.schema(chunks.schema).parquet(options.debug_workspace)
    if not (at_once or options.keep_image_markers):
        chunks = postprocessed(chunks)
    whole = chunks.withColumn("info", F.from_json("info", INFO))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.trim("markdown") != "", F.struct("chunk_index", "markdown")))), lambda p: p["markdown"])
    whole = whole.groupBy("doc_id").agg(F.first("info").alias("info"), F.array_join(parts, "\n\n").alias("markdown"), F.count("*").alias("n"), F.sum("images").alias("n_images"))
    facts = F.create_map(F.lit("image_count"), F.col("n_images").cast("string"), F.lit("chunk_count"), F.col("n").cast("string"))
    meta = F.map_concat(F.coalesce(clean_meta(F.col("info.meta")), empty), facts)
    md = F.when(F.col("n") > 1, keep_one_h1(F.col("markdown"))).otherwise(F.col("markdown"))
    result = whole.select("doc_id", "info.format", "info.title", md.alias("markdown"), "info.warnings", meta.alias("metadata"))
    if options.polish:
        if options.repeated is not None:
            result = result.join(options.repeated.select("doc_id", F.col("lines").alias("repeated_lines")), "doc_id", "left").withColumn("markdown", F.regexp_replace(without_lines(F.col("markdown"), F.col("repeated_lines")), r"\A\n+|\n+\z", "")).drop("repeated_lines")
        result = result.withColumn("markdown", without_fluff(F.col("markdown"))).withColumn("markdown", with_title(F.col("markdown"), F.col("title")))
    if options.return_blocks:
        result = result.join(docs.select("doc_id", clean_array(F.col("blocks"), F.col("format")).alias("blocks")), "doc_id", "left")
    if options.write_to:
        result.write.mode("overwrite").parquet(options.write_to)
        return docs.sparkSession.read.schema(result.schema).parquet(options.write_to)
    return result
