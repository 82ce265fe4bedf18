"""Image references, captions and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stem

#: What stands where neither a caption nor an alt text is known.
NO_CAPTION = "[Image: caption unavailable]"
CONTEXT_CHARS = 500


def first_refs(refs: DataFrame, keys: list[str], image_id: str, order: str) -> DataFrame:
    """The first reference to each image; references without an id go."""
    rows = refs.filter(F.coalesce(F.col(image_id), F.lit("")) != "")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, image_id).orderBy(order))).filter("__n = 1").drop("__n")


def caption_or_fallback(caption: Column, alt: Column) -> Column:
    return F.coalesce(F.when(caption != "", caption), F.when(F.trim(alt) != "", alt), F.lit(NO_CAPTION))


def with_captions(refs: DataFrame, captions: DataFrame, keys: list[str], alt: str = "alt_text") -> DataFrame:
    """References with their caption: the given one, else the alt text, else the placeholder."""
    return refs.join(captions, keys, "left").withColumn("caption", caption_or_fallback(F.col("caption"), F.col(alt)))


def captions_of(captions: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Captions whose image is referred to."""
    return captions.join(refs.select(*keys), keys, "left_semi")


def union_refs(*collected: DataFrame) -> DataFrame:
    """References of several collectors as one table; columns that one lacks are null."""
    out = collected[0]
    for more in collected[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def collect_refs(blocks: DataFrame) -> DataFrame:
    """References of a block table: doc_id, image_id, relative_path, container_kind, container_index, alt_text, label, context_text.

    ``container_index`` of HTML is the block's place in the document; of other formats the image's own. Context is the
    neighbours' text for docx and Markdown, the page's or slide's text for paged formats (column ``unit_text``).
    """
    img = F.col("image")
    name = F.coalesce(F.when(img["id"] != "", img["id"]), stem(img["relative_path"]))
    near = F.trim(F.concat_ws(" ", F.coalesce("before_text", F.lit("")), F.coalesce("after_text", F.lit(""))))
    fmt = F.col("format")
    context = F.when(fmt.isin("docx", "markdown"), near).when(fmt.isin("pptx", "pdf"), F.col("unit_text"))
    return blocks.filter("image is not null").select(
        "doc_id", "ord", name.alias("image_id"), img["relative_path"].alias("relative_path"),
        F.when(fmt == "html", "html_block").when(fmt == "docx", "docx_section").when(fmt == "markdown", "md_section").when(fmt == "pptx", "pptx_slide").when(fmt == "xlsx", "xlsx_sheet").otherwise("pdf_page").alias("container_kind"),
        F.when(fmt == "html", F.col("ord")).when(fmt.isin("docx", "markdown"), F.coalesce(img["container_index"], F.lit(1))).otherwise(F.col("unit_index")).alias("container_index"),
        F.when(F.trim(img["alt_text"]) != "", img["alt_text"]).alias("alt_text"), F.col("image.label").alias("label"), F.when(context != "", F.substring(context, 1, CONTEXT_CHARS)).alias("context_text"),
    )
