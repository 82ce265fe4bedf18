"""Report tables: sizes, coverage, counts, and checks of rendered Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_report(rows: DataFrame, key: str, raw: str, clean: str) -> DataFrame:
    """Bytes before and after cleaning for each key (a null one stays null), and a TOTAL row."""
    out = rows.rollup(key).agg(F.sum(raw).alias("raw_bytes"), F.sum(clean).alias("clean_bytes"), F.grouping(key).alias("is_total"))
    saved = F.when(F.col("raw_bytes") == 0, 0.0).otherwise(F.round(100.0 * (F.col("raw_bytes") - F.col("clean_bytes")) / F.col("raw_bytes"), 1))
    return out.select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col(key)).alias("sample"), "raw_bytes", "clean_bytes", saved.alias("saved_pct"))


def coverage(raw: DataFrame, ir: DataFrame, key: str) -> DataFrame:
    """Characters that reached the blocks against those of the source, with a note."""
    both = raw.join(ir, key, "left").withColumn("ir_chars", F.coalesce("ir_chars", F.lit(0)))
    pct = F.when(F.col("raw_chars") == 0, 0.0).otherwise(F.round(100.0 * F.col("ir_chars") / F.col("raw_chars"), 1))
    note = F.when(F.col("ir_chars") * 2 < F.col("raw_chars"), "text under-capture").otherwise("OK")
    return both.select(key, "ir_chars", "raw_chars", pct.alias("coverage_pct"), note.alias("notes"))


def block_counts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    return blocks.groupBy(key, "unit_index").pivot("type", ["heading", "paragraph", "text", "table", "image", "figure", "code", "chart", "smartart", "connector", "group"]).count().na.fill(0)


def review(blocks: DataFrame, rendered: DataFrame, key: str = "doc_id") -> DataFrame:
    """Checks of ``rendered`` (key, markdown with its markers): as many markers as images, no repeated marker, no skipped heading level."""
    images = blocks.groupBy(key).agg(F.count_if(F.col("image").isNotNull()).alias("n_images"))
    markers = F.regexp_extract_all("markdown", F.lit(r"(?m)^\*\*\[Image - \w+ #\d+(?:, \"[^\"]*\")?\]\*\*"), 0)
    levels = F.transform(F.regexp_extract_all("markdown", F.lit(r"(?m)^(#{1,6}) "), 1), lambda h: F.length(h))
    skips = F.size(F.filter(F.transform(levels, lambda v, i: v - F.coalesce(F.get(levels, i - 1), F.lit(0)) > 1), lambda x: x))
    return rendered.join(images, key, "left").select(
        key, F.coalesce("n_images", F.lit(0)).alias("n_images"), F.size(markers).alias("n_markers"), (F.size(markers) - F.size(F.array_distinct(markers))).alias("repeated_markers"), skips.alias("skipped_levels"),
        (F.size(markers) == F.coalesce("n_images", F.lit(0))).alias("complete"),
    )


def repeated_edges(lines: DataFrame, key: str, unit: str, order: str, text: str, least: int = 2) -> DataFrame:
    """Lines that open or close ``least`` units or more of a document: running heads and feet."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, unit)
    edge = lines.withColumn("lo", F.min(order).over(w)).withColumn("hi", F.max(order).over(w)).filter(f"{order} = lo or {order} = hi")
    return edge.groupBy(key, text).agg(F.countDistinct(unit).alias("n_units")).filter(F.col("n_units") >= least)


def audit(blocks: DataFrame, raw: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Counts of a source (n_headings, n_images, n_tables, n_chars) against its blocks', with what differs.

    ``key`` may be several columns: with ``unit_index`` it is a row for each slide, page or sheet.
    """
    keys = [key] if isinstance(key, str) else list(key)
    text = F.coalesce(F.array_join(F.transform("runs", lambda r: r["text"]), ""), F.lit(""))
    have = blocks.groupBy(*keys).agg(
        F.count_if(F.col("type") == "heading").alias("ir_headings"), F.count_if(F.col("image").isNotNull()).alias("ir_images"), F.count_if(F.col("type") == "table").alias("ir_tables"), F.sum(F.length(text)).alias("ir_chars")
    )
    counted = ["ir_headings", "ir_images", "ir_tables", "ir_chars", "n_headings", "n_images", "n_tables", "n_chars"]
    both = raw.join(have, keys, "left").na.fill(0, counted)
    pct = F.when(F.col("n_chars") == 0, 0.0).otherwise(F.round(100.0 * F.col("ir_chars") / F.col("n_chars"), 1))
    differs = [F.when(F.col("ir_chars") * 2 < F.col("n_chars"), "text under-capture"), F.when(F.col("ir_images") != F.col("n_images"), "img diff"), F.when(F.col("ir_tables") != F.col("n_tables"), "table diff")]
    return both.withColumn("coverage_pct", pct).withColumn("notes", F.coalesce(F.nullif(F.concat_ws(", ", *differs), F.lit("")), F.lit("OK")))


def audit_markdown(report: DataFrame, key: str = "doc_id") -> DataFrame:
    """The audit as the lines of a Markdown table, in order of ``n``: a head of two lines, then one for each key. To be written as it is, in sorted parts."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(key).cast("string"), F.col("coverage_pct").cast("string"), "notes"), F.lit(" |"))
    head = report.sparkSession.createDataFrame([(f"| {key} | coverage % | notes |",), ("| --- | --- | --- |",)], "line string")
    first = head.select(F.lit(None).cast(report.schema[key].dataType).alias("n"), "line").sortWithinPartitions(F.desc("line"))
    return first.unionByName(report.select(F.col(key).alias("n"), line.alias("line")).orderBy("n"))
