"""Order, neighbours and page heuristics as windows and aggregates; every key begins with the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block over so many times the page's median font size is likely a heading; a page under so many characters per 1000 square points is a scan.
HEADING_RATIO, SCAN_DENSITY = 1.15, 0.5
NEIGHBOR_CHARS = 200


def with_order(blocks: DataFrame, keys: list[str], order: list[str], name: str = "order") -> DataFrame:
    return blocks.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def reading_order(boxes: DataFrame, keys: list[str], top: str, left: str, tie: str, name: str = "reading_order") -> DataFrame:
    """Top-down, then left-right; ``tie`` keeps the extraction order of boxes at one place."""
    return with_order(boxes, keys, [top, left, tie], name)


def with_neighbors(blocks: DataFrame, keys: list[str], order: str, text: str = "text", kind: str = "type") -> DataFrame:
    """Text (its start) and kind of the blocks before and after; '' and null at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    cut = lambda c: F.coalesce(F.substring(c, 1, NEIGHBOR_CHARS), F.lit(""))
    return (
        blocks.withColumn("before_text", cut(F.lag(text).over(w))).withColumn("after_text", cut(F.lead(text).over(w)))
        .withColumn("before_kind", F.lag(kind).over(w)).withColumn("after_kind", F.lead(kind).over(w))
    )


def likely_headings(blocks: DataFrame, keys: list[str], size: str, name: str = "likely_heading") -> DataFrame:
    """Whether a block's font size is over 1.15 times its page's median."""
    pages = blocks.groupBy(*keys).agg(F.median(size).alias("__median"))
    return blocks.join(pages, keys).withColumn(name, F.col(size) > HEADING_RATIO * F.col("__median")).drop("__median")


def scanned(pages: DataFrame, key: str, chars: str, area: str) -> DataFrame:
    """Documents whose pages hold on average under 0.5 characters per 1000 square points."""
    density = F.col(chars) / F.greatest(F.lit(1.0), F.col(area)) * 1000
    return pages.groupBy(key).agg(F.avg(density).alias("density")).withColumn("is_scanned", F.col("density") < SCAN_DENSITY)


def flowchart_hint(connectors: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Groups with two connectors or more, all of them with both ends."""
    both = F.col(begin).isNotNull() & F.col(end).isNotNull()
    return connectors.groupBy(key).agg(((F.count("*") >= 2) & F.bool_and(both)).alias("is_flowchart"))


def islands(rows: DataFrame, keys: list[str], order: str, blank: Column, name: str = "cluster") -> DataFrame:
    """Runs of rows between blank ones, numbered from 0; blank rows are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__gap", F.sum(blank.cast("int")).over(w)).filter(~blank)
    return marked.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy("__gap")) - 1).drop("__gap")
