"""Spreadsheet logic over tables of cells and rows: merged ranges, row figures, clusters, titles, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import column_letters
from .layout import islands


def fill_merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, value) of every cell a merged range covers.

    A range (min_row, max_row, min_col, max_col, value) is spread over its cells, so that cells meet it by equality: no
    inequality join is planned.
    """
    rows = ranges.select(*keys, "value", "min_col", "max_col", F.explode(F.sequence("min_row", "max_row")).alias("row"))
    return rows.select(*keys, "row", F.explode(F.sequence("min_col", "max_col")).alias("col"), "value")


def full_cells(cells: DataFrame, ranges: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of each sheet's used area (max_row, max_col), merged values filled in; bold only where a cell says so itself."""
    area = extents.select(*keys, F.explode(F.sequence(F.lit(1), "max_row")).alias("row"), "max_col").select(*keys, "row", F.explode(F.sequence(F.lit(1), "max_col")).alias("col"))
    merged = fill_merged(ranges, keys).withColumnRenamed("value", "merged")
    return area.join(cells, [*keys, "row", "col"], "left").join(merged, [*keys, "row", "col"], "left").withColumn("value", F.coalesce("merged", "value")).drop("merged")


def row_stats(cells: DataFrame, keys: list[str], row: str = "row", value: str = "value", bold: str | None = "bold") -> DataFrame:
    """Per row: non-empty cells, distinct values, bold cells, blank or not, and whether one value fills the whole row.

    A row's distinct values are gathered as a set, so that its cells are shuffled once and not again for each count.
    """
    v = F.col(value).cast("string")
    bolds = F.count_if(F.col(bold)) if bold else F.lit(0).cast("long")
    figures = cells.groupBy(*keys, row).agg(F.count(F.when(v != "", v)).alias("non_null"), F.collect_set(v).alias("vals"), F.count(v).alias("held"), F.count("*").alias("cells"), bolds.alias("bold_count"))
    distinct = (F.size("vals") - F.array_contains("vals", F.lit("")).cast("int")).cast("long")
    full = (F.col("non_null") > 0) & (F.size("vals") == 1) & (F.col("held") == F.col("cells"))
    return figures.select(*keys, row, "non_null", distinct.alias("distinct_values"), "bold_count", (F.col("non_null") == 0).alias("is_blank"), full.alias("is_title"))


def row_clusters(stats: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    return islands(stats, keys, row, F.col("is_blank"))


def split_titles(clustered: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """Mark the title rows that lead a cluster (is_lead) and number the data rows after them (data_pos, from 0; n_data)."""
    whole = Window.partitionBy(*keys, "cluster")
    first = F.min(F.when(~F.col("is_title"), F.col(row))).over(whole)
    lead = first.isNull() | (F.col(row) < first)
    out = clustered.withColumn("is_lead", lead)
    pos = F.row_number().over(Window.partitionBy(*keys, "cluster", "is_lead").orderBy(row)) - 1
    return out.withColumn("data_pos", F.when(~F.col("is_lead"), pos)).withColumn("n_data", F.count_if(~F.col("is_lead")).over(whole))


def pick_headers(data_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The header's position in each cluster: all-distinct rows of three values or more, else three bold cells, else the first."""
    pos = F.col("data_pos")
    distinct = F.min(F.when(~F.col("is_title") & (F.col("distinct_values") >= 3) & (F.col("distinct_values") == F.col("non_null")), pos))
    bold = F.min(F.when(F.col("bold_count") >= 3, pos))
    return data_rows.filter(pos.isNotNull()).groupBy(*keys, "cluster").agg(F.coalesce(distinct, bold, F.lit(0)).alias("header_pos"))


def sheet_tables(cells: DataFrame, ranges: DataFrame, extents: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tables, labels) of sheets.

    tables: keys, cluster, range, header_row, rows; labels: keys, row, coordinate, value, kind ('title' for leading title
    rows, 'note' for a cluster's only data row).
    """
    full = full_cells(cells, ranges, extents, keys)
    stats = row_stats(full, keys)
    marked = split_titles(row_clusters(stats, keys), keys)
    text = F.col("value").cast("string")
    lists = full.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", text.alias("v")))), lambda c: c["v"]).alias("vals"))
    rows = marked.join(lists, [*keys, "row"])
    first = F.get(F.filter("vals", lambda v: v.isNotNull() & (v != "")), F.lit(0))
    label = F.when(F.col("is_lead"), "title").when(F.col("n_data") == 1, "note")
    labels = rows.withColumn("kind", label).filter("kind is not null").select(*keys, "row", F.concat(F.lit("A"), F.col("row")).alias("coordinate"), first.alias("value"), "kind")
    data = rows.filter("not is_lead and n_data > 1")
    head = pick_headers(data, keys)
    made = data.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(F.struct("data_pos", "vals"))).alias("r"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    made = made.join(head, [*keys, "cluster"]).join(extents.select(*keys, "max_col"), keys)
    titles = F.transform(F.get("r", F.col("header_pos"))["vals"], lambda v: F.coalesce(v, F.lit("")))
    last = F.aggregate(F.transform(titles, lambda v, i: F.when(v != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    header = F.when(last > 0, F.slice(titles, F.lit(1), last))
    place = F.concat(F.lit("A"), F.col("lo"), F.lit(":"), column_letters(F.greatest(F.col("max_col"), F.lit(1))), F.col("hi"))
    tables = made.select(*keys, "cluster", place.alias("range"), header.alias("header_row"), F.transform("r", lambda x: x["vals"]).alias("rows"))
    return tables, labels
