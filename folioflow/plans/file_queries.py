"""Queries over Office, PDF, Markdown and HTML files that are composed from ``conversations`` and read back by the parsers.

The SQL says from the table what each file's parts must be, so that a parser that loses, reorders or mistakes one shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.render import plain_text
from ..sources.files import blocks_of, extract
from .convert import ConvertOptions, convert
from .fixtures import files
from .registry import query

#: Turns with k, their place i, the number n of turns, and the first turn's role and text.
_T = """t AS (SELECT conv_id AS doc_id, turn, role, text, (turn + conv_id) % 8 AS k, CAST(row_number() OVER w AS INTEGER) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
first_value(role) OVER w AS role0, first_value(text) OVER w AS text0, conv_id AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
_FLAT = "replace(text, chr(10), ' ')"


def _docs(spark, sf, fmt: str) -> DataFrame:
    return extract(files(spark, sf, fmt))


def _blocks(spark, sf, fmt: str) -> DataFrame:
    return blocks_of(_docs(spark, sf, fmt))


def _text():
    return F.coalesce("content", plain_text(F.col("runs"))).alias("text")


def _place(*partition: str):
    from pyspark.sql import Window

    return (F.row_number().over(Window.partitionBy(*partition).orderBy("ord")) - 1).alias("pos")


def _json(path: str):
    return F.get_json_object("payload", f"$.{path}")


_NODES = "struct<layout_kind:string,nodes:array<struct<text:string,level:int>>>"


def _tree(blocks: DataFrame, *keys) -> DataFrame:
    """The nodes of the diagrams in their order."""
    art = F.from_json("payload", _NODES)
    rows = blocks.filter("type = 'smartart'").select(*keys, art["layout_kind"].alias("layout_kind"), F.posexplode(art["nodes"]).alias("pos", "node"))
    return rows.select("*", "node.text", "node.level").drop("node")


# ---- Word ----

_HEAD = "CASE c % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE least(c % 9, 6) END"


@query(f"""WITH {_T} SELECT doc_id, i AS pos, CASE k WHEN 0 THEN 'heading' WHEN 3 THEN 'code' ELSE 'paragraph' END AS type, CASE WHEN k = 4 THEN 'blockquote' END AS inside, CASE WHEN k = 0 THEN {_HEAD} END::INT AS level,
CASE WHEN k = 5 AND c % 2 = 1 THEN 'Caption' END AS style, CASE WHEN k = 7 OR k = 1 AND c % 2 = 0 THEN 'bullet' WHEN k = 1 THEN 'numbered' END AS list_kind, CASE k WHEN 1 THEN c % 3 WHEN 7 THEN 0 END::INT AS list_level,
CASE k WHEN 2 THEN role || text || 'farnear' WHEN 6 THEN text || '[Equation: x=' || turn || '+1]' ELSE text END AS text FROM t""")
def docx_paragraphs(spark, sf):
    b = _blocks(spark, sf, "docx").filter("type in ('heading', 'paragraph', 'code') and coalesce(inside, '') <> 'textbox'")
    return b.select("doc_id", _place("doc_id"), "type", "inside", "level", "style", "list_kind", "list_level", _text())


@query(f"""WITH {_T}, r AS (SELECT doc_id, c, unnest([0, 1, 2, 3]) AS idx, unnest([role, text, 'far', 'near']) AS text FROM t WHERE k = 2)
SELECT doc_id, idx, text, CASE WHEN idx IN (0, 3) THEN TRUE END AS bold, CASE WHEN idx = 1 THEN TRUE END AS italic, CASE WHEN idx = 1 THEN TRUE END AS underline,
CASE idx WHEN 2 THEN 'https://example.org/c/' || c WHEN 3 THEN '#near' END AS hyperlink FROM r""")
def docx_runs(spark, sf):
    b = _blocks(spark, sf, "docx").filter(F.exists("runs", lambda r: r["hyperlink"].isNotNull())).select("doc_id", F.posexplode("runs").alias("idx", "r"))
    return b.select("doc_id", "idx", *[F.col(f"r.{x}").alias(x) for x in ("text", "bold", "italic", "underline", "hyperlink")])


@query(f"""WITH {_T} SELECT doc_id, 0 AS row, unnest([0, 1, 2]) AS col, unnest(['turns', '', CAST(n AS VARCHAR)]) AS value FROM t WHERE i = 0
UNION ALL SELECT doc_id, i + 1, unnest([0, 1, 2]), unnest([CAST(c AS VARCHAR), role, text]) FROM t""")
def docx_tables(spark, sf):
    b = _blocks(spark, sf, "docx").filter("type = 'table'").select("doc_id", F.posexplode("rows").alias("row", "cells"))
    return b.select("doc_id", "row", F.posexplode("cells").alias("col", "value"))


@query(f"""WITH {_T} SELECT doc_id, 'textbox' AS kind, (c + 1) || 'x2' AS value FROM t WHERE i = 0 UNION ALL SELECT doc_id, 'paragraph', text FROM t WHERE i = 0 UNION ALL SELECT doc_id, 'heading', role FROM t WHERE i = 0
UNION ALL SELECT doc_id, 'image', 'img_1 raw_images/img_1.png ' || CASE c % 3 WHEN 0 THEN 'seen ' WHEN 1 THEN 'titled ' ELSE 'named ' END || c || ' ' || (1 + c % 5) || 'x3' FROM t WHERE i = 0
UNION ALL SELECT doc_id, 'warning', 'Image gone: part not found' FROM t WHERE i = 0""")
def docx_drawings(spark, sf):
    docs = _docs(spark, sf, "docx")
    b = blocks_of(docs)
    box = b.filter("type = 'textbox'").select("doc_id", F.col("type").alias("kind"), F.concat_ws("x", F.col("bbox.width").cast("int"), F.col("bbox.height").cast("int")).alias("value"))
    inner = b.filter("inside = 'textbox'").select("doc_id", "type", plain_text(F.col("runs")))
    size = F.concat_ws("x", "image.width_px", "image.height_px")
    image = b.filter("type = 'image'").select("doc_id", "type", F.concat_ws(" ", "image.id", "image.relative_path", "image.alt_text", size))
    said = docs.select("doc_id", F.explode("warnings").alias("value")).select("doc_id", F.lit("warning"), "value")
    return box.union(inner).union(image).union(said)


_NODES_SQL = "SELECT doc_id, 'hierarchy' AS layout_kind, i AS pos, role || ' ' || turn AS text, CASE WHEN i = 0 THEN 0 ELSE 1 END AS level FROM t"


@query(f"WITH {_T} {_NODES_SQL}")
def docx_smartart(spark, sf):
    return _tree(_blocks(spark, sf, "docx"), "doc_id")


@query(f"WITH {_T} {_NODES_SQL}")
def smartart_tree_tables(spark, sf):
    """The same trees by relational plans over the documents' points and edges."""
    from pyspark.sql import Window

    from ..operators.trees import tree_levels

    docs = _docs(spark, sf, "docx")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("x.diagram")).alias("diagram")
    points = docs.select("doc_id", F.explode("points").alias("x")).select(name, "x.node", "x.type", "x.text", "x.pos")
    edges = docs.select("doc_id", F.explode("edges").alias("x")).select(name, "x.parent", "x.child", "x.ord", "x.pos")
    levels = tree_levels(points, edges)
    turn = F.regexp_extract("text", r"(\d+)$", 1).cast("int")
    rows = levels.filter("text <> ''").select(F.substring_index("diagram", "/", 1).cast("long").alias("doc_id"), F.lit("hierarchy").alias("layout_kind"), turn.alias("turn"), "text", "level")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn")) - 1
    return rows.select("doc_id", "layout_kind", place.alias("pos"), "text", "level")


# ---- slides ----

_BR = "replace(text, chr(10), chr(11))"


@query(f"""WITH {_T}, s AS (
SELECT doc_id, i + 1 AS slide, 0 AS pos, 'heading' AS type, 2 AS level, NULL AS list_kind, NULL::INT AS list_level, role || ' ' || turn AS text FROM t
UNION ALL SELECT doc_id, i + 1, 1, 'paragraph', NULL, CASE k WHEN 0 THEN 'bullet' WHEN 1 THEN 'numbered' END, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 END, replace(text, chr(10), '') FROM t
UNION ALL SELECT doc_id, i + 1, 2, 'paragraph', NULL, NULL, NULL, 'left' FROM t UNION ALL SELECT doc_id, i + 1, 3, 'paragraph', NULL, NULL, NULL, 'right' FROM t
UNION ALL SELECT doc_id, i + 1, 4, 'paragraph', NULL, NULL, NULL, 'far' FROM t WHERE k = 2)
SELECT doc_id, slide, pos, type, level, list_kind, list_level, text FROM s""")
def pptx_texts(spark, sf):
    b = _blocks(spark, sf, "pptx").filter("type in ('heading', 'paragraph') and style is null and inside is null")
    return b.select("doc_id", F.col("unit_index").alias("slide"), _place("doc_id", "unit_index"), "type", "level", "list_kind", "list_level", _text())


@query(f"""WITH {_T} SELECT doc_id, i + 1 AS slide, 'notes' AS style, 'Note: ' || {_BR} AS text FROM t WHERE turn % 2 = 1
UNION ALL SELECT doc_id, i + 1, 'comment', CASE c % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'BB' ELSE 'Unknown' END || ': ' || text FROM t WHERE turn % 2 = 0""")
def pptx_notes_comments(spark, sf):
    return _blocks(spark, sf, "pptx").filter("style in ('notes', 'comment')").select("doc_id", F.col("unit_index").alias("slide"), "style", _text())


@query(f"""WITH {_T}, r AS (SELECT doc_id, i + 1 AS slide, unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 0, 1]) AS col, unnest([role, '', CAST(c AS VARCHAR), {_BR}]) AS value FROM t WHERE k = 3)
SELECT *, CASE WHEN row = 1 AND col = 1 THEN 2 WHEN row = 0 AND col = 0 THEN 1 END AS rowspan, CASE WHEN row = 0 AND col = 0 THEN 2 WHEN row = 1 AND col = 1 THEN 1 END AS colspan FROM r""")
def pptx_tables(spark, sf):
    spans = F.from_json("payload", "struct<spans:array<struct<row:int,col:int,rowspan:int,colspan:int>>>")["spans"]
    b = _blocks(spark, sf, "pptx").filter("type = 'table'").select("doc_id", F.col("unit_index").alias("slide"), spans.alias("spans"), F.posexplode("rows").alias("row", "cells"))
    b = b.select("doc_id", "slide", "spans", "row", F.posexplode("cells").alias("col", "value"))
    own = F.get(F.filter("spans", lambda s: (s["row"] == F.col("row")) & (s["col"] == F.col("col"))), F.lit(0))
    return b.select("doc_id", "slide", "row", "col", "value", own["rowspan"].alias("rowspan"), own["colspan"].alias("colspan"))


_CHART = "struct<chart_type:string,title:string,categories:array<string>,series:array<struct<name:string,values:array<string>>>>"
_POINTS = "SELECT doc_id, list(role ORDER BY turn) AS roles, list(CAST(length(text) AS VARCHAR) ORDER BY turn) AS sizes FROM t GROUP BY doc_id"


def _charts(b: DataFrame, *keys):
    c = F.from_json("payload", _CHART)
    rows = b.filter("type = 'chart'").select(*keys, c["chart_type"].alias("chart_type"), c["title"].alias("title"), c["categories"].alias("categories"), F.explode(c["series"]).alias("s"))
    return rows.select("doc_id", *[k for k in rows.columns if k not in ("doc_id", "s")], F.col("s.name").alias("series"), F.col("s.values").alias("sizes"))


@query(f"""WITH {_T}, g AS ({_POINTS}) SELECT doc_id, i + 1 AS slide, CASE WHEN c % 2 = 1 THEN 'bar' ELSE 'pie' END AS chart_type, n || ' turns' AS title, roles AS categories, 'size' AS series, sizes FROM t JOIN g USING (doc_id) WHERE k = 4""")
def pptx_charts(spark, sf):
    return _charts(_blocks(spark, sf, "pptx"), "doc_id", F.col("unit_index").alias("slide"))


@query(f"""WITH {_T}, p AS (SELECT doc_id, i + 1 AS slide, 'img_s' || (i + 1) || '_1' AS id, 'raw_images/img_s' || (i + 1) || '_1.png' AS path, '/tmp/' || c || '.png' AS alt, 2 AS w, CAST(1 + c % 4 AS INTEGER) AS h FROM t WHERE k = 5)
SELECT doc_id, slide, id, path, alt, w, h, 1.0::DOUBLE AS "left", 70.0::DOUBLE AS top, 2.0::DOUBLE AS width, 3.0::DOUBLE AS height FROM p""")
def pptx_pictures(spark, sf):
    b = _blocks(spark, sf, "pptx").filter("type = 'image'")
    return b.select("doc_id", F.col("unit_index").alias("slide"), "image.id", F.col("image.relative_path").alias("path"), F.col("image.alt_text").alias("alt"), F.col("image.width_px").alias("w"), F.col("image.height_px").alias("h"), "bbox.left", "bbox.top", "bbox.width", "bbox.height")


@query(f"""WITH {_T} SELECT doc_id, i + 1 AS slide, 'group' AS inside, unnest(['11', '12']) AS "from", unnest(['12', '11']) AS "to", unnest(['elbow', 'straight']) AS arrow FROM t WHERE k = 6
UNION ALL SELECT doc_id, i + 1, NULL, '2', '3', 'curved' FROM t WHERE k = 6""")
def pptx_connectors(spark, sf):
    b = _blocks(spark, sf, "pptx").filter("type = 'connector'")
    return b.select("doc_id", F.col("unit_index").alias("slide"), "inside", _json("from").alias("from"), _json("to").alias("to"), _json("arrow").alias("arrow"))


@query(f"""WITH {_T} SELECT doc_id, i + 1 AS slide, unnest(['S11["' || role || '"]', 'S12["end"]']) AS "from", unnest(['S12["end"]', 'S11["' || role || '"]']) AS "to" FROM t WHERE k = 6""")
def pptx_flowcharts(spark, sf):
    edges = F.from_json("payload", "struct<hint:string,flow:struct<edges:array<struct<from:string,to:string>>>>")["flow"]["edges"]
    b = _blocks(spark, sf, "pptx").filter("type = 'group'").select("doc_id", F.col("unit_index").alias("slide"), F.explode(edges).alias("e"))
    return b.select("doc_id", "slide", "e.from", "e.to")


@query(f"WITH {_T} SELECT s.doc_id, s.i + 1 AS slide, 'hierarchy' AS layout_kind, t.i AS pos, t.role || ' ' || t.turn AS text, CASE WHEN t.i = 0 THEN 0 ELSE 1 END AS level FROM t s JOIN t ON t.doc_id = s.doc_id WHERE s.k = 7")
def pptx_smartart(spark, sf):
    return _tree(_blocks(spark, sf, "pptx"), "doc_id", F.col("unit_index").alias("slide"))


@query(f"WITH {_T} SELECT doc_id, role || ' ' || turn AS title, CAST(n AS VARCHAR) AS slides FROM t WHERE i = 0")
def pptx_documents(spark, sf):
    return _docs(spark, sf, "pptx").select("doc_id", "title", F.col("meta")["slide_count"].alias("slides"))


@query(f"""WITH {_T}, x AS (SELECT doc_id, i + 1 AS unit_index, CASE WHEN k IN (5, 6) THEN 1 ELSE 0 END AS n_images, CASE k WHEN 3 THEN 1 ELSE 0 END AS n_tables, CASE k WHEN 5 THEN 1 ELSE 0 END AS ir_images, length(text) * 4 AS n_chars,
length(role || ' ' || turn) + length(replace(text, chr(10), '')) + 9 + CASE k WHEN 2 THEN 3 WHEN 6 THEN length(role) + 3 ELSE 0 END
+ CASE WHEN turn % 2 = 1 THEN length('Note: ' || text) ELSE length(CASE c % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'BB' ELSE 'Unknown' END || ': ' || text) END AS ir_chars FROM t)
SELECT doc_id, unit_index, ir_images, CAST(ir_chars AS BIGINT) AS ir_chars, round(100.0 * ir_chars / n_chars, 1) AS coverage_pct,
coalesce(nullif(concat_ws(', ', CASE WHEN ir_chars * 2 < n_chars THEN 'text under-capture' END, CASE WHEN ir_images <> n_images THEN 'img diff' END), ''), 'OK') AS notes FROM x""")
def audit_slides(spark, sf):
    """Counts of every slide against what the source is said to hold: an image too many on slides of k 6, four times the text."""
    from ..operators.reports import audit

    rows = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("k", (F.col("turn") + F.col("conv_id")) % 8)
    raw = rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("unit_index"), F.lit(1).alias("n_headings"), F.col("k").isin(5, 6).cast("int").alias("n_images"), (F.col("k") == 3).cast("int").alias("n_tables"), (F.length("text") * 4).alias("n_chars"))
    done = audit(_blocks(spark, sf, "pptx"), raw, ["doc_id", "unit_index"])
    return done.select("doc_id", "unit_index", F.col("ir_images").cast("int").alias("ir_images"), F.col("ir_chars").cast("long").alias("ir_chars"), "coverage_pct", "notes")


# ---- workbooks ----


@query(f"""WITH {_T}, d AS (SELECT doc_id, c, n, 1 AS row, 1 AS col, 'Talk ' || c AS value, 'string' AS kind, FALSE AS bold FROM t WHERE i = 0
UNION ALL SELECT doc_id, c, n, 3, unnest([1, 2, 3, 4, 5, 6]), unnest(['turn', 'role', 'text', 'half', 'long', 'day']), 'string', TRUE FROM t WHERE i = 0
UNION ALL SELECT doc_id, c, n, i + 4, unnest([1, 2, 3, 4, 5, 6]), unnest([CAST(turn AS VARCHAR), role, text, CAST(length(text) / 2 AS VARCHAR), CASE WHEN length(text) > 500 THEN 'True' ELSE 'False' END, CAST(DATE '2020-01-01' + CAST(c % 365 AS INTEGER) AS VARCHAR)]),
  unnest(['int', 'string', 'string', 'float', 'bool', 'datetime']), FALSE FROM t)
SELECT doc_id, 1 AS sheet, row, col, CASE WHEN kind = 'datetime' THEN left(value, 10) || ' 00:00:00' ELSE value END AS value, kind, bold FROM d""")
def xlsx_cells(spark, sf):
    return _docs(spark, sf, "xlsx").select("doc_id", F.inline("cells"))


@query(f"""WITH {_T} SELECT doc_id, 1 AS sheet, 'Turns' AS name, CAST(n + 5 AS INTEGER) AS max_row, 8 AS max_col FROM t WHERE i = 0 UNION ALL SELECT doc_id, 3, 'Drawn ' || c, 0, 0 FROM t WHERE i = 0""")
def xlsx_sheets(spark, sf):
    return _docs(spark, sf, "xlsx").select("doc_id", F.inline("extents"))


@query(f"""WITH {_T} SELECT doc_id, 1 AS sheet, 1 AS row, unnest(range(1, 7))::INT AS col, 'Talk ' || c AS value FROM t WHERE i = 0 UNION ALL SELECT doc_id, 1, unnest(range(4, n + 6))::INT, 8, NULL FROM t WHERE i = 0""")
def xlsx_merged_cells(spark, sf):
    """Every cell of the merged ranges, by the join of ranges and cells."""
    from ..operators.grids import fill_merged

    merged = _docs(spark, sf, "xlsx").select("doc_id", F.inline("merged"))
    return fill_merged(merged, ["doc_id", "sheet"]).select("doc_id", "sheet", "row", "col", "value")


@query(f"""WITH {_T} SELECT doc_id, 'link' AS kind, unnest(['B4', 'A4', 'G9']) AS ref, unnest(['https://example.org/c/' || c, 'Turns!A1', 'G9']) AS target, unnest([role, CAST(turn AS VARCHAR), NULL]) AS text FROM t WHERE i = 0
UNION ALL SELECT doc_id, 'comment', 'C4', CASE WHEN c % 2 = 1 THEN 'Bo' ELSE 'Ann' END, text FROM t WHERE i = 0""")
def xlsx_links_comments(spark, sf):
    notes = F.from_json("payload", "struct<links:array<struct<ref:string,target:string,display:string>>,comments:array<struct<ref:string,author:string,text:string>>>")
    b = _blocks(spark, sf, "xlsx").filter("type = 'cell_notes'").select("doc_id", notes.alias("x"))
    links = b.select("doc_id", F.lit("link").alias("kind"), F.inline("x.links"))
    return links.toDF("doc_id", "kind", "ref", "target", "text").union(b.select("doc_id", F.lit("comment"), F.inline("x.comments")))


@query(f"""WITH {_T} SELECT doc_id, unnest(['note', 'arrow', 'star', 'line']) AS name, unnest(['textbox', 'arrow', 'other', 'connector']) AS shape_kind, unnest(['rect', 'rightArrow', 'star5', 'line']) AS geom, unnest([replace(text, chr(10), ''), NULL, role, NULL]) AS text,
unnest(['two_cell', 'two_cell', 'two_cell', 'absolute']) AS anchor, unnest(['D2', 'Z2', 'E2', NULL]) AS from_cell, unnest(['D2:F5', 'Z2:AB5', 'E2:G5', NULL]) AS range FROM t WHERE i = 0""")
def xlsx_shapes(spark, sf):
    b = _blocks(spark, sf, "xlsx").filter("type = 'drawing'")
    return b.select("doc_id", _json("name").alias("name"), _json("shape_kind").alias("shape_kind"), _json("geom").alias("geom"), F.col("content").alias("text"), _json("anchor.kind").alias("anchor"), _json("anchor.from_cell").alias("from_cell"), _json("anchor.range").alias("range"))


@query(f"""WITH {_T} SELECT doc_id, 3 AS sheet, 'img_s3_1' AS id, 'seen ' || c AS alt, 'Drawn ' || c AS label, 4 AS w, 2 AS h, 'one_cell' AS anchor, 'AB' || (c + 1) AS from_cell, 3.0::DOUBLE AS width_px, 5.0::DOUBLE AS height_px FROM t WHERE i = 0""")
def xlsx_pictures(spark, sf):
    b = _blocks(spark, sf, "xlsx").filter("type = 'image'")
    size = [_json(k).cast("double").alias(k) for k in ("width_px", "height_px")]
    return b.select("doc_id", F.col("unit_index").alias("sheet"), "image.id", F.col("image.alt_text").alias("alt"), "image.label", F.col("image.width_px").alias("w"), F.col("image.height_px").alias("h"), _json("kind").alias("anchor"), _json("from_cell").alias("from_cell"), *size)


@query(f"""WITH {_T}, g AS ({_POINTS}) SELECT doc_id, 'line' AS chart_type, n || ' turns' AS title, roles AS categories, 'Turns!$B$1' AS series, sizes FROM t JOIN g USING (doc_id) WHERE i = 0""")
def xlsx_charts(spark, sf):
    return _charts(_blocks(spark, sf, "xlsx"), "doc_id")


@query(f"WITH {_T} {_NODES_SQL}")
def xlsx_smartart(spark, sf):
    return _tree(_blocks(spark, sf, "xlsx"), "doc_id")


@query(f"WITH {_T} SELECT doc_id, 'Sheet ''Hidden'': hidden, skipped' AS warning FROM t WHERE i = 0")
def xlsx_hidden_sheets(spark, sf):
    return _docs(spark, sf, "xlsx").select("doc_id", F.explode("warnings").alias("warning")).filter("warning like 'Sheet%'")


# ---- PDF ----


@query(f"""WITH {_T} SELECT doc_id, i + 1 AS page, unnest([0, 1]) AS pos, unnest([role || ' ' || turn, text]) AS text, unnest([20.0::DOUBLE, 10.0::DOUBLE]) AS font_size, unnest([TRUE, FALSE]) AS likely_heading FROM t""")
def pdf_text_blocks(spark, sf):
    b = _blocks(spark, sf, "pdf").filter("type = 'text'")
    return b.select("doc_id", F.col("unit_index").alias("page"), _place("doc_id", "unit_index"), _text(), _json("font_size").cast("double").alias("font_size"), (_json("likely_heading") == "true").alias("likely_heading"))


@query(f"""WITH {_T} SELECT doc_id, i + 1 AS page, ['uri', 'goto', 'goto', 'launch', 'named'][k + 1] AS kind, CASE k WHEN 0 THEN 'https://example.org/c/' || c WHEN 3 THEN 'a.txt' END AS uri, CASE k WHEN 1 THEN 1 WHEN 2 THEN n END::INT AS target_page FROM t WHERE k < 5""")
def pdf_links(spark, sf):
    links = F.from_json("payload", "struct<links:array<struct<kind:string,uri:string,target_page:int>>>")["links"]
    return _blocks(spark, sf, "pdf").filter("type = 'links'").select("doc_id", F.col("unit_index").alias("page"), F.inline(links))


@query(f"""WITH {_T} SELECT doc_id, 'title' AS key, 'Talk ' || c AS value FROM t WHERE i = 0 UNION ALL SELECT doc_id, 'subject', role FROM t WHERE i = 0 UNION ALL SELECT doc_id, 'producer', 'folioflow' FROM t WHERE i = 0
UNION ALL SELECT doc_id, 'page_count', CAST(n AS VARCHAR) FROM t WHERE i = 0
UNION ALL SELECT doc_id, 'is_scanned', CASE WHEN avg(length(role || ' ' || turn) + length(text)) / (612 * 792) * 1000 < 0.5 THEN 'true' ELSE 'false' END FROM t GROUP BY doc_id""")
def pdf_metadata(spark, sf):
    return _docs(spark, sf, "pdf").select("doc_id", F.explode("meta").alias("key", "value")).filter("key <> 'outline'")


@query(f"""WITH {_T}, p AS (SELECT doc_id, i + 1 AS page, unnest(CASE k WHEN 5 THEN ['_1', '_2'] ELSE [''] END) AS occ, k, CAST(1 + c % 5 AS INTEGER) AS w FROM t WHERE k IN (5, 6))
SELECT doc_id, page, 'img_p' || page || '_1' || occ AS id, 'raw_images/img_p' || page || '_1.png' AS path, w, 2 AS h, CASE occ WHEN '_1' THEN 120.0 WHEN '_2' THEN 8.0 ELSE 0.0 END::DOUBLE AS "left",
CASE occ WHEN '_1' THEN 636.0 WHEN '_2' THEN 1012.0 ELSE 1016.0 END::DOUBLE AS top, CASE occ WHEN '_1' THEN 40.0 WHEN '_2' THEN 16.0 ELSE 80.0 END::DOUBLE AS width, CASE occ WHEN '_1' THEN 20.0 WHEN '_2' THEN 32.0 ELSE 40.0 END::DOUBLE AS height FROM p""")
def pdf_images(spark, sf):
    b = _blocks(spark, sf, "pdf").filter("type = 'image'")
    return b.select("doc_id", F.col("unit_index").alias("page"), "image.id", F.col("image.relative_path").alias("path"), F.col("image.width_px").alias("w"), F.col("image.height_px").alias("h"), "bbox.left", "bbox.top", "bbox.width", "bbox.height")


@query(f"""WITH {_T}, o AS (SELECT doc_id, i * 2 AS place, 1 AS level, role || ' ' || turn AS title, i + 1 AS page FROM t UNION ALL SELECT doc_id, 1, 2, 'inner', -1 FROM t WHERE i = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS pos, level, title, page FROM o""")
def pdf_outline(spark, sf):
    rows = _docs(spark, sf, "pdf").select("doc_id", F.posexplode(F.from_json(F.col("meta")["outline"], "array<array<string>>")).alias("pos", "x"))
    return rows.select("doc_id", "pos", F.col("x")[0].cast("int").alias("level"), F.col("x")[1].alias("title"), F.col("x")[2].cast("int").alias("page"))


# ---- Markdown ----


@query(f"""WITH {_T}, b AS (SELECT doc_id, i, unnest(CASE WHEN k IN (1, 6, 7) THEN [0, 1] ELSE [0] END) AS j, k, c, turn, role, text FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos,
CASE WHEN k = 0 THEN 'heading' WHEN k = 3 THEN 'code' WHEN k = 5 THEN 'table' WHEN k = 6 AND j = 0 THEN 'divider' WHEN k = 6 THEN 'raw_html' ELSE 'paragraph' END AS type, CASE WHEN k = 4 THEN 'blockquote' END AS inside,
CASE WHEN k = 0 THEN 1 + c % 6 END::INT AS level, CASE k WHEN 1 THEN 'bullet' WHEN 7 THEN 'numbered' END AS list_kind, CASE WHEN k = 1 THEN j WHEN k = 7 THEN 0 END AS list_level, CASE WHEN k = 3 THEN 'py' END AS language,
CASE WHEN k = 1 AND j = 1 THEN 'inner ' || turn WHEN k = 2 THEN role || ' ' || turn || ' ' || {_FLAT} || ' far' || chr(10) || 'second line' WHEN k = 3 THEN text || chr(10) WHEN k = 5 THEN '' WHEN k = 6 AND j = 0 THEN ''
WHEN k = 6 THEN '<div>' || chr(10) || {_FLAT} || chr(10) || '</div>' || chr(10) WHEN k = 7 AND j = 0 THEN {_FLAT} || ' ' WHEN k = 7 THEN 'last' ELSE {_FLAT} END AS text FROM b""")
def markdown_blocks(spark, sf):
    b = _blocks(spark, sf, "markdown").filter("type not in ('blockquote', 'image')")
    return b.select("doc_id", _place("doc_id"), "type", "inside", "level", "list_kind", "list_level", "language", _text())


@query(f"""WITH {_T}, r AS (SELECT doc_id, c, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS idx, unnest([role, ' ', CAST(turn AS VARCHAR), ' ', {_FLAT}, ' ', 'far', chr(10), 'second line']) AS text FROM t WHERE k = 2)
SELECT doc_id, idx, text, CASE WHEN idx = 0 THEN TRUE END AS bold, CASE WHEN idx = 2 THEN TRUE END AS italic, CASE WHEN idx = 4 THEN TRUE END AS code, CASE WHEN idx = 6 THEN 'https://example.org/c/' || c END AS hyperlink FROM r""")
def markdown_runs(spark, sf):
    b = _blocks(spark, sf, "markdown").filter(F.exists("runs", lambda r: r["hyperlink"].isNotNull())).select("doc_id", F.posexplode("runs").alias("idx", "r"))
    return b.select("doc_id", "idx", *[F.col(f"r.{x}").alias(x) for x in ("text", "bold", "italic", "code", "hyperlink")])


@query(f"""WITH {_T} SELECT doc_id, unnest([0, 0, 1, 1, 2, 2]) AS row, unnest([0, 1, 0, 1, 0, 1]) AS col, unnest(['a', 'b', role, {_FLAT}, CAST(turn AS VARCHAR), '']) AS value FROM t WHERE k = 5""")
def markdown_tables(spark, sf):
    b = _blocks(spark, sf, "markdown").filter("type = 'table'").select("doc_id", F.posexplode("rows").alias("row", "cells"))
    return b.select("doc_id", "row", F.posexplode("cells").alias("col", "value"))


@query(f"""WITH {_T} SELECT doc_id, 'Talk ' || c AS title, CAST(count(*) FILTER (WHERE k = 7) AS BIGINT) AS images, max(CASE WHEN k = 7 THEN 'alt ' || turn END) AS alt, max(CASE WHEN k = 7 THEN 'ok' END) AS fetch_status FROM t GROUP BY doc_id, c""")
def markdown_documents(spark, sf):
    docs = _docs(spark, sf, "markdown")
    image = F.get(F.filter("blocks", lambda b: b["type"] == "image"), F.lit(0))["image"]
    return docs.select("doc_id", "title", F.size("images").cast("long").alias("images"), image["alt_text"].alias("alt"), image["fetch_status"].alias("fetch_status"))


_RENDERED = f"""CASE k WHEN 0 THEN repeat('#', CAST(1 + c % 6 AS INTEGER)) || ' ' || {_FLAT} WHEN 1 THEN '- ' || {_FLAT} || chr(10) || '  - inner ' || turn
WHEN 2 THEN '**' || role || '** *' || turn || '* `' || {_FLAT} || '` [far](https://example.org/c/' || c || ')' || chr(10) || 'second line' WHEN 3 THEN '```py' || chr(10) || text || chr(10) || '```' WHEN 4 THEN '> ' || {_FLAT}
WHEN 5 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || role || ' | ' || {_FLAT} || ' |' || chr(10) || '| ' || turn || ' |  |' WHEN 6 THEN '---' || chr(10) || chr(10) || '<div>' || chr(10) || {_FLAT} || chr(10) || '</div>'
ELSE '1. ' || {_FLAT} || chr(10) || chr(10) || '**[Image - md_section #1]**' || chr(10) || 'alt ' || turn || chr(10) || chr(10) || '1. last' END"""


@query(f"WITH {_T} SELECT doc_id, string_agg({_RENDERED}, chr(10) || chr(10) ORDER BY turn) AS markdown FROM t GROUP BY doc_id")
def rendered_markdown(spark, sf):
    """The whole way from files to Markdown: parsed, cleaned, rendered, packed and joined."""
    return convert(_docs(spark, sf, "markdown"), ConvertOptions(keep_image_markers=True)).select("doc_id", "markdown")


_SLIDE = f"""'## ' || role || ' ' || turn || chr(10) || chr(10) || CASE k WHEN 0 THEN '  - ' WHEN 1 THEN '    1. ' ELSE '' END || replace(text, chr(10), '') || chr(10) || chr(10) || 'left' || chr(10) || chr(10) || 'right' ||
CASE k WHEN 2 THEN chr(10) || chr(10) || '[**far**](https://example.org/c/' || c || ')' WHEN 3 THEN chr(10) || chr(10) || '| ' || role || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c || ' | ' || replace(text, chr(10), chr(11)) || ' |'
WHEN 5 THEN chr(10) || chr(10) || '**[Image - pptx_slide #' || (i + 1) || ']**' || chr(10) || '[Image: caption unavailable]'
WHEN 6 THEN chr(10) || chr(10) || '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || '  S11["' || role || '"] --> S12["end"]' || chr(10) || '  S12["end"] --> S11["' || role || '"]' || chr(10) || '```' || chr(10) || chr(10) || role || chr(10) || chr(10) || 'end' ELSE '' END ||
CASE WHEN turn % 2 = 1 THEN chr(10) || chr(10) || 'Note: ' || replace(text, chr(10), chr(11)) ELSE chr(10) || chr(10) || CASE c % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'BB' ELSE 'Unknown' END || ': ' || {_FLAT} END"""


@query(f"WITH {_T}, s AS (SELECT doc_id, turn, k, {_SLIDE} AS md FROM t) SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY turn) AS markdown FROM s GROUP BY doc_id HAVING count(*) FILTER (WHERE k IN (4, 7)) = 0")
def rendered_slides(spark, sf):
    """Presentations without charts and diagrams, whose texts have queries of their own: the same whole way; the picture's alt text is a path and goes."""
    docs = _docs(spark, sf, "pptx")
    plain = docs.filter(~F.exists("blocks", lambda b: b["type"].isin("chart", "smartart")))
    return convert(plain, ConvertOptions(keep_image_markers=True)).select("doc_id", "markdown")


# ---- HTML ----


@query(f"""WITH {_T}, b AS (SELECT doc_id, i, unnest(CASE WHEN k IN (0, 1) THEN [0, 1] WHEN k IN (4, 6) THEN [0, 1] ELSE [0] END) AS j, k, c, turn, role, text FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos,
CASE WHEN k = 3 THEN 'code' WHEN k = 5 THEN 'table' WHEN k = 4 AND j = 0 THEN 'blockquote' WHEN k = 6 THEN ['divider', 'figure'][j + 1] ELSE 'paragraph' END AS type, CASE k WHEN 1 THEN ['numbered', 'bullet'][j + 1] END AS list_kind, CASE WHEN k = 1 THEN j END AS list_level,
CASE WHEN k = 3 THEN 'sql' END AS language,
CASE WHEN k = 0 AND j = 0 THEN role WHEN k = 1 AND j = 1 THEN 'inner ' || turn WHEN k = 2 THEN role || turn || chr(10) || text || 'far' WHEN k = 5 THEN '' WHEN k IN (4, 6) AND j = 0 THEN '' ELSE text END AS text FROM b""")
def html_more_blocks(spark, sf):
    return _blocks(spark, sf, "html").select("doc_id", _place("doc_id"), "type", "list_kind", "list_level", "language", _text())


@query(f"WITH {_T} SELECT doc_id, role AS term FROM t WHERE k = 0")
def html_definition_terms(spark, sf):
    b = _blocks(spark, sf, "html").filter((F.size("runs") == 1) & F.get("runs", F.lit(0))["bold"])
    return b.select("doc_id", plain_text(F.col("runs")).alias("term"))


@query(f"""WITH {_T} SELECT doc_id, unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 0, 1]) AS col, unnest(['a', 'b', role, text]) AS value FROM t WHERE k = 5""")
def html_tables(spark, sf):
    b = _blocks(spark, sf, "html").filter("type = 'table'").select("doc_id", F.posexplode("rows").alias("row", "cells"))
    return b.select("doc_id", "row", F.posexplode("cells").alias("col", "value"))


@query(f"""WITH {_T} SELECT doc_id, role AS alt, 'skipped' AS fetch_status, 'remote fetch disabled' AS fetch_error, text AS caption FROM t WHERE k = 6""")
def html_figures(spark, sf):
    b = _blocks(spark, sf, "html").filter("type = 'figure'")
    return b.select("doc_id", F.col("image.alt_text").alias("alt"), "image.fetch_status", "image.fetch_error", plain_text(F.col("runs")).alias("caption"))


@query(f"""WITH {_T}, r AS (SELECT doc_id, c, unnest([0, 1, 2, 3, 4]) AS idx, unnest([role, CAST(turn AS VARCHAR), chr(10), text, 'far']) AS text FROM t WHERE k = 2)
SELECT doc_id, idx, text, CASE WHEN idx = 0 THEN TRUE END AS bold, CASE WHEN idx = 1 THEN TRUE END AS italic, CASE WHEN idx = 1 THEN TRUE END AS underline, CASE WHEN idx = 3 THEN TRUE END AS code, CASE WHEN idx = 4 THEN '/c/' || c END AS hyperlink FROM r""")
def html_runs(spark, sf):
    b = _blocks(spark, sf, "html").filter(F.exists("runs", lambda r: r["hyperlink"].isNotNull())).select("doc_id", F.posexplode("runs").alias("idx", "r"))
    return b.select("doc_id", "idx", *[F.col(f"r.{x}").alias(x) for x in ("text", "bold", "italic", "underline", "code", "hyperlink")])


@query(f"WITH {_T} SELECT doc_id, 'Talk ' || c AS title, 'https://example.org/' AS base_url FROM t WHERE i = 0")
def html_documents(spark, sf):
    return _docs(spark, sf, "html").select("doc_id", "title", F.col("meta")["base_url"].alias("base_url"))
