"""Blocks to Markdown, as column expressions: one text per block, joined in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .refs import caption_or_fallback

#: List levels are indented by so many spaces.
INDENT = 2


def _wrap(text: Column, mark: str) -> Column:
    return F.regexp_replace(text, r"(?s)\A(\s*)(.*?)(\s*)\z", f"$1{mark}$2{mark}$3")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def run_text(r: Column) -> Column:
    """A run with its marks; line ends within a text become spaces, a run that is one line end breaks the line."""
    flat = F.when(F.trim(r["text"]) == "\n", F.lit("\n")).otherwise(F.regexp_replace(r["text"], r"[ \t\r]*\n[ \t\r\n]*", " "))
    inked = flat.rlike(r"\S")
    text = F.when(inked & F.coalesce(r["code"], F.lit(False)), _wrap(flat, "`")).otherwise(flat)
    text = F.when(inked & F.coalesce(r["italic"], F.lit(False)), _wrap(text, "*")).otherwise(text)
    text = F.when(inked & F.coalesce(r["bold"], F.lit(False)), _wrap(text, "**")).otherwise(text)
    return F.when(inked & r["hyperlink"].isNotNull(), F.concat(F.lit("["), F.trim(text), F.lit("]("), r["hyperlink"], F.lit(")"))).otherwise(text)


def runs_text(runs: Column) -> Column:
    return F.coalesce(_strip(F.array_join(F.transform(runs, run_text), "")), F.lit(""))


def plain_text(runs: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(runs, lambda r: r["text"]), ""), F.lit(""))


def gfm_table(rows: Column) -> Column:
    """The first row is the head; short rows are filled up, bars and line ends in cells escaped."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", "<br>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""))
    lines = F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, 1 << 30), line))
    return F.when(width > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def image_marker(kind: Column, index: Column, label: Column) -> Column:
    quoted = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit(', "'), F.regexp_replace(label, '"', "'"), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit("**[Image - "), kind, F.lit(" #"), index.cast("string"), quoted, F.lit("]**"))


def mermaid(edges: Column) -> Column:
    """A flow chart of (from, to, label) structs."""
    one = lambda e: F.concat(F.lit("  "), e["from"], F.lit(" -->"), F.when(F.coalesce(e["label"], F.lit("")) != "", F.concat(F.lit("|"), e["label"], F.lit("| "))).otherwise(F.lit(" ")), e["to"])
    return F.concat(F.lit("```mermaid\nflowchart LR\n"), F.array_join(F.transform(edges, one), "\n"), F.lit("\n```"))


_CHART = "struct<title:string,chart_type:string,categories:array<string>,series:array<struct<name:string,values:array<string>>>>"
_ART = "struct<layout_kind:string,nodes:array<struct<text:string,level:int>>>"
_FLOW = "struct<edges:array<struct<from:string,to:string,label:string>>>"


def chart_text(payload: Column) -> Column:
    """Title, data table and one sentence on the series."""
    c = F.from_json(payload, _CHART)
    head = F.concat(F.array(F.lit("")), F.transform(c["series"], lambda s: s["name"]))
    body = F.transform(F.coalesce(c["categories"], F.array().cast("array<string>")), lambda k, i: F.concat(F.array(k), F.transform(c["series"], lambda s: F.get(s["values"], i))))
    said = F.concat(F.lit("A "), F.coalesce(c["chart_type"], F.lit("data")), F.lit(" chart of "), F.size(c["series"]).cast("string"), F.lit(" series over "), F.size(c["categories"]).cast("string"), F.lit(" categories."))
    return F.concat(F.lit("**Chart: "), F.coalesce(c["title"], F.lit("untitled")), F.lit("**\n\n"), gfm_table(F.concat(F.array(head), body)), F.lit("\n\n"), said)


def smartart_text(payload: Column) -> Column:
    """Nested bullets; cycles and processes as a flow chart of their texts."""
    a = F.from_json(payload, _ART)
    nodes = F.filter(a["nodes"], lambda n: n["text"] != "")
    bullets = F.array_join(F.transform(nodes, lambda n: F.concat(F.repeat(F.lit(" " * INDENT), n["level"]), F.lit("- "), n["text"])), "\n")
    name = lambda i: F.concat(F.lit("N"), i.cast("string"))
    boxes = F.transform(nodes, lambda n, i: F.concat(F.lit("  "), name(i), F.lit('["'), F.regexp_replace(n["text"], '"', "'"), F.lit('"]')))
    arrows = F.transform(F.slice(nodes, 2, 1 << 30), lambda n, i: F.concat(F.lit("  "), name(i), F.lit(" --> "), name(i + 1)))
    back = F.when((a["layout_kind"] == "cycle") & (F.size(nodes) > 1), F.array(F.concat(F.lit("  "), name(F.size(nodes) - 1), F.lit(" --> N0")))).otherwise(F.array().cast("array<string>"))
    chart = F.concat(F.lit("```mermaid\nflowchart LR\n"), F.array_join(F.concat(boxes, arrows, back), "\n"), F.lit("\n```"))
    return F.when(a["layout_kind"].isin("cycle", "process"), chart).otherwise(bullets)


def block_text(get, caption: Column, kind_of_place: Column, place: Column) -> Column:
    """The Markdown of one block by its type. ``get`` gives a field of it as a Column: of a row or of an array's element.

    ``md_runs`` is the text of its runs, made once beforehand; images stand at ``kind_of_place`` number ``place``.
    """
    kind, runs = get("type"), get("md_runs")
    hashes = F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(get("level"), F.lit(1)), F.lit(1)), F.lit(6)))
    bullet = F.concat(F.repeat(F.lit(" " * INDENT), F.coalesce(get("list_level"), F.lit(0))), F.when(get("list_kind") == "numbered", "1. ").otherwise("- "), runs)
    shown = caption_or_fallback(caption, get("image")["alt_text"])
    image = F.concat(image_marker(kind_of_place, place, get("image")["label"]), F.lit("\n"), shown)
    # The fence is longer than any run of ticks inside.
    fence = F.when(F.contains(get("content"), F.lit("```")), "````").otherwise("```")
    code = F.concat(fence, F.coalesce(get("language"), F.lit("")), F.lit("\n"), F.regexp_replace(F.coalesce(get("content"), F.lit("")), r"\n+\z", ""), F.lit("\n"), fence)
    flow = F.get_json_object(get("payload"), "$.flow")
    text = (
        F.when(kind == "heading", F.concat(hashes, F.lit(" "), F.regexp_replace(runs, r"\s*\n\s*", " ")))
        .when((kind == "paragraph") & get("list_kind").isNotNull(), bullet).when(kind.isin("paragraph", "text"), runs)
        .when(kind == "table", gfm_table(get("rows"))).when(kind == "code", code).when(kind == "divider", F.lit("---")).when(kind == "raw_html", _strip(get("content")))
        .when(kind == "image", image).when(kind == "figure", F.concat_ws("\n\n", image, F.when(runs != "", runs)))
        .when(kind == "chart", chart_text(get("payload"))).when(kind == "smartart", smartart_text(get("payload")))
        .when(kind == "group", F.when(flow.isNotNull(), mermaid(F.from_json(flow, _FLOW)["edges"])).otherwise(F.lit("")))
        .when(kind.isin("blockquote", "textbox", "connector"), F.lit(""))
        .otherwise(F.concat(F.lit("[Unknown block: "), kind, F.lit("]")))
    )
    return F.coalesce(text, F.lit(""))
