"""Operators of the document model on small frames."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import markdown as M
from folioflow.functions import scalars as S
from folioflow.operators import clean, grids, packing, refs, render, reports, trees
from folioflow.operators.packing import Packer
from folioflow.plans.convert import ConvertOptions, convert, image_refs, prepared_blocks
from folioflow.sources.files import blocks_of, extract, read_files, rejects
from test_parsers import PNG, docx_bytes, pdf_bytes, pptx_bytes, xlsx_bytes


def one(spark, text, f, *more):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"), *more).alias("r")).first()["r"]


def plain_pack(units, cap, images):
    out, cur, t, i = [], [], 0, 0
    for k, (ut, ui) in enumerate(units):
        if cur and (t + ut > cap or i + ui > images):
            out.append((cur, False))
            cur, t, i = [], 0, 0
        if (ut > cap or ui > images) and not cur:
            out.append(([k], True))
            continue
        cur.append(k)
        t, i = t + ut, i + ui
    return out + ([(cur, False)] if cur else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 14), st.integers(0, 3)), max_size=40))
def test_packer_equals_a_plain_fold(units):
    packer = Packer(10, 2)
    got = [packer.add(*u) for u in units]
    want = [(c, big) for c, (members, big) in enumerate(plain_pack(units, 10, 2)) for _ in members]
    assert got == want


def test_pack_units(spark):
    rows = [("a", i, t) for i, t in enumerate([5, 4, 3, 9, 1])] + [("b", 0, 12), ("b", 1, 2), (None, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, tokens int")
    packed = packing.pack_units(df, max_tokens=10)
    got = {(r["doc_id"], r["pos"]): (r["chunk_index"], r["truncated"]) for r in packed.collect()}
    assert [got["a", i][0] for i in range(5)] == [0, 0, 1, 2, 2] and got["b", 0] == (0, True) and got["b", 1] == (1, False) and got[None, 0] == (0, False)
    report = packing.chunk_report(packed, df).filter("doc_id = 'a'").orderBy("chunk_index").collect()
    assert [(r["unit_start"], r["unit_end"], r["n_units"], r["unit_tokens"], r["total_chunks"]) for r in report] == [(0, 1, 2, 9, 3), (2, 2, 1, 3, 3), (3, 4, 2, 10, 3)]


def test_many_units_of_one_key(spark):
    df = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.lit(3).alias("tokens"))
    assert packing.pack_units(df, max_tokens=10).agg(F.max("chunk_index")).first()[0] == 66_666


@pytest.mark.parametrize(
    "f, text, want",
    [
        (M.demote_second_h2, "## A\n\n## B\n", "## A\n\n### B\n"), (M.demote_second_h2, "## A\n```\n## x\n```\n## B", "## A\n```\n## x\n```\n### B"), (M.demote_second_h2, "## A\ntext\n## B\n", "## A\ntext\n## B\n"),
        (M.demote_second_h2, "## A\n# t\n## B\n## C", "## A\n# t\n### B\n## C"), (M.titlecase_h1, "# PDF BOOKMARK OF X\nb\n", "# Pdf Bookmark of X\nb"), (M.titlecase_h1, "# Mixed\n# THE END", "# Mixed\n# The End"),
        (M.keep_one_h1, "# A\n# B\n```\n# c\n```\n# D\n", "# A\n## B\n```\n# c\n```\n## D\n"), (M.keep_one_h1, "", ""),
        (M.dedupe_markers, 'x\n**[Image - a #1]**\nc\n\ny\n**[Image - b #1]**\nd\n**[Image - a #1]**\nc\n\ny\n', 'x\n**[Image - a #1]**\nc\n\ny\n**[Image - b #1]**\nd\n'),
        (M.strip_decorative, '**[Image - p #1]**\nLogo: acme\n\nrest', "rest"), (M.strip_decorative, '**[Image - p #1]**\nred square\n', ""), (M.strip_decorative, '**[Image - p #1]**\nA chart of sales\n\nrest', '**[Image - p #1]**\nA chart of sales\n\nrest'),
        (M.strip_markers, '  \n**[Image - p #1, "L"]**  \ncap\n\n\n\nend\n\n', "cap\n\nend\n"),
    ],
)
def test_markdown_passes(spark, f, text, want):
    assert one(spark, text, f) == want


def test_scan_markers(spark):
    md = '**[Image - pdf_page #1, "Page 1"]**\na\n**[Image - pdf_page #12]**\nb\n**[Image - x #1]**\n'
    assert one(spark, md, M.strip_scan_markers, F.array(F.lit(1))) == '\na\n**[Image - pdf_page #12]**\nb\n**[Image - x #1]**\n'
    assert one(spark, md, M.strip_scan_markers, F.lit(None).cast("array<int>")) == md


def test_postprocess_of_a_frame(spark):
    df = spark.createDataFrame([("# BIG NEWS\n\n## A\n\n## B\n\n**[Image - p #1]**\nLogo: x\n\nend\n",)], "markdown string")
    assert M.postprocess(df).first()[0] == "# Big News\n\n## A\n\n### B\n\nend"


def test_scalars(spark):
    df = spark.createDataFrame([("a/B.XLSM",), ("x.tar.md",), ("noext",), (".md",)], "p string")
    assert [r[0] for r in df.select(S.source_format(S.extension(F.col("p")))).collect()] == ["xlsx", "markdown", None, None]
    got = spark.range(1, 20000).select("id", S.column_letters(F.col("id")).alias("c")).collect()

    def letters(n):
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    assert all(r["c"] == letters(r["id"]) for r in got if r["id"] <= 18278)
    rels = [("../diagrams/data1.xml", "xl/drawings", "xl/diagrams/data1.xml"), ("/xl/a.xml", "q", "xl/a.xml"), ("xl/a.xml", "q", "xl/a.xml"), ("b.xml", "q/", "q/b.xml"), ("../../x", "a", "x")]
    df = spark.createDataFrame(rels, "t string, d string, w string")
    assert all(r[0] == r[1] for r in df.select(S.rel_target(F.col("t"), F.col("d")), "w").collect())
    heads = spark.createDataFrame([("Title",), ("Heading 3",), ("heading9",), ("Body",)], "s string").select(S.heading_level(F.col("s"))).collect()
    assert [r[0] for r in heads] == [1, 3, 6, None]
    assert one(spark, "data:image/png;base64,aGk=", S.data_uri_bytes) == b"hi" and one(spark, "http://x", S.data_uri_bytes) is None
    kinds = spark.createDataFrame([("BarClustered",), ("xyz",)], "s string").select(S.chart_kind(F.col("s")), S.layout_kind(F.lit("my hlist flow"))).collect()
    assert [tuple(r) for r in kinds] == [("bar", "process"), ("other", "process")]


def test_frontmatter(spark):
    df = spark.createDataFrame([('---\na: "x"\n# c: d\n- e: f\na: z: y\n---\nbody',), ("plain",), ("---\n---\nq",)], "t string")
    meta, body = M.frontmatter(F.col("t"))
    assert [tuple(r) for r in df.select(meta, body).collect()][:2] == [({"a": "z: y"}, "body"), (None, "plain")]


def test_sheet_tables(spark):
    docs = extract(spark.createDataFrame([(1, "xlsx", bytearray(xlsx_bytes()))], "doc_id long, format string, content binary"))
    keys = ["doc_id", "sheet"]
    cells, merged, extents = (docs.select("doc_id", F.inline(c)) for c in ("cells", "merged", "extents"))
    tables, labels = grids.sheet_tables(cells, merged, extents, keys)
    t = tables.collect()
    assert len(t) == 1 and t[0]["range"] == "A3:C4" and t[0]["header_row"] == ["a", "b", "c"] and t[0]["rows"] == [["a", "b", "c"], ["1", "2.5", "True"]]
    assert {(r["coordinate"], r["value"], r["kind"]) for r in labels.collect()} == {("A1", "Report", "title"), ("A6", "note", "note")}


def test_tree_levels(spark):
    nodes = [("d", "0", "doc", "", 0), ("d", "1", "node", "Root", 1), ("d", "2", "node", "B", 2), ("d", "3", "asst", "A", 3), ("d", "9", "pres", "", 4), ("e", "x", "node", "X", 0), ("e", "y", "node", "Y", 1)]
    edges = [("d", "0", "1", 0, 0), ("d", "1", "2", 5, 1), ("d", "1", "3", 1, 2), ("d", "3", "1", 0, 3), ("d", "1", "9", 0, 4), ("e", "x", "y", 0, 0), ("e", "y", "y", 0, 1)]
    rows = trees.tree_levels(spark.createDataFrame(nodes, "diagram string, node string, type string, text string, pos int"), spark.createDataFrame(edges, "diagram string, parent string, child string, ord int, pos int")).orderBy("diagram", "path").collect()
    assert [(r["text"], r["level"]) for r in rows] == [("Root", 0), ("A", 1), ("B", 1), ("X", 0), ("Y", 1)]
    assert {r["node"] for r in trees.roots(spark.createDataFrame([("d", "a"), ("d", "b")], "diagram string, node string"), spark.createDataFrame([("d", "a", "b")], "diagram string, parent string, child string")).collect()} == {"a"}


def test_refs_and_captions(spark):
    rows = spark.createDataFrame([(1, "i1", 0, "alt"), (1, "i1", 1, "b"), (1, "", 2, "c"), (1, "i2", 3, " "), (2, "i1", 0, None)], "doc_id long, image_id string, ord int, alt_text string")
    first = refs.first_refs(rows, ["doc_id"], "image_id", "ord")
    captions = spark.createDataFrame([(1, "i1", "cap"), (9, "z", "lost")], "doc_id long, image_id string, caption string")
    got = {(r["doc_id"], r["image_id"]): r["caption"] for r in refs.with_captions(first, captions, ["doc_id", "image_id"]).collect()}
    assert got == {(1, "i1"): "cap", (1, "i2"): refs.NO_CAPTION, (2, "i1"): refs.NO_CAPTION}
    assert refs.captions_of(captions, first, ["doc_id", "image_id"]).count() == 1


def all_formats(spark):
    html = "<title>T</title><h1>Head</h1><p>a<br>b <b>c</b></p><table><tr><td>x|y<td>2</table><figure><img src='data:image/png;base64,aGk=' alt='Pic'><figcaption>cap</figcaption></figure>".encode()
    md = b"---\ntitle: M\n---\n# H\n\n> q *i*\n\n- a\n- b\n\n```py\nx\n```\n"
    rows = [(1, "html", html), (2, "markdown", md), (3, "docx", docx_bytes()), (4, "pptx", pptx_bytes()), (5, "xlsx", xlsx_bytes()), (6, "pdf", pdf_bytes()), (7, "docx", b"broken"), (8, None, b"x"), (9, "html", None)]
    return extract(spark.createDataFrame([(i, f, bytearray(c) if c is not None else None) for i, f, c in rows], "doc_id long, format string, content binary"))


def test_convert_all_formats(spark):
    docs = all_formats(spark)
    got = {r["doc_id"]: r for r in convert(docs).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    assert got[1]["markdown"] == "# Head\n\na\nb **c**\n\n| x\\|y | 2 |\n| --- | --- |\n\nPic\n\ncap" and got[1]["metadata"]["image_count"] == "1"
    assert got[2]["markdown"] == "# H\n\n> q *i*\n\n- a\n- b\n\n```py\nx\n```" and got[2]["title"] == "M"
    assert "# **Head**" in got[3]["markdown"] and "> quoted" in got[3]["markdown"] and "- Root\n  - A\n  - B" in got[3]["markdown"] and "  1. item" in got[3]["markdown"]
    assert "**Chart: Sales**\n\n|  | Y |\n| --- | --- |\n| Q1 | 4 |" in got[4]["markdown"] and 'S1["S"] --> S2["T"]' in got[4]["markdown"]
    assert got[6]["markdown"].startswith("Big (title)") and got[6]["metadata"]["page_count"] == "1" and "producer" not in got[6]["metadata"]
    assert got[7]["markdown"] == "" and "BadZipFile" in got[7]["warnings"][0]


def test_captioner_renderer_and_markers(spark):
    docs = all_formats(spark).filter("doc_id in (1, 3)").cache()
    seen = image_refs(docs).collect()
    assert {(r["doc_id"], r["image_id"], r["container_kind"]) for r in seen} == {(1, "img_0", "html_block"), (3, "img_1", "docx_section")}
    options = ConvertOptions(captioner=lambda r: r.select("doc_id", "image_id", F.concat(F.lit("size "), F.length("content")).alias("caption")), keep_image_markers=True, renderer=lambda c: c.withColumn("markdown", F.concat("markdown", F.lit("\nEND"))))
    got = {r["doc_id"]: r["markdown"] for r in convert(docs, options).collect()}
    assert "**[Image - html_block #3]**\nsize 2" in got[1] and f"**[Image - docx_section #1]**\nsize {len(PNG)}" in got[3] and got[1].endswith("END")
    check = reports.review(blocks_of(docs), spark.createDataFrame(list(got.items()), "doc_id long, markdown string")).collect()
    assert all(r["complete"] and r["repeated_markers"] == 0 for r in check)


def test_chunks_cover_all_blocks(spark):
    md = "\n\n".join(f"# H{i}\n\n" + "word " * 60 for i in range(12))
    docs = extract(spark.createDataFrame([(1, "markdown", md)], "doc_id long, format string, content string"))
    r = convert(docs, ConvertOptions(max_chunk_tokens=400)).first()
    assert int(r["metadata"]["chunk_count"]) > 3 and r["markdown"].count("word") == 720 and r["markdown"].count("\n## H") == 11


def test_cleaning(spark):
    docs = extract(spark.createDataFrame([(1, "markdown", "> > \n\n**a** *b*\n\n![C:\\x\\y.png](z.png)")], "doc_id long, format string, content string"))
    kept = clean.clean_blocks(blocks_of(docs)).orderBy("ord").collect()
    assert [r["type"] for r in kept] == ["paragraph", "image"] and [x["text"] for x in kept[0]["runs"]] == ["a", "b"]
    assert prepared_blocks(docs).filter("type = 'image'").first()["before_text"] == "a b"


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.bin").write_text("?")
    (tmp_path / "c.md").write_text("# t")
    files = read_files(spark, str(tmp_path))
    assert files.count() == 3 and rejects(files).select("reason").first()[0] == "unsupported format: .bin"
    assert {r["format"] for r in extract(files, keep=("path",)).select("format", "path").collect()} == {"html", "markdown"}


def test_reports(spark):
    rows = spark.createDataFrame([("a", 100, 80), ("b", 0, 0)], "s string, r long, c long")
    got = {r["sample"]: r["saved_pct"] for r in reports.size_report(rows, "s", "r", "c").collect()}
    assert got == {"a": 20.0, "b": 0.0, "TOTAL": 20.0}
    lines = spark.createDataFrame([(1, p, n, t) for p in range(3) for n, t in enumerate(["head", f"x{p}", "foot"])], "doc_id long, page int, n int, text string")
    assert {r["text"] for r in reports.repeated_edges(lines, "doc_id", "page", "n", "text").collect()} == {"head", "foot"}
    counts = reports.block_counts(blocks_of(all_formats(spark).filter("doc_id = 2"))).collect()
    assert sum(r["paragraph"] for r in counts) == 3


def test_render_details(spark):
    rnd = random.Random(1)
    table = [[rnd.choice(["a|b", "x\ny", ""]) for _ in range(rnd.randint(1, 3))] for _ in range(3)]
    df = spark.createDataFrame([(table,)], "rows array<array<string>>")
    lines = df.select(render.gfm_table(F.col("rows"))).first()[0].split("\n")
    assert len(lines) == 4 and len({line.replace("\\|", "").count("|") for line in lines}) == 1


def test_local_images_are_joined_by_path(spark):
    from folioflow.sources.files import resolve_source, with_local_images

    paths = [("a/./b/../c.png", "/x/y/"), ("/r/s.png", "/x"), ("../../../up.png", "/x/y"), ("http://h/p/../q.png", "/x"), ("i.png", "file:/d/")]
    got = [r[0] for r in spark.createDataFrame(paths, "p string, b string").select(resolve_source(F.col("p"), F.col("b"))).collect()]
    assert got == ["/x/y/a/c.png", "/r/s.png", "/up.png", "http://h/q.png", "file:/d/i.png"]
    page = "<p>t</p><img src='img/a.png' alt='A'><img src='gone.png'><img src='../d/img/a.png?x=1'>"
    docs = extract(spark.createDataFrame([(1, "/d/p.html", "html", page), (2, "/d/q.md", "markdown", "no image")], "doc_id long, path string, format string, content string"), keep=("path",))
    done = {r["doc_id"]: r for r in with_local_images(docs, spark.createDataFrame([("/d/img/a.png", bytearray(PNG)), ("/d/z.png", bytearray(b"z"))], "path string, content binary")).collect()}
    images = [b["image"] for b in done[1]["blocks"] if b["image"]]
    assert [(i["fetch_status"], i["width_px"], i["height_px"]) for i in images] == [("ok", 2, 3), ("failed", 0, 0), ("ok", 2, 3)]
    assert sorted(i["relative_path"] for i in done[1]["images"]) == ["raw_images/img_0.png", "raw_images/img_2.png"] and done[2]["images"] == []


def test_html_title_equals_its_sql(spark, tmp_path):
    """A row for every page, also null ones, those without a title and those that share an id."""
    duckdb = pytest.importorskip("duckdb")
    from folioflow.plans import catalogue, registry

    inside = ["x", " x ", "\n x \n", "\tx", "x\u00a0", "\u3000x", "x\u2028", "", " ", "\n", "a\nb", "a &lt; b", "a < b", "a<b>c</b> d", "a <!-- c --> d", "<!-- z", "<script>q</script>z", "x</titl>", "a</", "&amp;lt;", "a&&amp", "&copy;&middot;&quot;&gt;", "&copy"]
    pages = [f"<html><head><title>{t}</title></head><body><h1>h</h1></body></html>" for t in inside] + [None, "", " ", "no page", "<p>x</p>", "<title>a</title><title>b</title>", "<svg><title>s</title></svg>"]
    rows = [(i, p) for i, p in enumerate(pages)] + [(0, "<title>again</title>"), (None, "<title>n</title>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.html_title(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(db.execute(registry.ORACLE_SQL["html_title"]).fetchall(), key=repr)


def test_html_title_of_odd_pages(spark, tmp_path):
    """Marked sections and long numbers leave a page its title; bytes are read as texts are; a failure does not look like a page without a title."""
    duckdb = pytest.importorskip("duckdb")
    from folioflow.plans import catalogue, registry
    from folioflow.sources import files, html

    odd = ["<![x[y]]>", "<![>", "<![1>", "<![if-x]>", "<![if x]>", "<![endif]-->", "<![CDATA[y]]>", "&#" + "9" * 5000 + ";", "<a href='&#" + "0" * 5000 + "65;'>"]
    pages = [form.format(x) for x in odd for form in ("{}<title>t</title><p>y", "<title>t</title><p>{}y", "<p>{}y")] + ["<title>\u00e9</title>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.execute(registry.ORACLE_SQL["html_title"]).fetchall())
    assert sorted(map(tuple, catalogue.html_title(spark, str(tmp_path)).collect())) == want
    as_bytes = spark.createDataFrame([(i, p if p is None else bytearray(p.encode())) for i, p in enumerate(pages)], "doc_id long, content binary")
    assert sorted(map(tuple, files.titles(as_bytes).collect())) == want
    no_utf8 = spark.sql("SELECT 1 AS doc_id, CAST(concat(CAST('<title>a' AS BINARY), X'FF', CAST('b</title>' AS BINARY)) AS STRING) AS content")
    assert files.titles(no_utf8).first()["title"] == "a\ufffdb"
    with pytest.MonkeyPatch.context() as m, pytest.raises(RuntimeError, match="page 7"):
        m.setattr(html, "parse_tree", lambda page: 1 / 0)
        files.title_of(7, "<title>t</title>")


LINES = ["# ONE TWO OF", "# Mixed", "## A", "## B", "text here", "", "  indented", "### C", "```", "~~~ x", "**[Image - pdf_page #1]**", '**[Image - pdf_page #2, "P"]**', "**[Image - pptx_slide #1]**", "Logo: x", "brand logo", "a caption", "#x", "\t", "**[Image - bad]**"]


def test_passes_over_texts_equal_those_over_columns(spark):
    """Both forms of every pass on many random texts."""
    from folioflow.functions import passes

    rng = random.Random(7)
    texts = ["", "\n", "x"] + ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 14))) + "\n" * rng.randrange(3) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("strip_decorative", "dedupe_markers", "strip_markers", "demote_second_h2", "keep_one_h1", "titlecase_h1"):
        got = [r[0] for r in df.select(getattr(M, name)(F.col("t"))).collect()]
        for text, column in zip(texts, got):
            assert getattr(passes, name)(text) == column, (name, text)
    for pages in ([], [1], [1, 2]):
        got = [r[0] for r in df.select(M.strip_scan_markers(F.col("t"), F.array(*map(F.lit, pages)).cast("array<int>"))).collect()]
        assert [passes.strip_scan_markers(t, pages) for t in texts] == got
