"""The query catalogue: every operator on the driver's tables, with the same result in SQL.

Where a table lacks an operator's own input, a table of like shape stands in, or files composed from one. Texts with Markdown
syntax are composed around whole ``documents`` by SQL expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import scalars as S
from ..operators import clean, grids, layout, packing, polish, refs, render, reports, trees
from ..sources.files import blocks_of, extract, spread, titles
from .convert import ConvertOptions, convert, image_refs
from .fixtures import files
from .registry import query, table

def pages_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("html").alias("format"), F.col("html").alias("content"))
    return extract(spread(pages))


# ---- sources ----

_EXTS = ", ".join(f"('{e}', '{f}')" for e, f in S.EXTENSIONS.items())
_URL_EXT = r"lower(regexp_extract(regexp_replace(regexp_extract(url, '^[^?#]*'), '^[A-Za-z]+://[^/]*', ''), '[^/\\](\.[^./\\]+)$', 1))"


@query(f"SELECT page_id, {_URL_EXT} AS ext, (SELECT max(fmt) FROM (VALUES {_EXTS}) AS e(x, fmt) WHERE x = {_URL_EXT}) AS format FROM pages")
def detect_format_urls(spark, sf):
    ext = S.extension(S.url_path(F.col("url")))
    return table(spark, sf, "pages").select("page_id", ext.alias("ext"), S.source_format(ext).alias("format"))


@query(f"SELECT page_id, 'unsupported format: ' || {_URL_EXT} AS reason FROM pages WHERE {_URL_EXT} NOT IN (SELECT x FROM (VALUES {_EXTS}) AS e(x, fmt))")
def rejects_unsupported(spark, sf):
    known = spark.createDataFrame(list(S.EXTENSIONS.items()), "ext string, fmt string")
    pages = table(spark, sf, "pages").select("page_id", S.extension(S.url_path(F.col("url"))).alias("ext"))
    return pages.join(F.broadcast(known), "ext", "left_anti").select("page_id", F.concat(F.lit("unsupported format: "), F.col("ext")).alias("reason"))


def _sql_unescape(x: str) -> str:
    for a, b in (("&quot;", "\""), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_CLEAN_HTML = "regexp_replace(regexp_replace(html, '(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query(f"SELECT page_id, trim({_sql_unescape('regexp_extract(html, $$(?s)<title>(.*?)</title>$$, 1)')}) AS title FROM pages".replace("$$", "'"))
def html_title(spark, sf):
    found = titles(spread(table(spark, sf, "pages").select("page_id", "html")), key="page_id", content="html")
    return found.select("page_id", F.regexp_replace("title", r"\A\p{Zs}+|\p{Zs}+\z", "").alias("title"))


@query(f"SELECT page_id, CAST(length({_CLEAN_HTML}) AS BIGINT) AS n_chars FROM pages")
def html_strip_noise_len(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", ""), r"(?s)<!--.*?-->", "")
    return table(spark, sf, "pages").select("page_id", F.length(bare).cast("long").alias("n_chars"))


@query(f"SELECT page_id, 1 AS level, {_sql_unescape('unnest(regexp_extract_all(html, $$<h1>(.*?)</h1>$$, 1))')} AS text FROM pages".replace("$$", "'"))
def html_headings(spark, sf):
    b = blocks_of(pages_parsed(spark, sf)).filter("type = 'heading'")
    return b.select(F.col("doc_id").alias("page_id"), "level", render.plain_text(F.col("runs")).alias("text"))


_PARAS = f"""
WITH s AS (SELECT page_id, string_split({_CLEAN_HTML}, '<p>')[2:] AS ps FROM pages),
p AS (SELECT page_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM s),
c AS (SELECT page_id, i, split_part(split_part(split_part(raw, '</p>', 1), '</article>', 1), '</body>', 1) AS body FROM p),
t AS (SELECT page_id, i, {_sql_unescape("regexp_replace(replace(body, '<br>', chr(10)), '<[^>]*>', '', 'g')")} AS text FROM c)
"""


@query(_PARAS + "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, text FROM t WHERE regexp_matches(text, '\\S')")
def html_paragraphs(spark, sf):
    b = blocks_of(pages_parsed(spark, sf)).filter("type = 'paragraph' and list_kind is null")
    return layout.with_order(b, ["doc_id"], ["ord"], "pos").select(F.col("doc_id").alias("page_id"), "pos", render.plain_text(F.col("runs")).alias("text"))


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all({_CLEAN_HTML}, '<li><a href="([^"]*)">', 1) AS h, regexp_extract_all({_CLEAN_HTML}, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
SELECT page_id, unnest(h) AS href, {_sql_unescape('unnest(t)')} AS text FROM l""")
def html_links(spark, sf):
    b = blocks_of(pages_parsed(spark, sf)).select(F.col("doc_id").alias("page_id"), F.explode("runs").alias("r")).filter("r.hyperlink is not null")
    return b.select("page_id", F.col("r.hyperlink").alias("href"), F.col("r.text").alias("text"))


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all({_CLEAN_HTML}, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
SELECT page_id, {_sql_unescape('unnest(t)')} AS text, 'bullet' AS list_kind, 0 AS list_level FROM l""")
def html_list_items(spark, sf):
    b = blocks_of(pages_parsed(spark, sf)).filter("list_kind is not null")
    return b.select(F.col("doc_id").alias("page_id"), render.plain_text(F.col("runs")).alias("text"), "list_kind", "list_level")


@query(f"""SELECT page_id, CAST(len(regexp_extract_all({_CLEAN_HTML}, '<h1>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all({_CLEAN_HTML}, '<li>')) AS BIGINT) AS list_items FROM pages""")
def html_tag_counts(spark, sf):
    b = blocks_of(pages_parsed(spark, sf))
    return b.groupBy(F.col("doc_id").alias("page_id")).agg(F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("list_kind").isNotNull()).alias("list_items"))


@query(_PARAS + """, b AS (SELECT page_id, i, text FROM t WHERE regexp_matches(text, '\\S'))
SELECT page_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, coalesce(left(lag(text) OVER w, 200), '') AS before_text, coalesce(left(lead(text) OVER w, 200), '') AS after_text,
       lag('paragraph') OVER w AS before_kind, lead('paragraph') OVER w AS after_kind FROM b WINDOW w AS (PARTITION BY page_id ORDER BY i)""")
def html_block_neighbors(spark, sf):
    b = blocks_of(pages_parsed(spark, sf)).filter("type = 'paragraph' and list_kind is null").withColumn("text", render.plain_text(F.col("runs")))
    near = layout.with_neighbors(layout.with_order(b, ["doc_id"], ["ord"], "pos"), ["doc_id"], "ord")
    return near.select(F.col("doc_id").alias("page_id"), "pos", "before_text", "after_text", "before_kind", "after_kind")


# ---- tokens and chunks ----


@query("SELECT doc_id, CAST(greatest(1, length(text) // 3) AS BIGINT) AS tokens FROM documents")
def token_count_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


def _pack_sql(units: str, key: str, cap: int, images: int, tail: str) -> str:
    return f"""
WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS n FROM ({units})),
p(k, pos, n, cid, t, i, big) AS (
  SELECT k, pos, n, 0, tk, im, tk > {cap} OR im > {images} FROM u WHERE n = 1
  UNION ALL
  SELECT u.k, u.pos, u.n, p.cid + CASE WHEN p.big OR p.t + u.tk > {cap} OR p.i + u.im > {images} THEN 1 ELSE 0 END,
         CASE WHEN p.big OR p.t + u.tk > {cap} OR p.i + u.im > {images} THEN u.tk ELSE p.t + u.tk END,
         CASE WHEN p.big OR p.t + u.tk > {cap} OR p.i + u.im > {images} THEN u.im ELSE p.i + u.im END, u.tk > {cap} OR u.im > {images}
  FROM p JOIN u ON u.k = p.k AND u.n = p.n + 1),
c AS (SELECT k AS {key}, pos, CAST(cid AS INTEGER) AS chunk_index, big AS truncated FROM p)
{tail}"""


_DOC_UNITS = "SELECT source AS k, doc_id AS pos, greatest(1, length(text) // 3) AS tk, 0 AS im FROM documents"
_TURN_UNITS = "SELECT conv_id AS k, turn AS pos, greatest(1, length(text) // 3) AS tk, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS im FROM conversations"


def _doc_units(spark, sf):
    return table(spark, sf, "documents").select("source", F.col("doc_id").alias("pos"), S.estimate_tokens(F.col("text")).alias("tokens"))


@query(_pack_sql(_DOC_UNITS, "source", 2000, 80, "SELECT * FROM c"))
def chunk_pack_docs(spark, sf):
    return packing.pack_units(_doc_units(spark, sf), key="source", max_tokens=2000)


@query(_pack_sql(_TURN_UNITS, "conv_id", 100000, 2, "SELECT * FROM c"))
def chunk_pack_images(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), S.estimate_tokens(F.col("text")).alias("tokens"), (F.col("role") == "user").cast("int").alias("images"))
    return packing.pack_units(t, key="conv_id", images="images", max_tokens=100000, max_images=2)


@query(_pack_sql(_DOC_UNITS, "source", 500, 80, "SELECT source, CAST(count(*) FILTER (WHERE truncated) AS BIGINT) AS n_truncated, CAST(max(chunk_index) + 1 AS BIGINT) AS total_chunks FROM c GROUP BY source"))
def chunk_truncated(spark, sf):
    packed = packing.pack_units(_doc_units(spark, sf), key="source", max_tokens=500)
    return packed.groupBy("source").agg(F.count_if("truncated").alias("n_truncated"), (F.max("chunk_index") + 1).cast("long").alias("total_chunks"))


@query(_pack_sql(_DOC_UNITS, "source", 2000, 80, """, r AS (SELECT c.*, greatest(1, length(text) // 3) AS tk FROM c JOIN documents d ON d.doc_id = c.pos)
SELECT source, chunk_index, min(pos) AS unit_start, max(pos) AS unit_end, count(*) AS n_units, CAST(sum(tk) AS BIGINT) AS unit_tokens, bool_or(truncated) AS truncated, count(*) OVER (PARTITION BY source) AS total_chunks FROM r GROUP BY source, chunk_index"""))
def chunk_report(spark, sf):
    units = _doc_units(spark, sf)
    return packing.chunk_report(packing.pack_units(units, key="source", max_tokens=2000), units, key="source")


@query("SELECT conv_id, turn, lag(right(text, 1000)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_tail FROM conversations")
def previous_tail(spark, sf):
    return packing.previous_tail(table(spark, sf, "conversations"), key="conv_id", order="turn", text="text").select("conv_id", "turn", "previous_tail")


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS text FROM conversations GROUP BY conv_id")
def join_chunks(spark, sf):
    return packing.join_chunks(table(spark, sf, "conversations"), key="conv_id", order="turn", text="text")


# ---- references and joins ----


@query("SELECT source, doc_id, md5(text) AS image_id FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents WHERE text <> '') WHERE n = 1")
def image_ref_dedup(spark, sf):
    rows = table(spark, sf, "documents").filter("text <> ''").select("source", "doc_id", F.md5("text").alias("image_id"))
    return refs.first_refs(rows, ["source"], "image_id", "doc_id").select("source", "doc_id", "image_id")


@query(f"""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'quality ' || l.quality END, CASE WHEN d.doc_id % 3 = 0 THEN d.lang END, '{refs.NO_CAPTION}') AS caption
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def caption_join_fallback(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("alt_text"))
    captions = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("quality "), F.col("quality"))).alias("caption"))
    return refs.with_captions(rows, captions, ["doc_id"]).select("doc_id", "caption")


@query("SELECT doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'fr')")
def caption_semi_subset(spark, sf):
    return refs.captions_of(table(spark, sf, "labels"), table(spark, sf, "documents").filter("lang = 'fr'"), ["doc_id"]).select("doc_id", "quality")


@query("SELECT conv_id AS doc_id, role || ' ' || turn AS text FROM conversations WHERE turn = 0")
def smartart_roots_anti(spark, sf):
    docs = extract(files(spark, sf, "docx"))
    points = docs.select("doc_id", F.explode("points").alias("x")).select("doc_id", "x.node", "x.type", "x.text").filter("type = 'node'")
    edges = docs.select("doc_id", F.explode("edges").alias("x")).select("doc_id", "x.parent", "x.child").filter("parent <> '0'")
    return trees.roots(points, edges, "doc_id").select("doc_id", "text")


@query("SELECT l_orderkey AS sheet, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, l_returnflag AS value FROM (SELECT l_orderkey, l_returnflag, unnest(range(l_linenumber, l_linenumber + 2)) AS r, c FROM lineitem, (VALUES (1), (2), (3)) AS v(c))")
def merged_fill_range_join(spark, sf):
    n = F.col("l_linenumber").cast("int")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet"), n.alias("min_row"), (n + 1).alias("max_row"), F.lit(1).alias("min_col"), F.lit(3).alias("max_col"), F.col("l_returnflag").alias("value"))
    return grids.fill_merged(rows, ["sheet"]).select("sheet", "row", "col", "value")


@query("""WITH e AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS text FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
t AS (WITH RECURSIVE w(node, text, level) AS (SELECT node, text, 0 FROM e WHERE parent IS NULL UNION ALL SELECT e.node, e.text, w.level + 1 FROM w JOIN e ON e.parent = w.node) SELECT * FROM w)
SELECT node, text, CAST(level AS INTEGER) AS level FROM t""")
def tree_levels(spark, sf):
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    part = lambda df, k, key, up, parent, name: df.select(F.concat(F.lit(k), F.col(key)).alias("node"), (F.concat(F.lit(up), F.col(parent)) if parent else F.lit(None).cast("string")).alias("parent"), F.col(name).alias("text"), F.col(key).cast("int").alias("pos"))
    rows = part(r, "r", "r_regionkey", "", None, "r_name").unionByName(part(n, "n", "n_nationkey", "r", "n_regionkey", "n_name")).unionByName(part(s, "s", "s_suppkey", "n", "s_nationkey", "s_name")).withColumn("diagram", F.lit("d"))
    nodes = rows.select("diagram", "node", F.lit("node").alias("type"), "text", "pos")
    edges = rows.filter("parent is not null").select("diagram", "parent", F.col("node").alias("child"), F.col("pos").alias("ord"), "pos")
    return trees.tree_levels(nodes, edges).select("node", "text", "level")


_HINTS = " ".join(f"WHEN contains(lower(p_type || ' ' || p_name), '{h}') THEN '{k}'" for h, k in S.LAYOUT_HINTS)


@query(f"SELECT p_partkey, CASE {_HINTS} ELSE 'other' END AS layout_kind FROM part")
def layout_kind_first_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.layout_kind(F.concat_ws(" ", "p_type", "p_name")).alias("layout_kind"))


# ---- layout ----


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 10), floor(l_extendedprice / 1000), l_linenumber, l_partkey) - 1 AS INTEGER) AS reading_order FROM lineitem")
def reading_order(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("top", F.floor(F.col("l_quantity") / 10)).withColumn("left", F.floor(F.col("l_extendedprice") / 1000)).withColumn("tie", F.struct("l_linenumber", "l_partkey"))
    return layout.reading_order(rows, ["l_orderkey"], "top", "left", "tie").select("l_orderkey", "l_linenumber", "reading_order")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'N' AS blank FROM lineitem),
g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS gap FROM r)
SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY gap) - 1 AS INTEGER) AS cluster FROM g WHERE NOT blank""")
def blank_row_clusters(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey"))
    return layout.islands(rows, ["l_orderkey"], "o", F.col("l_returnflag") == "N").select("l_orderkey", "l_linenumber", "cluster")


_ROW_CELLS = """cells AS (SELECT l_orderkey, row, unnest([l_returnflag, l_linestatus, nullif(CAST(l_linenumber % 4 AS VARCHAR), '0')]) AS v, unnest([l_quantity > 25, l_discount > 0.03, l_tax > 0.02]) AS bold
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row FROM lineitem))"""
_ROW_STATS = f"""{_ROW_CELLS},
st AS (SELECT l_orderkey, row, count(nullif(v, '')) AS non_null, count(DISTINCT nullif(v, '')) AS distinct_values, count(*) FILTER (WHERE bold) AS bold_count, count(nullif(v, '')) = 0 AS is_blank,
count(nullif(v, '')) > 0 AND count(DISTINCT v) = 1 AND bool_and(v IS NOT NULL) AS is_title FROM cells GROUP BY l_orderkey, row)"""


def _row_stats(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").withColumn("row", F.row_number().over(w))
    mod = (F.col("l_linenumber") % 4).cast("string")
    cell = lambda v, b: F.struct(v.alias("value"), b.alias("bold"))
    cells = F.array(cell(F.col("l_returnflag"), F.col("l_quantity") > 25), cell(F.col("l_linestatus"), F.col("l_discount") > 0.03), cell(F.when(mod != "0", mod), F.col("l_tax") > 0.02))
    return grids.row_stats(rows.select("l_orderkey", "row", F.inline(cells)), ["l_orderkey"])


@query(f"WITH {_ROW_STATS} SELECT l_orderkey, CAST(row AS INTEGER) AS row, non_null, distinct_values, bold_count, is_blank, is_title FROM st")
def row_stats(spark, sf):
    return _row_stats(spark, sf)


@query(f"""WITH {_ROW_STATS}, d AS (SELECT *, min(CASE WHEN NOT is_title THEN row END) OVER (PARTITION BY l_orderkey) AS f FROM st WHERE NOT is_blank),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY row) - 1 AS pos FROM d WHERE f IS NOT NULL AND row >= f)
SELECT l_orderkey, CAST(coalesce(min(CASE WHEN NOT is_title AND distinct_values >= 3 AND distinct_values = non_null THEN pos END), min(CASE WHEN bold_count >= 3 THEN pos END), 0) AS INTEGER) AS header_pos FROM p GROUP BY l_orderkey""")
def header_row_pick(spark, sf):
    marked = grids.split_titles(grids.row_clusters(_row_stats(spark, sf), ["l_orderkey"]), ["l_orderkey"])
    return grids.pick_headers(marked, ["l_orderkey"]).select("l_orderkey", "header_pos")


@query("SELECT source, avg(length(text) / greatest(1.0, n_chars * 50) * 1000) < 0.5 AS is_scanned FROM documents GROUP BY source")
def scanned_docs(spark, sf):
    rows = table(spark, sf, "documents").select("source", F.length("text").alias("chars"), (F.col("n_chars") * 50).alias("area"))
    return layout.scanned(rows, "source", "chars", "area").select("source", "is_scanned")


@query("""WITH m AS (SELECT l_orderkey AS k, median(l_quantity) AS med FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_quantity > 1.15 * med AS likely_heading FROM lineitem JOIN m ON k = l_orderkey""")
def likely_heading(spark, sf):
    return layout.likely_headings(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "likely_heading")


@query("SELECT l_orderkey, count(*) >= 2 AND bool_and(nullif(l_returnflag, 'N') IS NOT NULL AND nullif(l_linestatus, 'O') IS NOT NULL) AS is_flowchart FROM lineitem GROUP BY l_orderkey")
def flowchart_hint(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("from"), F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("to"))
    return layout.flowchart_hint(rows, "l_orderkey", "from", "to")


# ---- cleaning ----


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS kept, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS INTEGER) AS n FROM documents")
def drop_empties_runs(spark, sf):
    parts = F.split("text", "\n")
    blank = F.lit(None).cast("boolean")
    runs = F.transform(parts, lambda t: F.struct(t.alias("text"), blank.alias("bold"), blank.alias("italic"), blank.alias("underline"), blank.alias("code"), F.lit(None).cast("string").alias("hyperlink")))
    kept = F.transform(F.coalesce(clean.clean_runs(runs), F.slice(runs, 1, 0)), lambda r: r["text"])
    return table(spark, sf, "documents").select("doc_id", kept.alias("kept"), F.size(kept).alias("n"))


_PATHS = "CASE p_size % 4 WHEN 0 THEN 'C:\\img\\' || p_name || '.PNG' WHEN 1 THEN '/home/' || p_name || '.jpeg' WHEN 2 THEN p_name || '.png' ELSE '\\\\srv\\' || p_name || '.txt' END"


@query(f"SELECT p_partkey, regexp_matches({_PATHS}, '{S.PATH_LEAK}') AS leak FROM part")
def path_leak_alt(spark, sf):
    n, size = F.col("p_name"), F.col("p_size") % 4
    path = F.when(size == 0, F.concat(F.lit("C:\\img\\"), n, F.lit(".PNG"))).when(size == 1, F.concat(F.lit("/home/"), n, F.lit(".jpeg"))).when(size == 2, F.concat(n, F.lit(".png"))).otherwise(F.concat(F.lit("\\\\srv\\"), n, F.lit(".txt")))
    return table(spark, sf, "part").select("p_partkey", S.is_path_leak(path).alias("leak"))


@query("""SELECT doc_id, unnest(['title', 'lang', 'source']) AS key, unnest(['Text ' || doc_id, lang, source]) AS value FROM documents""")
def frontmatter_kv(spark, sf):
    text = F.expr("""'---\n# note\ntitle: "Text ' || doc_id || '"\nlang:  ' || lang || ' \n- item\nsource: \\'' || source || '\\'\n---\nBody'""")
    meta, _ = M.frontmatter(text)
    return table(spark, sf, "documents").select("doc_id", F.explode(meta).alias("key", "value"))


@query("SELECT doc_id, text FROM documents WHERE text <> ''")
def data_uri_decode(spark, sf):
    src = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    return table(spark, sf, "documents").filter("text <> ''").select("doc_id", F.decode(S.data_uri_bytes(src), "UTF-8").alias("text"))


# ---- Markdown passes ----

# Composed alike in both engines: whole texts with markers, headings and captions before, between and after them.
_FLAT = "replace(text, chr(10), ' ')"
_MARKED = f"""'intro ' || text || chr(10) || '**[Image - pdf_page #' || (doc_id % 3) || ', "Page"]**' || chr(10) || {_FLAT} || chr(10) || chr(10) || chr(10) || 'mid ' || text || chr(10) ||
'**[Image - pptx_slide #1]**' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Logo: ' ELSE 'cap ' END || {_FLAT} || chr(10) || chr(10) || 'tail' || chr(10) || '**[Image - pptx_slide #1]**' || chr(10) ||
CASE WHEN doc_id % 2 = 0 THEN 'x ' ELSE 'cap ' END || {_FLAT} || chr(10) || chr(10) || 'tail'"""


def _marked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_MARKED).alias("md"))


_COLLAPSE = "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, trim({_COLLAPSE.format('''regexp_replace(md, '(?m)^\\*\\*\\[Image - \\w+ #\\d+(?:, \"[^\"]*\")?\\]\\*\\*[ \\t]*\\n?', '', 'g')''')}, ' ' || chr(10)) || chr(10) AS md FROM (SELECT doc_id, {_MARKED} AS md FROM documents)")
def strip_image_markers(spark, sf):
    return _marked(spark, sf).select("doc_id", M.strip_markers(F.col("md")).alias("md"))


@query(f"SELECT doc_id, {_COLLAPSE.format('md')} AS md FROM (SELECT doc_id, {_MARKED} AS md FROM documents)")
def collapse_blank_runs(spark, sf):
    return _marked(spark, sf).select("doc_id", M.collapse_blank_lines(F.col("md")).alias("md"))


@query(f"""SELECT doc_id, {_COLLAPSE.format('''regexp_replace(md, '(?m)^\\*\\*\\[Image - pdf_page #(?:1|2)(?:, "[^"]*")?\\]\\*\\*\\s*$', '', 'g')''')} AS md FROM (SELECT doc_id, {_MARKED} AS md FROM documents)""")
def scan_marker_strip(spark, sf):
    return _marked(spark, sf).select("doc_id", M.strip_scan_markers(F.col("md"), F.array(F.lit(1), F.lit(2))).alias("md"))


_PIECES = f"""p AS (SELECT doc_id, md, string_split(md, '**[Image - ') AS s FROM (SELECT doc_id, {_MARKED} AS md FROM documents)),
b AS (SELECT doc_id, CASE WHEN i = 1 THEN x ELSE '**[Image - ' || x END AS blk, i FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM p))"""


@query(f"""WITH {_PIECES}, c AS (SELECT *, CASE WHEN i > 1 THEN substr(blk, position(chr(10) IN blk) + 1) END AS body FROM b),
d AS (SELECT *, position(chr(10) || chr(10) IN body) AS e FROM c)
SELECT doc_id, {_COLLAPSE.format("string_agg(CASE WHEN i > 1 AND starts_with(body, 'Logo: ') THEN substr(body, e + 2) ELSE blk END, '' ORDER BY i)")} AS md FROM d GROUP BY doc_id""")
def decorative_strip(spark, sf):
    return _marked(spark, sf).select("doc_id", M.strip_decorative(F.col("md")).alias("md"))


@query(f"""WITH {_PIECES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN i > 1 THEN trim(blk, ' ' || chr(10)) ELSE '' END ORDER BY i) AS n FROM b)
SELECT doc_id, string_agg(blk, '' ORDER BY i) AS md FROM n WHERE i = 1 OR n = 1 GROUP BY doc_id""")
def dedupe_markers(spark, sf):
    return _marked(spark, sf).select("doc_id", M.dedupe_markers(F.col("md")).alias("md"))


_HEADED = f"""'# ' || CASE WHEN doc_id % 2 = 0 THEN 'THE ART OF X' || (doc_id % 10) || ' AND MORE' ELSE 'Mixed Case' END || chr(10) || chr(10) || '## ' || {_FLAT} || chr(10) || chr(10) ||
CASE WHEN doc_id % 3 = 0 THEN '' ELSE text || chr(10) END || '## ' || {_FLAT} || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || text || chr(10) || '```' || chr(10) || '# Second' || chr(10) || text || chr(10) || '# Third' || chr(10) || 'end' || chr(10)"""


def _headed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_HEADED).alias("md"))


_LINES = f"""l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(rtrim(md, chr(10)), chr(10)) AS s FROM (SELECT doc_id, {_HEADED} AS md FROM documents))),
f AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 OR starts_with(line, '```') AS fenced FROM l)"""


@query(f"""WITH {_LINES}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, NOT fenced AND starts_with(line, '# ') ORDER BY i) AS n FROM f)
SELECT doc_id, string_agg(CASE WHEN NOT fenced AND starts_with(line, '# ') AND n > 1 THEN '#' || line ELSE line END, chr(10) ORDER BY i) || chr(10) AS md FROM h GROUP BY doc_id""")
def collapse_h1(spark, sf):
    return _headed(spark, sf).select("doc_id", M.keep_one_h1(F.col("md")).alias("md"))


@query(f"""WITH {_LINES}, k AS (SELECT *, NOT fenced AND starts_with(line, '## ') AS h2, NOT fenced AND regexp_matches(line, '\\S') AND NOT regexp_matches(line, '^\\s*#') AS content FROM f),
g AS (SELECT *, sum(content::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, h2 ORDER BY i) AS n FROM g)
SELECT doc_id, string_agg(CASE WHEN h2 AND n % 2 = 0 THEN '#' || line ELSE line END, chr(10) ORDER BY i) || chr(10) AS md FROM m GROUP BY doc_id""")
def demote_h2(spark, sf):
    return _headed(spark, sf).select("doc_id", M.demote_second_h2(F.col("md")).alias("md"))


@query(f"""WITH {_LINES} SELECT doc_id, string_agg(CASE WHEN i = 1 AND doc_id % 2 = 0 THEN '# The Art of X' || (doc_id % 10) || ' and More' ELSE line END, chr(10) ORDER BY i) AS md FROM f GROUP BY doc_id""")
def titlecase_h1(spark, sf):
    return _headed(spark, sf).select("doc_id", M.titlecase_h1(F.col("md")).alias("md"))


# ---- geometry, reports ----


@query("SELECT p_partkey, CAST(p_partkey * 4 AS DOUBLE) / 10 AS px, CASE WHEN n <= 26 THEN chr(64 + n) ELSE chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) END AS col FROM (SELECT p_partkey, CAST(p_size AS INTEGER) AS n FROM part)")
def emu_px_round(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.emu_to_px(F.col("p_partkey") * 3810).alias("px"), S.column_letters(F.col("p_size")).alias("col"))


@query("""SELECT coalesce(source, 'TOTAL') AS sample, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, CAST(sum(strlen(replace(text, chr(10), ''))) AS BIGINT) AS clean_bytes,
round(100.0 * (sum(strlen(text)) - sum(strlen(replace(text, chr(10), '')))) / sum(strlen(text)), 1) AS saved_pct FROM documents GROUP BY ROLLUP(source)""")
def size_report_rollup(spark, sf):
    rows = table(spark, sf, "documents").select("source", F.octet_length("text").alias("raw"), F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))).alias("clean"))
    return reports.size_report(rows, "source", "raw", "clean")


@query(_PARAS + f""", ir AS (SELECT page_id, sum(length(text)) AS c FROM t WHERE regexp_matches(text, '\\S') GROUP BY page_id),
raw AS (SELECT page_id, length({_sql_unescape("regexp_replace(" + _CLEAN_HTML + ", '<[^>]*>', '', 'g')")}) AS r FROM pages)
SELECT page_id, CAST(coalesce(c, 0) AS BIGINT) AS ir_chars, CAST(r AS BIGINT) AS raw_chars, round(CASE WHEN r = 0 THEN 0 ELSE 100.0 * coalesce(c, 0) / r END, 1) AS coverage_pct, CASE WHEN coalesce(c, 0) * 2 < r THEN 'text under-capture' ELSE 'OK' END AS notes FROM raw LEFT JOIN ir USING (page_id)""")
def coverage_audit(spark, sf):
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", ""), r"(?s)<!--.*?-->", ""), "<[^>]*>", "")
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    raw = table(spark, sf, "pages").select("page_id", F.length(bare).cast("long").alias("raw_chars"))
    b = blocks_of(pages_parsed(spark, sf)).filter("type = 'paragraph' and list_kind is null")
    ir = b.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(F.length(render.plain_text(F.col("runs")))).cast("long").alias("ir_chars"))
    return reports.coverage(raw, ir, "page_id")


@query("SELECT conv_id AS doc_id, CAST(count(*) AS VARCHAR) AS chunk_count, CAST(count(*) FILTER (WHERE (turn + conv_id) % 8 = 5) AS VARCHAR) AS image_count FROM conversations GROUP BY conv_id")
def convert_metadata(spark, sf):
    """Every slide is a chunk of its own under a cap of one token."""
    done = convert(extract(files(spark, sf, "pptx")), ConvertOptions(max_chunk_tokens=1))
    return done.select("doc_id", F.col("metadata")["chunk_count"].alias("chunk_count"), F.col("metadata")["image_count"].alias("image_count"))


@query("SELECT doc_id AS ref, lang AS label, 'doc' AS kind FROM documents UNION ALL SELECT page_id, NULL, 'page' FROM pages")
def union_refs(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("ref"), F.col("lang").alias("label"), F.lit("doc").alias("kind"))
    return refs.union_refs(a, table(spark, sf, "pages").select(F.col("page_id").alias("ref"), F.lit("page").alias("kind")))


@query("""WITH e AS (SELECT lang, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT lang, doc_id, l[1] AS line FROM e UNION SELECT lang, doc_id, l[-1] FROM e)
SELECT lang, line, count(DISTINCT doc_id) AS n_units FROM x GROUP BY lang, line HAVING count(DISTINCT doc_id) >= 2""")
def repeated_edges(spark, sf):
    """First and last lines that several documents of a language share."""
    rows = table(spark, sf, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return reports.repeated_edges(rows, "lang", "doc_id", "n", "line")


_TITLED = "CASE WHEN doc_id % 4 = 0 THEN '# Own' || chr(10) ELSE '' END || text"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(md, '^\\s*# ') OR trim(coalesce(source, '')) = '' THEN md ELSE '# ' || trim(source) || chr(10) || chr(10) || md END AS md FROM (SELECT doc_id, source, {_TITLED} AS md FROM documents)")
def title_added(spark, sf):
    return table(spark, sf, "documents").select("doc_id", polish.with_title(F.expr(_TITLED), F.col("source")).alias("md"))


@query("SELECT doc_id, 'This is an open base, a data tool. ' || text || ' The engine, ' || text || ' works' AS md FROM documents")
def fluff_removed(spark, sf):
    text = F.expr("'This is a robust, innovative open base, a powerful data tool. ' || text || ' The seamless engine, ' || text || ' rich works'")
    return table(spark, sf, "documents").select("doc_id", polish.without_fluff(text).alias("md"))


_BARE = "regexp_replace(trim({}), '[0-9]+', '0', 'g')"


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, regexp_replace(array_to_string(list_filter(l, lambda x: trim(x) = '' OR {_BARE.format('x')} <> {_BARE.format('l[1]')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS md FROM d""")
def edge_lines_removed(spark, sf):
    """Every document without the lines that equal its first one, numbers aside."""
    return table(spark, sf, "documents").select("doc_id", polish.without_lines(F.col("text"), F.slice(F.split("text", "\n"), 1, 1)).alias("md"))


@query("""WITH t AS (SELECT conv_id AS doc_id, (turn + conv_id) % 8 AS k FROM conversations)
SELECT doc_id, CAST(count(*) FILTER (WHERE k = 7) AS BIGINT) AS n_images, CAST(count(*) FILTER (WHERE k = 7) AS INTEGER) AS n_markers, 0 AS repeated_markers, CAST(count(*) FILTER (WHERE k = 0 AND doc_id % 6 > 0) AS INTEGER) AS skipped_levels, TRUE AS complete FROM t GROUP BY doc_id""")
def review_markdown(spark, sf):
    docs = extract(files(spark, sf, "markdown"))
    return reports.review(blocks_of(docs), convert(docs, ConvertOptions(keep_image_markers=True)))


@query("""SELECT conv_id AS doc_id, 'img_0' AS image_id, 'md_section' AS container_kind, 1 AS container_index, 'alt ' || turn AS alt_text, left(trim(left(replace(text, chr(10), ' ') || ' ', 200) || ' last'), 500) AS context_text
FROM conversations WHERE (turn + conv_id) % 8 = 7""")
def image_references(spark, sf):
    refs_ = image_refs(extract(files(spark, sf, "markdown")))
    return refs_.select("doc_id", "image_id", "container_kind", "container_index", "alt_text", "context_text")


@query("""SELECT conv_id AS doc_id, 'img_1' AS image_id, CASE WHEN conv_id % 2 = 0 THEN 'picture of ' || octets ELSE '' END AS said FROM (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'seen ' WHEN 1 THEN 'titled ' ELSE 'named ' END || conv_id AS octets FROM conversations)""")
def captions_in_markdown(spark, sf):
    """What stands under the image's marker in the whole conversion: the caption that a captioner gave, else the alt text."""
    docs = extract(files(spark, sf, "docx"))
    captioner = lambda refs_: refs_.filter("doc_id % 2 = 0 and content is not null").select("doc_id", "image_id", F.concat(F.lit("picture of "), F.col("alt_text")).alias("caption"))
    done = convert(docs, ConvertOptions(captioner=captioner, keep_image_markers=True))
    said = F.regexp_extract("markdown", r"(?m)^\*\*\[Image - docx_section #1\]\*\*\n(picture of .*)$", 1)
    return done.select("doc_id", F.lit("img_1").alias("image_id"), said.alias("said"))


@query()
def convert_pages_markdown(spark, sf):
    return convert(pages_parsed(spark, sf)).select(F.col("doc_id").alias("page_id"), "title", "markdown")


@query()
def convert_documents_markdown(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit("markdown").alias("format"), F.col("text").alias("content"))
    return convert(extract(spread(docs))).select("doc_id", "markdown")
