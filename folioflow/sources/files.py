"""Readers: files and tables of documents, parsed into one row per document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import extension, source_format
from .model import DOCUMENT, LOCAL, Parsed, image_size

#: Documents parsed before their rows leave a worker.
ROWS = 32


def read_files(spark: SparkSession, paths: str | list[str], *, max_bytes: int | None = None) -> DataFrame:
    """Files as (doc_id, path, ext, format, length, content); doc_id is a hash of the path. Unknown formats have a null format.

    Filters on path and length reach the reader, so a file that is not wanted is never opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    raw = raw.filter(F.col("length") <= max_bytes) if max_bytes else raw
    ext = extension(F.col("path"))
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", ext.alias("ext"), source_format(ext).alias("format"), "length", "content")


def rejects(files: DataFrame) -> DataFrame:
    """Files of a format that nothing reads, with the reason."""
    return files.filter("format is null").select("doc_id", "path", F.concat(F.lit("unsupported format: "), F.col("ext")).alias("reason"))


def colliding_ids(files: DataFrame) -> DataFrame:
    """doc_ids that stand for several paths: hashes of 64 bits collide from some 10^9 files on. Empty for most collections."""
    return files.groupBy("doc_id").agg(F.count_distinct("path").alias("paths")).filter("paths > 1")


def _parser(fmt: str):
    if fmt == "html":
        from .html import parse_html as f
    elif fmt == "markdown":
        from .markdown import parse_markdown as f
    elif fmt == "docx":
        from .docx import parse_docx as f
    elif fmt == "pptx":
        from .pptx import parse_pptx as f
    elif fmt == "xlsx":
        from .xlsx import parse_xlsx as f
    elif fmt == "pdf":
        from .pdf import parse_pdf as f
    else:
        return None
    return f


def parse_one(fmt: str, content) -> Parsed:
    """One document; what a parser cannot read becomes a warning and no blocks."""
    try:
        return _parser(fmt)(content)
    except Exception as e:  # a broken file must not end the job that reads a million of them
        out = Parsed(fmt)
        out.warnings.append(f"{type(e).__name__}: {e}"[:500])
        return out


def _fill(schema: pa.DataType, value):
    """Values for a struct type: missing fields are null."""
    if value is None:
        return None
    if pa.types.is_struct(schema):
        return {f.name: _fill(f.type, value.get(f.name)) for f in schema}
    if pa.types.is_list(schema):
        return [_fill(schema.value_type, v) for v in value]
    if pa.types.is_map(schema):
        return [(str(k), str(v)) for k, v in value.items()]
    return value


def spread(files: DataFrame) -> DataFrame:
    """Deal rows out anew where they come in fewer partitions than there are cores: parsing costs more than moving a few files."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def extract(files: DataFrame, *, key: str = "doc_id", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse documents: one row each with the columns of ``model.DOCUMENT``, the key and ``keep``.

    ``files`` has the key, a ``format`` and the content, bytes or text. Rows with a null format or content give no row. A
    document is parsed whole in one task; images' bytes come in their own column, so that a plan that does not select them does not carry them on.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    base = files.filter(F.col("format").isNotNull() & F.col(content).isNotNull()).select(F.col(key), *[F.col(k) for k in keep], F.col("format"), F.col(content).alias("content"))
    head = T.StructType(base.schema.fields[: 1 + len(keep)])
    out = T.StructType([*head.fields, *T._parse_datatype_string(DOCUMENT).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                fmts, contents = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                docs = [parse_one(f, c).row() for f, c in zip(fmts, contents)]
                cols = [part.column(i) for i in range(len(head.fields))]
                cols += [pa.array([_fill(f.type, d[f.name]) for d in docs], f.type) for f in list(arrow)[len(head.fields) :]]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([*[pa.field(h.name, c.type) for h, c in zip(head.fields, cols)], *list(arrow)[len(head.fields) :]]))

    return base.mapInArrow(run, out)


def title_of(key, page: bytes | str) -> str:
    """The title of a page, '' without one. Any page can be read: a failure is one of the parser, and raised, since '' would look like a page without a title."""
    from .html import parse_tree, title_text

    try:
        return title_text(parse_tree(page.decode("utf-8", "replace") if isinstance(page, bytes) else page)) or ""
    except Exception as e:
        raise RuntimeError(f"no title could be read from page {key}") from e


def titles(pages: DataFrame, *, key: str = "doc_id", content: str = "content") -> DataFrame:
    """The titles of HTML pages, bytes or text, with all their white space: one row per page, '' without a title, null for a null page.

    Bytes that are no UTF-8 become U+FFFD, as in ``parse_html``. A failure of the parser ends the job with the page's key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    base = pages.select(F.col(key), F.col(content).cast("binary").alias("content"))
    out = T.StructType([base.schema.fields[0], T.StructField("title", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            found = pa.array([None if c is None else title_of(k, c) for k, c in zip(batch.column(0), (x.as_py() for x in batch.column(1)))], arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=arrow.names)

    return base.mapInArrow(run, out)


def blocks_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The block table: one row per block, nested ones by their path."""
    return docs.select(key, "format", F.inline("blocks"))


def resolve_source(path, base=None):
    """A path made absolute against the folder ``base`` and freed of ``.`` and ``..``, as Columns; URLs keep their scheme and host."""
    absolute = path.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/")
    whole = path if base is None else F.when(absolute, path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))
    root = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/?", 0)
    parts = F.filter(F.split(F.substring(whole, F.length(root) + 1, F.length(whole)), "/"), lambda x: ~x.isin("", "."))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(root, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def with_local_images(docs: DataFrame, files: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Documents whose images that are files beside them are filled in from ``files`` (path, content).

    ``docs`` is what ``extract`` gives with ``keep=("path",)``. A source is taken from the document's folder; what no file
    has stays failed. Only paths are shuffled with the references, and the bytes of the files that are referred to.
    """
    refs = docs.select(key, "path", F.posexplode("blocks").alias("at", "b")).filter(F.startswith("b.image.fetch_error", F.lit(LOCAL)))
    folder = F.regexp_replace("path", "[^/]*$", "")
    source = F.regexp_replace(F.substring("b.image.fetch_error", len(LOCAL) + 1, 1 << 30), r"[?#].*$", "")
    refs = refs.select(key, "at", F.col("b.image.id").alias("id"), resolve_source(source, folder).alias("wanted"))
    found = refs.join(files.select(resolve_source(F.col("path")).alias("wanted"), "content"), "wanted").select(key, "at", "id", "content")
    kind = found.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes = [image_size(c) for c in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], names=[key, "at", "id", "content", "w", "h"])

    sized = found.mapInArrow(run, f"`{key}` {kind}, at int, id string, content binary, w int, h int")
    lists = sized.groupBy(key).agg(F.collect_list(F.struct("at", "id", "content", "w", "h")).alias("found_images"))
    place = lambda i: F.concat(F.lit("raw_images/"), i, F.lit(".png"))

    def filled(b, i):
        hit = F.get(F.filter("found_images", lambda x: x["at"] == i), F.lit(0))
        image = b["image"].withField("relative_path", place(hit["id"])).withField("width_px", hit["w"]).withField("height_px", hit["h"]).withField("fetch_status", F.lit("ok")).withField("fetch_error", F.lit(None).cast("string"))
        return F.when(hit.isNotNull(), b.withField("image", image)).otherwise(b)

    more = F.transform("found_images", lambda x: F.struct(place(x["id"]).alias("relative_path"), x["content"].alias("content"), x["w"].alias("width_px"), x["h"].alias("height_px")))
    joined = docs.join(lists, key, "left").withColumn("found_images", F.coalesce("found_images", F.array().cast(lists.schema["found_images"].dataType)))
    return joined.withColumn("blocks", F.transform("blocks", filled)).withColumn("images", F.concat(F.coalesce("images", F.array().cast(docs.schema["images"].dataType)), more)).drop("found_images")
