"""Scalar rules of the document model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the six source formats.
EXTENSIONS = {
    ".xlsx": "xlsx", ".xlsm": "xlsx", ".docx": "docx", ".docm": "docx", ".pptx": "pptx", ".pptm": "pptx",
    ".pdf": "pdf", ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown",
}

# Layout name hints, in the order in which they are tried.
LAYOUT_HINTS = (
    ("hier", "hierarchy"), ("orgchart", "hierarchy"), ("organization", "hierarchy"), ("cycle", "cycle"), ("circular", "cycle"), ("process", "process"), ("flow", "process"),
    ("arrow", "process"), ("step", "process"), ("compost", "process"), ("lineartextimage", "process"), ("vlist", "list"), ("hlist", "list"), ("bullet", "list"),
    ("descendanttext", "list"), ("parenttext", "list"), ("matrix", "matrix"), ("relationship", "matrix"), ("pyramid", "matrix"),
)

# Chart kinds, in the order in which a type name is searched for them.
CHART_KINDS = ("bar", "column", "line", "pie", "scatter", "area", "doughnut")

# Fixed value: an alt text that is only a path of the author's machine.
PATH_LEAK = r"(?i)^([a-zA-Z]:[\\/]|/|\\\\).*\.(png|jpe?g|gif|webp|bmp|tiff?)$"

#: Characters that one token is taken to have.
CHARS_PER_TOKEN = 3


def extension(path: Column) -> Column:
    """The lower-cased suffix of a path's last part, '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def url_path(url: Column) -> Column:
    """The path of a URL, without host, query and fragment."""
    return F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), r"^[A-Za-z]+://[^/]*", "")


def source_format(ext: Column) -> Column:
    """The format an extension stands for, null for none."""
    out = None
    for e, fmt in EXTENSIONS.items():
        out = out.when(ext == e, fmt) if out is not None else F.when(ext == e, fmt)
    return out


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def is_path_leak(alt: Column) -> Column:
    return F.coalesce(alt.rlike(PATH_LEAK), F.lit(False))


def nullify_empty(value: Column) -> Column:
    return F.when(value != "", value)


def has_ink(text: Column) -> Column:
    """Whether a text has more than white space of any kind."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def emu_to_px(emu: Column) -> Column:
    """EMU to pixels at 96 dpi, to one decimal."""
    return F.round(emu / 9525.0, 1)


def pt_to_px(pt: Column) -> Column:
    return F.round(pt * 4.0 / 3.0, 1)


def column_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to three letters."""
    n = n.cast("long")
    letter = lambda v: F.char(F.pmod(v, F.lit(26)) + 65)
    # Offsets of the blocks of one, two and three letters.
    return F.when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(F.floor((n - 27) / 26)), letter(n - 27))).otherwise(
        F.concat(letter(F.floor((n - 703) / 676)), letter(F.floor((n - 703) / 26)), letter(n - 703))
    )


def heading_level(style: Column) -> Column:
    """The level a paragraph style's name stands for; null if it is no heading."""
    number = F.regexp_extract(style, r"(?i)heading\s*(\d+)", 1)
    return F.when(style == "Title", 1).when(style == "Subtitle", 2).when(number != "", F.least(number.cast("int"), F.lit(6)))


def first_match(text: Column, pairs, default: str | None = None) -> Column:
    """The value of the first pair whose key is part of the text: the pairs' order decides, not the text's."""
    low, out = F.lower(text), None
    for key, value in pairs:
        hit = F.contains(low, F.lit(key))
        out = out.when(hit, value) if out is not None else F.when(hit, value)
    return out.otherwise(F.lit(default)) if default is not None else out


def layout_kind(names: Column) -> Column:
    return first_match(names, LAYOUT_HINTS, "other")


def chart_kind(name: Column) -> Column:
    return first_match(name, [(k, k) for k in CHART_KINDS], "other")


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(last, r"\.[^.]*$", "")


def data_uri_bytes(src: Column) -> Column:
    """The bytes of a base64 data URI, null for other sources and for broken ones."""
    return F.try_to_binary(F.when(src.rlike(r"(?s)^data:[^;]+;base64,.+$"), F.regexp_extract(src, r"(?s)^data:[^;]+;base64,(.+)$", 1)), F.lit("base64"))


def image_status(src: Column, loaded: Column, remote: bool = False) -> Column:
    """ok, failed or skipped, by where an image comes from and whether its bytes are there."""
    web = src.rlike("(?i)^https?://")
    out = F.when(F.coalesce(src, F.lit("")) == "", "failed").when(loaded, "ok")
    return (out if remote else out.when(web, "skipped")).otherwise("failed")


def rel_target(target: Column, folder: Column) -> Column:
    """A relationship target as a path from the package root."""
    ups = (F.length(F.regexp_extract(target, r"^((?:\.\./)*)", 1)) / 3).cast("int")
    parts = F.split(F.regexp_replace(folder, "^/+|/+$", ""), "/")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0)))
    rest = F.regexp_replace(target, r"^(\.\./)+", "")
    return (
        F.when(target.startswith("/"), F.regexp_replace(target, "^/+", ""))
        .when(target.startswith("../"), F.when(F.size(base) > 0, F.concat(F.array_join(base, "/"), F.lit("/"), rest)).otherwise(rest))
        .when(~F.contains(target, F.lit("/")) & (folder != ""), F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), target))
        .otherwise(target)
    )
