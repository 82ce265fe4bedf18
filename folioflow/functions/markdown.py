"""Deterministic passes over rendered Markdown, as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker line over an image's caption, captions of decoration, small words of titles.
MARKER = r'\*\*\[Image - (\w+) #(\d+)(?:, "[^"]*")?\]\*\*'
MARKER_START = "**[Image - "
LOGO_LINE = r"(?iu)^\s*(?:Logo[: ]|Watermark[: ]|Branding[: ]|Decorative image|H[iì]nh trang tr[íi]|Logo\s+(?:image|with))"
BRAND_WORDS = r"(?iu)\b(?:red square|white curved lines|accelio|brand(?:ing)?|trademark|™|\(R\)|watermark|logo)\b"
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "of", "on", "or", "the", "to", "vs", "via")

#: Limits of a short brand caption, and how many lines may hold the title.
BRAND_LINES, BRAND_CHARS, TITLE_LINES = 2, 200, 5
#: Pages with fewer characters of text count as scans.
SCAN_CHARS = 40


def collapse_blank_lines(md: Column) -> Column:
    return F.regexp_replace(md, r"\n{3,}", "\n\n")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def marker_blocks(md: Column) -> Column:
    """The text in pieces: what comes before the first marker line, then one piece from each marker line to the next."""
    return F.split(md, r"(?md)(?=^\*\*\[Image - )")


def _is_marker(block: Column) -> Column:
    return F.startswith(block, F.lit(MARKER_START))


def strip_scan_markers(md: Column, scan_pages: Column) -> Column:
    """Remove the marker lines of pages that are scans; ``scan_pages`` is an array of page numbers, null for other formats."""
    pages = F.array_join(F.transform(scan_pages, lambda p: p.cast("string")), "|")
    pattern = F.concat(F.lit(r'(?md)^\*\*\[Image - pdf_page #0*(?:'), pages, F.lit(r')(?:, "[^"]*")?\]\*\*\s*$'))
    return F.when(F.coalesce(F.size(scan_pages), F.lit(0)) > 0, collapse_blank_lines(F.regexp_replace(md, pattern, F.lit("")))).otherwise(md)


def scan_pages(is_scanned: Column, pages: Column) -> Column:
    """Page numbers of scans: every page of a scanned document, else pages with an image and hardly any text.

    ``pages`` is an array of structs (index, chars, has_image).
    """
    thin = F.filter(pages, lambda p: F.coalesce(is_scanned, F.lit(False)) | ((p["chars"] < SCAN_CHARS) & p["has_image"]))
    return F.transform(thin, lambda p: p["index"])


def strip_decorative(md: Column) -> Column:
    """Remove marker and caption of logos and other decoration; what follows the caption stays."""

    def kept(block: Column) -> Column:
        body = F.regexp_extract(block, r"(?s)^[^\n]*\n(.*)$", 1)
        end = F.instr(body, "\n\n")
        caption = strip_space(F.when(end > 0, F.substring(body, F.lit(1), end - 1)).otherwise(body))
        lines = F.split(caption, "\n")
        brand = (F.size(lines) <= BRAND_LINES) & (F.length(caption) < BRAND_CHARS) & caption.rlike(BRAND_WORDS)
        drop = _is_marker(block) & F.contains(block, F.lit("\n")) & (caption != "") & (F.get(lines, F.lit(0)).rlike(LOGO_LINE) | brand)
        rest = F.when(end > 0, F.substring(body, end + 2, F.length(body)))
        return F.when(drop, F.coalesce(rest, F.lit(""))).otherwise(block)

    parts = F.transform(marker_blocks(md), kept)
    return collapse_blank_lines(F.array_join(parts, ""))


def dedupe_markers(md: Column) -> Column:
    """Keep the first of equal marker pieces, wherever they stand."""
    blocks = marker_blocks(md)
    keys = F.transform(blocks, strip_space)
    kept = F.filter(F.transform(blocks, lambda b, i: F.when(~_is_marker(b) | (F.array_position(keys, strip_space(b)) == i + 1), b)), lambda b: b.isNotNull())
    return F.array_join(kept, "")


def strip_markers(md: Column) -> Column:
    """Remove every marker line, keep the captions, end with one line feed."""
    bare = F.regexp_replace(md, r'(?md)^\*\*\[Image - \w+ #\d+(?:, "[^"]*")?\]\*\*[ \t]*\n?', "")
    return F.concat(strip_space(collapse_blank_lines(bare)), F.lit("\n"))


def lines_of(md: Column) -> Column:
    """Lines without their ends; a final line feed ends the last line and does not begin another."""
    return F.when(md == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(md, r"\r\n?", "\n").substr(F.lit(1), F.length(md) - F.endswith(md, F.lit("\n")).cast("int")), "\n"))


def _joined(md: Column, lines: Column) -> Column:
    """The lines again, with the final line feed that the text had."""
    text = F.array_join(lines, "\n")
    return F.when(F.endswith(md, F.lit("\n")) & ~F.endswith(text, F.lit("\n")), F.concat(text, F.lit("\n"))).otherwise(text)


def _is_fence(line: Column) -> Column:
    return line.rlike(r"^\s*(?:```|~~~)")


def _fold(md: Column, marks, step) -> Column:
    """Rewrite lines with a state of flags: ``step(flags, line) -> (flags, line)``, outside of code fences."""
    names = ["fence", *marks]
    start = F.struct(*[F.lit(False).alias(n) for n in names], F.array().cast("array<string>").alias("out"))

    def merge(acc: Column, line: Column) -> Column:
        fence = _is_fence(line)
        plain = ~fence & ~acc["fence"]
        after, text = step(acc, line)
        flags = [(acc["fence"] != fence).alias("fence")] + [F.when(plain, after[m]).otherwise(acc[m]).alias(m) for m in marks]
        return F.struct(*flags, F.concat(acc["out"], F.array(F.when(plain, text).otherwise(line))).alias("out"))

    return _joined(md, F.aggregate(lines_of(md), start, merge, lambda acc: acc["out"]))


def demote_second_h2(md: Column) -> Column:
    """A ``##`` heading after another with only blank lines, fences or further headings between becomes ``###``."""

    def step(acc, line):
        h2 = F.startswith(line, F.lit("## "))
        content = line.rlike(r"(?U)\S") & ~line.rlike(r"(?U)^\s*#")
        pending = F.when(h2, ~acc["pending"]).when(content, F.lit(False)).otherwise(acc["pending"])
        return {"pending": pending}, F.when(h2 & acc["pending"], F.concat(F.lit("#"), line)).otherwise(line)

    return _fold(md, ["pending"], step)


def keep_one_h1(md: Column) -> Column:
    """Every ``#`` heading after the first becomes ``##``."""

    def step(acc, line):
        h1 = F.startswith(line, F.lit("# "))
        return {"seen": acc["seen"] | h1}, F.when(h1 & acc["seen"], F.concat(F.lit("#"), line)).otherwise(line)

    return _fold(md, ["seen"], step)


def titlecase_h1(md: Column) -> Column:
    """The first all-capitals ``#`` heading of the first lines in title case; small words stay small, except the first."""
    lines = lines_of(md)
    letters = lambda line: F.regexp_replace(F.substring(line, 3, 1 << 30), r"\P{L}", "")
    hit = lambda line: F.startswith(line, F.lit("# ")) & (letters(line) != "") & ~letters(line).rlike(r"[^\p{Lu}]")
    top = F.slice(lines, 1, TITLE_LINES)
    at = F.array_position(F.transform(top, hit), F.lit(True))
    words = lambda line: F.filter(F.split(strip_space(F.substring(line, 3, 1 << 30)), r"(?U)\s+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    cased = lambda line: F.concat(F.lit("# "), F.array_join(F.transform(words(line), lambda w, j: F.when((j > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(capital(w))), " "))
    # Only the first lines are looked at; what a lambda refers to is computed again for each element.
    first = F.transform(top, lambda line, i: F.when(i + 1 == at, cased(line)).otherwise(line))
    return F.array_join(F.concat(first, F.slice(lines, TITLE_LINES + 1, 1 << 30)), "\n")


def postprocess(df: DataFrame, column: str = "markdown", scans: Column | None = None) -> DataFrame:
    """All passes in their order over a text column. Each is a projection of its own, so that none is computed twice."""
    passes = [strip_decorative, dedupe_markers, strip_markers, demote_second_h2, titlecase_h1]
    if scans is not None:
        passes.insert(0, lambda md: strip_scan_markers(md, scans))
    for f in passes:
        df = df.withColumn(column, f(F.col(column)))
    return df


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(map of keys and values or null, text after it): lines ``key: value`` between two ``---`` lines at the start."""
    pattern = r"^(?s)---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?"
    raw = F.regexp_extract(text, pattern, 1)
    has = text.rlike(r"^(?s)---[ \t]*\r?\n.*?\r?\n---[ \t]*\r?\n?")
    good = F.filter(F.split(raw, r"\r?\n"), lambda x: x.rlike(r"^[^\s#\-][^:]*:") & ~x.rlike(r"^[ \t\-]"))
    value = lambda x: F.regexp_replace(F.regexp_replace(strip_space(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)), '^"+|"+$', ""), "^'+|'+$", "")
    pairs = F.transform(good, lambda x: F.struct(strip_space(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), value(x).alias("value")))
    # The last of equal keys wins.
    last = F.filter(pairs, lambda e: F.array_position(F.reverse(F.transform(pairs, lambda o: o["key"])), e["key"]) > 0)
    keys = F.array_distinct(F.transform(last, lambda e: e["key"]))
    made = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"]))
    return F.when(has & (F.size(keys) > 0), made), F.when(has, F.regexp_replace(text, pattern, "")).otherwise(text)
