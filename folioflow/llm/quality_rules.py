"""Line-first quality rules: judge every line, remove those that fail, reject texts that lose too much."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The characters of the symbol count, and the white space that ends a word.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the verdict."""

    #: A line fails where more than this share of its words end in one of ``mark_chars``, and it has over ``mark_least``.
    max_marked_share: float = 0.3
    mark_least: int = 3
    mark_chars: str = "#*$%&|<>!"
    #: Navigation: separators between words, per word.
    separators: str = "|»›·•"
    max_separator_share: float = 0.2
    #: Boilerplate: a line of at most ``boilerplate_words`` words that holds one of these, in any case.
    boilerplate: tuple[str, ...] = (
        "lorem ipsum", "enable javascript", "javascript is", "requires javascript", "cookie policy", "uses cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "read more", "click here", "sign up", "log in",
        "mentions légales", "tous droits réservés", "en savoir plus", "cliquez ici", "política de cookies", "todos los derechos reservados", "leer más", "haga clic aquí", "datenschutzerklärung", "alle rechte vorbehalten", "weiterlesen", "hier klicken",
    )
    boilerplate_words: int = 20
    #: Punctuation: some word of a line must have an ending mark, unless the line is short enough for a heading.
    endings: str = ".!?…:;\"'”’)]»"
    heading_words: int = 12
    #: A text is rejected where its remaining lines keep less than this share of its word characters.
    min_kept_share: float = 0.5
    #: Base rules.
    min_words: int = 50
    max_repeat_percent: int = 50


DEFAULT_RULES = LineRules()


def line_fails(line: str, rules: LineRules = DEFAULT_RULES) -> bool:
    """Whether a line goes. Lines without a word neither fail nor count."""
    words = _WORDS(line)
    n = len(words)
    if not n:
        return False
    marked = sum(1 for w in words if w[-1] in rules.mark_chars)
    if marked > rules.mark_least and marked > rules.max_marked_share * n:
        return True
    bars = sum(1 for w in words if w in rules.separators and len(w) == 1)
    if bars >= 2 and bars > rules.max_separator_share * n:
        return True
    if n <= rules.boilerplate_words:
        low = line.lower()
        if any(b in low for b in rules.boilerplate):
            return True
    return n > rules.heading_words and not any(w[-1] in rules.endings for w in words)


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def repeated_words(words: list) -> int:
    """Words that stand in a three-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    if len(set(words)) == n:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    base = len(ids)
    pair = np.unique(a[:-1] * base + a[1:], return_inverse=True)[1].astype(np.int64)
    code = pair[:-1] * base + a[2:]
    _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    counts = Counter(line for line in text.split("\n") if line.strip(SPACES))
    return sum(counts.values()) - len(counts)


def judge(text: str | None, rules: LineRules = DEFAULT_RULES) -> dict:
    """Every figure of one text."""
    text = text or ""
    words = text.encode().split()
    n, chars = len(words), word_chars(text)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    lines = text.split("\n")
    bad = [line for line in lines if line_fails(line, rules)]
    lost = sum(map(word_chars, bad))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeat,
        "base_failed": failed, "kept": not failed and chars - lost >= rules.min_kept_share * chars, "n_failed_lines": len(bad), "lost_chars": lost,
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_chars long"


def quality_report(docs: DataFrame, rules: LineRules = DEFAULT_RULES) -> DataFrame:
    """One row per document with the base figures, the lines removed and the verdict.

    Null and empty texts have no words: every figure is 0, base_failed is true, kept false. Null and repeated doc_ids
    stay as they are, equal lines and windows count each time they occur, other columns are not read, and an empty table
    gives no rows. A text is judged whole inside its task; nothing is shuffled.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [judge(t, rules) for t in batch.column(1).to_pylist()]
            cols = [pa.array([x[k] for x in found], pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean_text(text: str | None, rules: LineRules = DEFAULT_RULES) -> str | None:
    return text and "\n".join(line for line in text.split("\n") if not line_fails(line, rules))


def keep_good(docs: DataFrame, rules: LineRules = DEFAULT_RULES, *, remove_lines: bool = True) -> DataFrame:
    """Only the documents whose verdict is kept, with all their columns, and without their failed lines.

    The figures are those of the text as it came. Null and empty texts are rejected, each of rows that repeat is judged by
    itself, other columns stay as they are but for a whole-number column ``n_chars``, which counts the text that is left; an empty table stays empty.
    With ``remove_lines`` false texts are left alone.
    """
    at = docs.columns.index("text")
    count = next((i for i, f in enumerate(docs.schema) if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer")), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            judged = [judge(t, rules) for t in texts]
            out = batch.filter(pa.array([j["kept"] for j in judged], pa.bool_()))
            if remove_lines and any(j["kept"] and j["n_failed_lines"] for j in judged):
                left = [clean_text(t, rules) if j["n_failed_lines"] else t for t, j in zip(texts, judged) if j["kept"]]
                out = out.set_column(at, batch.schema.field(at), pa.array(left, batch.schema.field(at).type))
                if count is not None:
                    out = out.set_column(count, batch.schema.field(count), pa.array([len(t) for t in left], batch.schema.field(count).type))
            yield out

    return docs.mapInArrow(run, docs.schema)
