"""The passes of ``markdown`` over one text in Python, for stages that hold the text there already.

A Column cannot carry a state from line to line without copying what it has; here a text is read once, however long.
"""

from __future__ import annotations

import re
import unicodedata

from .markdown import BRAND_CHARS, BRAND_LINES, BRAND_WORDS, LOGO_LINE, MARKER_START, SMALL_WORDS, TITLE_LINES

_MARKER_LINE = re.compile(r'^\*\*\[Image - \w+ #\d+(?:, "[^"]*")?\]\*\*[ \t]*\n?', re.M | re.A)
_PIECES = re.compile(r"(?=^\*\*\[Image - )", re.M)
_BLANK_LINES = re.compile(r"\n{3,}")
_LOGO, _BRAND = re.compile(LOGO_LINE.replace("(?iu)", ""), re.I), re.compile(BRAND_WORDS.replace("(?iu)", ""), re.I)
_FENCE = re.compile(r"[ \t\n\v\f\r]*(?:```|~~~)")


def collapse_blank_lines(md: str) -> str:
    return _BLANK_LINES.sub("\n\n", md)


def strip_scan_markers(md: str, pages: list[int] | None) -> str:
    if not pages:
        return md
    return collapse_blank_lines(re.sub(rf'^\*\*\[Image - pdf_page #0*(?:{"|".join(map(str, pages))})(?:, "[^"]*")?\]\*\*\s*$', "", md, flags=re.M))


def strip_decorative(md: str) -> str:
    out = []
    for piece in _PIECES.split(md):
        if piece.startswith(MARKER_START) and "\n" in piece:
            body = piece.split("\n", 1)[1]
            end = body.find("\n\n")
            caption = (body if end < 0 else body[:end]).strip()
            lines = caption.split("\n")
            brand = len(lines) <= BRAND_LINES and len(caption) < BRAND_CHARS and _BRAND.search(caption)
            if caption and (brand or _LOGO.search(lines[0])):
                piece = "" if end < 0 else body[end + 2 :]
        out.append(piece)
    return collapse_blank_lines("".join(out))


def dedupe_markers(md: str) -> str:
    seen, out = set(), []
    for piece in _PIECES.split(md):
        if piece.startswith(MARKER_START):
            key = piece.strip()
            if key in seen:
                continue
            seen.add(key)
        out.append(piece)
    return "".join(out)


def strip_markers(md: str) -> str:
    return collapse_blank_lines(_MARKER_LINE.sub("", md)).strip() + "\n"


def _lines(md: str) -> list[str]:
    md = re.sub(r"\r\n?", "\n", md)
    return md.removesuffix("\n").split("\n") if md else []


def _joined(md: str, lines: list[str]) -> str:
    text = "\n".join(lines)
    return text + "\n" if md.endswith("\n") and not text.endswith("\n") else text


def _outside_fences(md: str, step) -> str:
    """Rewrite the lines outside of code fences."""
    out, fenced = [], False
    for line in _lines(md):
        fence = bool(_FENCE.match(line))
        out.append(line if fence or fenced else step(line))
        fenced ^= fence
    return _joined(md, out)


def demote_second_h2(md: str) -> str:
    pending = False

    def step(line: str) -> str:
        nonlocal pending
        if line.startswith("## "):
            pending = not pending
            return line if pending else "#" + line
        if line.strip() and not line.lstrip().startswith("#"):
            pending = False
        return line

    return _outside_fences(md, step)


def keep_one_h1(md: str) -> str:
    seen = False

    def step(line: str) -> str:
        nonlocal seen
        if not line.startswith("# "):
            return line
        out, seen = "#" + line if seen else line, True
        return out

    return _outside_fences(md, step)


def titlecase_h1(md: str) -> str:
    lines = _lines(md)
    for i, line in enumerate(lines[:TITLE_LINES]):
        letters = [c for c in line[2:] if c.isalpha()]
        if line.startswith("# ") and letters and all(unicodedata.category(c) == "Lu" for c in letters):
            words = line[2:].split()
            lines[i] = "# " + " ".join(w.lower() if j and w.lower() in SMALL_WORDS else w[:1].upper() + w[1:].lower() for j, w in enumerate(words))
            break
    return "\n".join(lines)


def postprocess(md: str, scans: list[int] | None = None) -> str:
    """All passes in their order."""
    md = strip_scan_markers(md, scans)
    for f in (strip_decorative, dedupe_markers, strip_markers, demote_second_h2, titlecase_h1):
        md = f(md)
    return md
