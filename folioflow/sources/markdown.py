"""Markdown to blocks: the block and inline constructs of CommonMark that documents use, GFM tables and strikethrough.

Not covered: reference definitions, nested link brackets, lazy continuation inside nested quotes and entity edge cases.
"""

from __future__ import annotations

import html as entities
import re

from .model import Parsed, block, load_image, run

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][\w-]*(?:[\s/>]|$)|!--|!\[CDATA|\?|![A-Z])")
_DELIM = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FRONT = re.compile(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", re.S)


def frontmatter(text: str) -> tuple[dict[str, str], str]:
    """Keys and values between two ``---`` lines at the start, and the text after them."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    out = {}
    for line in re.split(r"\r?\n", m[1]):
        if not line.strip() or line.lstrip().startswith("#") or ":" not in line or line[0] in " \t-":
            continue
        key, _, value = line.partition(":")
        out[key.strip()] = value.strip().strip('"').strip("'")
    return out, text[m.end() :]


# ---- inline ----

_TOKEN = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<code>(?<!`)(`+)(?!`)(?P<body>.+?)(?<!`)\3(?!`))|(?P<auto><(?:https?|mailto|ftp):[^\s<>]*>)|(?P<tag><(?:/?[A-Za-z][^<>]*|!--.*?--)>)"
    r"|(?P<img>!\[(?P<alt>[^\]]*)\]\((?P<src><[^<>]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\))"
    r"|(?P<link>\[(?P<text>(?:[^\[\]\\]|\\.|!\[[^\]]*\]\([^)]*\))*)\]\((?P<href><[^<>]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\))"
    r"|(?P<marks>\*+|_+|~~)|(?P<brk>(?: {2,}|\\)?\n[ \t]*)|(?P<ent>&(?:#\d+|#x[0-9a-fA-F]+|\w+);)",
    re.S,
)


def _pieces(text: str) -> list:
    """Texts, marks and finished pieces of a paragraph, in order."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            out.append(("text", text[at : m.start()]))
        at = m.end()
        kind = m.lastgroup if m.lastgroup in ("esc", "auto", "tag", "img", "link", "marks", "brk", "ent", "code") else next(k for k in ("code", "img", "link") if m[k])
        if kind == "esc":
            out.append(("text", m[0][1:]))
        elif kind == "ent":
            out.append(("text", entities.unescape(m[0])))
        elif kind == "code":
            body = m["body"].replace("\n", " ")
            if len(body) > 2 and body[0] == body[-1] == " " and body.strip():
                body = body[1:-1]
            out.append(("code", body))
        elif kind == "auto":
            out.append(("link", m[0][1:-1], [("text", m[0][1:-1])]))
        elif kind == "img":
            out.append(("img", m["src"].strip("<>"), m["alt"]))
        elif kind == "link":
            out.append(("link", m["href"].strip("<>"), _pieces(m["text"])))
        elif kind == "brk":
            out.append(("break",))
        elif kind == "tag":
            out.append(("text", m[0]))
        else:
            before, after = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
            word = lambda c: c.isalnum()
            opens = not after.isspace() and (word(after) or after in "*_~`[!<\\(\"'" or not word(before))
            closes = not before.isspace() and (word(before) or not word(after))
            if m[0][0] == "_":
                opens, closes = opens and not word(before), closes and not word(after)
            out.append(("mark", m[0], opens, closes))
    if at < len(text):
        out.append(("text", text[at:]))
    return out


def _emphasis(pieces: list) -> list:
    """Pair the marks: (kind, first, last) spans of piece numbers; what stays unpaired is text."""
    stack, spans, left = [], [], {}
    for i, p in enumerate(pieces):
        if p[0] != "mark":
            continue
        mark, n = p[1][0], len(p[1])
        if p[3]:
            for k in range(len(stack) - 1, -1, -1):
                j, m, have = stack[k]
                if m != mark:
                    continue
                while have and n:
                    use = 2 if have >= 2 and n >= 2 else 1
                    if mark == "~":
                        use = 2
                    spans.append(("strike" if mark == "~" else "bold" if use == 2 else "italic", j, i))
                    have, n = have - use, n - use
                del stack[k + 1 :]
                if have:
                    stack[k] = (j, m, have)
                    left[j] = have
                else:
                    left[j] = 0
                    del stack[k]
                if not n:
                    break
        left[i] = n
        if n and p[2]:
            stack.append((i, mark, n))
    return spans, left


def inline(text: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """Runs of a paragraph and the images (source, alt text) in it."""
    runs: list[dict] = []
    images: list[tuple[str, str]] = []

    def walk(pieces, style):
        spans, left = _emphasis(pieces)
        for i, p in enumerate(pieces):
            own = dict(style)
            for kind, a, b in spans:
                if a < i < b and kind != "strike":
                    own[kind] = True
            if p[0] == "text" and p[1]:
                emit(p[1], own)
            elif p[0] == "code":
                emit(p[1], own | {"code": True}, True)
            elif p[0] == "break":
                runs.append(run("\n"))
            elif p[0] == "img":
                images.append((p[1], p[2]))
            elif p[0] == "link":
                walk(p[2], own | {"hyperlink": p[1]})
            elif p[0] == "mark" and left.get(i):
                emit(p[1][0] * left[i], own)

    def emit(text, style, alone=False):
        last = runs[-1] if runs else None
        if last and not alone and last["text"] != "\n" and {k: v for k, v in last.items() if k != "text"} == style and not style.get("code"):
            last["text"] += text
        else:
            runs.append(run(text, **style))

    walk(_pieces(text), {})
    return runs, images


# ---- blocks ----


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)]


def _cell_text(cell: str) -> str:
    return "".join(r["text"] for r in inline(cell)[0]).strip()


def _dedent(line: str, n: int) -> str:
    k = 0
    while k < n and k < len(line) and line[k] == " ":
        k += 1
    return line[k:]


def _interrupts(line: str) -> bool:
    m = _ITEM.match(line)
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4 or m and m[4] and (m[2] in "-+*" or m[2][:-1] == "1") or _HTML.match(line))


def tree(lines: list[str]) -> list[tuple]:
    """Block nodes: (kind, ...) tuples, lists as ('list', ordered, items of nodes)."""
    out, i, n = [], 0, len(lines)
    while i < n:
        line = lines[i].expandtabs(4)
        if not line.strip():
            i += 1
            continue
        if len(line) - len(line.lstrip()) >= 4:
            body = []
            while i < n and (not lines[i].strip() or lines[i].expandtabs(4).startswith("    ")):
                body.append(lines[i].expandtabs(4)[4:])
                i += 1
            while body and not body[-1].strip():
                body.pop()
            out.append(("code", "", "\n".join(body) + "\n"))
            continue
        if m := _FENCE.match(line):
            pad, body, close = len(line) - len(line.lstrip()), [], re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            i += 1
            while i < n and not close.match(lines[i]):
                body.append(_dedent(lines[i], pad))
                i += 1
            i += 1
            out.append(("code", (m[2].split() or [""])[0], "".join(x + "\n" for x in body)))
        elif m := _ATX.match(line):
            out.append(("heading", len(m[1]), (m[2] or "").strip()))
            i += 1
        elif _RULE.match(line):
            out.append(("rule",))
            i += 1
        elif line.lstrip().startswith(">"):
            body = []
            while i < n and lines[i].strip() and (lines[i].lstrip().startswith(">") or not _interrupts(lines[i])):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(("quote", tree(body)))
        elif m := _ITEM.match(line):
            ordered, items = m[2] not in "-+*", []
            kind = m[2] if not ordered else m[2][-1]
            while i < n and (m := _ITEM.match(lines[i].expandtabs(4))) and (m[2] if m[2] in "-+*" else m[2][-1]) == kind and not _RULE.match(lines[i]):
                gap = len(m[3]) if m[3] and len(m[3]) < 5 and m[4] else 1
                width, body = len(m[1]) + len(m[2]) + gap, [m[4] or ""]
                i += 1
                blank = False
                while i < n:
                    x = lines[i].expandtabs(4)
                    if not x.strip():
                        blank = True
                        body.append("")
                    elif x.startswith(" " * width):
                        blank = False
                        body.append(x[width:])
                    elif blank or _interrupts(x) or _ITEM.match(x):
                        break
                    else:
                        body.append(x)
                    i += 1
                items.append(tree(body))
            out.append(("list", ordered, items))
        elif _HTML.match(line):
            body = []
            while i < n and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append(("html", "\n".join(body) + "\n"))
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and _DELIM.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            width, rows = len(_cells(line)), [_cells(line)]
            i += 2
            while i < n and lines[i].strip() and not _interrupts(lines[i]):
                rows.append((_cells(lines[i]) + [""] * width)[:width])
                i += 1
            out.append(("table", rows))
        else:
            body, level = [], None
            while i < n and lines[i].strip() and not (body and _interrupts(lines[i]) and not re.match(r" {0,3}-+[ \t]*$", lines[i])):
                if body and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[i])):
                    level = 1 if m[1][0] == "=" else 2
                    i += 1
                    break
                body.append(lines[i].strip() if not lines[i].endswith("  ") else lines[i].strip() + "  ")
                i += 1
            text = "\n".join(body).rstrip()
            out.append(("heading", level, text) if level else ("paragraph", text))
    return out


class _Reader:
    def __init__(self):
        self.out, self.count = Parsed("markdown"), 0

    def images(self, found) -> list[dict]:
        made = []
        for src, alt in found:
            made.append(block("image", image=load_image(src, alt, f"img_{self.count}", "md_section", self.out)))
            self.count += 1
        return made

    def read(self, nodes) -> list[dict]:
        out = []
        for x in nodes:
            kind = x[0]
            if kind == "heading":
                out.append(block("heading", level=x[1], runs=inline(x[2])[0]))
            elif kind == "paragraph":
                runs, found = inline(x[1])
                if any(r["text"].strip() for r in runs):
                    out.append(block("paragraph", runs=runs))
                out += self.images(found)
            elif kind == "list":
                self.items(x, 0, out)
            elif kind == "table":
                out.append(block("table", rows=[[_cell_text(c) for c in row] for row in x[1]]))
            elif kind == "code":
                out.append(block("code", language=x[1], content=x[2]))
            elif kind == "quote":
                out.append(block("blockquote", children=self.read(x[1])))
            elif kind == "rule":
                out.append(block("divider"))
            elif kind == "html":
                out.append(block("raw_html", content=x[1]))
        return out

    def items(self, node, level: int, out: list[dict]) -> None:
        for item in node[2]:
            runs, found, others, nested = [], [], [], []
            for x in item:
                if x[0] == "paragraph":
                    more, imgs = inline(x[1])
                    runs += more
                    found += imgs
                elif x[0] == "list":
                    nested.append(x)
                else:
                    others.append(x)
            if any(r["text"].strip() for r in runs):
                out.append(block("paragraph", runs=runs, list_kind="numbered" if node[1] else "bullet", list_level=level))
            out += self.images(found)
            out += self.read(others)
            for x in nested:
                self.items(x, level + 1, out)


def parse_markdown(content: bytes | str) -> Parsed:
    """Blocks of a Markdown text; its front matter becomes the document's metadata."""
    text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
    reader = _Reader()
    meta, body = frontmatter(text)
    reader.out.meta.update(meta)
    reader.out.title = meta.get("title")
    if not text.strip():
        reader.out.warnings.append("Empty Markdown")
    for b in reader.read(tree(re.split(r"\r\n?|\n", body))):
        reader.out.add(b)
    return reader.out
