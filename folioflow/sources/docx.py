"""Word documents to blocks."""

from __future__ import annotations

import re

from .model import Parsed, block, is_svg, keep_image, run
from .ooxml import Package, diagram, pack, px, q

# Style names.
CODE_STYLES = ("HTML Preformatted", "Preformatted Text", "Macro Text")
QUOTE_STYLES = ("Quote", "Intense Quote")
SILENT_STYLES = ("", "Normal", "Body Text", "Default Paragraph Font", "List Paragraph")


def _val(elem, path: str):
    x = elem.find(path) if elem is not None else None
    return x.get(q("w:val")) if x is not None else None


def _on(props, name: str) -> bool:
    x = props.find(q(name)) if props is not None else None
    return x is not None and x.get(q("w:val"), "true").lower() not in ("0", "false", "none", "off")


def heading_level(style: str) -> int | None:
    if style in ("Title", "Subtitle"):
        return 1 if style == "Title" else 2
    m = re.search(r"heading\s*(\d+)", style, re.I)
    return min(int(m[1]), 6) if m else None


class _Reader:
    def __init__(self, content: bytes):
        self.package, self.out, self.count = Package(content), Parsed("docx"), 0
        self.rels = self.package.rels("word/document.xml")
        self.styles, self.style_nums = self._styles()
        self.lists = self._numbering()

    def _styles(self):
        root = self.package.xml("word/styles.xml")
        names, nums = {}, {}
        for s in root.iter(q("w:style")) if root is not None else ():
            names[s.get(q("w:styleId"))] = _val(s, q("w:name")) or ""
            nums[s.get(q("w:styleId"))] = s.find(f"{q('w:pPr')}/{q('w:numPr')}")
        return names, nums

    def _numbering(self):
        """numId -> level -> kind, through the abstract numbering it names."""
        root = self.package.xml("word/numbering.xml")
        if root is None:
            return {}
        kinds = {}
        for x in root.findall(q("w:abstractNum")):
            levels = {lvl.get(q("w:ilvl")): "bullet" if _val(lvl, q("w:numFmt")) == "bullet" else "numbered" for lvl in x.findall(q("w:lvl"))}
            kinds[x.get(q("w:abstractNumId"))] = levels
        return {x.get(q("w:numId")): kinds.get(_val(x, q("w:abstractNumId")), {}) for x in root.findall(q("w:num"))}

    def body(self, parent) -> list[dict]:
        out = []
        for x in parent:
            if x.tag == q("w:p"):
                out += self.paragraph(x)
            elif x.tag == q("w:tbl"):
                out.append(block("table", rows=self.table(x)))
        return out

    def runs(self, p) -> list[dict]:
        out = []
        for x in p:
            if x.tag == q("w:r"):
                self._run(x, None, out)
            elif x.tag == q("w:hyperlink"):
                link = self.rels.get(x.get(q("r:id"), "")) or (f"#{x.get(q('w:anchor'))}" if x.get(q("w:anchor")) else None)
                for r in x.findall(q("w:r")):
                    self._run(r, link, out)
        return out

    @staticmethod
    def _text(r) -> str:
        parts = []
        for x in r:
            if x.tag == q("w:t"):
                parts.append(x.text or "")
            elif x.tag == q("w:tab"):
                parts.append("\t")
            elif x.tag in (q("w:br"), q("w:cr")):
                parts.append("\n")
        return "".join(parts)

    def _run(self, r, link, out):
        text, props = self._text(r), r.find(q("w:rPr"))
        if text or link:
            out.append(run(text, bold=_on(props, "w:b"), italic=_on(props, "w:i"), underline=_on(props, "w:u"), hyperlink=link))

    def list_info(self, p, style_id) -> tuple[str | None, int]:
        num = p.find(f"{q('w:pPr')}/{q('w:numPr')}")
        num = self.style_nums.get(style_id) if num is None else num
        number = _val(num, q("w:numId"))
        if number in (None, "0"):
            return None, 0
        level = _val(num, q("w:ilvl")) or "0"
        return self.lists.get(number, {}).get(level, "bullet"), int(level)

    def paragraph(self, p) -> list[dict]:
        style_id = _val(p, f"{q('w:pPr')}/{q('w:pStyle')}")
        style = self.styles.get(style_id, style_id or "") or ""
        runs = self.runs(p)
        math = "".join(t.text or "" for o in p.iter(q("m:oMath")) for t in o.iter(q("m:t")))
        if math:
            runs.append(run(f"[Equation: {math}]"))
        kind, level = self.list_info(p, style_id)
        out, text = [], "".join(r["text"] for r in runs)
        if text.strip():
            head = heading_level(style)
            if kind:
                out.append(block("paragraph", runs=runs, list_kind=kind, list_level=level))
            elif head is not None:
                out.append(block("heading", level=head, runs=runs))
            elif "code" in style.lower() or style in CODE_STYLES:
                out.append(block("code", content=text))
            elif style in QUOTE_STYLES:
                out.append(block("blockquote", children=[block("paragraph", runs=runs)]))
            else:
                out.append(block("paragraph", runs=runs, style=None if style in SILENT_STYLES else style))
        for drawing in p.iter(q("w:drawing")):
            out += self.drawing(drawing)
        return out

    def drawing(self, d) -> list[dict]:
        """A drawing is a text box, else a diagram, else a picture."""
        box = d.find(f".//{q('wps:txbx')}/{q('w:txbxContent')}")
        if box is not None:
            inner = self.body(box)
            extent = d.find(f".//{q('wp:extent')}")
            size = {"left": 0.0, "top": 0.0, "width": px(extent.get("cx")), "height": px(extent.get("cy"))} if extent is not None else None
            return [block("textbox", children=inner, bbox=size)] if inner else []
        ids = d.find(f".//{q('dgm:relIds')}")
        if ids is not None:
            return [block("smartart", payload=pack(diagram(self.package, self.rels, ids, f"smartart_{len(self.out.points)}", self.out, True)))]
        blip = d.find(f".//{q('a:blip')}")
        rid = blip.get(q("r:embed")) if blip is not None else None
        if not rid:
            return []
        blob = self.package.read(self.rels.get(rid, ""))
        if blob is None:
            self.out.warnings.append(f"Image {rid}: part not found")
            return []
        self.count += 1
        name = f"img_{self.count}"
        path = f"raw_images/{name}.{'svg' if is_svg(blob) else 'png'}"
        w, h = keep_image(self.out, path, blob)
        doc = d.find(f".//{q('wp:docPr')}")
        alt = next((doc.get(k) for k in ("descr", "title", "name") if doc.get(k)), None) if doc is not None else None
        return [block("image", image={"id": name, "relative_path": path, "width_px": w, "height_px": h, "alt_text": alt, "container_kind": "docx_section", "container_index": 1, "fetch_status": "ok"})]

    def table(self, t) -> list[list[str]]:
        """Cell texts; the further columns of a cell that spans several are blank, rows of one that spans down repeat it."""
        rows, above = [], {}
        for tr in t.findall(q("w:tr")):
            row, col = [], 0
            for tc in tr.findall(q("w:tc")):
                props = tc.find(q("w:tcPr"))
                span = int(_val(props, q("w:gridSpan")) or 1)
                merge = props.find(q("w:vMerge")) if props is not None else None
                text = "\n".join("".join(self._text(r) for r in p.iter(q("w:r"))) for p in tc.findall(q("w:p"))).strip()
                if merge is not None and merge.get(q("w:val")) != "restart":
                    text = above.get(col, text)
                above[col] = text
                row += [text] + [""] * (span - 1)
                col += span
            rows.append(row)
        return rows


def parse_docx(content: bytes) -> Parsed:
    """Paragraphs and tables of the body in their order, with lists, quotes, code, equations, pictures, text boxes and diagrams."""
    reader = _Reader(content)
    body = reader.package.xml("word/document.xml").find(q("w:body"))
    for b in reader.body(body):
        reader.out.add(b)
    core = reader.package.read("docProps/core.xml")
    m = re.search(rb"<dc:title>([^<]+)</dc:title>", core or b"")
    reader.out.title = m[1].decode("utf-8", "replace") if m else None
    return reader.out
