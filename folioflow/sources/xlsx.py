"""Workbooks to cells, merged ranges and drawings; tables are made of the cells by relational plans."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from .model import Parsed, block, is_svg, keep_image
from .ooxml import Package, chart, diagram, pack, px, q

_REF = re.compile(r"([A-Z]+)(\d+)")


def col_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _range(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    (c1, r1), (c2, r2) = (_REF.fullmatch(x).groups() for x in (a, b or a))
    return int(r1), int(r2), col_number(c1), col_number(c2)


class _Reader:
    def __init__(self, content: bytes):
        self.package, self.out, self.count = Package(content), Parsed("xlsx"), 0
        strings = self.package.xml("xl/sharedStrings.xml")
        self.strings = ["".join(t.text or "" for t in si.iter(q("s:t"))) for si in strings.findall(q("s:si"))] if strings is not None else []
        self.bold, self.dates = self._styles()

    def _styles(self):
        """For each cell style: whether its font is bold, whether its number format is a date."""
        root = self.package.xml("xl/styles.xml")
        if root is None:
            return [], []
        fonts = [f.find(q("s:b")) is not None and f.find(q("s:b")).get("val", "1") not in ("0", "false") for f in root.findall(f"{q('s:fonts')}/{q('s:font')}")]
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(q("s:numFmt"))}
        dated = lambda i: 14 <= i <= 22 or 45 <= i <= 47 or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")), re.I))
        xfs = root.findall(f"{q('s:cellXfs')}/{q('s:xf')}")
        return [bool(fonts[int(x.get("fontId") or 0)]) if fonts else False for x in xfs], [dated(int(x.get("numFmtId") or 0)) for x in xfs]

    def value(self, c) -> tuple[str | None, str]:
        kind, raw = c.get("t", "n"), c.findtext(q("s:v"))
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(q("s:t"))), "string"
        if raw is None:
            return None, "null"
        if kind == "s":
            return self.strings[int(raw)], "string"
        if kind == "b":
            return str(raw == "1"), "bool"
        if kind in ("str", "e", "d"):
            return raw, "string"
        style = int(c.get("s") or 0)
        number = float(raw)
        if style < len(self.dates) and self.dates[style]:
            return str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400))), "datetime"
        return (str(int(number)), "int") if re.fullmatch(r"-?\d+", raw) else (repr(number), "float")

    def read(self) -> Parsed:
        book, rels = self.package.xml("xl/workbook.xml"), self.package.rels("xl/workbook.xml")
        for n, s in enumerate(book.iter(q("s:sheet")), 1):
            state = s.get("state", "visible")
            if state != "visible":
                self.out.warnings.append(f"Sheet {s.get('name')!r}: {state}, skipped")
                continue
            part = rels.get(s.get(q("r:id")), "")
            root = self.package.xml(part)
            if root is not None:
                self.sheet(n, s.get("name"), part, root)
        return self.out

    def sheet(self, n: int, name: str, part: str, root) -> None:
        rels, at, max_row, max_col, values = self.package.rels(part), 0, 0, 0, {}
        for tr in root.iter(q("s:row")):
            at = int(tr.get("r") or at + 1)
            col = 0
            for c in tr.findall(q("s:c")):
                m = _REF.fullmatch(c.get("r") or "")
                col = col_number(m[1]) if m else col + 1
                value, kind = self.value(c)
                style = int(c.get("s") or 0)
                bold = style < len(self.bold) and self.bold[style]
                max_row, max_col = max(max_row, at), max(max_col, col)
                if value is not None or bold:
                    values[at, col] = value
                    self.out.cells.append({"sheet": n, "row": at, "col": col, "value": value, "kind": kind, "bold": bold})
        for m in root.iter(q("s:mergeCell")):
            r1, r2, c1, c2 = _range(m.get("ref"))
            max_row, max_col = max(max_row, r2), max(max_col, c2)
            self.out.merged.append({"sheet": n, "min_row": r1, "max_row": r2, "min_col": c1, "max_col": c2, "value": values.get((r1, c1))})
        self.out.extents.append({"sheet": n, "name": name, "max_row": max_row, "max_col": max_col})
        self.out.meta[f"sheet_{n}"] = name
        links = []
        for h in root.iter(q("s:hyperlink")):
            target = rels.get(h.get(q("r:id"), "")) or h.get("location") or h.get("ref")
            r1, _, c1, _ = _range(h.get("ref"))
            links.append({"ref": h.get("ref"), "target": target, "display": values.get((r1, c1))})
        notes = next((t for t in rels.values() if re.search(r"comments\d*\.xml$", t)), None)
        comments = []
        if notes and (found := self.package.xml(notes)) is not None:
            people = [a.text or "" for a in found.iter(q("s:author"))]
            comments = [{"ref": c.get("ref"), "author": people[int(c.get("authorId") or 0)] if people else None, "text": "".join(t.text or "" for t in c.iter(q("s:t")))} for c in found.iter(q("s:comment"))]
        if links or comments:
            self.add(block("cell_notes", payload=pack({"links": links, "comments": comments})), n)
        drawing = root.find(q("s:drawing"))
        if drawing is not None:
            self.drawing(n, name, rels.get(drawing.get(q("r:id")), ""))

    def add(self, b: dict, n: int) -> None:
        self.out.add(b, unit_kind="sheet", unit_index=n)

    @staticmethod
    def anchor(x) -> dict:
        """Kind, first cell, range and size of an anchor."""
        kind = {"twoCellAnchor": "two_cell", "oneCellAnchor": "one_cell", "absoluteAnchor": "absolute"}[x.tag.rpartition("}")[2]]
        cell = lambda e: letters(int(e.findtext(q("xdr:col"))) + 1) + str(int(e.findtext(q("xdr:row"))) + 1)
        begin, end, ext = x.find(q("xdr:from")), x.find(q("xdr:to")), x.find(q("xdr:ext"))
        out = {"kind": kind, "from_cell": cell(begin) if begin is not None else None, "range": f"{cell(begin)}:{cell(end)}" if begin is not None and end is not None else None}
        return out | ({"width_px": px(ext.get("cx")), "height_px": px(ext.get("cy"))} if ext is not None else {})

    def drawing(self, n: int, sheet: str, part: str) -> None:
        root, rels = self.package.xml(part), self.package.rels(part)
        for a in root if root is not None else ():
            if not a.tag.endswith("Anchor"):
                continue
            where = self.anchor(a)
            for x in a.iter():
                tag = x.tag.rpartition("}")[2]
                name = x.find(f".//{q('xdr:cNvPr')}")
                name = name.get("name") if name is not None else tag
                if x.tag == q("xdr:graphicFrame"):
                    ids, ref = x.find(f".//{q('dgm:relIds')}"), x.find(f".//{q('c:chart')}")
                    if ids is not None:
                        self.add(block("smartart", payload=pack(diagram(self.package, rels, ids, f"sheet_{n}_{len(self.out.points)}", self.out, False) | {"anchor": where, "name": name})), n)
                    elif ref is not None and (c := self.package.xml(rels.get(ref.get(q("r:id")), ""))) is not None:
                        self.add(block("chart", payload=pack(chart(c, named_by_formula=True) | {"anchor": where})), n)
                elif x.tag == q("xdr:pic"):
                    self.picture(n, sheet, x, rels, where)
                elif x.tag == q("xdr:sp"):
                    geom = x.find(f".//{q('a:prstGeom')}")
                    preset = geom.get("prst") if geom is not None else None
                    text = "\n".join("".join(t.text or "" for t in p.iter(q("a:t"))) for p in x.iter(q("a:p"))).strip()
                    plain = preset in (None, "rect", "roundRect", "ellipse")
                    kind = "textbox" if plain else "arrow" if re.search("arrow|callout", preset, re.I) else "other"
                    if text or kind != "textbox":
                        self.add(block("drawing", content=text or None, payload=pack({"name": name, "geom": preset, "shape_kind": kind, "anchor": where})), n)
                elif x.tag == q("xdr:cxnSp"):
                    geom = x.find(f".//{q('a:prstGeom')}")
                    self.add(block("drawing", payload=pack({"name": name, "geom": geom.get("prst") if geom is not None else None, "shape_kind": "connector", "anchor": where})), n)

    def picture(self, n, sheet, x, rels, where) -> None:
        blip = x.find(f".//{q('a:blip')}")
        blob = self.package.read(rels.get(blip.get(q("r:embed"), ""), "")) if blip is not None else None
        self.count += 1
        if blob is None:
            self.out.warnings.append(f"Sheet {sheet!r}: image #{self.count} could not be read")
            return
        name = f"img_s{n}_{self.count}"
        path = f"raw_images/{name}.{'svg' if is_svg(blob) else 'png'}"
        w, h = keep_image(self.out, path, blob)
        props = x.find(f".//{q('xdr:cNvPr')}")
        alt = props.get("descr") if props is not None else None
        self.add(block("image", image={"id": name, "relative_path": path, "width_px": w, "height_px": h, "alt_text": alt, "container_kind": "xlsx_sheet", "container_index": n, "label": sheet, "fetch_status": "ok"}, payload=pack(where)), n)


def parse_xlsx(content: bytes) -> Parsed:
    """Visible sheets: cells with their cached values, merged ranges, extents, links, comments, charts, pictures, diagrams and shapes."""
    return _Reader(content).read()
