"""Presentations to blocks: a unit for each slide, shapes in reading order."""

from __future__ import annotations

import re

from .model import Parsed, block, is_svg, keep_image, run
from .ooxml import Package, chart, diagram, pack, px, q


def _paragraph(p) -> str:
    """Texts and fields of a paragraph; a break is a vertical tab."""
    parts = []
    for x in p:
        if x.tag in (q("a:r"), q("a:fld")):
            parts.append(x.findtext(q("a:t")) or "")
        elif x.tag == q("a:br"):
            parts.append("\v")
    return "".join(parts)


def _lines(elem) -> str:
    return "\n".join(map(_paragraph, elem.iter(q("a:p"))))


def _text(elem) -> str:
    return _lines(elem).strip()


class _Reader:
    def __init__(self, content: bytes):
        self.package, self.out, self.count = Package(content), Parsed("pptx"), 0

    def slides(self) -> list[str]:
        """Slide parts in the order of the presentation."""
        root, rels = self.package.xml("ppt/presentation.xml"), self.package.rels("ppt/presentation.xml")
        listed = [rels.get(x.get(q("r:id"))) for x in root.iter(q("p:sldId"))] if root is not None else []
        return [x for x in listed if x in self.package.names] or self.package.numbered(r"ppt/slides/slide(\d+)\.xml")

    def read(self) -> Parsed:
        parts = self.slides()
        self.out.meta["slide_count"] = str(len(parts))
        for n, part in enumerate(parts, 1):
            self.slide(n, part)
        return self.out

    def slide(self, n: int, part: str) -> None:
        root, self.rels, self.n = self.package.xml(part), self.package.rels(part), n
        title, shapes = None, []
        for x in root.find(f"{q('p:cSld')}/{q('p:spTree')}"):
            kind = x.find(f"{q('p:nvSpPr')}/{q('p:nvPr')}/{q('p:ph')}")
            if kind is not None and kind.get("type") in ("title", "ctrTitle") and title is None:
                title = _text(x) or None
            shapes += self.shape(x)
        shapes.sort(key=lambda s: (s["bbox"]["top"], s["bbox"]["left"]))
        if n == 1 and title:
            self.out.title = title
        for s in shapes:
            self.add(s, n, title)
        notes = next((t for t in self.rels.values() if "notesSlides/" in t), None)
        said = self.notes(notes) if notes else ""
        if said:
            self.out.add(block("paragraph", style="notes", runs=[run(said)]), unit_kind="slide", unit_index=n)
        for c in self.comments():
            self.out.add(block("paragraph", style="comment", runs=[run(f"{c['author']}: {c['text']}")], payload=pack(c)), unit_kind="slide", unit_index=n)

    def add(self, shape: dict, n: int, title: str | None) -> None:
        """A text shape becomes one block for each of its paragraphs, the title a heading."""
        for b in self.flat(shape, title):
            self.out.add(b, unit_kind="slide", unit_index=n)

    def flat(self, shape: dict, title: str | None) -> list[dict]:
        if shape["type"] != "text":
            if shape["type"] == "group":
                inner = [b for c in shape.pop("inner") for b in self.flat(c, None)]
                return [shape | {"children": inner}]
            return [shape]
        out = []
        for p in shape["paragraphs"]:
            if p["runs"]:
                whole = "".join(r["text"] for r in p["runs"]).strip()
                head = title is not None and whole and whole in title.split("\n")
                out.append(block("heading", level=2, runs=p["runs"], bbox=shape["bbox"]) if head else block("paragraph", runs=p["runs"], list_kind=p["kind"], list_level=p["level"] if p["kind"] else None, bbox=shape["bbox"]))
        return out

    def bbox(self, x) -> dict:
        off, ext = x.find(f".//{q('a:off')}"), x.find(f".//{q('a:ext')}[@cx]")
        if x.tag == q("p:graphicFrame"):
            off, ext = x.find(f"{q('p:xfrm')}/{q('a:off')}"), x.find(f"{q('p:xfrm')}/{q('a:ext')}")
        at = lambda e, k: px(e.get(k)) if e is not None else 0.0
        return {"left": at(off, "x"), "top": at(off, "y"), "width": at(ext, "cx"), "height": at(ext, "cy")}

    def paragraphs(self, body) -> list[dict]:
        out = []
        for p in body.findall(q("a:p")):
            props, runs = p.find(q("a:pPr")), []
            for r in p:
                if r.tag == q("a:r"):
                    rp = r.find(q("a:rPr"))
                    link = rp.find(q("a:hlinkClick")) if rp is not None else None
                    on = lambda k: rp is not None and rp.get(k) not in (None, "0", "false", "none")
                    runs.append(run(r.findtext(q("a:t")) or "", bold=on("b"), italic=on("i"), underline=on("u"), hyperlink=self.rels.get(link.get(q("r:id"), "")) if link is not None else None))
            if not runs and (whole := _paragraph(p)):
                runs.append(run(whole))
            kind = None
            if props is not None:
                kind = "bullet" if props.find(q("a:buChar")) is not None else "numbered" if props.find(q("a:buAutoNum")) is not None else None
            out.append({"runs": [r for r in runs if r["text"]], "kind": kind, "level": int(props.get("lvl") or 0) if props is not None else 0})
        return out

    def shape(self, x) -> list[dict]:
        tag, box = x.tag.rpartition("}")[2], self.bbox(x)
        if tag == "graphicFrame":
            data = x.find(f".//{q('a:graphicData')}")
            uri = data.get("uri", "") if data is not None else ""
            if "diagram" in uri:
                ids = data.find(q("dgm:relIds"))
                return [block("smartart", bbox=box, payload=pack(diagram(self.package, self.rels, ids if ids is not None else {}, f"slide_{self.n}_{len(self.out.points)}", self.out, True)))]
            ref = data.find(q("c:chart")) if data is not None else None
            if ref is not None:
                root = self.package.xml(self.rels.get(ref.get(q("r:id")), ""))
                return [block("chart", bbox=box, payload=pack(chart(root) if root is not None else {"series": [], "categories": []}))]
            table = data.find(q("a:tbl")) if data is not None else None
            return [block("table", bbox=box, rows=self.table(table), payload=pack({"spans": self.spans(table)}))] if table is not None else []
        if tag == "pic":
            return self.picture(x, box)
        if tag == "grpSp":
            inner = sorted((s for c in x for s in self.shape(c)), key=lambda s: (s["bbox"]["top"], s["bbox"]["left"]))
            return [block("group", bbox=box, inner=inner, payload=self.flow(x, inner))]
        if tag == "cxnSp":
            ends = [x.find(f".//{q(k)}") for k in ("a:stCxn", "a:endCxn")]
            geom = x.find(f".//{q('a:prstGeom')}")
            preset = geom.get("prst", "").lower() if geom is not None else ""
            facts = {"from": ends[0].get("id") if ends[0] is not None else None, "to": ends[1].get("id") if ends[1] is not None else None, "arrow": "elbow" if "bent" in preset else "curved" if "curve" in preset else "straight", "label": _text(x) or None}
            return [block("connector", bbox=box, payload=pack({k: v for k, v in facts.items() if v}))]
        if tag == "sp":
            body = x.find(q("p:txBody"))
            return [block("text", bbox=box, paragraphs=self.paragraphs(body))] if body is not None else []
        if tag not in ("nvGrpSpPr", "grpSpPr", "extLst"):
            self.out.warnings.append(f"Slide {self.n}: unknown shape {tag}")
        return []

    @staticmethod
    def flow(group, inner) -> str | None:
        """Edges between the named shapes of a group whose connectors, two or more, all have both ends."""
        import json

        ends = [json.loads(s["payload"]) for s in inner if s["type"] == "connector"]
        if len(ends) < 2 or not all(e.get("from") and e.get("to") for e in ends):
            return None
        names = {x.get("id"): x.get("name") for x in group.iter(q("p:cNvPr"))}
        texts = {sp.find(f".//{q('p:cNvPr')}").get("id"): _text(sp).replace("\n", " ") for sp in group.iter(q("p:sp"))}
        label = lambda i: f'S{i}["{(texts.get(i) or names.get(i) or i).replace(chr(34), chr(39))}"]'
        return pack({"hint": "flowchart", "flow": {"edges": [{"from": label(e["from"]), "to": label(e["to"]), "label": e.get("label")} for e in ends]}})

    @staticmethod
    def table(t) -> list[list[str]]:
        return [[_lines(c) for c in tr.findall(q("a:tc"))] for tr in t.findall(q("a:tr"))]

    @staticmethod
    def spans(t) -> list[dict]:
        found = []
        for i, tr in enumerate(t.findall(q("a:tr"))):
            for j, c in enumerate(tr.findall(q("a:tc"))):
                if c.get("rowSpan") or c.get("gridSpan"):
                    found.append({"row": i, "col": j, "rowspan": int(c.get("rowSpan") or 1), "colspan": int(c.get("gridSpan") or 1)})
        return found

    def picture(self, x, box) -> list[dict]:
        blip = x.find(f".//{q('a:blip')}")
        blob = self.package.read(self.rels.get(blip.get(q("r:embed"), ""), "")) if blip is not None else None
        self.count += 1
        name = f"img_s{self.n}_{self.count}"
        props = x.find(f".//{q('p:cNvPr')}")
        alt = props.get("descr") if props is not None else None
        image = {"id": name, "relative_path": "", "width_px": 0, "height_px": 0, "alt_text": alt or None, "container_kind": "pptx_slide", "container_index": self.n, "fetch_status": "failed"}
        if blob is None:
            self.out.warnings.append(f"Slide {self.n}: picture {name} has no part")
        else:
            path = f"raw_images/{name}.{'svg' if is_svg(blob) else 'png'}"
            w, h = keep_image(self.out, path, blob)
            image |= {"relative_path": path, "width_px": w, "height_px": h, "fetch_status": "ok"}
        return [block("image", bbox=box, image=image)]

    def notes(self, part: str) -> str:
        root = self.package.xml(part)
        for sp in root.iter(q("p:sp")) if root is not None else ():
            ph = sp.find(f"{q('p:nvSpPr')}/{q('p:nvPr')}/{q('p:ph')}")
            if ph is not None and ph.get("type") == "body":
                return _text(sp)
        return ""

    def comments(self) -> list[dict]:
        """Comments of the slide with their authors' names, else initials, else Unknown."""
        part = next((t for t in self.rels.values() if re.search(r"comments/[^/]*\.xml$", t)), None)
        root = self.package.xml(part) if part else None
        if root is None:
            return []
        people = self.package.xml("ppt/commentAuthors.xml")
        authors = {a.get("id"): a.get("name") or a.get("initials") or "Unknown" for a in (people if people is not None else ())}
        found = [{"author": authors.get(c.get("authorId"), "Unknown"), "created": c.get("dt"), "text": (c.findtext(q("p:text")) or "").strip()} for c in root.iter(q("p:cm"))]
        return [c for c in found if c["text"]]


def parse_pptx(content: bytes) -> Parsed:
    """Slides with titles, texts, tables, charts, pictures, diagrams, groups, connectors, notes and comments."""
    return _Reader(content).read()
