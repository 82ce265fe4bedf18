"""What the three Office formats share: zip members, relationships, diagram parts, lengths."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET

from .model import Parsed

# Namespaces.
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "m": "http://schemas.openxmlformats.org/officeDocument/2006/math", "dgm": "http://schemas.openxmlformats.org/drawingml/2006/diagram",
    "c": "http://schemas.openxmlformats.org/drawingml/2006/chart", "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "xdr": "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "wps": "http://schemas.microsoft.com/office/word/2010/wordprocessingShape", "pic": "http://schemas.openxmlformats.org/drawingml/2006/picture",
}
EMU_PER_PX = 9525
# Hints in layout names, in the order in which they are tried.
from ..functions.scalars import CHART_KINDS, LAYOUT_HINTS  # noqa: E402


def q(name: str) -> str:
    """'w:p' as ElementTree writes it."""
    prefix, _, local = name.partition(":")
    return f"{{{NS[prefix]}}}{local}"


def px(emu) -> float:
    return round(int(emu) / EMU_PER_PX, 1) if emu not in (None, "") else 0.0


class Package:
    """An Office file: members are read when they are asked for."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def xml(self, name: str):
        raw = self.read(name)
        return ET.fromstring(raw) if raw is not None else None

    def rels(self, part: str) -> dict[str, str]:
        """Relationship id -> member name (or the outer target as it is) of a part; {} where they cannot be read."""
        folder, name = posixpath.split(part)
        raw = self.read(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        try:
            root = ET.fromstring(raw) if raw else ()
        except ET.ParseError:
            return {}
        out = {}
        for x in root:
            if x.get("Id"):
                target = x.get("Target", "")
                outer = x.get("TargetMode") == "External"
                out[x.get("Id")] = target if outer else posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
        return out

    def numbered(self, pattern: str) -> list[str]:
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]


def diagram(package: Package, rels: dict[str, str], ids, name: str, out: Parsed, fallback: bool) -> dict:
    """A SmartArt payload: layout kind and nodes in tree order; its points and edges also go to the document's tables."""
    data_part, layout_part = rels.get(ids.get(q("r:dm"), "")), rels.get(ids.get(q("r:lo"), ""))
    data, layout = (package.xml(x) if x else None for x in (data_part, layout_part))
    folder = {"data": None, "layout": None}
    if fallback:
        for kind in folder:
            found = sorted(n for n in package.names if re.search(rf"/diagrams/{kind}\d*\.xml$", n))
            folder[kind] = found[0] if found else None
        if data is None and folder["data"]:
            data = package.xml(folder["data"])
        if layout is None and folder["layout"]:
            layout = package.xml(folder["layout"])
    if data is None:
        out.warnings.append(f"{name}: SmartArt data not found")
    points, edges = diagram_tables(data, name) if data is not None else ([], [])
    out.points += points
    out.edges += edges
    names = " ".join(x.get("name", "").lower() for x in layout.iter(q("dgm:layoutNode"))) if layout is not None else ""
    kind = next((k for h, k in LAYOUT_HINTS if h in names), "other")
    return {"layout_kind": kind, "nodes": diagram_nodes(points, edges)}


def diagram_tables(data, name: str) -> tuple[list[dict], list[dict]]:
    points, edges = [], []
    for i, pt in enumerate(data.iter(q("dgm:pt"))):
        if pt.get("modelId"):
            text = "".join(t.text or "" for t in pt.iter(q("a:t"))).strip()
            points.append({"diagram": name, "node": pt.get("modelId"), "type": pt.get("type") or "node", "text": text, "pos": i})
    for i, cxn in enumerate(data.iter(q("dgm:cxn"))):
        if (cxn.get("type") or "parOf") == "parOf" and cxn.get("srcId") and cxn.get("destId"):
            order = cxn.get("destOrd") or cxn.get("srcOrd") or "0"
            edges.append({"diagram": name, "parent": cxn.get("srcId"), "child": cxn.get("destId"), "ord": int(order) if re.fullmatch(r"-?\d+", order) else 0, "pos": i})
    return points, edges


def diagram_nodes(points: list[dict], edges: list[dict]) -> list[dict]:
    """The tree of one diagram, as (text, level) in depth-first order. A node stands once; a doc root without text gives way."""
    real = {p["node"]: p for p in points if p["type"] in ("doc", "node", "asst")}
    below: dict[str, list] = {}
    for e in sorted(edges, key=lambda e: (e["ord"], e["pos"])):
        if e["parent"] in real and e["child"] in real:
            below.setdefault(e["parent"], []).append(e["child"])
    entered = {c for kids in below.values() for c in kids}
    roots = [n for n, p in real.items() if p["type"] == "doc"] or [n for n in real if n not in entered]
    out, met = [], set()
    for root in roots:
        lift = 1 if not real[root]["text"] and below.get(root) else 0
        stack = [(root, 0)]
        while stack:
            node, level = stack.pop()
            if node in met:
                continue
            met.add(node)
            if level >= lift:
                out.append({"text": real[node]["text"], "level": level - lift})
            stack += [(c, level + 1) for c in reversed(below.get(node, [])) if c not in met]
    return out or [{"text": p["text"], "level": 0} for p in real.values() if p["text"]]


def chart(root, *, named_by_formula: bool = False) -> dict:
    """Kind, title, categories and series of a chart part, from its cached values. A workbook's series goes by the formula of its name."""
    kinds = [x.tag.rpartition("}")[2].lower() for x in root.iter() if x.tag.endswith("Chart") and x.tag.startswith(f"{{{NS['c']}}}")]
    name = kinds[0] if kinds else ""
    direction = root.find(f".//{q('c:barDir')}")
    name = "column" if name.startswith("bar") and direction is not None and direction.get("val") == "col" else name
    title = root.find(f"./{q('c:chart')}/{q('c:title')}")
    values = lambda x: [v.text or "" for pt in x.iter(q("c:pt")) for v in pt.findall(q("c:v"))] if x is not None else []
    series, categories = [], []
    for s in root.iter(q("c:ser")):
        head = s.find(q("c:tx"))
        names = values(head) if head is not None else []
        numbers = s.find(q("c:val")) if s.find(q("c:val")) is not None else s.find(q("c:yVal"))
        formula = head.findtext(f".//{q('c:f')}") if head is not None else None
        series.append({"name": formula if formula and (named_by_formula or not names) else names[0] if names else None, "values": values(numbers)})
        categories = categories or values(s.find(q("c:cat")) if s.find(q("c:cat")) is not None else s.find(q("c:xVal")))
    text = "".join(t.text or "" for t in title.iter(q("a:t"))) if title is not None else None
    return {"chart_type": next((k for k in CHART_KINDS if k in name), "other"), "title": text or None, "categories": categories, "series": series}


def pack(payload) -> str:
    return json.dumps(payload, ensure_ascii=False)
