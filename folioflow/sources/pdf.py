"""PDF files, as far as the standard library goes: text and image operators of Flate-coded content streams, links, outline, metadata.

No page is rendered, and fonts with their own encodings (CID fonts) are not decoded: both are noted in the warnings. Images
are JPEG files as they are, or grey and RGB samples of 8 bits, which are written as PNG; others are noted.
"""

from __future__ import annotations

import re
import statistics
import zlib

from .model import Parsed, block, keep_image, run, write_png
from .ooxml import pack

_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
# Metadata keys.
META = {b"Title": "title", b"Author": "author", b"Subject": "subject", b"Keywords": "keywords", b"Creator": "creator", b"Producer": "producer", b"CreationDate": "creationDate", b"ModDate": "modDate"}
PX = 4 / 3


def text_of(raw: bytes) -> str:
    """A PDF string, literal or hexadecimal."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else escapes.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


class _File:
    def __init__(self, content: bytes):
        if b"/Encrypt" in content[-4096:] or re.search(rb"trailer\s*<<[^>]*/Encrypt", content):
            raise ValueError("PDF is encrypted")
        self.objects = {int(n): body for n, _, body in _OBJ.findall(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)
        self.trailer = b"".join(re.findall(rb"trailer\s*(<<.*?>>)\s*startxref", content, re.S)) + b"".join(b for b in self.objects.values() if b"/XRef" in b[:400])

    def data(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" in body[: m.start()]:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error:
                return b""
        return m[1]

    def _unpack(self, body: bytes) -> None:
        data, n, first = self.data(body), re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
        if not (data and n and first):
            return
        head = list(map(int, data[: int(first[1])].split()[: 2 * int(n[1])]))
        starts = [(head[i], head[i + 1] + int(first[1])) for i in range(0, len(head) - 1, 2)]
        for (num, a), b in zip(starts, [x for _, x in starts[1:]] + [len(data)]):
            self.objects.setdefault(num, data[a:b])

    def inner(self, body: bytes, key: bytes) -> bytes:
        """The dictionary under a key, in place or by reference; empty without one."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|(?=<<))", body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        depth, at = 0, m.end()
        for x in re.finditer(rb"<<|>>", body[m.end() :]):
            depth += 1 if x[0] == b"<<" else -1
            if depth == 0:
                at = m.end() + x.end()
                break
        return body[m.end() : at]

    def image(self, n: int) -> bytes | None:
        """An image object as a JPEG or PNG file; None where its coding is not known."""
        body = self.objects.get(n, b"")
        head = body[: body.find(b"stream")]
        number = lambda key: int(m[1]) if (m := re.search(rb"/" + key + rb"\s+(\d+)", head)) else 0
        if b"/DCTDecode" in head and b"/FlateDecode" not in head:
            m = _STREAM.search(body)
            return m[1] if m else None
        kinds = {b"/DeviceGray": 1, b"/DeviceRGB": 3}
        bands = next((v for k, v in kinds.items() if k in head), 0)
        w, h = number(b"Width"), number(b"Height")
        data = self.data(body)
        if not bands or number(b"BitsPerComponent") != 8 or b"/Predictor" in head or re.search(rb"/(?:JPX|CCITTFax|JBIG2|LZW|RunLength)", head) or len(data) < w * h * bands:
            return None
        return write_png(w, h, bands, data)

    def refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[bytes]:
        out, seen = [], set()

        def walk(n):
            if n in seen or n not in self.objects:
                return
            seen.add(n)
            body = self.objects[n]
            if re.search(rb"/Type\s*/Pages\b", body):
                for k in self.refs(body, b"Kids"):
                    walk(k)
            elif re.search(rb"/Type\s*/Page\b", body):
                self.numbers[n] = len(out) + 1
                out.append(body)

        self.numbers: dict[int, int] = {}
        roots = self.refs(self.trailer, b"Root")
        for r in roots:
            for top in self.refs(self.objects.get(r, b""), b"Pages"):
                walk(top)
        if not out:
            for n in sorted(self.objects):
                walk(n)
        return out


def _spans(data: bytes) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of every string shown, from the text and matrix operators."""
    out, stack, size, leading = [], [], 0.0, 0.0
    tm, line = [1, 0, 0, 1, 0.0, 0.0], [0.0, 0.0]
    array: list | None = None

    def num(k):
        return float(stack[k])

    def show(text):
        if text:
            out.append((tm[4], tm[5], size * abs(tm[3] or tm[0]), text))
            tm[4] += len(text) * size * 0.5 * abs(tm[0])

    for m in _TOKEN.finditer(data):
        t = m[0]
        c = t[:1]
        if t == b"[":
            array = []
        elif t == b"]":
            stack.append(array or [])
            array = None
        elif c in b"(<":
            (array if array is not None else stack).append(text_of(t))
        elif c in b"+-.0123456789":
            (array if array is not None else stack).append(float(t))
        elif c == b"/":
            stack.append(t)
        else:
            try:
                if t == b"Tf":
                    size = num(-1)
                elif t == b"TL":
                    leading = num(-1)
                elif t == b"BT":
                    tm, line = [1, 0, 0, 1, 0.0, 0.0], [0.0, 0.0]
                elif t == b"Tm":
                    tm = [float(x) for x in stack[-6:]]
                    line = tm[4:6]
                elif t in (b"Td", b"TD"):
                    if t == b"TD":
                        leading = -num(-1)
                    line = [line[0] + num(-2) * tm[0], line[1] + num(-1) * tm[3]]
                    tm[4:6] = line
                elif t in (b"T*", b"'", b'"'):
                    line = [line[0], line[1] - leading * tm[3]]
                    tm[4:6] = line
                    if t != b"T*":
                        show(stack[-1])
                elif t == b"Tj":
                    show(stack[-1])
                elif t == b"TJ":
                    show("".join(x if isinstance(x, str) else " " if x < -200 else "" for x in stack[-1]))
            except (IndexError, TypeError, ValueError):
                pass
            stack.clear()
    return out


def _placed(data: bytes) -> list[tuple[bytes, tuple[float, float, float, float]]]:
    """(name, x0, y0, x1, y1) of every XObject drawn, from the matrix operators."""
    out, stack, saved, ctm = [], [], [], (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    for m in _TOKEN.finditer(data):
        t = m[0]
        if t == b"q":
            saved.append(ctm)
        elif t == b"Q":
            ctm = saved.pop() if saved else ctm
        elif t == b"cm" and len(stack) >= 6 and all(isinstance(x, float) for x in stack[-6:]):
            a, b, c, d, e, f = stack[-6:]
            A, B, C, D, E, F_ = ctm
            ctm = (a * A + b * C, a * B + b * D, c * A + d * C, c * B + d * D, e * A + f * C + E, e * B + f * D + F_)
        elif t == b"Do" and stack and isinstance(stack[-1], bytes):
            a, b, c, d, e, f = ctm
            xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
            out.append((stack[-1][1:], (min(xs), min(ys), max(xs), max(ys))))
        if t[:1] in b"+-.0123456789":
            stack.append(float(t))
        elif t[:1] == b"/":
            stack.append(t)
        else:
            stack.clear()
    return out


def _images(f: _File, page: bytes, data: bytes, n: int, height: float, out: Parsed) -> None:
    """A block for every place of every image of a page; places of one image share its file."""
    spots: dict[bytes, list] = {}
    for name, box in _placed(data):
        spots.setdefault(name, []).append(box)
    count = 0
    for name, num in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", f.inner(f.inner(page, b"Resources"), b"XObject")):
        if not re.search(rb"/Subtype\s*/Image", f.objects.get(int(num), b"")):
            continue
        count += 1
        blob = f.image(int(num))
        if blob is None:
            out.warnings.append(f"Page {n}: image #{count} extract failed: coding not known")
            continue
        name_, path = f"img_p{n}_{count}", f"raw_images/img_p{n}_{count}.png"
        w, h = keep_image(out, path, blob)
        boxes = spots.get(name) or [None]
        for k, box in enumerate(boxes, 1):
            image = {"id": name_ if len(boxes) == 1 else f"{name_}_{k}", "relative_path": path, "width_px": w, "height_px": h, "container_kind": "pdf_page", "container_index": n, "label": f"Page {n}", "fetch_status": "ok"}
            place = {"left": round(box[0] * PX, 1), "top": round((height - box[3]) * PX, 1), "width": round((box[2] - box[0]) * PX, 1), "height": round((box[3] - box[1]) * PX, 1)} if box else None
            out.add(block("image", image=image, bbox=place), unit_kind="page", unit_index=n)


def _text_blocks(spans, height: float) -> list[dict]:
    """Lines of one height, then blocks of lines close to each other, top-down."""
    lines: list[list] = []
    for x, y, size, text in sorted(spans, key=lambda s: (-round(s[1], 1), s[0])):
        if lines and abs(lines[-1][0] - y) < 2:
            lines[-1][2].append((x, text, size))
        else:
            lines.append([y, x, [(x, text, size)]])
    out: list[dict] = []
    for y, x, parts in lines:
        size = max(s for _, _, s in parts) or 1.0
        text = "".join(t for _, t, _ in parts)
        last = out[-1] if out else None
        if last and last["y"] - y < 1.6 * max(size, last["size"]) and abs(last["size"] - size) < 0.5:
            last["lines"].append(text)
            last["sizes"] += [s for _, _, s in parts]
            last["y"], last["left"] = y, min(last["left"], x)
        else:
            out.append({"top": y + size, "y": y, "left": x, "size": size, "lines": [text], "sizes": [s for _, _, s in parts]})
    made = []
    for b in out:
        text = "\n".join(b["lines"]).strip()
        if text:
            width = max(len(t) for t in b["lines"]) * b["size"] * 0.5
            made.append({"text": text, "size": sum(b["sizes"]) / len(b["sizes"]), "sizes": b["sizes"], "bbox": {"left": round(b["left"] * PX, 1), "top": round((height - b["top"]) * PX, 1), "width": round(width * PX, 1), "height": round((b["top"] - b["y"]) * PX, 1)}})
    return sorted(made, key=lambda b: (b["bbox"]["top"], b["bbox"]["left"]))


def parse_pdf(content: bytes) -> Parsed:
    """Pages with text blocks in reading order, images, link annotations, metadata, outline and whether the document is a scan."""
    f, out = _File(content), Parsed("pdf")
    densities = []
    pages = f.pages()
    for n, page in enumerate(pages, 1):
        m = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", page)
        x0, y0, x1, y1 = map(float, m.groups()) if m else (0, 0, 612, 792)
        data = b"\n".join(f.data(f.objects.get(r, b"")) for r in f.refs(page, b"Contents"))
        blocks = _text_blocks(_spans(data), y1 - y0)
        densities.append(sum(len(b["text"]) for b in blocks) / max(1.0, (x1 - x0) * (y1 - y0)) * 1000)
        sizes = [s for b in blocks for s in b["sizes"]]
        median = statistics.median(sizes) if sizes else 0
        for b in blocks:
            likely = b["size"] > 1.15 * median
            out.add(block("text", runs=[run(b["text"])], content=b["text"], bbox=b["bbox"], payload=pack({"font_size": round(b["size"], 2), "likely_heading": likely})), unit_kind="page", unit_index=n)
        _images(f, page, data, n, y1 - y0, out)
        links = []
        for r in f.refs(page, b"Annots"):
            body = f.objects.get(r, b"")
            if uri := re.search(rb"/URI\s*(\((?:[^()\\]|\\.)*\))", body):
                links.append({"kind": "uri", "uri": text_of(uri[1])})
            elif dest := re.search(rb"/(?:Dest|D)\s*\[\s*(\d+)\s+\d+\s+R", body):
                links.append({"kind": "goto", "target_page": f.numbers.get(int(dest[1]))})
            elif re.search(rb"/S\s*/Launch", body):
                target = re.search(rb"/F\s*(?:<<.*?/F\s*)?(\((?:[^()\\]|\\.)*\))", body, re.S)
                links.append({"kind": "launch", "uri": text_of(target[1]) if target else None})
            elif b"/Link" in body:
                links.append({"kind": "named" if b"/Named" in body else "other"})
        if links:
            out.add(block("links", payload=pack({"links": links})), unit_kind="page", unit_index=n)
        if re.search(rb"/Subtype\s*/Type0", b"".join(f.objects.get(r, b"") for r in f.refs(page, b"F\\d+"))):
            out.warnings.append(f"Page {n}: fonts with their own encoding are not decoded")
    for r in f.refs(f.trailer, b"Info"):
        for key, name in META.items():
            m = re.search(rb"/" + key + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", f.objects.get(r, b""))
            if m and text_of(m[1]):
                out.meta[name] = text_of(m[1])
    out.title = out.meta.get("title")
    out.meta |= {"page_count": str(len(pages)), "is_scanned": str(bool(densities) and sum(densities) / len(densities) < 0.5).lower()}
    outline = []

    def walk(n, level, seen):
        while n and n not in seen:
            seen.add(n)
            body = f.objects.get(n, b"")
            t, d = re.search(rb"/Title\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", body), re.search(rb"/Dest\s*\[\s*(\d+)", body)
            outline.append([level, text_of(t[1]) if t else "", f.numbers.get(int(d[1]), -1) if d else -1])
            for k in f.refs(body, b"First"):
                walk(k, level + 1, seen)
            n = next(iter(f.refs(body, b"Next")), None)

    for r in f.refs(f.trailer, b"Root"):
        for o in f.refs(f.objects.get(r, b""), b"Outlines"):
            for k in f.refs(f.objects.get(o, b""), b"First"):
                walk(k, 1, set())
    if outline:
        out.meta["outline"] = pack(outline)
    out.warnings.append("pages are not rendered")
    return out
