"""What a parser gives back: plain values of one document, and their Spark schema."""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib
from dataclasses import dataclass, field

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,code:boolean,hyperlink:string>"
IMAGE = "struct<id:string,relative_path:string,width_px:int,height_px:int,alt_text:string,container_kind:string,container_index:int,label:string,fetch_status:string,fetch_error:string>"
BBOX = "struct<left:double,top:double,width:double,height:double>"
BLOCK = (
    "struct<unit_kind:string,unit_index:int,ord:int,path:array<int>,type:string,level:int,style:string,list_kind:string,list_level:int,language:string,"
    f"content:string,runs:array<{RUN}>,rows:array<array<string>>,image:{IMAGE},bbox:{BBOX},payload:string,inside:string>"
)
CELL = "struct<sheet:int,row:int,col:int,value:string,kind:string,bold:boolean>"
RANGE = "struct<sheet:int,min_row:int,max_row:int,min_col:int,max_col:int,value:string>"
EXTENT = "struct<sheet:int,name:string,max_row:int,max_col:int>"
POINT = "struct<diagram:string,node:string,type:string,text:string,pos:int>"
EDGE = "struct<diagram:string,parent:string,child:string,ord:int,pos:int>"
BYTES = "struct<relative_path:string,content:binary,width_px:int,height_px:int>"
#: One row per document.
DOCUMENT = (
    f"format string, title string, meta map<string,string>, blocks array<{BLOCK}>, cells array<{CELL}>, merged array<{RANGE}>, extents array<{EXTENT}>, "
    f"points array<{POINT}>, edges array<{EDGE}>, images array<{BYTES}>, warnings array<string>"
)


@dataclass
class Parsed:
    format: str
    title: str | None = None
    meta: dict[str, str] = field(default_factory=dict)
    blocks: list[dict] = field(default_factory=list)
    cells: list[dict] = field(default_factory=list)
    merged: list[dict] = field(default_factory=list)
    extents: list[dict] = field(default_factory=list)
    points: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def add(self, b: dict, *, unit_kind: str = "block", unit_index: int | None = None, above: tuple[int, ...] = (), inside: str | None = None) -> None:
        """Append a block and, flattened after it, its children; a block's path holds its places from the top down, ``inside`` the type of its top-level container."""
        children = b.pop("children", None) or []
        counts = self.__dict__.setdefault("_counts", {})
        place = counts.get((unit_index, above), 0)
        counts[(unit_index, above)] = place + 1
        path = (*above, place)
        index = unit_index if unit_index is not None else path[0]
        self.blocks.append(b | {"unit_kind": unit_kind, "unit_index": index, "ord": len(self.blocks), "path": list(path), "inside": inside})
        for child in children:
            self.add(child, unit_kind=unit_kind, unit_index=index, above=path, inside=inside or b["type"])

    def row(self) -> dict:
        return {k: getattr(self, k) for k in ("format", "title", "meta", "blocks", "cells", "merged", "extents", "points", "edges", "images", "warnings")}


#: What stands before the source of an image that is a file beside the document.
LOCAL = "local file: "


def run(text: str, **styles) -> dict:
    return {"text": text, **{k: v for k, v in styles.items() if v}}


def block(kind: str, **values) -> dict:
    return {"type": kind, **values}


def image_size(blob: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG, GIF, BMP or JPEG; (0, 0) for others."""
    if blob[:8] == b"\x89PNG\r\n\x1a\n" and len(blob) >= 24:
        return struct.unpack(">II", blob[16:24])
    if blob[:4] == b"GIF8" and len(blob) >= 10:
        return struct.unpack("<HH", blob[6:10])
    if blob[:2] == b"BM" and len(blob) >= 26:
        w, h = struct.unpack("<ii", blob[18:26])
        return w, abs(h)
    if blob[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(blob) and blob[at] == 0xFF:
            mark = blob[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", blob[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", blob[at + 2 : at + 4])[0]
    return 0, 0


def write_png(width: int, height: int, bands: int, data: bytes) -> bytes:
    """A PNG file of grey (one band) or RGB (three) samples of 8 bits."""
    row = width * bands
    lines = b"".join(b"\0" + data[k * row : (k + 1) * row] for k in range(height))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if bands == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def is_svg(blob: bytes) -> bool:
    head = blob[:512].lstrip().lower()
    return head.startswith(b"<svg") or head.startswith(b"<?xml") and b"<svg" in head


def keep_image(out: Parsed, path: str, blob: bytes) -> tuple[int, int]:
    """Keep an image's bytes as they are: without an imaging library nothing is re-encoded; other kinds than PNG are noted."""
    w, h = image_size(blob)
    if blob[:8] != b"\x89PNG\r\n\x1a\n":
        out.warnings.append(f"{path}: kept as it is, not a PNG")
    out.images.append({"relative_path": path, "content": blob, "width_px": w, "height_px": h})
    return w, h


def load_image(src: str, alt: str, image_id: str, container: str, out: Parsed, index: int = 1) -> dict:
    """An image by its source: data URIs are decoded; remote ones are skipped; local files fail here and can be joined by path (``files.with_local_images``)."""
    image = {"id": image_id, "relative_path": "", "width_px": 0, "height_px": 0, "alt_text": alt or None, "container_kind": container, "container_index": index}
    m = re.match(r"(?s)data:[^;]+;base64,(.+)$", src or "")
    error, status = None, "failed"
    if not src:
        error = "empty src"
    elif m:
        try:
            blob = base64.b64decode(m[1])
            path = f"raw_images/{image_id}.png"
            w, h = keep_image(out, path, blob)
            return image | {"relative_path": path, "width_px": w, "height_px": h, "fetch_status": "ok"}
        except (binascii.Error, ValueError) as e:
            error = f"data URI decode: {e}"
    elif re.match(r"(?i)https?://", src):
        status, error = "skipped", "remote fetch disabled"
    else:
        error = f"{LOCAL}{src}"
    out.warnings.append(f"Image {src[:200]!r}: {error}")
    return image | {"fetch_status": status, "fetch_error": error}
