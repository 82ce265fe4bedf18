"""Office, PDF, Markdown and HTML files composed from ``conversations``, one file for each conversation.

The catalogue reads them back with the parsers and compares what they find with SQL on the table itself. ``k`` of a turn
is (turn + conv_id) % 8; it picks what the turn becomes in a file.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.model import write_png
from ..sources.ooxml import NS

_XMLNS = " ".join(f'xmlns:{k}="{v}"' for k, v in NS.items())
_MAIN = f'xmlns="{NS["s"]}" xmlns:r="{NS["r"]}"'


def png(width: int, height: int) -> bytes:
    """A black picture."""
    return write_png(width, height, 1, bytes(width * height))


def _zip(members: dict[str, str | bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


def _rels(links: dict[str, str], outer: dict[str, str] | None = None) -> str:
    rows = [f'<Relationship Id="{i}" Target={quoteattr(t)}/>' for i, t in links.items()]
    rows += [f'<Relationship Id="{i}" Target={quoteattr(t)} TargetMode="External"/>' for i, t in (outer or {}).items()]
    return f"<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>{''.join(rows)}</Relationships>"


def _diagram(turns) -> tuple[str, str]:
    """A data model with one node for each turn under the first one, listed backwards, and its layout."""
    node = lambda t: f'<dgm:pt modelId="{t["turn"] + 1}"><dgm:t><a:p><a:r><a:t>{escape(t["role"])} {t["turn"]}</a:t></a:r></a:p></dgm:t></dgm:pt>'
    points = '<dgm:pt modelId="0" type="doc"/>' + "".join(node(t) for t in reversed(turns)) + '<dgm:pt modelId="99" type="pres"/>'
    links = '<dgm:cxn srcId="0" destId="1" srcOrd="0"/>' + "".join(f'<dgm:cxn srcId="1" destId="{t["turn"] + 1}" destOrd="{t["turn"]}"/>' for t in reversed(turns[1:])) + '<dgm:cxn type="presOf" srcId="1" destId="99"/>'
    return f"<dgm:dataModel {_XMLNS}><dgm:ptLst>{points}</dgm:ptLst><dgm:cxnLst>{links}</dgm:cxnLst></dgm:dataModel>", f'<dgm:layoutDef {_XMLNS}><dgm:layoutNode name="hierRoot1"/></dgm:layoutDef>'


def _chart(turns, kind: str) -> str:
    """Series `size` of the texts' lengths over the turns' roles."""
    pts = lambda values: "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(values))
    series = f"<c:ser><c:tx><c:strRef><c:f>Turns!$B$1</c:f><c:strCache>{pts(['size'])}</c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache>{pts([t['role'] for t in turns])}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache>{pts([len(t['text']) for t in turns])}</c:numCache></c:numRef></c:val></c:ser>"
    title = f"<c:title><c:tx><c:rich><a:p><a:r><a:t>{len(turns)} turns</a:t></a:r></a:p></c:rich></c:tx></c:title>"
    return f"<c:chartSpace {_XMLNS}><c:chart>{title}<c:plotArea><c:{kind}>{series}</c:{kind}></c:plotArea></c:chart></c:chartSpace>"


def _w(text: str, props: str = "") -> str:
    """Word runs of a text, its line ends as breaks."""
    body = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n"))
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{body}</w:r>"


def docx(conv: int, turns: list[dict]) -> bytes:
    """Paragraph k: 0 heading, 1 list item, 2 styled runs and a link, 3 code, 4 quote, 5 own style, 6 equation, 7 list by style; then a table and drawings."""
    head = "Title" if conv % 9 == 0 else "Subtitle" if conv % 9 == 1 else f"heading {conv % 9}"
    para = lambda body, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>"
    style = lambda name: f'<w:pStyle w:val="{name}"/>'
    body = []
    for t in turns:
        k, text = (t["turn"] + conv) % 8, t["text"]
        if k == 0:
            body.append(para(_w(text), style("Head")))
        elif k == 1:
            body.append(para(_w(text), f'<w:numPr><w:ilvl w:val="{conv % 3}"/><w:numId w:val="{1 + conv % 2}"/></w:numPr>'))
        elif k == 2:
            body.append(para(_w(t["role"], '<w:b/><w:i w:val="0"/>') + _w("") + _w(text, "<w:i/><w:u w:val='single'/>") + f'<w:hyperlink r:id="far">{_w("far")}</w:hyperlink><w:hyperlink w:anchor="near">{_w("near", "<w:b/>")}</w:hyperlink>'))
        elif k == 3:
            body.append(para(_w(text), style("Pre" if conv % 2 else "Source")))
        elif k == 4:
            body.append(para(_w(text), style("Said")))
        elif k == 5:
            body.append(para(_w(text), style("Own" if conv % 2 else "Plain")))
        elif k == 6:
            body.append(para(_w(text) + f"<m:oMath><m:r><m:t>x={t['turn']}</m:t></m:r><m:r><m:t>+1</m:t></m:r></m:oMath>"))
        else:
            body.append(para(_w(text), style("Listed")))
        body.append(para(_w(" ")))
    cell = lambda text, props="": f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{para(_w(text))}</w:tc>"
    rows = f'<w:tr>{cell("turns", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}{cell(f" {len(turns)} ")}</w:tr>'
    for i, t in enumerate(turns):
        merge = '<w:vMerge w:val="restart"/>' if i == 0 else "<w:vMerge/>"
        rows += f"<w:tr>{cell(str(conv) if i == 0 else '', merge)}{cell(t['role'])}{cell(t['text'])}</w:tr>"
    drawing = lambda inner: para(f"<w:r><w:drawing><wp:inline>{inner}</wp:inline></w:drawing></w:r>")
    box = drawing(f'<wp:extent cx="{9525 * (conv + 1)}" cy="19050"/><wps:txbx><w:txbxContent>{para(_w(turns[0]["text"]))}{para(_w(turns[0]["role"]), style("Head"))}</w:txbxContent></wps:txbx>')
    alt = {0: f'descr="seen {conv}"', 1: f'descr="" title="titled {conv}"', 2: ""}[conv % 3]
    picture = drawing(f'<wp:docPr id="1" name="named {conv}" {alt}/><a:blip r:embed="pic"/>') + drawing('<a:blip r:embed="gone"/>')
    tree = drawing('<dgm:relIds r:dm="data" r:lo="layout"/>' if conv % 2 else '<dgm:relIds r:dm="lost" r:lo="lost"/>')
    names = {"Head": head, "Pre": "HTML Preformatted", "Source": "Source Code", "Said": "Intense Quote" if conv % 2 else "Quote", "Own": "Caption", "Plain": "Body Text", "Listed": "List Bullet"}
    listed = '<w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr>'
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/>{listed if i == "Listed" else ""}</w:style>' for i, n in names.items())
    level = lambda i, fmt: f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{fmt}"/></w:lvl>'
    kinds = "".join(f'<w:abstractNum w:abstractNumId="{a}">{"".join(level(i, fmt) for i in range(3))}</w:abstractNum>' for a, fmt in ((5, "bullet"), (6, "decimal")))
    data, layout = _diagram(turns)
    return _zip({
        "word/document.xml": f"<w:document {_XMLNS}><w:body>{''.join(body)}<w:tbl>{rows}</w:tbl>{box}{picture}{tree}</w:body></w:document>", "word/styles.xml": f"<w:styles {_XMLNS}>{styles}</w:styles>",
        "word/numbering.xml": f'<w:numbering {_XMLNS}>{kinds}<w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="6"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": _rels({"pic": "media/p.png", "gone": "media/none.png", "data": "diagrams/data1.xml", "layout": "diagrams/layout1.xml"}, {"far": f"https://example.org/c/{conv}"}),
        "word/media/p.png": png(1 + conv % 5, 3), "word/diagrams/data1.xml": data, "word/diagrams/layout1.xml": layout, "docProps/core.xml": f"<x><dc:title>Talk {conv}</dc:title></x>",
    })


def _a(text: str, props: str = "", run: str = "") -> str:
    """A DrawingML paragraph, line ends as breaks."""
    return f"<a:p>{props}" + "<a:br/>".join(f"<a:r>{run}<a:t>{escape(x)}</a:t></a:r>" for x in text.split("\n")) + "</a:p>"


def pptx(conv: int, turns: list[dict]) -> bytes:
    """A slide for each turn: title, text, table, chart, picture, group with connectors, diagram, notes and comments by k."""
    members: dict[str, str | bytes] = {"ppt/media/p.png": png(2, 1 + conv % 4)}
    box = lambda top, left=0, w=9525, h=9525: f'<a:xfrm><a:off x="{left * 9525}" y="{top * 9525}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm>'
    shape = lambda i, top, body, ph="", left=0: f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="shape {i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{box(top, left)}</p:spPr><p:txBody>{body}</p:txBody></p:sp>'
    frame = lambda top, uri, inner: f'<p:graphicFrame><p:xfrm><a:off x="0" y="{top * 9525}"/><a:ext cx="1" cy="1"/></p:xfrm><a:graphic><a:graphicData uri="{uri}">{inner}</a:graphicData></a:graphic></p:graphicFrame>'
    cxn = lambda i, a, b, preset: f'<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="{i}" name="line"/><p:cNvCxnSpPr><a:stCxn id="{a}"/><a:endCxn id="{b}"/></p:cNvCxnSpPr></p:nvCxnSpPr><p:spPr><a:prstGeom prst="{preset}"/></p:spPr></p:cxnSp>'
    order = {}
    for i, t in enumerate(turns):
        k, n = (t["turn"] + conv) % 8, len(turns) - i  # the parts are numbered backwards; the presentation's list counts
        props = {0: '<a:pPr lvl="1"><a:buChar char="-"/></a:pPr>', 1: '<a:pPr lvl="2"><a:buAutoNum type="arabicPeriod"/></a:pPr>', 2: '<a:pPr algn="ctr"/>'}.get(k, "")
        # The lower one comes first in the file; of equal tops the left one is read first.
        tree = shape(5, 30, _a("right"), left=50) + shape(4, 30, _a("left"), left=10) + shape(3, 20, _a(t["text"], props)) + shape(2, 5, _a(f"{t['role']} {t['turn']}"), '<p:ph type="title"/>') + shape(6, 25, "<a:p/>")
        links, outer = {}, {}
        if k == 2:
            link = '<a:rPr b="1" i="0"><a:hlinkClick r:id="far"/></a:rPr>'
            tree += shape(7, 40, f"<a:p><a:r>{link}<a:t>far</a:t></a:r><a:fld><a:t>field</a:t></a:fld></a:p>")
            outer["far"] = f"https://example.org/c/{conv}"
        elif k == 3:
            grid = f'<a:tr><a:tc gridSpan="2"><a:txBody>{_a(t["role"])}</a:txBody></a:tc><a:tc><a:txBody>{_a("")}</a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody>{_a(str(conv))}</a:txBody></a:tc><a:tc rowSpan="2"><a:txBody>{_a(t["text"])}</a:txBody></a:tc></a:tr>'
            tree += frame(50, "table", f"<a:tbl>{grid}</a:tbl>")
        elif k == 4:
            tree += frame(60, "chart", '<c:chart r:id="chart"/>')
            links["chart"] = f"../charts/chart{n}.xml"
            members[f"ppt/charts/chart{n}.xml"] = _chart(turns, "barChart" if conv % 2 else "pieChart")
        elif k == 5:
            tree += f'<p:pic><p:nvPicPr><p:cNvPr id="8" name="x" descr="/tmp/{conv}.png"/></p:nvPicPr><p:blipFill><a:blip r:embed="pic"/></p:blipFill><p:spPr>{box(70, 1, 19050, 28575)}</p:spPr></p:pic>'
            links["pic"] = "../media/p.png"
        elif k == 6:
            inner = shape(11, 1, _a(t["role"])) + shape(12, 2, _a("end")) + cxn(13, 11, 12, "bentConnector3") + cxn(14, 12, 11, "straightConnector1")
            tree += f"<p:grpSp><p:grpSpPr>{box(80)}</p:grpSpPr>{inner}</p:grpSp>" + cxn(15, 2, 3, "curvedConnector2")
        elif k == 7:
            tree += frame(90, "http://schemas.openxmlformats.org/drawingml/2006/diagram", '<dgm:relIds r:dm="data" r:lo="layout"/>')
            links |= {"data": f"../diagrams/data{n}.xml", "layout": f"../diagrams/layout{n}.xml"}
            members[f"ppt/diagrams/data{n}.xml"], members[f"ppt/diagrams/layout{n}.xml"] = _diagram(turns)
        if t["turn"] % 2:
            links["notes"] = f"../notesSlides/notesSlide{n}.xml"
            members[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {_XMLNS}><p:cSld><p:spTree>{shape(1, 0, _a('7'), '<p:ph type=' + chr(34) + 'sldNum' + chr(34) + '/>')}{shape(2, 0, _a('Note: ' + t['text']), '<p:ph type=' + chr(34) + 'body' + chr(34) + '/>')}</p:spTree></p:cSld></p:notes>"
        else:
            links["comments"] = f"../comments/comment{n}.xml"
            members[f"ppt/comments/comment{n}.xml"] = f'<p:cmLst {_XMLNS}><p:cm authorId="{conv % 3}" dt="2020-01-01"><p:text>{escape(t["text"])}</p:text></p:cm><p:cm authorId="0"><p:text> </p:text></p:cm></p:cmLst>'
        members[f"ppt/slides/slide{n}.xml"] = f"<p:sld {_XMLNS}><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>{tree}</p:spTree></p:cSld></p:sld>"
        members[f"ppt/slides/_rels/slide{n}.xml.rels"] = _rels(links, outer)
        order[f"r{i}"] = f"slides/slide{n}.xml"
    members["ppt/presentation.xml"] = f"<p:presentation {_XMLNS}><p:sldIdLst>{''.join(f'<p:sldId r:id={quoteattr(i)}/>' for i in order)}</p:sldIdLst></p:presentation>"
    members["ppt/_rels/presentation.xml.rels"] = _rels(order)
    members["ppt/commentAuthors.xml"] = f'<p:cmAuthorLst {_XMLNS}><p:cmAuthor id="0" name="Ann" initials="A"/><p:cmAuthor id="1" name="" initials="BB"/></p:cmAuthorLst>'
    return _zip(members)


def xlsx(conv: int, turns: list[dict]) -> bytes:
    """Sheet 1: merged title, blank row, bold header, a row for each turn, links, comments. Sheet 2: hidden. Sheet 3: drawings."""
    inline = lambda ref, text, style=0: f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    heads = ("turn", "role", "text", "half", "long", "day")
    rows = f'<row r="1">{inline("A1", f"Talk {conv}")}</row><row r="3">{"".join(inline(chr(65 + i) + "3", h, 1) for i, h in enumerate(heads))}</row>'
    roles = sorted({t["role"] for t in turns})
    for i, t in enumerate(turns):
        r, n = i + 4, len(t["text"])
        rows += f'<row r="{r}"><c r="A{r}"><v>{t["turn"]}</v></c><c r="B{r}" t="s"><v>{roles.index(t["role"])}</v></c>{inline(f"C{r}", t["text"])}<c r="D{r}"><v>{n / 2}</v></c><c r="E{r}" t="b"><v>{int(n > 500)}</v></c><c r="F{r}" s="2"><v>{43831 + conv % 365}</v></c></row>'
    last = len(turns) + 3
    merged = f'<mergeCells><mergeCell ref="A1:F1"/><mergeCell ref="H4:H{last + 2}"/></mergeCells>'
    links = f'<hyperlinks><hyperlink ref="B4" r:id="far"/><hyperlink ref="A4" location="Turns!A1"/><hyperlink ref="G9"/></hyperlinks>'
    first = f"<worksheet {_MAIN}><sheetData>{rows}</sheetData>{merged}{links}</worksheet>"
    comments = f'<comments {_MAIN}><authors><author>Ann</author><author>Bo</author></authors><commentList><comment ref="C4" authorId="{conv % 2}"><text><r><t>{escape(turns[0]["text"])}</t></r></text></comment></commentList></comments>'
    cell = lambda tag, col, row: f"<xdr:{tag}><xdr:col>{col}</xdr:col><xdr:row>{row}</xdr:row></xdr:{tag}>"
    name = lambda i, text: f'<xdr:cNvPr id="{i}" name="{text}"/>'
    shape = lambda preset, text, label: f'<xdr:sp>{name(3, label)}<a:prstGeom prst="{preset}"/>{_a(text) if text else ""}</xdr:sp>'
    two = lambda inner, col: f'<xdr:twoCellAnchor>{cell("from", col, 1)}{cell("to", col + 2, 4)}{inner}</xdr:twoCellAnchor>'
    one = lambda inner: f'<xdr:oneCellAnchor>{cell("from", 27, conv)}<xdr:ext cx="{9525 * 3}" cy="{9525 * 5}"/>{inner}</xdr:oneCellAnchor>'
    drawing = two(f'<xdr:graphicFrame>{name(1, "c")}<c:chart r:id="chart"/></xdr:graphicFrame>', 0) + one(f'<xdr:pic><xdr:cNvPr id="2" name="p" descr="seen {conv}"/><a:blip r:embed="pic"/></xdr:pic>')
    drawing += two(shape("rect", turns[0]["text"], "note"), 3) + two(shape("rect", "", "empty"), 3) + two(shape("rightArrow", "", "arrow"), 25) + two(shape("star5", turns[0]["role"], "star"), 4)
    drawing += f'<xdr:absoluteAnchor><xdr:ext cx="9525" cy="0"/><xdr:cxnSp>{name(4, "line")}<a:prstGeom prst="line"/></xdr:cxnSp></xdr:absoluteAnchor>' + two(f'<xdr:graphicFrame>{name(5, "tree")}<dgm:relIds r:dm="data" r:lo="layout"/></xdr:graphicFrame>', 0)
    data, layout = _diagram(turns)
    return _zip({
        "xl/workbook.xml": f'<workbook {_MAIN}><sheets><sheet name="Turns" r:id="s1"/><sheet name="Hidden" state="hidden" r:id="s2"/><sheet name="Drawn {conv}" r:id="s3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels({"s1": "worksheets/sheet1.xml", "s2": "worksheets/sheet2.xml", "s3": "/xl/worksheets/sheet3.xml"}), "xl/worksheets/sheet1.xml": first, "xl/worksheets/sheet2.xml": first,
        "xl/worksheets/_rels/sheet1.xml.rels": _rels({"notes": "../comments1.xml"}, {"far": f"https://example.org/c/{conv}"}), "xl/comments1.xml": comments,
        "xl/worksheets/sheet3.xml": f'<worksheet {_MAIN}><sheetData/><drawing r:id="d"/></worksheet>', "xl/worksheets/_rels/sheet3.xml.rels": _rels({"d": "../drawings/drawing1.xml"}),
        "xl/drawings/drawing1.xml": f"<xdr:wsDr {_XMLNS}>{drawing}</xdr:wsDr>", "xl/drawings/_rels/drawing1.xml.rels": _rels({"chart": "../charts/chart1.xml", "pic": "../media/p.png", "data": "../diagrams/data1.xml", "layout": "../diagrams/layout1.xml"}),
        "xl/charts/chart1.xml": _chart(turns, "lineChart"), "xl/media/p.png": png(4, 2), "xl/diagrams/data1.xml": data, "xl/diagrams/layout1.xml": layout,
        "xl/sharedStrings.xml": f"<sst {_MAIN}>{''.join(f'<si><t>{escape(r)}</t></si>' for r in roles)}</sst>",
        "xl/styles.xml": f'<styleSheet {_MAIN}><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/><xf fontId="0" numFmtId="14"/></cellXfs></styleSheet>',
    })


def pdf(conv: int, turns: list[dict]) -> bytes:
    """A page for each turn: the role in large letters, the text's lines in small ones, a link of a kind or images by k; metadata and an outline."""
    shown = lambda x: b"(" + x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    objects: dict[int, bytes] = {}
    pages = [10 + 10 * i for i in range(len(turns))]
    for i, (n, t) in enumerate(zip(pages, turns)):
        k = (t["turn"] + conv) % 8
        lines = b" ".join(b"0 -12 Td " + shown(x) + b" Tj" for x in t["text"].split("\n"))
        drawn = b"q 30 0 0 15 90 300 cm /Im Do Q q 1 0 0 1 6 9 cm 12 0 0 24 0 0 cm /Im Do Q " if k == 5 else b"q 60 0 0 30 0 0 cm /Im Do Q /Jp Do " if k == 6 else b""
        body = zlib.compress(drawn + b"BT /F1 20 Tf 72 740 Td " + shown(f"{t['role']} {t['turn']}") + b" Tj ET BT /F1 10 Tf 72 700 Td " + lines + b" ET")
        target = {0: b"/A <</S /URI /URI " + shown(f"https://example.org/c/{conv}") + b">>", 1: b"/Dest [%d 0 R /Fit]" % pages[0], 2: b"/A <</S /GoTo /D [%d 0 R /Fit]>>" % pages[-1], 3: b"/A <</S /Launch /F (a.txt)>>", 4: b"/A <</S /Named /N /NextPage>>"}.get(k)
        objects[n] = b"<</Type /Page /MediaBox [0 0 612 792] /Contents %d 0 R%s%s>>" % (n + 1, b" /Annots [%d 0 R]" % (n + 2) if target else b"", b" /Resources <</Font <</F1 6 0 R>> /XObject <</Im %d 0 R /Jp %d 0 R>>>>" % (n + 4, n + 5) if drawn else b"")
        if drawn:
            wide = 1 + conv % 5
            samples = zlib.compress(bytes(wide * 2 * (3 if k == 5 else 1)))
            objects[n + 4] = b"<</Subtype /Image /Width %d /Height 2 /BitsPerComponent 8 /ColorSpace %s /Filter /FlateDecode /Length %d>>\nstream\n" % (wide, b"/DeviceRGB" if k == 5 else b"/DeviceGray", len(samples)) + samples + b"\nendstream"
            objects[n + 5] = b"<</Subtype /Image /Width 1 /Height 1 /Filter /JPXDecode>>\nstream\nx\nendstream"
        objects[n + 1] = b"<</Length %d /Filter /FlateDecode>>\nstream\n" % len(body) + body + b"\nendstream"
        if target:
            objects[n + 2] = b"<</Subtype /Link " + target + b">>"
        after = b" /Next %d 0 R" % (pages[i + 1] + 3) if i + 1 < len(pages) else b""
        first = b" /First 5 0 R" if i == 0 else b""
        objects[n + 3] = b"<</Title " + shown(f"{t['role']} {t['turn']}") + b" /Dest [%d 0 R /Fit]%s%s>>" % (n, first, after)
    objects |= {1: b"<</Type /Catalog /Pages 2 0 R /Outlines 3 0 R>>", 2: b"<</Type /Pages /Kids [" + b" ".join(b"%d 0 R" % n for n in pages) + b"] /Count %d>>" % len(pages), 3: b"<</First %d 0 R>>" % (pages[0] + 3)}
    objects |= {4: b"<</Title " + shown(f"Talk {conv}") + b" /Author () /Subject " + shown(turns[0]["role"]) + b" /Producer (folioflow)>>", 5: b"<</Title (inner)>>"}
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj " % n + o + b" endobj\n" for n, o in sorted(objects.items())) + b"trailer <</Root 1 0 R /Info 4 0 R>>\nstartxref\n0\n%%EOF"


def markdown(conv: int, turns: list[dict]) -> bytes:
    """Turn k: 0 heading, 1 list with a nested item, 2 inline styles, 3 fence, 4 quote, 5 table, 6 rule and HTML, 7 numbered list and image."""
    out = [f'---\ntitle: "Talk {conv}"\n---']
    for t in turns:
        k, flat = (t["turn"] + conv) % 8, t["text"].replace("\n", " ")
        out.append({
            0: f"{'#' * (1 + conv % 6)} {flat}", 1: f"- {flat}\n  - inner {t['turn']}", 2: f"**{t['role']}** *{t['turn']}* `{flat}` [far](https://example.org/c/{conv})\nsecond line", 3: f"```py x\n{t['text']}\n```", 4: f"> {flat}",
            5: f"| a | b |\n|---|:-:|\n| {t['role']} | {flat} |\n| **{t['turn']}** |", 6: f"***\n\n<div>\n{flat}\n</div>", 7: f"3. {flat} ![alt {t['turn']}](data:image/png;base64,AAAA)\n4. last",
        }[k])
    return "\n\n".join(out).encode()


def html(conv: int, turns: list[dict]) -> bytes:
    """Turn k: 0 definition list, 1 nested list, 2 styled runs, 3 code, 4 quote, 5 table, 6 rule and figure, 7 caption alone."""
    out = []
    for t in turns:
        k, text = (t["turn"] + conv) % 8, escape(t["text"])
        out.append({
            0: f"<dl><dt>{t['role']}</dt><dd>{text}</dd></dl>", 1: f"<ol><li>{text}<ul><li>inner {t['turn']}</li></ul></li></ol>", 2: f"<p><b>{t['role']}</b><i><u>{t['turn']}</u></i><br><code>{text}</code><a href='/c/{conv}'>far</a></p>",
            3: f"<pre><code class='x language-sql'>{text}</code></pre>", 4: f"<blockquote>{text}</blockquote>", 5: f"<table><tr><th> a </th><th>b</th></tr><tr><td>{t['role']}</td><td colspan=2>{text}</td></tr></table>",
            6: f"<hr><figure><img src='http://example.org/{conv}.png' alt='{t['role']}'><figcaption>{text}</figcaption></figure>", 7: f"<figure><figcaption>{text}</figcaption></figure><p> </p>",
        }[k])
    return f"<html><head><title> Talk {conv} </title><base href='https://example.org/'></head><body>{''.join(out)}</body></html>".encode()


WRITERS: dict[str, Callable[[int, list[dict]], bytes]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf, "markdown": markdown, "html": html}


def files(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """(doc_id, format, content): a file of the format for each conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [WRITERS[fmt](conv, rows) for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fmt] * len(made), pa.string()), pa.array(made, pa.binary())], names=["doc_id", "format", "content"])

    return turns.mapInArrow(run, "doc_id long, format string, content binary")
