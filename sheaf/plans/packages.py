"""Small files in each binary format, built from values: what the queries over real bytes and the tests read."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

#: The formats' public namespaces.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDES = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PARTS = "http://schemas.openxmlformats.org/package/2006/relationships"


@lru_cache(256)
def deflated(body: bytes) -> tuple[int, bytes]:
    """A member's checksum and packed bytes; parts that many packages have alike are packed once."""
    packer = zlib.compressobj(wbits=-15, memLevel=5)
    return zlib.crc32(body), packer.compress(body) + packer.flush()


def zipped(members: dict[str, str | bytes]) -> bytes:
    bodies, listed, at = [], [], 0
    for name, body in members.items():
        plain, path = body.encode() if isinstance(body, str) else body, name.encode()
        crc, packed = deflated(plain)
        about = struct.pack("<HHHHIIIHH", 0 if name.isascii() else 1 << 11, 8, 0, 0x21, crc, len(packed), len(plain), len(path), 0)
        bodies += [b"PK\3\4", struct.pack("<H", 20), about, path, packed]
        listed += [b"PK\1\2", struct.pack("<BBH", 20, 3, 20), about, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), path]
        at += 30 + len(path) + len(packed)
    directory = b"".join(listed)
    return b"".join([*bodies, directory, b"PK\5\6", struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(directory), at, 0)])


def part_links(targets: dict[str, str]) -> str:
    return f'<Relationships xmlns="{PARTS}">' + "".join(f"<Relationship Id={quoteattr(k)} Type=\"link\" Target={quoteattr(v)}/>" for k, v in targets.items()) + "</Relationships>"


def docx(blocks: list) -> bytes:
    """A block is (style or None, runs) or a grid of cells; a run is a text, or (text, URL)."""
    links: dict[str, str] = {}

    def run(piece: str | tuple[str, str]) -> str:
        text, url = (piece, None) if isinstance(piece, str) else piece
        made = f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
        if url is None:
            return made
        links[key := f"link{len(links) + 1}"] = url
        return f'<w:hyperlink r:id="{key}">{made}</w:hyperlink>'

    def block(b) -> str:
        if isinstance(b, list):
            cells = lambda row: "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in row)
            return "<w:tbl>" + "".join(f"<w:tr>{cells(row)}</w:tr>" for row in b) + "</w:tbl>"
        style, runs = b
        about = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{about}{''.join(map(run, runs))}</w:p>"

    body = "".join(map(block, blocks))
    return zipped({"word/document.xml": f'<w:document xmlns:w="{WORD}" xmlns:r="{LINKS}"><w:body>{body}</w:body></w:document>', "word/_rels/document.xml.rels": part_links(links)})


def pptx(slides: list[dict]) -> bytes:
    """A slide has any of title, texts (a text is a string, or (text, URL)), table (a grid), footer and notes."""
    spaces = f'xmlns:p="{SLIDES}" xmlns:a="{DRAWING}" xmlns:r="{LINKS}"'
    members = {"ppt/presentation.xml": f"<p:presentation {spaces}><p:sldIdLst>" + "".join(f'<p:sldId id="{i + 1}" r:id="s{i + 1}"/>' for i in range(len(slides))) + "</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": part_links({f"s{i + 1}": f"slides/page{i + 1}.xml" for i in range(len(slides))})}
    page = lambda inner: f"<p:sld {spaces}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    for i, slide in enumerate(slides):
        links: dict[str, str] = {}

        def paragraph(piece, links=links) -> str:
            text, url = (piece, None) if isinstance(piece, str) else piece
            about = ""
            if url:
                links[key := f"u{len(links) + 1}"] = url
                about = f'<a:rPr><a:hlinkClick r:id="{key}"/></a:rPr>'
            return f"<a:p><a:r>{about}<a:t>{escape(text)}</a:t></a:r></a:p>"

        def shape(kind: str | None, piece, paragraph=paragraph) -> str:
            mark = f'<p:ph type="{kind}"/>' if kind else ""
            return f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:txBody>{paragraph(piece)}</p:txBody></p:sp>"

        inner = shape("title", slide["title"]) if slide.get("title") else ""
        inner += "".join(shape(None, t) for t in slide.get("texts", ()))
        if slide.get("footer"):
            inner += shape("ftr", slide["footer"])
        if slide.get("table"):
            rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{paragraph(c)}</a:txBody></a:tc>" for c in row) + "</a:tr>" for row in slide["table"])
            inner += f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
        if slide.get("notes"):
            links["notes"] = f"../notesSlides/notes{i + 1}.xml"
            members[f"ppt/notesSlides/notes{i + 1}.xml"] = page(shape("body", slide["notes"]))
        members[f"ppt/slides/page{i + 1}.xml"] = page(inner)
        members[f"ppt/slides/_rels/page{i + 1}.xml.rels"] = part_links(links)
    return zipped(members)


@lru_cache(1024)
def column_name(at: int) -> str:
    """A to Z, AA to AZ, and so on."""
    return (column_name(at // 26 - 1) if at >= 26 else "") + chr(65 + at % 26)


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A cell is a text (shared), a number, a truth value, (number, format code), or None."""
    shared: dict[str, int] = {}
    codes: dict[str, int] = {}

    def cell(place: str, value) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str):
            return f'<c r="{place}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        if isinstance(value, tuple):
            return f'<c r="{place}" s="{codes.setdefault(value[1], len(codes)) + 1}"><v>{value[0]!r}</v></c>'
        return f'<c r="{place}"><v>{value}</v></c>'

    space, members = f'xmlns="{SHEETS}" xmlns:r="{LINKS}"', {}
    for i, rows in enumerate(sheets.values()):
        lines = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{column_name(c)}{r + 1}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows) if row)
        members[f"xl/worksheets/grid{i + 1}.xml"] = f"<worksheet {space}><sheetData>{lines}</sheetData></worksheet>"
    members["xl/workbook.xml"] = f"<workbook {space}><sheets>" + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="g{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>"
    members["xl/_rels/workbook.xml.rels"] = part_links({f"g{i + 1}": f"worksheets/grid{i + 1}.xml" for i in range(len(sheets))})
    members["xl/sharedStrings.xml"] = shared_part(tuple(shared))
    members["xl/styles.xml"] = styles_part(tuple(codes))
    return zipped(members)


@lru_cache(64)
def shared_part(texts: tuple[str, ...]) -> str:
    return f'<sst xmlns="{SHEETS}" xmlns:r="{LINKS}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>"


@lru_cache(64)
def styles_part(codes: tuple[str, ...]) -> str:
    formats = "".join(f"<numFmt numFmtId=\"{200 + i}\" formatCode={quoteattr(c)}/>" for i, c in enumerate(codes))
    return f'<styleSheet xmlns="{SHEETS}" xmlns:r="{LINKS}"><numFmts>{formats}</numFmts><cellXfs><xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{200 + i}"/>' for i in range(len(codes))) + "</cellXfs></styleSheet>"


def epub(about: dict[str, str], chapters: dict[str, str], missing: tuple[str, ...] = ()) -> bytes:
    """about: Dublin Core elements; chapters: XHTML by name; missing: names that the spine has and the archive doesn't."""
    names = [*chapters, *missing]
    meta = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in about.items())
    items = "".join(f'<item id="i{i}" href={quoteattr(n)}/>' for i, n in enumerate(names))
    spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(names) + 1))
    book = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    return zipped({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="text/book.opf"/></rootfiles></container>', "text/book.opf": book} | {f"text/{n}": body for n, body in chapters.items()})


def pdf(lines: list[str], compressed: bool = True) -> bytes:
    """One page with these lines, one below the other."""
    shown = [line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for line in lines]
    drawn = ("BT /F1 11 Tf 60 740 Td " + " 0 -15 Td ".join(f"({line}) Tj" for line in shown) + " ET").encode("latin-1")
    body = zlib.compress(drawn) if compressed else drawn
    stream = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(body), b"/Filter/FlateDecode" if compressed else b"", body)
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 5 0 R>>>>/Contents 4 0 R>>", stream, b"<</Type/Font/Subtype/Type1/BaseFont/Courier>>"]
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer\n<</Root 1 0 R/Size 6>>\n%%EOF"


def xls_record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def xls_string(form: str, text: str) -> bytes:
    return struct.pack(form, len(text), 0) + text.encode("latin-1")


@lru_cache(64)
def xls_styles(codes: tuple[str, ...]) -> bytes:
    formats = b"".join(xls_record(0x041E, struct.pack("<H", 180 + i) + xls_string("<HB", code)) for i, code in enumerate(codes))
    return formats + b"".join(xls_record(0x00E0, struct.pack("<HH", 0, code) + bytes(16)) for code in (0, *range(180, 180 + len(codes))))


@lru_cache(64)
def xls_shared(texts: tuple[str, ...]) -> bytes:
    return xls_record(0x00FC, struct.pack("<II", len(texts), len(texts)) + b"".join(xls_string("<HB", t) for t in texts))


def xls(name: str, rows: list[list]) -> bytes:
    """A BIFF8 workbook of one sheet in a compound file. A cell is a text (shared), a number, (number, "date") or (number,
    format code)."""
    record, counted = xls_record, xls_string
    texts = {c: i for i, c in enumerate(dict.fromkeys(c for row in rows for c in row if isinstance(c, str)))}
    begin = record(0x0809, struct.pack("<HHHHII", 0x0600, 5, 0, 0, 0, 0))
    codes = {c: i for i, c in enumerate(dict.fromkeys("yyyy-mm-dd" if c[1] == "date" else c[1] for row in rows for c in row if isinstance(c, tuple)))}
    styles, table = xls_styles(tuple(codes)), xls_shared(tuple(texts))
    made = []
    for r, row in enumerate(rows):
        for c, value in enumerate(row):
            if isinstance(value, str):
                made.append(record(0x00FD, struct.pack("<HHHI", r, c, 0, texts[value])))
            elif isinstance(value, tuple):
                made.append(record(0x0203, struct.pack("<HHHd", r, c, 1 + codes["yyyy-mm-dd" if value[1] == "date" else value[1]], value[0])))
            elif isinstance(value, int) and abs(value) < 1 << 29:
                made.append(record(0x027E, struct.pack("<HHHi", r, c, 0, value << 2 | 2)))
            elif value is not None:
                made.append(record(0x0203, struct.pack("<HHHd", r, c, 0, value)))
    globals_ = lambda place: begin + record(0x0085, struct.pack("<IBB", place, 0, 0) + counted("<BB", name)) + styles + table + record(0x000A)
    stream = b"".join([globals_(len(globals_(0))), begin, *made, record(0x000A)])
    stream = stream.ljust(4096, b"\0")
    stream += bytes(-len(stream) % 512)
    sectors = len(stream) // 512
    chain = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + sectors), 0xFFFFFFFE]  # one sector of the table serves 126 of the stream
    fat = struct.pack(f"<{len(chain)}I", *chain).ljust(512, b"\xff")
    entry = lambda title, kind, start, size: title.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(title) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<III", start, size, 0)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return (head + struct.pack("<I", 0)).ljust(512, b"\xff") + fat + directory + stream
