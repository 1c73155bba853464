"""Zipped document formats: workbooks, documents, decks, books. Parts are parsed in Arrow batches into flat blocks;
blocks become Markdown natively."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function, slices
from ..functions.charset import decode_bytes
from ..functions.tables import greatest_width, render_table
from ..functions.text import escape_cell, let, trim_ws
from .archives import book_metadata
from .dispatch import Source, result
from .feeds import local
from .html import html_to_markdown
from .number_formats import BUILT_IN, shown_number, shown_text

#: Limits of a package, as nothing else bounds what a small file unpacks to.
PACKAGE_ENTRIES, PACKAGE_BYTES = 10_000, 256 << 20


class Unsupported(ValueError):
    pass


def open_package(data: bytes) -> dict[str, bytes]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            infos = [i for i in archive.infolist() if not i.is_dir()]
            if len(infos) > PACKAGE_ENTRIES or sum(i.file_size for i in infos) > PACKAGE_BYTES:
                raise ValueError("the package is over the limit")
            return {i.filename: archive.read(i) for i in infos}
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
        raise ValueError(f"not a package: {e}") from e


def remembered(read: Callable) -> Callable:
    """What small parts are read to, which many packages have alike; only a few hundred are kept. What is returned is
    not to be changed."""
    kept = lru_cache(256)(read)

    @wraps(read)
    def call(data: bytes, *args):
        return (kept if len(data) <= 1 << 16 else read)(data, *args)

    call.kept = kept
    return call


@lru_cache(4096)
def plain_name(name: str) -> str:
    """A tag's or an attribute's local name, in lower case."""
    return local(name).lower()


def child(node: ET.Element | None, name: str) -> ET.Element | None:
    if node is not None:
        name = name.lower()
        for c in node:
            if plain_name(c.tag) == name:
                return c
    return None


def children(node: ET.Element | None, name: str) -> list[ET.Element]:
    name = name.lower()
    return [c for c in node if plain_name(c.tag) == name] if node is not None else []


def attribute(node: ET.Element, name: str, namespace: str | None = None) -> str:
    """By its local name, in any case; with a part of a namespace, only in such a one."""
    name = name.lower()
    for key, value in node.attrib.items():
        if plain_name(key) == name and (namespace is None or namespace in key.rpartition("}")[0]):
            return value
    return ""


def relationships(package: dict[str, bytes], part: str, base: str) -> dict[str, str]:
    """Targets by id: web and mail addresses as they are, others as names of parts; a leading slash is the root."""
    data = package.get(part)
    return targets(data, base) if data else {}


@remembered
def targets(data: bytes, base: str) -> dict[str, str]:
    out = {}
    for r in ET.fromstring(data):
        target = attribute(r, "Target")
        web = target.startswith(("http://", "https://", "mailto:"))
        out[attribute(r, "Id")] = target if web else posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(base, target))
    return out


# -- running text, shared by documents and decks


def spaced(parts: list[tuple[str, bool]]) -> str:
    """Fragments in order; a space goes before one whose predecessor preserves space where neither has any."""
    if len(parts) == 1:
        return parts[0][0]
    out, before = "", False
    for text, preserve in parts:
        if text and out and before and not out[-1].isspace() and not text[0].isspace():
            out += " "
        out += text
        before = preserve if text else before
    return out


def inline(text: str) -> str:
    if "\n" not in text:
        return " ".join(text.split())
    return "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()


def preserves(node: ET.Element) -> bool:
    return any(n.attrib and attribute(n, "space", "XML/1998") == "preserve" for n in node.iter())


# -- word documents


def word_inline(node: ET.Element, rels: dict[str, str]) -> str:
    parts = []
    several = len(node) > 1  # whether space is preserved matters to what follows alone
    for c in node:
        name = plain_name(c.tag)
        if name == "t":
            text = "".join(c.itertext())
        elif name == "tab":
            text = " "
        elif name in ("br", "cr"):
            text = "\n"
        elif name == "nobreakhyphen":
            text = "-"
        elif name in ("deltext", "instrtext", "rpr", "ppr"):
            text = ""
        elif name == "hyperlink":
            text = word_inline(c, rels)
            target = rels.get(attribute(c, "id", "relationships"), "")
            text = f"[{inline(text)}]({target})" if target and inline(text) else text
        else:
            text = word_inline(c, rels)
        parts.append((text, several and preserves(c)))
    return spaced(parts)


def word_cell(cell: ET.Element, rels: dict[str, str]) -> str:
    out = []
    for c in cell:
        name = plain_name(c.tag)
        if name == "p":
            out.append(inline(word_inline(c, rels)))
        elif name == "tbl":
            out += [" ".join(row) for row in word_grid(c, rels)]
    return "\n".join(x for x in out if x)


def word_grid(table: ET.Element, rels: dict[str, str]) -> list[list[str]]:
    return [[word_cell(tc, rels) for tc in children(tr, "tc")] for tr in children(table, "tr")]


def parse_docx(data: bytes) -> tuple[list[dict], str]:
    package = open_package(data)
    if "word/document.xml" not in package:
        raise Unsupported
    body = child(ET.fromstring(package["word/document.xml"]), "body")
    if body is None:
        raise Unsupported
    rels = relationships(package, "word/_rels/document.xml.rels", "word")
    blocks, title = [], ""
    for c in body:
        name = plain_name(c.tag)
        if name == "p":
            style = child(child(c, "pPr"), "pStyle")
            style = attribute(style, "val") if style is not None else ""
            text = inline(word_inline(c, rels))
            if text:
                blocks.append({"style": style, "text": text, "grid": None})
                if not title and re.fullmatch("(?i)title|subtitle|heading[1-6]", style):
                    title = text
        elif name == "tbl":
            blocks.append({"style": "", "text": "", "grid": word_grid(c, rels)})
    return blocks, title


def styled_paragraph(style: Column, text: Column) -> Column:
    """Titles are first-level headings, heading1 to heading6 as deep as their number; other styles are plain."""
    name = F.lower(style)
    level = F.when(name.isin("title", "subtitle"), 1).when(name.rlike(r"\Aheading[1-6]\z"), F.regexp_extract(name, r"(\d)", 1).cast("int"))
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), text)).otherwise(text)


def cell_with_breaks(text: Column) -> Column:
    return escape_cell(text, "<br>")


# -- decks

SKIPPED = {"dt", "ftr", "hdr", "sldnum", "sldimg"}


def deck_text(body: ET.Element | None, rels: dict[str, str]) -> str:
    lines = []
    for p in children(body, "p"):
        parts = []
        for r in p:
            name = plain_name(r.tag)
            if name in ("r", "fld"):
                t = child(r, "t")
                text = "".join(t.itertext()) if t is not None else ""
                link = child(child(r, "rPr"), "hlinkClick")
                target = rels.get(attribute(link, "id", "relationships"), "") if link is not None else ""
                parts.append((f"[{inline(text)}]({target})" if target and text.strip() else text, preserves(r)))
            elif name in ("br", "tab"):
                parts.append(("\n" if name == "br" else " ", False))
        lines.append(inline(spaced(parts)))
    return "\n".join(x for x in lines if x)


def deck_blocks(tree: ET.Element | None, rels: dict[str, str], notes: bool) -> tuple[str, list[dict]]:
    title, blocks = "", []

    def walk(node: ET.Element) -> None:
        nonlocal title
        for c in node:
            name = plain_name(c.tag)
            if name == "grpsp":
                walk(c)
            elif name == "graphicframe":
                table = child(child(child(c, "graphic"), "graphicData"), "tbl")
                if table is not None:
                    blocks.append({"text": None, "grid": [[deck_text(child(tc, "txBody"), rels) for tc in children(tr, "tc")] for tr in children(table, "tr")]})
            elif name == "sp":
                ph = child(child(child(c, "nvSpPr"), "nvPr"), "ph")
                kind = attribute(ph, "type").lower() if ph is not None else ""
                if kind in SKIPPED or notes and kind in ("title", "ctrtitle"):
                    continue
                text = deck_text(child(c, "txBody"), rels)
                if not text:
                    continue
                if kind in ("title", "ctrtitle") and not title and not notes:
                    title = text.split("\n")[0].strip()
                else:
                    blocks.append({"text": text, "grid": None})

    if tree is not None:
        walk(tree)
    return title, blocks


def part_rels(package: dict[str, bytes], part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    return relationships(package, f"{folder}/_rels/{name}.rels", folder)


def plain_table(grid: list[list[str]]) -> str:
    width = max(map(len, grid), default=0)
    if not width:
        return ""
    cell = lambda x: x.replace("|", "\\|").replace("\n", "<br>").strip()
    rows = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in grid]
    return "\n".join([rows[0], "| " + " | ".join(["---"] * width) + " |", *rows[1:]])


def parse_pptx(data: bytes) -> list[dict]:
    package = open_package(data)
    if "ppt/presentation.xml" not in package:
        raise Unsupported
    rels = relationships(package, "ppt/_rels/presentation.xml.rels", "ppt")
    ids = children(child(ET.fromstring(package["ppt/presentation.xml"]), "sldIdLst"), "sldId")
    parts = [rels[i] for i in (attribute(s, "id", "relationships") for s in ids) if i in rels]
    if not parts:
        raise Unsupported
    slides = []
    for part in parts:
        if part not in package:
            raise ValueError(f"slide part {part} is missing")
        own = part_rels(package, part)
        tree = child(child(ET.fromstring(package[part]), "cSld"), "spTree")
        title, blocks = deck_blocks(tree, own, notes=False)
        noted = ""
        found = sorted(t for t in own.values() if "/notesSlides/" in t and t.lower().endswith(".xml") and t in package)
        if found:
            try:
                inner = child(child(ET.fromstring(package[found[0]]), "cSld"), "spTree")
                noted = "\n\n".join(b["text"] for b in deck_blocks(inner, part_rels(package, found[0]), notes=True)[1] if b["text"])
            except ET.ParseError:
                pass
        slides.append({"title": title, "blocks": [b["text"] if b["grid"] is None else plain_table(b["grid"]) for b in blocks], "notes": noted})
    return slides


def render_slides(slides: Column) -> Column:
    """Numbered slides with their blocks and notes, from array<struct<title, blocks, notes>>."""
    some = lambda c: F.nullif(trim_ws(c), F.lit(""))

    def slide(s: Column, i: Column) -> Column:
        head = F.concat(F.lit("## Slide "), (i + 1).cast("string"), F.coalesce(F.concat(F.lit(": "), some(s["title"])), F.lit("")))
        blocks = F.filter(F.transform(s["blocks"], trim_ws), lambda b: b != "")
        return F.concat_ws("\n\n", head, F.nullif(F.array_join(blocks, "\n\n"), F.lit("")), F.concat(F.lit("### Notes\n\n"), some(s["notes"])))

    return F.array_join(F.transform(slides, slide), "\n\n")


# -- workbooks


@lru_cache(1 << 16)
def cell_place(name: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Za-z]+)(\d+)", name).groups()
    column = 0
    for c in letters.upper():
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def rich_text(node: ET.Element | None) -> str:
    """The text of a string item, its phonetic runs left out."""
    if node is None:
        return ""
    parts = []
    for c in node:
        name = local(c.tag)
        parts.append("".join(c.itertext()) if name == "t" else rich_text(c) if name == "r" else "")
    return "".join(parts)


@remembered
def book_sheets(data: bytes) -> tuple[list[tuple[str, str]], bool]:
    """Each sheet's name and the id of its part, and whether days count from 1904."""
    book = ET.fromstring(data)
    props = child(book, "workbookPr")
    epoch = props is not None and attribute(props, "date1904") in ("1", "true")
    return [(attribute(sheet, "name"), attribute(sheet, "id", "relationships")) for sheet in children(child(book, "sheets"), "sheet")], epoch


@remembered
def shared_strings(data: bytes) -> list[str]:
    return [rich_text(si) for si in children(ET.fromstring(data), "si")]


@remembered
def cell_formats(data: bytes) -> list[str | None]:
    """The format codes by number of style."""
    styles = ET.fromstring(data)
    codes = {int(attribute(n, "numFmtId")): attribute(n, "formatCode") for n in children(child(styles, "numFmts"), "numFmt")}
    return [codes.get(k, BUILT_IN.get(k)) for k in (int(attribute(x, "numFmtId") or 0) for x in children(child(styles, "cellXfs"), "xf"))]


#: Names of a cell's attributes; among these alone, none is another's in another case.
CELL = frozenset(("r", "s", "t", "cm", "vm", "ph"))


def parse_xlsx(data: bytes) -> list[dict]:
    package = open_package(data)
    if "xl/workbook.xml" not in package:
        raise ValueError("no workbook in the package")
    listed, epoch = book_sheets(package["xl/workbook.xml"])
    rels = relationships(package, "xl/_rels/workbook.xml.rels", "xl")
    shared = shared_strings(package["xl/sharedStrings.xml"]) if "xl/sharedStrings.xml" in package else []
    formats = cell_formats(package["xl/styles.xml"]) if "xl/styles.xml" in package else []

    def value(c: ET.Element, about: dict[str, str]) -> str:
        kind, v = about.get("t", ""), child(c, "v")
        raw = (v.text or "") if v is not None else ""
        style = about.get("s", "")
        code = formats[int(style)] if style.isdigit() and int(style) < len(formats) else None
        if kind == "s":
            return shown_text(shared[int(raw)], code) if raw.isdigit() and int(raw) < len(shared) else ""
        if kind == "inlineStr":
            return shown_text(rich_text(child(c, "is")), code)
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE" if raw else ""
        if kind in ("str", "e", "d") or not raw:
            return raw
        try:
            return shown_number(float(raw), code, epoch)
        except (ValueError, OverflowError):
            return raw

    sheets = []
    for name, key in listed:
        part = rels.get(key)
        rows: list[list[str]] = []
        for r, row in enumerate(children(child(ET.fromstring(package[part]), "sheetData"), "row")) if part in package else []:
            at = int(attribute(row, "r") or r + 1) - 1
            cells: list[str] = []
            for c in children(row, "c"):
                about = c.attrib if CELL.issuperset(c.attrib) else {n: attribute(c, n) for n in "rst"}
                where = cell_place(about["r"])[1] if about.get("r") else len(cells)
                cells += [""] * (where - len(cells))
                cells.append(value(c, about))
            while cells and not cells[-1]:
                cells.pop()
            rows += [[] for _ in range(min(at - len(rows), 1 << 20))] + [cells]
        while rows and not rows[-1]:
            rows.pop()
        sheets.append({"name": name, "grid": rows})
    return sheets


def render_sheets(sheets: Column) -> Column:
    """A heading for each sheet, and its table if it has rows, from array<struct<name, grid>>."""
    sheet = lambda s: F.concat_ws("\n\n", F.concat(F.lit("## "), s["name"]), F.nullif(render_table(s["grid"], greatest_width(s["grid"])), F.lit("")))
    return F.array_join(F.transform(sheets, sheet), "\n\n")


# -- books


def parse_epub(data: bytes) -> dict:
    package = open_package(data)
    if "META-INF/container.xml" not in package:
        raise Unsupported
    roots = [n for n in ET.fromstring(package["META-INF/container.xml"]).iter() if local(n.tag) == "rootfile"]
    path = attribute(roots[0], "full-path") if roots else ""
    if path not in package:
        raise Unsupported
    book = ET.fromstring(package[path])
    meta, base = child(book, "metadata"), posixpath.dirname(path)
    texts = lambda name: ["".join(n.itertext()).strip() for n in children(meta, name)]
    last = lambda name: texts(name)[-1] if texts(name) else ""
    hrefs = {attribute(i, "id"): posixpath.normpath(posixpath.join(base, attribute(i, "href"))) for i in children(child(book, "manifest"), "item")}
    chapters = []
    for ref in children(child(book, "spine"), "itemref"):
        name = hrefs.get(attribute(ref, "idref"))
        if name in package:
            text = html_to_markdown(decode_bytes(package[name], None))[0].strip()
            if text:
                chapters.append(text)
    return {"title": last("title"), "creators": texts("creator"), "language": last("language"), "publisher": last("publisher"), "date": last("date"), "description": last("description"), "identifier": last("identifier"), "chapters": chapters}


# -- converters


def reader(parse: Callable[[bytes], object], kind: str):
    """An Arrow function of bytes: struct<value, error>; what a file breaks on is that file's error."""

    @arrow_function(f"struct<value:{kind},error:string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in (x for whole in batches for x in slices(whole)):
            out = []
            for data in batch:
                if data is None:  # a row that isn't for this converter
                    out.append((None, None))
                    continue
                try:
                    out.append((parse(bytes(data)), None))
                except Unsupported:
                    out.append((None, "unsupported"))
                except Exception as e:  # noqa: BLE001  broken files fail in many ways
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

    return read


GRID = "array<array<string>>"
read_xlsx = reader(parse_xlsx, f"array<struct<name:string,grid:{GRID}>>")
read_docx = reader(lambda data: dict(zip(("blocks", "title"), parse_docx(data), strict=True)), f"struct<blocks:array<struct<style:string,text:string,grid:{GRID}>>,title:string>")
read_pptx = reader(parse_pptx, "array<struct<title:string,blocks:array<string>,notes:string>>")
read_epub = reader(parse_epub, "struct<title:string,creators:array<string>,language:string,publisher:string,date:string,description:string,identifier:string,chapters:array<string>>")


def read_once(parsed: Column, markdown: Callable[[Column], Column], title: Callable[[Column], Column] | None = None) -> Column:
    """A converter's result from struct<value, error>."""
    return let(parsed, lambda p: result(markdown(p["value"]), title(p["value"]) if title else None, p["error"]))


def xlsx(source: Source) -> Column:
    return read_once(read_xlsx(source.content), render_sheets)


def docx(source: Source) -> Column:
    block = lambda b: F.when(b["grid"].isNotNull(), render_table(b["grid"], greatest_width(b["grid"]), cell_with_breaks)).otherwise(styled_paragraph(b["style"], b["text"]))
    return read_once(read_docx(source.content), lambda v: F.array_join(F.filter(F.transform(v["blocks"], block), lambda x: x != ""), "\n\n"), lambda v: v["title"])


def pptx(source: Source) -> Column:
    return read_once(read_pptx(source.content), render_slides, lambda v: F.nullif(F.get(v, F.lit(0))["title"], F.lit("")))


def epub(source: Source) -> Column:
    about = lambda v: F.nullif(book_metadata(*(v[n] for n in ("title", "creators", "language", "publisher", "date", "description", "identifier"))), F.lit(""))
    return read_once(read_epub(source.content), lambda v: F.concat_ws("\n\n", about(v), F.nullif(F.array_join(v["chapters"], "\n\n"), F.lit(""))), lambda v: v["title"])
