"""RSS and Atom feeds: parsed in Arrow batches, rendered natively."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function, slices
from ..functions.text import let, trim_ws
from .dispatch import Source, result
from .html import html_to_markdown

FEED = "struct<kind:string,title:string,about:string,items:array<struct<title:string,date:string,body:string>>,error:string>"


def local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse_xml(text: str) -> ET.Element:
    """The root, whatever encoding the text declares: it's decoded already."""
    return ET.fromstring(re.sub(r"\A(?:﻿|\s)*<\?xml[^>]*\?>", "", text))


def last_text(node: ET.Element, name: str) -> str:
    """The own character data of the last child of that local name, in any namespace."""
    found = [c for c in node if local(c.tag) == name]
    if not found:
        return ""
    return (found[-1].text or "") + "".join(c.tail or "" for c in found[-1])


def rendered(text: str) -> str:
    """Trimmed; as Markdown if it looks like HTML and that gives anything."""
    text = text.strip()
    if "<" in text and ">" in text:
        return html_to_markdown(text)[0].strip() or text
    return text


def parse_feed(text: str) -> tuple:
    """What a feed holds, or what it breaks on, which is its own row's error."""
    try:
        return read_root(parse_xml(text))
    except ET.ParseError as e:
        return None, None, None, None, f"malformed feed: {e}"
    except Exception as e:  # noqa: BLE001
        return None, None, None, None, f"{type(e).__name__}: {e}"


def read_root(root: ET.Element) -> tuple:
    kind = local(root.tag).lower()
    if kind == "rss":
        channel = next((c for c in root if local(c.tag) == "channel"), ET.Element("channel"))
        items = [(last_text(i, "title"), last_text(i, "pubDate"), rendered(last_text(i, "encoded")) or rendered(last_text(i, "description"))) for i in channel if local(i.tag) == "item"]
        return kind, last_text(channel, "title"), rendered(last_text(channel, "description")), items, None
    if kind == "feed":
        items = [(last_text(i, "title"), last_text(i, "updated"), rendered(last_text(i, "content")) or rendered(last_text(i, "summary"))) for i in root if local(i.tag) == "entry"]
        return kind, last_text(root, "title"), rendered(last_text(root, "subtitle")), items, None
    return None, None, None, None, "unsupported"


@arrow_function(FEED)
def read_feed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in (x for whole in batches for x in slices(whole)):
        out = [(None,) * 5 if x is None else parse_feed(x) for x in batch]
        frame = pd.DataFrame(out, columns=["kind", "title", "about", "items", "error"])
        frame["items"] = [None if i is None else [{"title": t, "date": d, "body": b} for t, d, b in i] for i in frame["items"]]
        yield frame


def render_feed(feed: Column) -> Column:
    """The title, what the feed is about, and a section for each item that has anything."""
    some = lambda c: F.nullif(trim_ws(c), F.lit(""))
    label = F.when(feed["kind"] == "rss", "Published on: ").otherwise("Updated on: ")
    section = lambda i: F.concat_ws("\n\n", F.concat(F.lit("## "), some(i["title"])), F.concat(label, some(i["date"])), some(i["body"]))
    sections = F.filter(F.transform(feed["items"], section), lambda s: s != "")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), some(feed["title"])), some(feed["about"]), F.nullif(F.array_join(sections, "\n\n"), F.lit("")))


def feed(source: Source) -> Column:
    return let(read_feed(source.text), lambda f: result(render_feed(f), trim_ws(f["title"]), f["error"]))
