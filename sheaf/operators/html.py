"""HTML to Markdown: the page's tree, and a renderer with its own stack, run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function, slices
from ..functions.text import let, trim_ws
from .dispatch import Source, result
from .html_tree import Node, parse, preorder

#: Elements whose content isn't shown, elements that stand alone, and those that mark up text.
HIDDEN = frozenset("script style head noscript iframe input textarea template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}


def find(node: Node, tag: str) -> Node | None:
    """The first element of that name, in document order."""
    return next((n for n in preorder(node) if n.tag == tag), None)


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            out.append(here)
        else:
            stack += reversed(here.children)
    return "".join(out)


def escaped(text: str) -> str:
    """Only what would change the meaning gets a backslash."""
    text = re.sub(r"([\\`*_\[\]])", r"\\\1", text)
    return re.sub(r"<(?=[A-Za-z/!])", r"\\<", text)


def flag_blocks(root: Node) -> None:
    """Marks every element that is a block or holds one."""
    for node in reversed(list(preorder(root))):
        node.block = node.tag in BLOCK or any(isinstance(c, Node) and c.block and c.tag not in HIDDEN for c in node.children)


def around(inner: str, before: str, after: str) -> str:
    """White space and line breaks at the ends stay outside of marks; without text there are none."""
    blank = " \t\n\v\f\r\x00"
    core = inner.strip(blank)
    return f"{inner[: len(inner) - len(inner.lstrip(blank))]}{before}{core}{after}{inner[len(inner.rstrip(blank)) :]}" if core else inner


def link_marks(node: Node) -> tuple[str, str] | None:
    href, title = node.attrs.get("href"), node.attrs.get("title")
    named = f' "{title}"' if title else ""
    return None if href is None else ("[", f"]({href}{named})")


def run(made: Generator) -> object:
    """The result of a generator that yields the generators whose results it needs: calls without Python's own stack."""
    stack, value = [made], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class Renderer:
    """Inline elements become strings with single spaces, blocks lists of paragraphs. `marks` are the kinds of marks that
    are on: text that is bold needs no second pair, and there are no links in links. Marks around blocks go around each
    of their paragraphs."""

    def inline(self, children: list, marks: frozenset = frozenset()) -> Generator:
        parts = []
        for child in children:
            parts.append(escaped(child) if isinstance(child, str) else (yield self._inline(child, marks)))
        return "".join(parts)

    @staticmethod
    def line(text: str) -> str:
        return re.sub(r"[ \t\n\f\r]+", " ", text).strip(" \x00").replace(" \x00", "\x00").replace("\x00 ", "\x00").replace("\x00", "  \n")

    def _inline(self, node: Node, marks: frozenset) -> Generator:
        tag = node.tag
        if tag in HIDDEN:
            return ""
        if tag == "br":
            return "\x00"
        if tag in ("code", "kbd", "samp", "tt"):
            inner = text_of(node)
            ticks = "`" * (max((len(r) for r in re.findall("`+", inner)), default=0) + 1)
            return f"{ticks}{inner}{ticks}" if inner.strip() else ""
        if tag == "img":
            return f"![{escaped(node.attrs.get('alt') or '')}]({node.attrs.get('src') or ''})" if node.attrs.get("src") else ""
        mark, pair = self._marks(node, marks)
        inner = yield self.inline(node.children, marks | {mark})
        if pair:
            return around(inner, *pair)
        return f" {inner} " if tag in BLOCK else inner

    @staticmethod
    def _marks(node: Node, marks: frozenset) -> tuple[str, tuple[str, str] | None]:
        """The kind of mark that an element is, and what it puts before and after its text, if that isn't on already."""
        mark = MARKS.get(node.tag, node.tag if node.tag == "a" else "")
        if not mark or mark in marks:
            return mark, None
        return mark, link_marks(node) if mark == "a" else (mark, mark)

    def blocks(self, children: list, marks: frozenset = frozenset(), pairs: tuple = ()) -> Generator:
        out: list[str] = []
        held: list = []

        def flush() -> Generator:
            text = yield self.inline(held, marks)
            for pair in pairs:
                text = around(text, *pair)
            text = self.line(text)
            if text:
                out.append(re.sub(r"^(\d+)([.)])(?= )", r"\1\\\2", re.sub(r"^(#{1,6} |[-+>](?= ))", r"\\\1", text)))
            held.clear()

        for child in children:
            if isinstance(child, Node) and child.tag in HIDDEN:
                continue
            if isinstance(child, Node) and child.block:
                yield flush()
                out += yield self._block(child, marks, pairs)
            else:
                held.append(child)
        yield flush()
        return out

    def _block(self, node: Node, marks: frozenset, pairs: tuple) -> Generator:
        tag = node.tag
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = yield self.inline(node.children, marks)
            line = self.line(text).replace("  \n", " ")
            return [f"{'#' * int(tag[1])} {line}"] if line else []
        if tag == "hr":
            return ["* * *"]
        if tag in ("pre", "listing", "plaintext", "xmp"):
            code = text_of(node).strip("\n")
            child = next((c for c in node.children if isinstance(c, Node) and c.tag == "code"), None)
            found = re.search(r"language-(\S+)", (child.attrs.get("class") or "") if child else "")
            fence = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", code)), default=0))
            return [f"{fence}{found[1] if found else ''}\n{code}\n{fence}"]
        if tag == "blockquote":
            parts = yield self.blocks(node.children, marks, pairs)
            inner = "\n\n".join(parts)
            return ["\n".join("> " + x if x else ">" for x in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol", "menu", "dir"):
            items, start = [], node.attrs.get("start") or "1"
            number = int(start) if start.isdecimal() else 1
            for child in node.children:
                if isinstance(child, Node) and child.tag not in HIDDEN:
                    parts = yield self.blocks(child.children if child.tag == "li" else [child], marks, pairs)
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    tight = all("\n\n" not in p for p in parts) and len(parts) <= 2
                    body = ("\n" if tight else "\n\n").join(parts)
                    if body:
                        items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            return ["\n".join(items)] if items else []
        if tag == "tr" and not any(isinstance(c, Node) and any(isinstance(x, Node) and x.block for x in c.children) for c in node.children):
            # a row of plain cells is one line
            cells = [c for x in node.children for c in ([x, " "] if isinstance(x, Node) else [x])]
            return (yield self.blocks([c if isinstance(c, str) else self._plain_cell(c) for c in cells], marks, pairs))
        mark, pair = self._marks(node, marks)
        return (yield self.blocks(node.children, marks | {mark} if mark else marks, (pair, *pairs) if pair else pairs))

    @staticmethod
    def _plain_cell(cell: Node) -> Node:
        inline = Node("span")
        inline.children = cell.children
        return inline


def html_to_markdown(text: str) -> tuple[str, str]:
    """(Markdown, title) of an HTML text: the body if there is one, else all of it."""
    root = parse(text)
    title, body = find(root, "title"), find(root, "body")
    flag_blocks(root)
    return "\n\n".join(run(Renderer().blocks((body or root).children))), text_of(title).strip() if title else ""


def attempted(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(Markdown, title, error): whatever a page breaks on is its own row's error."""
    if text is None:
        return None, None, None
    try:
        return *html_to_markdown(text), None
    except Exception as e:  # noqa: BLE001
        return None, None, f"{type(e).__name__}: {e}"


@arrow_function("struct<markdown:string,title:string,error:string>")
def render_html(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in (x for whole in batches for x in slices(whole)):
        yield pd.DataFrame([attempted(x) for x in batch], columns=["markdown", "title", "error"])


def maybe_html(text: Column) -> Column:
    """Trimmed; rendered if it holds both angle brackets and that gives anything."""
    plain = trim_ws(text)
    marked = F.contains(plain, F.lit("<")) & F.contains(plain, F.lit(">"))
    rendered = render_html(F.when(marked, plain))["markdown"]
    return F.when(marked, F.coalesce(F.nullif(trim_ws(rendered), F.lit("")), plain)).otherwise(plain)


def prune(html: Column) -> Column:
    """Without script and style elements, natively."""
    out = html
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return out


def title_of(html: Column) -> Column:
    """The first title's text with the basic entities, trimmed, natively."""
    out = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return trim_ws(out)


def html(source: Source) -> Column:
    return let(render_html(source.text), lambda r: result(r["markdown"], r["title"], r["error"]))
