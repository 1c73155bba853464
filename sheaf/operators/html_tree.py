"""HTML to a tree by the web's rules: misnested, unclosed and misplaced tags end up where browsers put them.

The rules are those of the HTML standard's tree construction, with scripts on. Nothing recurses, so a page's depth is
limited by memory alone; what a page may grow to, by reopening formatting again and again, is limited by its length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.entities import html5

#: Groups of element names that the rules speak of.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
RAW = frozenset("iframe noembed noframes noscript script style xmp".split())
SPECIAL = CLOSES_P | HEADINGS | VOID - {"meter"} | frozenset("applet body button caption colgroup dd dt form frameset head html iframe li listing marquee noembed noframes noscript object plaintext pre script select style table tbody td template textarea tfoot th thead title tr xmp".split())
SCOPE = frozenset("applet caption html marquee object table td template th".split())
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset(("html", "table", "template"))
FOSTERING = frozenset("table tbody tfoot thead tr".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
OLD_TYPES = ("+//silmaril", "-//ietf//dtd html", "-//w3c//dtd html 3", "-//w3c//dtd html 4.0 frameset", "-//w3c//dtd html 4.0 transitional", "-//w3o//dtd w3 html", "-/w3c/dtd html 4.0 transitional/en", "html")
SPACE = " \t\n\f"

TAG = re.compile(r"(/?)([A-Za-z][^ \t\n\f/>]*)")
ATTRIBUTE = re.compile(r"[ \t\n\f/]*([^ \t\n\f/>][^ \t\n\f/>=]*)(?:[ \t\n\f]*=[ \t\n\f]*(\"[^\"]*\"|'[^']*'|[^ \t\n\f>\"'][^ \t\n\f>]*|(?=>)|([\"'])))?")
TAG_END = re.compile(r"[ \t\n\f/]*>")
SCRIPT_MARK = re.compile(r"<!--|-->|<(/?)script(?=[ \t\n\f/>])", re.I)
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")
MARKER = None


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent", "space", "block")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, space: str = ""):
        self.tag, self.attrs, self.children, self.space = tag, attrs or {}, [], space
        self.parent: Node | None = None
        self.block = False

    def append(self, child: Node | str, before: Node | None = None) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.insert(self.place(before), child) if before is not None else self.children.append(child)

    def place(self, child: Node) -> int:
        at = len(self.children) - 1
        while self.children[at] is not child:
            at -= 1
        return at

    def leave(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent.place(self)]
            self.parent = None


def attribute_text(value: str) -> str:
    """An attribute's value: names without a semicolon aren't references where a letter, digit or = follows."""

    def read(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#" and not name.endswith(";") and (m[2] or name not in html5):
            return m[0]
        return unescape(f"&{name}") + m[2]

    return REFERENCE.sub(read, value) if "&" in value else value


class TreeBuilder:
    """One document. `stack` holds the open elements, `formatting` the formatting elements that are reopened where
    something else closed them, and `mode` is the part of the document that decides what a tag means."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.limit = len(text) + 10_000
        self.root, self.html = Node("#root"), Node("html")
        self.root.append(self.html)
        self.stack, self.open = [self.html], Counter(["html"])
        self.formatting: list[Node | None] = []
        self.modes: list[str] = []  # of open templates
        self.mode, self.before_text = "before head", ""
        self.head: Node | None = None
        self.form: Node | None = None
        self.foster = self.quirks = self.skip_feed = False
        self.made, self.at = 0, 0

    # -- reading

    def parse(self) -> Node:
        text, size = self.text, len(self.text)
        m = re.match(r"(?:[ \t\n\f]|<!--.*?-->)*(?=<!doctype)", text, re.S | re.I)
        self.quirks = m is None
        while self.at < size:
            mark = text.find("<", self.at)
            if mark != self.at:
                piece = text[self.at : mark if mark >= 0 else size]
                self.at = mark if mark >= 0 else size
                self.characters(unescape(piece))
                continue
            tag = TAG.match(text, mark + 1)
            if tag:
                self.at = tag.end()
                attrs, closed = self.attributes()
                if self.at < 0:  # a tag that never ends is no tag
                    break
                name = tag[2].lower().replace("\0", "�")
                self.end(name) if tag[1] else self.start(name, attrs, closed)
            elif text.startswith("<!--", mark):
                stop = re.compile("--!?>").search(text, mark + 2)  # <!--> is a whole comment
                self.at = size if stop is None else max(stop.end(), mark + 5)
            elif text.startswith("<![CDATA[", mark) and self.stack[-1].space:
                stop = text.find("]]>", mark)
                self.characters(text[mark + 9 : stop if stop >= 0 else size])
                self.at = stop + 3 if stop >= 0 else size
            elif text.startswith(("<!", "<?", "</"), mark):
                stop = text.find(">", mark + 2)
                if text[mark + 1] == "!" and re.compile("doctype", re.I).match(text, mark + 2):
                    self.doctype(text[mark + 9 : stop if stop >= 0 else size])
                if text.startswith("</", mark) and mark + 2 >= size:
                    self.characters("</")
                self.at = stop + 1 if stop >= 0 else size
            else:
                self.characters("<")
                self.at = mark + 1
        if self.mode in ("before head", "in head", "after head"):
            self.into_body()
        return self.root

    def attributes(self) -> tuple[dict[str, str], bool]:
        attrs: dict[str, str] = {}
        while True:
            end = TAG_END.match(self.text, self.at)
            if end:
                self.at = end.end()
                return attrs, self.text[end.end() - 2] == "/"
            m = ATTRIBUTE.match(self.text, self.at)
            if not m or m[3]:  # the text, or a quoted value, ends here
                self.at = -1
                return attrs, False
            value = m[2] or ""
            attrs.setdefault(m[1].lower(), attribute_text(value[1:-1] if value[:1] in ("'", '"') else value))
            self.at = m.end()

    def raw_text(self, name: str) -> str:
        """All up to an element's end tag, which is read too."""
        if name == "script":
            inside, at = 0, self.at
            while True:
                m = SCRIPT_MARK.search(self.text, at)
                if not m:
                    break
                at = m.start() + 2 if m[0] == "<!--" else m.end()
                if m[0] == "<!--":
                    inside = max(inside, 1)
                elif m[0] == "-->":
                    inside = 0
                elif not m[1]:
                    inside = 2 if inside else 0
                elif inside == 2:
                    inside = 1
                else:
                    break
        else:
            m = re.compile(rf"</{name}(?=[ \t\n\f/>])", re.I).search(self.text, self.at)
        found = self.text[self.at : m.start() if m else len(self.text)]
        self.at = m.end() if m else len(self.text)
        if m:
            self.attributes()
            if self.at < 0:
                self.at = len(self.text)
        return found

    def doctype(self, rest: str) -> None:
        m = re.match(r"\s*(\S*)(?:\s+public\s*[\"']([^\"'>]*))?(.*)", rest, re.I | re.S)
        known = (m[2] or "").lower()
        self.quirks = m[1].lower() != "html" or any(known.startswith(x) if x != "html" else known == x for x in OLD_TYPES) or (known.startswith(("-//w3c//dtd html 4.01 frameset", "-//w3c//dtd html 4.01 transitional")) and m[3].strip(" \"'") == "")

    # -- the stack

    def current(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.open[node.tag] += 1

    def pop(self) -> Node:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        return node

    def drop(self, node: Node) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at] is node:
                del self.stack[at]
                self.open[node.tag] -= 1
                return

    def pop_until(self, *names: str) -> None:
        while len(self.stack) > 1 and not (self.pop().tag in names):
            pass

    def pop_to(self, *names: str) -> None:
        while self.current().tag not in names and len(self.stack) > 1:
            self.pop()

    def within(self, *names: str, stops: frozenset[str] = SCOPE) -> bool:
        """Whether one of the names is open and none of the stops is inside of it."""
        if not any(self.open[n] for n in names):
            return False
        for node in reversed(self.stack):
            if node.tag in names and not node.space:
                return True
            if node.tag in stops and not node.space or node.space and node.tag in ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"):
                return False
        return False

    def imply_ends(self, but: str = "") -> None:
        while self.current().tag in IMPLIED and self.current().tag != but:
            self.pop()

    def close_p(self) -> None:
        if self.within("p", stops=BUTTON_SCOPE):
            self.imply_ends("p")
            self.pop_until("p")

    # -- placing

    def put(self, child: Node | str, target: Node | None = None) -> None:
        """Into the target, or the current element; what a table can't hold goes before it, if that is asked for."""
        target = target or self.current()
        if self.foster and target.tag in FOSTERING:
            at = max((i for i, n in enumerate(self.stack) if n.tag in ("table", "template")), default=0)
            table = self.stack[at]
            if table.tag == "template":
                table.append(child)
            elif table.parent is not None:
                table.parent.append(child, table)
            else:
                self.stack[max(0, at - 1)].append(child)
        else:
            target.append(child)

    def insert(self, tag: str, attrs: dict | None = None, space: str = "", keep: bool = True) -> Node:
        self.made += 1
        if self.made > self.limit:
            raise ValueError("the page grows too much where its formatting is reopened")
        node = Node(tag, attrs, space)
        self.put(node)
        if keep:
            self.push(node)
        return node

    def insert_raw(self, tag: str, attrs: dict) -> None:
        node = self.insert(tag, attrs, keep=False)
        text = self.raw_text(tag)
        node.append(unescape(text) if tag in ("title", "textarea") else text)

    def into_body(self) -> None:
        """What comes now belongs to a body; the tags of head and body may be left out."""
        if self.head is None:
            self.head = self.insert("head", keep=False)
        while len(self.stack) > 1:
            self.pop()
        self.insert("body")
        self.mode = "in body"

    # -- formatting that is reopened

    def reopen(self) -> None:
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not MARKER and not self.is_open(self.formatting[at - 1]):
            at -= 1
        for i in range(at, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self.insert(old.tag, old.attrs)

    def is_open(self, node: Node) -> bool:
        return self.open[node.tag] > 0 and any(n is node for n in reversed(self.stack))

    def remember(self, node: Node) -> None:
        """At most three alike are kept since the last marker."""
        alike = 0
        for at in range(len(self.formatting) - 1, -1, -1):
            other = self.formatting[at]
            if other is MARKER:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                alike += 1
                if alike == 3:
                    del self.formatting[at]
                    break
        self.formatting.append(node)

    def forget(self, node: Node) -> None:
        self.formatting = [n for n in self.formatting if n is not node]

    def to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not MARKER:
            pass

    def adopt(self, name: str) -> None:
        """The end of a formatting element that may be misnested: what blocks inside it keep of it, and what follows, gets
        a formatting element of its own."""
        if self.current().tag == name and not any(n is self.current() for n in self.formatting):
            self.pop()
            return
        for _ in range(8):
            own = next((n for n in self._since_marker() if n.tag == name), None)
            if own is None:
                self.any_end(name)
                return
            if not self.is_open(own):
                self.forget(own)
                return
            if not self.within(name):
                return
            where = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i] is own)
            block_at = next((i for i in range(where + 1, len(self.stack)) if self.stack[i].tag in SPECIAL and not self.stack[i].space), None)
            if block_at is None:
                while self.pop() is not own:
                    pass
                self.forget(own)
                return
            block, ancestor = self.stack[block_at], self.stack[where - 1]
            mark = next(i for i, n in enumerate(self.formatting) if n is own)
            last, steps = block, 0
            for i in range(block_at - 1, where, -1):
                node, steps = self.stack[i], steps + 1
                listed = next((j for j, n in enumerate(self.formatting) if n is node), None)
                if steps > 3 and listed is not None:
                    del self.formatting[listed]
                    mark -= listed < mark
                    listed = None
                if listed is None:
                    self.drop(node)
                    continue
                clone = Node(node.tag, node.attrs)
                self.made += 1
                self.formatting[listed] = self.stack[i] = clone
                if last is block:
                    mark = listed + 1
                last.leave()
                clone.append(last)
                last = clone
            last.leave()
            foster, self.foster = self.foster, True
            self.put(last, ancestor)
            self.foster = foster
            clone = Node(own.tag, own.attrs)
            self.made += 1
            clone.children, block.children = block.children, []
            for child in clone.children:
                if isinstance(child, Node):
                    child.parent = clone
            block.append(clone)
            held = next(i for i, n in enumerate(self.formatting) if n is own)
            del self.formatting[held]
            self.formatting.insert(mark - (held < mark), clone)
            self.drop(own)
            at = next(i for i, n in enumerate(self.stack) if n is block)
            self.stack.insert(at + 1, clone)
            self.open[clone.tag] += 1
            if self.made > self.limit:
                raise ValueError("the page grows too much where its formatting is reopened")

    def _since_marker(self):
        for node in reversed(self.formatting):
            if node is MARKER:
                return
            yield node

    # -- text

    def characters(self, text: str) -> None:
        text = text.replace("\0", "")
        if self.skip_feed:
            text, self.skip_feed = text.removeprefix("\n"), False
        if not text:
            return
        blank = not text.strip(SPACE)
        if self.mode in ("before head", "in head", "after head"):
            if blank:
                if self.mode != "before head":
                    self.current().append(text)
                return
            self.into_body()
        elif self.mode in ("after body", "after frameset") and not blank and "frameset" not in self.mode:
            self.mode = "in body"
        if self.mode in ("in frameset", "after frameset") or self.mode == "in column group" and not blank and not self.leave_columns():
            return
        if self.mode in ("in table", "in table body", "in row") and not self.current().space:
            if blank or self.current().tag not in FOSTERING:
                self.current().append(text)
                return
            self.foster = True
            self.reopen()
            self.put(text)
            self.foster = False
            return
        if self.mode not in ("in select", "in column group") and not self.current().space:
            self.reopen()
        self.put(text)

    def leave_columns(self) -> bool:
        if self.current().tag != "colgroup":
            return False
        self.pop()
        self.mode = "in table"
        return True

    # -- start tags

    def start(self, name: str, attrs: dict, closed: bool) -> None:
        self.skip_feed = False
        if self.current().space and not self.at_home(name):
            self.foreign_start(name, attrs, closed)
            return
        while True:
            mode = self.mode
            if mode in ("before head", "in head", "after head"):
                if name == "html":
                    return
                if name == "head":
                    if mode == "before head":
                        self.head = self.insert("head")
                        self.mode = "in head"
                    return
                if name in IN_HEAD:
                    if self.head is None:
                        self.head = self.insert("head")
                        self.mode = "in head"
                    back = self.mode == "after head"
                    if back:
                        self.push(self.head)
                    self.head_start(name, attrs)
                    if back:
                        self.drop(self.head)
                    return
                if name in ("body", "frameset"):
                    self.into_body()
                    if name == "frameset":
                        self.pop().leave()
                        self.insert("frameset", attrs)
                        self.mode = "in frameset"
                    else:
                        self.current().attrs = attrs
                    return
                if name == "noscript" and mode == "in head":
                    self.insert_raw(name, attrs)
                    return
                self.into_body()
                continue
            if mode in ("in frameset", "after frameset"):
                if name == "frameset" and mode == "in frameset":
                    self.insert(name, attrs)
                elif name in ("frame", "noframes"):
                    self.insert_raw(name, attrs) if name == "noframes" else self.insert(name, attrs, keep=False)
                return
            if mode == "after body":
                self.mode = "in body"
                continue
            if mode == "in template":
                self.modes[-1] = self.mode = {"col": "in column group", "tr": "in table body", "td": "in row", "th": "in row"}.get(name, "in table" if name in ("caption", "colgroup", "tbody", "tfoot", "thead") else "in body")
                continue
            again = self.table_start(mode, name, attrs)
            if again is None:
                return
            if not again:
                break
        self.body_start(name, attrs, closed)
        self.foster = False

    def head_start(self, name: str, attrs: dict) -> None:
        if name == "template":
            self.insert(name, attrs)
            self.formatting.append(MARKER)
            self.modes.append("in template")
            self.mode = "in template"
        elif name in VOID:
            self.insert(name, attrs, keep=False)
        else:
            self.insert_raw(name, attrs)

    def table_start(self, mode: str, name: str, attrs: dict) -> bool | None:
        """What a tag means in a table's parts and lists of choices: None if it is done, true to look at it again in the
        mode that is now on, false if it means what it means in a body."""
        parts = ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if mode == "in column group":
            if name == "col":
                self.insert(name, attrs, keep=False)
                return None
            if name == "template":
                self.head_start(name, attrs)
                return None
            return True if self.leave_columns() else None
        if mode == "in caption" and name in parts:
            return True if self.end_caption() else None
        if mode == "in cell" and name in parts:
            if not self.within("td", "th", stops=TABLE_SCOPE):
                return None
            self.end_cell()
            return True
        if mode == "in select":
            if name in ("input", "keygen", "textarea", "select") or name in ("caption", "table", "tbody", "td", "tfoot", "th", "thead", "tr"):
                if self.open["select"]:
                    self.pop_until("select")
                    self.reset()
                return None if name == "select" else True
            if name in ("option", "optgroup", "hr"):
                if self.current().tag == "option":
                    self.pop()
                if name != "option" and self.current().tag == "optgroup":
                    self.pop()
                self.insert(name, attrs, keep=name != "hr")
            elif name in ("script", "template"):
                self.head_start(name, attrs)
            return None
        if mode in ("in table body", "in row", "in table"):
            if mode == "in row" and name in ("td", "th"):
                self.pop_to("tr", "template", "html")
                self.insert(name, attrs)
                self.formatting.append(MARKER)
                self.mode = "in cell"
                return None
            if mode == "in row" and name in parts:
                if not self.within("tr", stops=TABLE_SCOPE):
                    return None
                self.pop_until("tr")
                self.mode = "in table body"
                return True
            if mode == "in table body" and name in ("tr", "td", "th"):
                self.pop_to("tbody", "tfoot", "thead", "template", "html")
                self.insert("tr", attrs if name == "tr" else {})
                self.mode = "in row"
                return None if name == "tr" else True
            if mode == "in table body" and name in parts:
                if not self.within("tbody", "thead", "tfoot", stops=TABLE_SCOPE):
                    return None
                self.pop_to("tbody", "tfoot", "thead", "template", "html")
                self.pop()
                self.mode = "in table"
                return True
            if name in parts:
                self.pop_to("table", "template", "html")
                if name == "caption":
                    self.formatting.append(MARKER)
                made = {"col": "colgroup", "td": "tbody", "th": "tbody", "tr": "tbody"}.get(name, name)
                self.insert(made, attrs if made == name else {})
                self.mode = {"caption": "in caption", "colgroup": "in column group"}.get(made, "in table body")
                return None if made == name else True
            if name == "table":
                if not self.within("table", stops=TABLE_SCOPE):
                    return None
                self.pop_until("table")
                self.reset()
                return True
            if name in ("style", "script", "template"):
                self.head_start(name, attrs)
                return None
            if name == "input" and attrs.get("type", "").lower() == "hidden":
                self.insert(name, attrs, keep=False)
                return None
            if name == "form":
                if self.form is None and not self.modes:
                    self.form = self.insert(name, attrs, keep=False)
                return None
            self.foster = True
        return False

    def body_start(self, name: str, attrs: dict, closed: bool) -> None:
        if name in IN_HEAD:
            self.head_start(name, attrs)
        elif name in ("html", "body", "frameset", "head", "caption", "col", "colgroup", "frame", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return
        elif name in CLOSES_P or name in HEADINGS or name in ("pre", "listing", "plaintext", "xmp", "form", "hr"):
            if name == "form" and self.form is not None and not self.modes:
                return
            self.close_p()
            if name in HEADINGS and self.current().tag in HEADINGS:
                self.pop()
            if name == "xmp":
                self.reopen()
                self.insert_raw(name, attrs)
                return
            node = self.insert(name, attrs, keep=name != "hr")
            self.skip_feed = name in ("pre", "listing")
            if name == "form" and not self.modes:
                self.form = node
            if name == "plaintext":
                node.append(self.text[self.at :])
                self.at = len(self.text)
        elif name in ("li", "dd", "dt"):
            alike = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.stack if any(self.open[n] for n in alike) else []):
                if node.tag in alike:
                    self.imply_ends(node.tag)
                    self.pop_until(node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(name, attrs)
        elif name in FORMATTING:
            if name == "a":
                old = next((n for n in self._since_marker() if n.tag == "a"), None)
                if old is not None:
                    self.adopt("a")
                    self.forget(old)
                    self.drop(old)
            self.reopen()
            if name == "nobr" and self.within("nobr"):
                self.adopt("nobr")
                self.reopen()
            self.remember(self.insert(name, attrs))
        elif name == "button":
            if self.within("button"):
                self.imply_ends()
                self.pop_until("button")
            self.reopen()
            self.insert(name, attrs)
        elif name in ("applet", "marquee", "object"):
            self.reopen()
            self.insert(name, attrs)
            self.formatting.append(MARKER)
        elif name == "table":
            if not self.quirks:
                self.close_p()
            self.insert(name, attrs)
            self.mode = "in table"
        elif name in VOID or name == "image":
            if name not in ("param", "source", "track"):
                self.reopen()
            self.insert("img" if name == "image" else name, attrs, keep=False)
        elif name in RAW or name == "textarea":
            if name in ("noembed", "noscript", "iframe", "textarea"):
                if name == "textarea" and self.text.startswith("\n", self.at):
                    self.at += 1
                self.insert_raw(name, attrs)
        elif name == "select":
            self.reopen()
            self.insert(name, attrs)
            self.mode = "in select"
        elif name in ("option", "optgroup"):
            if self.current().tag == "option":
                self.pop()
            self.reopen()
            self.insert(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.within("ruby"):
                self.imply_ends("rtc" if name in ("rp", "rt") else "")
            self.insert(name, attrs)
        elif name in ("math", "svg"):
            self.reopen()
            self.insert(name, attrs, space=name, keep=not closed)
        else:
            self.reopen()
            self.insert(name, attrs)

    # -- end tags

    def end(self, name: str) -> None:
        self.skip_feed = False
        if self.current().space and self.foreign_end(name):
            return
        mode = self.mode
        if mode in ("before head", "in head", "after head"):
            if name == "head":
                if mode == "in head":
                    self.pop_to("head", "html")
                    self.pop() if len(self.stack) > 1 else None
                    self.mode = "after head"
                return
            if name not in ("body", "html", "br"):
                return
            self.into_body()
        elif mode in ("in frameset", "after frameset"):
            if name == "frameset" and len(self.stack) > 1:
                self.pop()
                if self.current().tag != "frameset":
                    self.mode = "after frameset"
            return
        elif mode == "after body":
            if name == "html":
                return
            self.mode = "in body"
        elif self.table_end(mode, name):
            return
        self.body_end(name)
        self.foster = False

    def table_end(self, mode: str, name: str) -> bool:
        """Whether an end tag has been dealt with by the rules of a table's part or a list of choices."""
        if name == "template":
            return False
        if mode == "in template":
            return True
        if mode == "in column group":
            if name == "colgroup":
                self.leave_columns()
                return True
            return name == "col" or not self.leave_columns() or self.table_end(self.mode, name)
        if mode == "in caption":
            if name in ("caption", "table"):
                if self.end_caption() and name == "table":
                    self.table_end(self.mode, name)
                return True
            return name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr")
        if mode == "in cell":
            if name in ("td", "th"):
                if self.within(name, stops=TABLE_SCOPE):
                    self.imply_ends()
                    self.pop_until(name)
                    self.to_marker()
                    self.mode = "in row"
                return True
            if name in ("table", "tbody", "tfoot", "thead", "tr"):
                if self.within(name, stops=TABLE_SCOPE):
                    self.end_cell()
                    self.table_end(self.mode, name)
                return True
            return name in ("body", "caption", "col", "colgroup", "html")
        if mode == "in select":
            if name in ("option", "optgroup"):
                if name == "optgroup" and self.current().tag == "option" and len(self.stack) > 2 and self.stack[-2].tag == "optgroup":
                    self.pop()
                if self.current().tag == name:
                    self.pop()
            elif name in ("select", "caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and (name == "select" or self.within(name, stops=TABLE_SCOPE)):
                if self.open["select"]:
                    self.pop_until("select")
                    self.reset()
                if name != "select":
                    self.end(name)
            return True
        if mode in ("in row", "in table body", "in table"):
            if mode == "in row" and name in ("tr", "table", "tbody", "tfoot", "thead"):
                if self.within("tr", stops=TABLE_SCOPE) and (name in ("tr", "table") or self.within(name, stops=TABLE_SCOPE)):
                    self.pop_until("tr")
                    self.mode = "in table body"
                    if name != "tr":
                        self.table_end(self.mode, name)
                return True
            if mode == "in table body" and name in ("tbody", "tfoot", "thead", "table"):
                if self.within(*((name,) if name != "table" else ("tbody", "tfoot", "thead")), stops=TABLE_SCOPE):
                    self.pop_to("tbody", "tfoot", "thead", "template", "html")
                    self.pop()
                    self.mode = "in table"
                    if name == "table":
                        self.table_end(self.mode, name)
                return True
            if name == "table":
                if self.within("table", stops=TABLE_SCOPE):
                    self.pop_until("table")
                    self.reset()
                return True
            if name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return True
            self.foster = True
        return False

    def end_caption(self) -> bool:
        if not self.within("caption", stops=TABLE_SCOPE):
            return False
        self.imply_ends()
        self.pop_until("caption")
        self.to_marker()
        self.mode = "in table"
        return True

    def end_cell(self) -> None:
        self.imply_ends()
        self.pop_until("td", "th")
        self.to_marker()
        self.mode = "in row"

    def reset(self) -> None:
        """The mode that the innermost open element asks for."""
        asked = {"select": "in select", "td": "in cell", "th": "in cell", "tr": "in row", "tbody": "in table body", "thead": "in table body", "tfoot": "in table body", "caption": "in caption", "colgroup": "in column group", "table": "in table", "head": "in head", "body": "in body", "frameset": "in frameset"}
        for node in reversed(self.stack):
            if node.tag == "template" and self.modes:
                self.mode = self.modes[-1]
                return
            if node.tag in asked and not node.space:
                self.mode = asked[node.tag]
                return
        self.mode = "in body" if self.open["body"] else "after head" if self.head else "before head"

    def body_end(self, name: str) -> None:
        if name == "template":
            if self.open["template"]:
                self.imply_ends()
                self.pop_until("template")
                self.to_marker()
                self.modes.pop()
                self.reset()
        elif name in ("body", "html"):
            if self.within("body"):
                self.mode = "after body"
        elif name == "form" and not self.modes:
            node, self.form = self.form, None
            if node is not None and self.is_open(node) and self.within("form"):
                self.imply_ends()
                self.drop(node)
        elif name == "p":
            if not self.within("p", stops=BUTTON_SCOPE):
                self.insert("p")
            self.close_p()
        elif name in HEADINGS:
            if self.within(*HEADINGS):
                self.imply_ends()
                self.pop_until(*HEADINGS)
        elif name in CLOSES_P or name in ("button", "dd", "dt", "form", "li", "listing", "pre"):
            if self.within(name, stops=LIST_SCOPE if name == "li" else SCOPE):
                self.imply_ends(name)
                self.pop_until(name)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("applet", "marquee", "object"):
            if self.within(name):
                self.imply_ends()
                self.pop_until(name)
                self.to_marker()
        elif name == "br":
            self.reopen()
            self.insert("br", keep=False)
        else:
            self.any_end(name)

    def any_end(self, name: str) -> None:
        if not self.open[name]:
            return
        for node in reversed(self.stack):
            if node.tag == name and not node.space:
                self.imply_ends(name)
                while self.pop() is not node:
                    pass
                return
            if node.tag in SPECIAL and not node.space:
                return

    # -- drawings and formulas

    def at_home(self, name: str) -> bool:
        """Whether a tag inside a drawing or formula is one of the page's: in a place made for that."""
        node = self.current()
        if node.space == "svg":
            return node.tag in ("foreignobject", "desc", "title")
        return node.tag in ("mi", "mo", "mn", "ms", "mtext") and name not in ("mglyph", "malignmark") or node.tag == "annotation-xml" and (name == "svg" or node.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml"))

    def foreign_start(self, name: str, attrs: dict, closed: bool) -> None:
        if name in BREAKS_OUT or name == "font" and attrs.keys() & {"color", "face", "size"}:
            while self.current().space and not self.at_home(""):
                self.pop()
            self.start(name, attrs, closed)
        else:
            self.insert(name, attrs, space=self.current().space, keep=not closed)

    def foreign_end(self, name: str) -> bool:
        if name in ("br", "p"):
            while self.current().space and not self.at_home(""):
                self.pop()
            return False
        for at in range(len(self.stack) - 1, 0, -1):
            if not self.stack[at].space:
                return False
            if self.stack[at].tag == name:
                while len(self.stack) > at:
                    self.pop()
                return True
        return False


def parse(text: str) -> Node:
    """The tree of a text, under a node of its own; html, head and body are always there."""
    return TreeBuilder(text).parse()


def preorder(node: Node):
    """All elements, each before what it holds."""
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        stack += [c for c in reversed(here.children) if isinstance(c, Node)]


def outline(node: Node) -> str:
    """The tree in short: tag(children), texts as they are."""
    out, stack = [], [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            out.append(here)
        else:
            out.append(f"{here.tag}(")
            stack.append(")")
            stack += reversed(here.children)
    return "".join(out)
