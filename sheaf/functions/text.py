"""Text functions as native columns: white space, line rules, Markdown normalization, cells and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a character class of Java's regular expressions.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters as a plain string.
WS_CHARACTERS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: White space that a data URI can't hold.
BREAK = r"\t\n\f\r "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value made once however often the body reads it, and written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.trim(text, F.lit(WS_CHARACTERS))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def rtrim_lines(text: Column) -> Column:
    """Each line without spaces and tabs at its end."""
    return F.regexp_replace(text, r"(?<![ \t])[ \t]++(?=\n|\z)", "")  # only whole runs are tried, each once


def drop_empty_headings(text: Column) -> Column:
    """Without lines that hold nothing but # signs and spaces, one sign at least."""
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~(F.contains(line, F.lit("#")) & line.rlike(rf"\A{WS}*+#[# ]*+{WS}*+\z")))
    return F.when(F.contains(text, F.lit("#")), F.array_join(kept, "\n")).otherwise(text)


def truncate_data_uris(text: Column) -> Column:
    """Data URIs of over 96 characters with a comma end after it, with an ellipsis."""
    return F.regexp_replace(text, rf"data:(?=[^){BREAK}]{{92,}})([^,){BREAK}]*),[^){BREAK}]*", "data:$1,...")


def normalize_markdown(text: Column, keep_data_uris: bool = False) -> Column:
    """What every converter's output goes through: line ends, ends of lines, empty headings, runs of blank lines, the
    document's own ends and, unless kept, long data URIs. Null stays null."""
    out = trim_ws(F.regexp_replace(drop_empty_headings(rtrim_lines(unix_lines(text))), r"\n{3,}", "\n\n"))
    return out if keep_data_uris else truncate_data_uris(out)


def inline_text(text: Column) -> Column:
    """A paragraph's text: no-break spaces are spaces, white space within a line is one space, none around line feeds."""
    plain = F.replace(text, F.lit(" "), F.lit(" "))
    words = F.regexp_replace(plain, r"[\t\x0B\f\r \x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " ")
    return trim_ws(F.regexp_replace(words, r" ?\n ?", "\n"))


def escape_cell(text: Column, line_feed: str | None = " ") -> Column:
    """A table cell: bars escaped, line feeds replaced (None: left), trimmed."""
    out = F.replace(text, F.lit("|"), F.lit("\\|"))
    if line_feed is not None:
        out = F.replace(out, F.lit("\n"), F.lit(line_feed))
    return trim_ws(out)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """From the last dot of the last element on, the dot included; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def clean_path(path: Column) -> Column:
    """Without empty elements and single dots, and each double dot taken together with the element before it. Double
    dots that lead out of a relative path stay; at a root they go. Nothing is a single dot."""
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        up = F.when((F.size(done) > 0) & (F.coalesce(last, F.lit("")) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def percent_decode(text: Column) -> Column:
    """%XX decoded, + left as it is; null for what can't be decoded."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
