"""Bytes to text by the labels of the web's encoding standard."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow_function, slices

#: The standard's encodings and their labels; those of two families follow from their numbers, below.
LABELS: dict[str, str] = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "ibm866": "866 cp866 csibm866 ibm866",
    "iso-8859-2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2",
    "iso-8859-3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3",
    "iso-8859-4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "iso-8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "iso-8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso-8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "iso-8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso_8859-8:1988 visual",
    "iso-8859-8-i": "csiso88598i iso-8859-8-i logical",
    "iso-8859-10": "csisolatin6 iso-ir-157 l6 latin6",
    "iso-8859-13": "",
    "iso-8859-14": "",
    "iso-8859-15": "csisolatin9 iso_8859-15 l9",
    "iso-8859-16": "iso-8859-16",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "windows-1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "windows-1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc-jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso-2022-jp": "csiso2022jp iso-2022-jp",
    "shift_jis": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "euc-kr": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "replacement": "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement",
    "utf-16be": "unicodefffe utf-16be",
    "utf-16le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "x-user-defined": "x-user-defined",
}
#: Where single bytes mean something else in the standard than in Python's tables.
OWN_BYTES = {"koi8-u": {0xAE: "ў", 0xBE: "Ў"}, "windows-1255": {0xCA: "ֺ"}}
#: Python's tables for the standard's encodings of several bytes, and the second bytes that each may have.
SEVERAL = {"gbk": ("gb18030", "40-7e80-fe"), "gb18030": ("gb18030", "40-7e80-fe"), "big5": ("big5hkscs", "40-7ea1-fe"), "euc-jp": ("euc_jp", "a1-fe"), "shift_jis": ("cp932", "40-7e80-fc"), "euc-kr": ("cp949", "41-fe")}
SINGLE = {"ibm866": "cp866", "koi8-r": "koi8-r", "koi8-u": "koi8-u", "macintosh": "mac-roman", "x-mac-cyrillic": "mac-cyrillic", "windows-874": "cp874", "iso-8859-8-i": "iso8859-8"}


def labels_by_rule() -> dict[str, str]:
    """Each label's encoding. ISO's parts are also named without one hyphen or both, with an underscore up to the eighth;
    Windows' pages have three names each."""
    found = {label: name for name, labels in LABELS.items() for label in labels.split()}
    for n in (*range(2, 9), 10, 13, 14, 15):
        for form in ("iso-8859-{}", "iso8859-{}", "iso8859{}") + (("iso_8859-{}",) if n < 9 else ()):
            found[form.format(n)] = f"iso-8859-{n}"
    for n in range(1250, 1259):
        for form in ("cp{}", "windows-{}", "x-cp{}"):
            found[form.format(n)] = f"windows-{n}"
    return found


ENCODINGS = labels_by_rule()


def byte_table(name: str) -> str:
    """The characters of all 256 bytes of a single-byte encoding: control bytes without a meaning mean themselves,
    others the replacement character."""
    if name == "x-user-defined":
        return "".join(chr(b if b < 128 else 0xF780 + b - 128) for b in range(256))
    codec = SINGLE.get(name) or name.replace("windows-", "cp").replace("iso-8859-", "iso8859-")
    own = OWN_BYTES.get(name, {})
    told = (bytes([b]).decode(codec, "replace") for b in range(256))
    return "".join(own.get(b) or (chr(b) if c == "�" and b < 0xA0 else c) for b, c in enumerate(told))


_tables: dict[str, str] = {}


def second_bytes(ranges: str) -> frozenset[int]:
    ends = [int(x, 16) for x in re.findall("[0-9a-f]{2}", ranges)]
    return frozenset(b for low, high in zip(ends[::2], ends[1::2], strict=True) for b in range(low, high + 1))


SECOND = {name: second_bytes(ranges) for name, (_, ranges) in SEVERAL.items()}


def _error_rule(name: str):
    """What stands for bytes that mean nothing: one replacement character for a pair that could be one, and for a byte
    that can't begin any; a second byte that is ASCII keeps its own meaning."""

    def rule(e: UnicodeError) -> tuple[str, int]:
        if name in ("gbk", "gb18030") and e.object[e.start] == 0x80:
            return "€", e.start + 1
        after = e.object[e.start + 1] if e.start + 1 < len(e.object) else 0
        pair = e.object[e.start] > 0x80 and after >= 0x80 and after in SECOND[name]
        return "�", e.start + 1 + pair

    return rule


for _name in SEVERAL:
    codecs.register_error(f"sheaf-{_name}", _error_rule(_name))


def decode_utf8(data: bytes) -> str:
    """Each run of bytes that isn't valid becomes one replacement character. A byte order mark stays."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]+", "�", data.decode("utf-8", "surrogateescape"))


def decode_bytes(data: bytes, label: str | None) -> str:
    """By the label, in any case and with white space around it; as UTF-8 without one or with one that the standard
    doesn't have. No label fails, and no byte does."""
    name = ENCODINGS.get((label or "").strip(" \t\n\f\r").lower(), "utf-8")
    if name == "utf-8":
        return decode_utf8(data)
    if name == "replacement":
        return "�" if data else ""
    if name in ("utf-16le", "utf-16be"):
        return data.decode(name.replace("utf-16", "utf-16-"), "replace")
    if name == "iso-2022-jp":
        return data.decode("iso2022_jp_ext", "replace")
    if name in SEVERAL:
        text = data.decode(SEVERAL[name][0], f"sheaf-{name}")
        return re.sub("[\\xa0\\uf8f0-\\uf8f3]", "�", text) if name == "shift_jis" else text
    if name not in _tables:
        _tables[name] = byte_table(name)
    return codecs.charmap_decode(data, "strict", _tables[name])[0]


@arrow_function("string")
def _decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, label in batches:
        done = 0
        for run in slices(data):
            yield pd.Series([None if d is None else decode_bytes(d, c) for d, c in zip(run, label[done : done + len(run)], strict=True)], dtype=object)
            done += len(run)


def decode_text(content: Column, charset: Column) -> Column:
    """Valid UTF-8 is cast where it lies; only other rows' bytes go to Python."""
    others = [label for label, name in ENCODINGS.items() if name != "utf-8"]
    label = F.coalesce(F.lower(F.regexp_replace(charset, r"\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")), F.lit(""))
    plain = ~label.isin(*others) & F.is_valid_utf8(content.cast("string"))
    return F.when(plain, content.cast("string")).otherwise(_decode(F.when(~plain, content), F.when(~plain, charset)))
