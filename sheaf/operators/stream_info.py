"""Type hints of a source: overlay, normalization, and inference from extensions and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import base_name, extension, let

FIELDS = ("mime_type", "extension", "charset", "filename", "local_path", "url")

#: The pinned table of extensions and their MIME types. The first extension of a type is the one that a
#: type alone gives.
EXTENSION_TYPES = {
    ".atom": "application/atom+xml",
    ".css": "text/css; charset=utf-8",
    ".csv": "text/csv; charset=utf-8",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".epub": "application/epub+zip",
    ".gif": "image/gif",
    ".htm": "text/html; charset=utf-8",
    ".html": "text/html; charset=utf-8",
    ".ipynb": "application/x-ipynb+json",
    ".jpeg": "image/jpeg",
    ".jpg": "image/jpeg",
    ".js": "text/javascript; charset=utf-8",
    ".json": "application/json",
    ".log": "text/plain; charset=utf-8",
    ".md": "text/markdown; charset=utf-8",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".rss": "application/rss+xml",
    ".txt": "text/plain; charset=utf-8",
    ".webp": "image/webp",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xml": "text/xml; charset=utf-8",
    ".yaml": "application/yaml",
    ".zip": "application/zip",
}

#: Signatures of content, as hex with __ for any byte, and their types, in the order of the sniffing standard.
SIGNATURES = (
    ("255044462D", "application/pdf"),
    ("252150532D41646F62652D", "application/postscript"),
    ("FEFF____", "text/plain; charset=utf-16be"),
    ("FFFE____", "text/plain; charset=utf-16le"),
    ("EFBBBF__", "text/plain; charset=utf-8"),
    ("00000100", "image/x-icon"),
    ("00000200", "image/x-icon"),
    ("424D", "image/bmp"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("52494646________574542505650", "image/webp"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("464F524D________41494646", "audio/aiff"),
    ("494433", "audio/mpeg"),
    ("4F67675300", "application/ogg"),
    ("4D54686400000006", "audio/midi"),
    ("52494646________41564920", "video/avi"),
    ("52494646________57415645", "audio/wave"),
    ("MP4", "video/mp4"),
    ("1A45DFA3", "video/webm"),
    ("__" * 34 + "4C50", "application/vnd.ms-fontobject"),
    ("00010000", "font/ttf"),
    ("4F54544F", "font/otf"),
    ("74746366", "font/collection"),
    ("774F4646", "font/woff"),
    ("774F4632", "font/woff2"),
    ("1F8B08", "application/x-gzip"),
    ("504B0304", "application/zip"),
    ("526172211A0700", "application/x-rar-compressed"),
    ("526172211A070100", "application/x-rar-compressed"),
    ("0061736D", "application/wasm"),
)
#: What HTML begins with, in any case, before a space or a closing sign.
HTML_TAGS = ("<!DOCTYPE HTML", "<HTML", "<HEAD", "<SCRIPT", "<IFRAME", "<H1", "<DIV", "<FONT", "<TABLE", "<A", "<STYLE", "<TITLE", "<B", "<BODY", "<BR", "<P", "<!--")


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def media_type(value: Column) -> Column:
    """The type without its parameters, in lower case."""
    return blank_to_null(F.lower(F.trim(F.substring_index(value, ";", 1))))


def media_charset(value: Column) -> Column:
    """The charset parameter, in lower case and without quotes."""
    found = F.regexp_extract(value, r"(?i);\s*charset\s*=\s*\"?([^\";\s]+)", 1)
    return blank_to_null(F.lower(F.trim(found)))


def normalized(info: dict[str, Column]) -> dict[str, Column]:
    """Extensions in lower case with their dot; a filename from the path and an extension from the filename where they
    lack; a MIME type without parameters, its charset taken over where none is given."""
    get = lambda name: blank_to_null(info.get(name, F.lit(None).cast("string")))
    path, mime = get("local_path"), get("mime_type")
    filename = F.coalesce(get("filename"), blank_to_null(base_name(path)))
    own = F.lower(F.trim(get("extension")))
    dotted = F.when(own.startswith("."), own).when(own.isNotNull(), F.concat(F.lit("."), own))
    return {
        "mime_type": media_type(mime),
        "extension": F.coalesce(blank_to_null(dotted), blank_to_null(F.lower(extension(filename)))),
        "charset": F.coalesce(blank_to_null(F.lower(F.trim(get("charset")))), media_charset(mime)),
        "filename": filename,
        "local_path": path,
        "url": get("url"),
    }


def merged(base: dict[str, Column], over: dict[str, Column]) -> dict[str, Column]:
    """Field by field, what the overlay has, else the base; then normalized. An empty string counts as unset."""
    return normalized({name: F.coalesce(*(blank_to_null(x[name]) for x in (over, base) if name in x), F.lit(None).cast("string")) for name in FIELDS})


def type_of_extension(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_TYPES.items() for x in pair])
    return F.element_at(table, ext)


def extension_of_type(mime: Column) -> Column:
    first: dict[str, str] = {}
    for ext, kind in EXTENSION_TYPES.items():
        first.setdefault(kind.split(";")[0], ext)
    return F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), mime)


def has_signature(digits: Column, signature: str) -> Column:
    """Whether content, as hex, begins with a signature. MP4's is the walk over a file's first box: its size, `ftyp`, and
    among its brands, without the version behind the first one, one that begins with mp4."""
    if signature != "MP4":
        return digits.like(f"{signature}%") if "_" in signature else digits.startswith(signature)
    size = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    whole = (F.substring(digits, 9, 8) == "66747970") & (size >= 12) & (size % 4 == 0) & (size * 2 <= F.length(digits))
    brands = F.sequence(F.lit(8), (size - 4).cast("int"), F.lit(4))
    return F.when(whole, F.exists(brands, lambda at: (at != 12) & (F.substr(digits, at * 2 + 1, F.lit(6)) == "6D7034"))).otherwise(False)


def sniffed_type(content: Column) -> Column:
    """By the first 512 bytes: HTML and XML openings, signatures, else text if no control byte is among them."""
    head = F.substring(content, 1, 512)
    digits = F.hex(head)
    bare = F.regexp_replace(digits, r"\A(?:09|0A|0C|0D|20)+", "")
    out = F.when(F.length(digits) == 0, "text/plain; charset=utf-8")
    tags = "|".join("".join(f"(?:{ord(c):02X}|{ord(c.lower()):02X})" for c in tag) for tag in HTML_TAGS if tag != "<!--")
    out = out.when(bare.rlike(rf"\A(?:{tags})(?:20|3E)") | bare.rlike(r"\A3C212D2D"), "text/html; charset=utf-8")
    out = out.when(bare.startswith("3C3F786D6C"), "text/xml; charset=utf-8")
    for signature, kind in SIGNATURES:
        out = out.when(has_signature(digits, signature), kind)
    control = digits.rlike(r"\A(?:..)*(?:0[0-8BEF]|1[0-9ACDEF])")  # tab, line feeds, form feed and escape may stand in text
    return out.when(control, "application/octet-stream").otherwise("text/plain; charset=utf-8")


def enriched(info: dict[str, Column], content: Column) -> Column:
    """A struct of all fields. What lacks is filled in: the type from the extension, else from the content; the extension from the type. A
    charset that was given stays."""
    given = F.struct(*(c.alias(n) for n, c in normalized(info).items()))

    def filled(given: Column) -> Column:
        known = F.coalesce(given["mime_type"], type_of_extension(given["extension"]))
        seen = F.when(known.isNull(), let(sniffed_type(content), lambda s: F.nullif(s, F.lit("application/octet-stream"))))
        return let(F.coalesce(known, seen), lambda kind: with_type(given, kind))

    def with_type(given: Column, kind: Column) -> Column:
        mime = media_type(kind)
        by_kind = F.when(given["mime_type"].isNull(), media_charset(kind))
        more = {"mime_type": mime, "charset": F.coalesce(given["charset"], by_kind), "extension": F.coalesce(given["extension"], extension_of_type(mime))}
        return F.struct(*(more.get(n, given[n]).alias(n) for n in FIELDS))

    return let(given, filled)
