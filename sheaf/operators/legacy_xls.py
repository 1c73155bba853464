"""Workbooks of the older binary format: compound files, then BIFF records, read in Arrow batches."""

from __future__ import annotations

import struct
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tables import drop_blank_rows, greatest_width, render_table
from ..functions.text import let
from .dispatch import Source
from .number_formats import BUILT_IN, general, shown_number, shown_text
from .office import GRID, read_once, reader

#: The compound file's signature and its marks for sectors that end a chain or aren't used.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
LAST_SECTOR = 0xFFFFFFFA

#: Record numbers.
BOF, EOF, BOUNDSHEET, SST, CONTINUE, FORMAT, XF, DATEMODE = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22
LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


class XlsError(ValueError):
    pass


def workbook_stream(data: bytes) -> bytes:
    """The stream named Workbook, or Book, of a compound file."""
    if data[:8] != SIGNATURE or len(data) < 512:
        raise XlsError("not a compound file")
    sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, = struct.unpack_from("<I", data, 48)
    cutoff, mini_first = struct.unpack_from("<II", data, 56)
    extra, = struct.unpack_from("<I", data, 68)
    block = lambda n: data[512 + n * sector : 512 + (n + 1) * sector] if sector == 512 else data[(n + 1) * sector : (n + 2) * sector]
    longs = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    tables, seen = [n for n in struct.unpack_from("<109I", data, 76) if n < LAST_SECTOR], set()
    while extra < LAST_SECTOR and extra not in seen:
        seen.add(extra)
        more = longs(block(extra))
        if not more:
            break
        tables += [n for n in more[:-1] if n < LAST_SECTOR]
        extra = more[-1]
    follows = [n for t in tables for n in longs(block(t))]

    def chain(n: int, table: list[int]) -> list[int]:
        out = []
        while n < LAST_SECTOR:
            if n >= len(table) or len(out) > len(table):
                raise XlsError("a broken chain of sectors")
            out.append(n)
            n = table[n]
        return out

    entries = b"".join(map(block, chain(directory, follows)))
    small_table = longs(b"".join(map(block, chain(mini_first, follows)))) if mini_first < LAST_SECTOR else []
    root, found = None, {}
    for at in range(0, len(entries) - 127, 128):
        length, = struct.unpack_from("<H", entries, at + 64)
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "ignore").lower()
        start, size = struct.unpack_from("<II", entries, at + 116)
        if entries[at + 66] == 5:
            root = start
        elif entries[at + 66] == 2:
            found.setdefault(name, (start, size))
    for name in ("workbook", "book"):
        if name in found:
            start, size = found[name]
            if size < cutoff and root is not None:
                body = b"".join(map(block, chain(root, follows)))
                return b"".join(body[n * mini : (n + 1) * mini] for n in chain(start, small_table))[:size]
            return b"".join(map(block, chain(start, follows)))[:size]
    raise XlsError("no workbook in the file")


def records(data: bytes, at: int = 0):
    """(number, body, place) up to the end of the data."""
    while at + 4 <= len(data):
        number, length = struct.unpack_from("<HH", data, at)
        yield number, data[at + 4 : at + 4 + length], at
        at += 4 + length


class Strings:
    """Reads strings that run across records; a new record repeats the flag of how characters are stored."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            here = self.parts[self.part]
            if self.at >= len(here):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise XlsError("strings are cut short")
                continue
            piece = here[self.at : self.at + n]
            out, self.at, n = out + piece, self.at + len(piece), n - len(piece)
        return out

    def string(self) -> str:
        here, at = self.parts[self.part], self.at
        if at + 3 <= len(here) and not here[at + 2] & 12:  # most have no runs and lie in one record
            count, wide = here[at] | here[at + 1] << 8, here[at + 2] & 1
            end = at + 3 + (2 * count if wide else count)
            if end <= len(here):
                self.at = end
                return here[at + 3 : end].decode("utf-16-le" if wide else "latin1", "replace")
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, ""
        while count:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise XlsError("strings are cut short")
                wide = self.take(1)[0] & 1
            room = (len(self.parts[self.part]) - self.at) // (2 if wide else 1)
            n = min(count, room)
            if not n:
                raise XlsError("a character is cut in two")
            out += self.take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin1", "replace")
            count -= n
        self.take(4 * runs + more)
        return out


def shared_strings(parts: tuple[bytes, ...]) -> list[str]:
    strings = Strings(list(parts))
    _, unique = struct.unpack("<II", strings.take(8))
    return [strings.string() for _ in range(unique)]


#: What small tables are read to, which many books have alike.
small_strings = lru_cache(256)(shared_strings)


def short_string(body: bytes, at: int, wide_count: bool) -> str:
    if wide_count:
        (count,), at = struct.unpack_from("<H", body, at), at + 2
    else:
        count, at = body[at], at + 1
    wide = body[at] & 1
    raw = body[at + 1 : at + 1 + count * (2 if wide else 1)]
    return raw.decode("utf-16-le" if wide else "latin1", "replace")


def packed_number(value: int) -> float:
    number = float(value >> 2 if value < 1 << 31 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def parse_xls(data: bytes) -> list[dict]:
    stream = workbook_stream(data)
    sheets, shared, codes, styles, epoch = [], [], dict(BUILT_IN), [], False
    listed = []
    for record in records(stream):  # what lies behind the book's own records is read by sheet
        listed.append(record)
        if record[0] == EOF:
            break
    if not listed or listed[0][0] != BOF:
        raise XlsError("not a workbook of this format")
    for i, (number, body, _) in enumerate(listed):
        if number == EOF:
            break
        if number == BOUNDSHEET:
            place, = struct.unpack_from("<I", body)
            if body[5] == 0:
                sheets.append((place, short_string(body, 6, False)))
        elif number == SST:
            parts = [body]
            for follow, more, _ in listed[i + 1 :]:
                if follow != CONTINUE:
                    break
                parts.append(more)
            shared = (small_strings if sum(map(len, parts)) <= 1 << 16 else shared_strings)(tuple(parts))
        elif number == FORMAT:
            codes[struct.unpack_from("<H", body)[0]] = short_string(body, 2, True)
        elif number == XF:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif number == DATEMODE:
            epoch = body[:1] == b"\x01"

    styled = [codes.get(style) for style in styles]
    code = lambda style: styled[style] if style < len(styled) else None

    def shown(value: float, style: int) -> str:
        return shown_number(value, code(style), epoch) or general(value)

    out = []
    for index, (place, name) in enumerate(sheets):
        cells: dict[tuple[int, int], str] = {}
        waiting = None
        try:
            depth = 0
            for number, body, _ in records(stream, place):
                if number == BOF:
                    depth += 1
                elif number == EOF:
                    depth -= 1
                    if depth <= 0:
                        break
                elif depth == 1:
                    if number in (LABELSST, LABEL, RSTRING, NUMBER, RK, FORMULA, BOOLERR):
                        row, column, style = struct.unpack_from("<HHH", body)
                    if number == LABELSST:
                        cells[row, column] = shown_text(shared[struct.unpack_from("<I", body, 6)[0]], code(style))
                    elif number in (LABEL, RSTRING):
                        cells[row, column] = shown_text(short_string(body, 6, True), code(style))
                    elif number == NUMBER:
                        cells[row, column] = shown(struct.unpack_from("<d", body, 6)[0], style)
                    elif number == RK:
                        cells[row, column] = shown(packed_number(struct.unpack_from("<I", body, 6)[0]), style)
                    elif number == MULRK:
                        row, first = struct.unpack_from("<HH", body)
                        for k in range((len(body) - 6) // 6):
                            style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                            cells[row, first + k] = shown(packed_number(value), style)
                    elif number == BOOLERR:
                        cells[row, column] = ERRORS.get(body[6], "#ERR") if body[7] else ("TRUE" if body[6] else "FALSE")
                    elif number == FORMULA:
                        if body[12:14] != b"\xff\xff":
                            cells[row, column] = shown(struct.unpack_from("<d", body, 6)[0], style)
                        elif body[6] == 0:
                            waiting = (row, column)
                        elif body[6] == 1:
                            cells[row, column] = "TRUE" if body[8] else "FALSE"
                        elif body[6] == 2:
                            cells[row, column] = ERRORS.get(body[8], "#ERR")
                    elif number == STRING and waiting:
                        cells[waiting] = short_string(body, 0, True)
                        waiting = None
        except (struct.error, IndexError):
            continue  # a sheet that can't be read is left out
        grid, last = [], {}
        for r, c in cells:
            if len(cells) < 2000 or c < 256:
                last[r] = max(c, last.get(r, -1))
        for r in range(max((r for r, _ in cells), default=-1) + 1):
            grid.append([cells.get((r, c), "").strip() for c in range(last.get(r, -1) + 1)])
        out.append({"name": name.strip() or f"Sheet {index + 1}", "grid": grid})
    return out


read_xls = reader(parse_xls, f"array<struct<name:string,grid:{GRID}>>")


def xls(source: Source) -> Column:
    """A heading for each sheet and its table without blank rows."""

    def sheet(s):
        table = let(drop_blank_rows(s["grid"]), lambda grid: render_table(grid, greatest_width(grid)))
        return F.concat_ws("\n\n", F.concat(F.lit("## "), s["name"]), F.nullif(table, F.lit("")))

    return read_once(read_xls(source.content), lambda sheets: F.array_join(F.transform(sheets, sheet), "\n\n"))
