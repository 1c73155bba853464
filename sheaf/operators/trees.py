"""Archives taken apart to all levels, one entry at a time, and put together again: steps over streams of rows."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import WS_CHARACTERS
from .archives import ArchiveLimits
from .stream_info import EXTENSION_TYPES

LIMIT = "archive limit"
#: Bytes that are inflated at a time.
PIECE = 1 << 16


class Budget:
    """Bytes that one source's archives may still be inflated to, on all levels together."""

    def __init__(self, limits: ArchiveLimits):
        self.limits, self.left = limits, limits.tree_bytes

    def read(self, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes, str | None]:
        """An entry's bytes, inflated in pieces, and the limit that it breaks; no more is inflated than the limits let."""
        held, size = [], 0
        with archive.open(info) as f:
            while piece := f.read(PIECE):
                size += len(piece)
                self.left -= len(piece)
                if size > self.limits.entry_bytes:
                    return b"", "entry size limit"
                if self.left < 0:
                    return b"", f"{self.limits.tree_bytes} bytes of all levels"
                held.append(piece)
        return b"".join(held), None


def is_archive(name: str, body: bytes) -> bool:
    ext = os.path.splitext(name)[1].lower()
    return ext == ".zip" or (body[:4] == b"PK\x03\x04" and ext not in EXTENSION_TYPES)


def tree_entries(content: bytes, limits: ArchiveLimits, path: str = "", level: int = 0, budget: Budget | None = None) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
    """(path, name, content, error) of all entries of an archive and of the archives in it, each before its own entries.
    A path holds the numbers of an entry and of the archives around it; directories are left out. What an archive breaks
    on comes with that archive's own path and ends it. One entry of each level is held at a time."""
    budget = budget or Budget(limits)
    if level >= limits.depth:
        yield path, None, None, f"{LIMIT}: recursion depth limit of {limits.depth}"
        return
    total = 0
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        listed = [i for i in archive.infolist() if not i.is_dir()]
    except Exception as e:  # noqa: BLE001  broken archives fail in many ways
        yield path, None, None, f"{type(e).__name__}: {e}"
        return
    for n, info in enumerate(listed):
        total += info.file_size
        broken = "entry limit" if n >= limits.entries else "entry size limit" if info.file_size > limits.entry_bytes else "total size limit" if total > limits.total_bytes else None
        body = b""
        if not broken:
            try:
                body, broken = budget.read(archive, info)
            except Exception as e:  # noqa: BLE001
                yield path, None, None, f"{type(e).__name__}: {e}"
                return
        if broken:
            yield path, None, None, f"{LIMIT}: {broken}"
            return
        inner = f"{path}/{n}".lstrip("/")
        yield inner, info.filename, body, None
        if is_archive(info.filename, body):
            yield from tree_entries(body, limits, inner, level + 1, budget)


def register_entries(spark: SparkSession, name: str = "archive_entries", limits: ArchiveLimits | None = None) -> None:
    """Makes a table function for SQL: archive_entries(content) gives (path, name, content, error) of all levels, row by
    row, as in `SELECT s.id, e.* FROM sources AS s, LATERAL archive_entries(s.content) AS e`. A null has no entries."""
    bound = limits or ArchiveLimits()

    class Entries:
        def eval(self, content: bytes):
            if content is not None:
                yield from tree_entries(bytes(content), bound)

    spark.udtf.register(name, F.udtf(Entries, returnType="path string, name string, content binary, error string"))


def opened(rows: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """rows (with content and is_archive) with path, name and archive_error: each row with an empty path, and after it
    the rows of its tree, whose other columns but the first, the source's, are null. Rows that are no archives go
    through as they come."""
    columns = rows.columns
    at_content, at_flag = columns.index("content"), columns.index("is_archive")
    schema = StructType(list(rows.schema)).add("path", "string").add("name", "string").add("archive_error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_tops(batch: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.nulls(batch.num_rows, pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([""] * batch.num_rows, pa.string()), none, none], [*columns, "path", "name", "archive_error"])

        def entry(batch: pa.RecordBatch, i: int, path: str, name: str | None, body: bytes | None, error: str | None) -> pa.RecordBatch:
            made = [batch.column(0).slice(i, 1) if j == 0 else pa.array([body], pa.binary()) if j == at_content else pa.array([False]) if j == at_flag else pa.nulls(1, c.type) for j, c in enumerate(batch.columns)]
            return pa.RecordBatch.from_arrays([*made, *(pa.array([x], pa.string()) for x in (path, name, error))], [*columns, "path", "name", "archive_error"])

        for batch in batches:
            done = 0
            for i, archive in enumerate(batch.column(at_flag).to_pylist()):
                if archive:
                    yield with_tops(batch.slice(done, i + 1 - done))
                    for found in tree_entries(batch.column(at_content)[i].as_py() or b"", limits):
                        yield entry(batch, i, *found)
                    done = i + 1
            if done < batch.num_rows:
                yield with_tops(batch.slice(done))

    return rows.mapInArrow(run, schema)


def joined(rows: DataFrame) -> DataFrame:
    """(source_id, tries) of each source from rows (source_id, tries, path, name, label, archive_error, is_archive) as `opened` gave
    them, in that order: an archive's text is made of its entries' texts, the innermost first. A tree's rows follow each
    other in one partition, so nothing is shuffled; one tree is held at a time, which the limits bound."""
    kind = rows.select("source_id", "tries").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("tries")], ["source_id", "tries"])

        def tree() -> pa.RecordBatch:
            top = held[0]
            solved = written_tree([row for b in held for row in b.select(["path", "name", "label", "tries", "archive_error"]).to_pylist()])
            held.clear()
            return pa.RecordBatch.from_arrays([top.column("source_id").slice(0, 1), pa.array([solved], top.schema.field("tries").type)], ["source_id", "tries"])

        for batch in batches:
            path, archive, error = (batch.column(c).to_pylist() for c in ("path", "is_archive", "archive_error"))
            at = 0
            while at < batch.num_rows:
                to = at + 1
                if path[at] == "" and error[at] is None and not archive[at]:
                    # sources that are no archives go through together
                    if held:
                        yield tree()
                    while to < batch.num_rows and path[to] == "" and error[to] is None and not archive[to]:
                        to += 1
                    yield plain(batch.slice(at, to - at))
                else:
                    if held and path[at] == "" and error[at] is None:
                        yield tree()
                    while to < batch.num_rows and (path[to] != "" or error[to] is not None):
                        to += 1
                    held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield tree()

    return rows.mapInArrow(run, kind)


def written_tree(rows: list[dict]) -> list[dict]:
    """The tries of a tree's top, where archives are texts now: a heading with the label, then a section for each entry
    that has any text. A limit that an inner archive breaks is the whole archive's failure."""
    errors, nodes, inside = {}, {}, {}
    for row in rows:
        if row["archive_error"] is not None:
            errors[row["path"]] = row["archive_error"]
        else:
            nodes[row["path"]] = row
    for path in nodes:
        if path:
            inside.setdefault(path.rpartition("/")[0], []).append(path)

    def solved(path: str) -> list[dict]:
        tries = nodes[path]["tries"] or []
        for attempt in tries:
            if attempt["converter"] == "zip":
                attempt["markdown"], attempt["error"] = written(path)
        return tries

    def written(path: str) -> tuple[str | None, str | None]:
        if path in errors:
            return None, errors[path]
        sections = [f"Content from zip file `{nodes[path]['label']}`"]
        for inner in sorted(inside.get(path, ()), key=lambda p: int(p.rpartition("/")[2])):
            tries = solved(inner)
            good = next((t for t in tries if t["error"] is None), None)
            limit = next((t["error"] for t in tries if t["error"] and LIMIT in t["error"]), None)
            if good is None and limit:
                return None, limit
            body = ((good or {}).get("markdown") or "").strip(WS_CHARACTERS)
            if body:
                sections.append(f"## File: {nodes[inner]['name']}\n\n{body}")
        return "\n\n".join(sections), None

    return solved("")
