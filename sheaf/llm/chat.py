"""Chat formatting: a finite-state machine over roles, a declarative template and per-segment loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. Control strings inside texts get `escape` before them, and so does `escape` itself.

    labels: the written name of each known role; any other role is written as unknown + its own name, escaped.
    turns: the states (last roles) from which a role may follow; "" is the start. ends: roles that may come last.
    """

    opening: str = "### "
    between: str = ": "
    closing: str = "</turn>"
    escape: str = "\\"
    unknown: str = "?"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    turns: dict = field(default_factory=lambda: {"system": ("",), "user": ("", "system", "assistant"), "assistant": ("user",)})
    ends: tuple = ("assistant",)
    loss_roles: tuple = ("assistant",)

    def pattern(self) -> re.Pattern:
        """Of all control strings. `between` only matters in labels, so texts keep it as it is."""
        return re.compile("|".join(re.escape(x) for x in (self.escape, self.opening, self.closing, self.between)))

    def escaped(self, text: str, label: bool = False) -> str:
        return self.pattern().sub(lambda m: m.group() if m.group() == self.between and not label else self.escape + m.group(), text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + f"({self.pattern().pattern})", lambda m: m.group(1), text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as pieces of output with their loss flags."""
        label = self.labels.get(role) or self.unknown + self.escaped(role, label=True)
        return [(self.opening + label + self.between, False), (self.escaped(text), role in self.loss_roles), (self.closing, False)]

    def parse(self, output: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of an output, read back."""
        names = {label: role for role, label in self.labels.items()}
        token = re.compile(re.escape(self.escape) + f"(?:{self.pattern().pattern})|({re.escape(self.opening)})|({re.escape(self.between)})|({re.escape(self.closing)})")
        at, role, began = 0, None, 0
        for m in token.finditer(output):
            if m.group(1) is not None and role is None:
                began = m.end()
            elif m.group(2) is not None and role is None:
                label = output[began : m.start()]
                role, at = names[label] if label in names else self.unescaped(label[len(self.unknown) :]), m.end()
            elif m.group(3) is not None and role is not None:
                yield role, self.unescaped(output[at : m.start()])
                role = None


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, position, role, state_ok, valid_so_far, segments) of each turn, in order within each partition.

    Rows are dealt by conv_id and sorted by turn, ties by role and text; each partition is then read as a stream with
    the machine's state alone, so a conversation of any length needs no memory. Null texts and roles count as empty
    strings, null turns come first, a null conv_id is a conversation of its own. A turn that the machine doesn't allow
    is kept and written, with state_ok false; valid_so_far tells whether all turns up to this one were in order.
    """
    template = template or Template()
    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, position, fine = object(), "", 0, True
        for batch in batches:
            ids, positions, roles, oks, fines, segments = [], [], [], [], [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != current:
                    current, state, position, fine = conv, "", 0, True
                ok = state in template.turns.get(role, ())
                fine = fine and ok
                ids.append(conv)
                positions.append(position)
                roles.append(role)
                oks.append(ok)
                fines.append(fine)
                segments.append([{"text": x, "loss": loss} for x, loss in template.segments(role, text)])
                state, position = role, position + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(positions, pa.int64()), pa.array(roles, pa.string()), pa.array(oks, pa.bool_()), pa.array(fines, pa.bool_()), pa.array(segments, SEGMENTS)], ["conv_id", "position", "role", "state_ok", "valid_so_far", "segments"])

    return ordered.mapInArrow(run, "conv_id long, position long, role string, state_ok boolean, valid_so_far boolean, segments array<struct<text:string,loss:boolean>>")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation, computed from the segments alone: the written turns are parsed and unescaped again.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid). It reads format_conversations'
    output as it lies and keeps a running digest, never a conversation. Turns that don't follow each other, as when the
    output has been dealt or ordered otherwise, are an error.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        rows: list[tuple] = []
        open_: dict | None = None

        def close() -> None:
            if open_:
                rows.append((open_["id"], open_["n"], open_["turns"].hexdigest(), open_["loss_n"], open_["loss"].hexdigest(), open_["chars"], open_["fine"] and open_["last"] in template.ends))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for conv, position, fine, segments in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
                if position == 0:
                    close()
                    open_ = {"id": conv, "at": 0, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "fine": True, "last": ""}
                elif open_ is None or conv != open_["id"] or position != open_["at"] + 1:
                    raise ValueError(f"turn {position} of conversation {conv} doesn't follow the one before it")
                open_["at"] = position
                written = "".join(x["text"] for x in segments)
                for role, text in template.parse(written):
                    open_["n"] += 1
                    open_["last"] = role
                    open_["turns"].update(f"{role}\n{text}\n".encode())
                for x in segments:
                    if x["loss"]:
                        text = template.unescaped(x["text"])
                        open_["loss_n"] += len(text)
                        open_["loss"].update(text.encode())
                open_["chars"] += len(written)
                open_["fine"] = fine
            if rows:
                yield flush()
        close()
        if rows:
            yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
