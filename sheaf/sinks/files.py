"""A sink that writes one file a row: `df.write.format("document_files").mode("append").save(folder)`."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its own folder, and the names in it."""

    folder: str
    names: list[str]


class DocumentWriter(DataSourceWriter):
    """Each task writes into a folder of its own under _temporary. When all have ended the driver moves the files to
    where they belong; a task that fails, or is done again elsewhere, leaves nothing behind. The folder is in any store
    that Arrow has a file system for."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.job = uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")

    def write(self, rows: Iterator[Row]) -> Written:
        store, base = self.place()
        own = f"{base}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        names = []
        for row in rows:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {name!r}")
            with store.open_output_stream(f"{own}/{name}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            names.append(name)
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self.place()
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        store.create_dir(base, recursive=True)
        if self.overwrite:
            old = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.is_file]
            for path in old:
                store.delete_file(path)
        for message in done:
            for name in message.names:
                store.move(f"{message.folder}/{name}", f"{base}/{name}")
        self.clear(store, base)
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*self.place())

    def clear(self, store: fs.FileSystem, base: str) -> None:
        mine = f"{base}/_temporary/{self.job}"
        if store.get_file_info(mine).type != fs.FileType.NotFound:
            store.delete_dir(mine)
        rest = f"{base}/_temporary"
        if store.get_file_info(rest).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(rest)):
            store.delete_dir(rest)


class DocumentFiles(DataSource):
    """Rows (name, content) as files; content is text or bytes."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        missing = {"name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return DocumentWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(DocumentFiles)
