"""A sink of documents: each row becomes one indented JSON file, which appears only when the whole job commits."""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerlens.sources.files import opened
from ledgerlens.sources.journal import camel_case

FORMAT = "json_documents"


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]  # file under its temporary name, and its own name


class DocumentWriter(DataSourceWriter):
    """Tasks write <name>.json.<job>-<attempt>.part; the commit renames them, an abort removes them."""

    def __init__(self, path: str, name: str):
        self.path, self.name, self.job = path, name, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        attempt, done = uuid.uuid4().hex, []
        try:
            for row in rows:
                fields = row.asDict(recursive=True)
                name = fields.pop(self.name)
                if not isinstance(name, str) or not re.fullmatch(r"[\w][\w.-]*", name):
                    raise ValueError(f"{name!r} is no file name")
                part = f"{folder}/{name}.json.{self.job}-{attempt}.part"
                done.append((part, f"{folder}/{name}.json"))
                text = json.dumps({camel_case(k): v for k, v in fields.items()}, indent=2, ensure_ascii=False, default=str)
                with store.open_output_stream(part, compression=None) as f:
                    f.write(text.encode())
        except BaseException:
            self._remove(store, [p for p, _ in done])
            raise
        return Written(done)

    def _remove(self, store: fs.FileSystem, parts: list[str]) -> None:
        for p in parts:
            if store.get_file_info(p).type == fs.FileType.File:
                store.delete_file(p)

    def _left(self, store: fs.FileSystem, folder: str) -> list[str]:
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return []
        return [e.path for e in store.get_file_info(fs.FileSelector(folder)) if f".json.{self.job}-" in e.base_name]

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        names = [n for m in messages if m for n in m.names]
        twice = [n for n, k in Counter(n for _, n in names).items() if k > 1]
        if twice:
            raise ValueError(f"{len(twice)} names are given twice, {twice[0]} for one")
        for part, name in names:
            store.move(part, name)
        self._remove(store, self._left(store, folder))  # what lost attempts have left

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        self._remove(store, self._left(store, folder))


class DocumentSink(DataSource):
    """df.write.format("json_documents").mode("append").option("name", column).save(folder)

    One file a row, called by the column named (letters, digits, _, . and -; option name, by default "name"); its other
    columns are the document, names in camelCase, nulls written. A document that is there is replaced. Names that repeat,
    or are none, fail the job and leave nothing; so does a task that fails for good. An empty table writes nothing.
    The commit renames one file after another on the driver, which holds the names only.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        name = self.options.get("name", "name")
        if name not in schema.names:
            raise ValueError(f"no column {name}")
        return DocumentWriter(self.options["path"], name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSink)
