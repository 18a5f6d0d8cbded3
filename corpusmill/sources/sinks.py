"""Writers of translation memories and token texts as data sources: `df.write.format("corpusmill_tmx")`, after register(spark).

A task writes its files under a hidden name; when all tasks are done, the driver gives them their names, and if one fails it removes them. So a
failed job leaves no file, and a task that runs twice no repeated rows. Folders are addressed as pyarrow does (file, hdfs, s3, …).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class _FileWriter(DataSourceWriter):
    """Rows of a task as one file. Subclasses say how a file begins and ends, and what a row is in it."""

    suffix, head, foot = "", "", ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def row(self, row: Row) -> str:
        raise NotImplementedError

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> _Files:
        system, folder = self._folder()
        system.create_dir(folder)
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        hidden = f"{folder}/.{name}"
        count = 0
        try:
            with system.open_output_stream(hidden) as out:
                out.write(self.head.encode())
                for r in rows:
                    text = self.row(r)
                    count += bool(text)
                    out.write(text.encode())
                out.write(self.foot.encode())
        except BaseException:
            system.delete_file(hidden)
            raise
        if not count:
            system.delete_file(hidden)
        return _Files([name] if count else [])

    def commit(self, messages: list[_Files | None]) -> None:
        from pyarrow import fs

        system, folder = self._folder()
        new = [n for m in messages if m for n in m.names]
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.base_name.startswith("part-"):
                    system.delete_file(f.path)
        for n in new:
            system.move(f"{folder}/.{n}", f"{folder}/{n}")

    def abort(self, messages: list[_Files | None]) -> None:
        system, folder = self._folder()
        for n in (n for m in messages if m for n in m.names):
            system.delete_file(f"{folder}/.{n}")


class _TmxWriter(_FileWriter):
    suffix = ".tmx"
    head = '<?xml version="1.0" encoding="utf-8"?>\n<tmx version="1.4"><header segtype="sentence" o-tmf="plain" adminlang="en" datatype="PlainText"/>\n<body>\n'
    foot = "</body></tmx>\n"

    def row(self, row: Row) -> str:
        """A translation unit; one with an empty side is left out."""
        sides = ((row["src_lang"], row["src_text"]), (row["tgt_lang"], row["tgt_text"]))
        if not all((text or "").strip() for _, text in sides):
            return ""
        return "<tu>" + "".join(f"<tuv xml:lang={quoteattr(lang or '')}><seg>{escape(text)}</seg></tuv>" for lang, text in sides) + "</tu>\n"


class _VrtWriter(_FileWriter):
    suffix = ".vrt"

    def row(self, row: Row) -> str:
        return row["vrt"] + "\n" if row["vrt"] else ""


class _Sink(DataSource):
    writer_class: type[_FileWriter]

    def writer(self, schema: StructType, overwrite: bool) -> _FileWriter:
        path = self.options["path"]
        return self.writer_class(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1), overwrite)


class TmxSink(_Sink):
    """Rows (src_lang, src_text, tgt_lang, tgt_text) as translation memories, one a task."""

    writer_class = _TmxWriter

    @classmethod
    def name(cls) -> str:
        return "corpusmill_tmx"

    def schema(self) -> str:
        return "src_lang string, src_text string, tgt_lang string, tgt_text string"


class VrtSink(_Sink):
    """Rows (vrt) as token texts, one file a task."""

    writer_class = _VrtWriter

    @classmethod
    def name(cls) -> str:
        return "corpusmill_vrt"

    def schema(self) -> str:
        return "vrt string"


def register(spark: SparkSession) -> None:
    for source in (TmxSink, VrtSink):
        spark.dataSource.register(source)
