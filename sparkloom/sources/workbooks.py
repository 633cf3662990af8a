"""Workbooks as a data source: spark.read.format("workbook") and df.write.format("workbook").

Each file's first sheet is read in ranges of rows, each by a task of its own, which parses
the sheet as a stream and the shared strings once. Paths are opened through Arrow's file
systems, so they may be local, on HDFS or in an object store.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Rows that a task reads unless the option rowsPerPartition says otherwise, and that a batch has.
ROWS, BATCH = 100_000, 4096
#: Characters that XML cannot hold, and how workbooks spell them.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_SPELLED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def clean_names(names: list[str]) -> list[str]:
    """Trimmed; blank ones named by place; repeated ones numbered."""
    out: list[str] = []
    for k, n in enumerate(names):
        base = name = (n or "").strip().lstrip("﻿") or f"unnamed_{k}"
        again = 1
        while name in out:
            name, again = f"{base}.{again}", again + 1
        out.append(name)
    return out


def _plain(text: str | None) -> str:
    return _SPELLED.sub(lambda m: chr(int(m[1], 16)), text or "")


def _strings(z: zipfile.ZipFile) -> list[str]:
    """Shared strings, read as a stream."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if e.tag == f"{_NS}si":
                out.append("".join(_plain(t.text) for t in e.iter(f"{_NS}t")))
                e.clear()
    return out


def _sheet(z: zipfile.ZipFile) -> str:
    """The part of the first sheet: by the workbook's order where it is there, else by number."""
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
    if not sheets:
        raise ValueError("a workbook without sheets")
    try:
        first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"))
        wanted = next(v for k, v in first.attrib.items() if k.endswith("}id"))
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == wanted)
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        return name if name in z.namelist() else sheets[0]
    except (KeyError, StopIteration):
        return sheets[0]


def _place(reference: str, k: int) -> int:
    letters = re.match(r"[A-Z]+", reference)
    if not letters:
        return k
    at = 0
    for x in letters[0]:
        at = at * 26 + ord(x) - 64
    return at - 1


def rows_of(z: zipfile.ZipFile, first: int = 0, last: int | None = None, strings: list[str] | None = None) -> Iterator[list[str | None]]:
    """Cells of rows first .. last - 1 of the first sheet, as strings; rows before are passed over as they stream by."""
    with z.open(_sheet(z)) as part:
        root, seen = None, 0
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            root = e if root is None else root
            if event != "end" or e.tag != f"{_NS}row":
                continue
            if last is not None and seen >= last:
                return
            if seen >= first:
                if strings is None:
                    strings = _strings(z)
                cells: dict[int, str | None] = {}
                for k, c in enumerate(e.findall(f"{_NS}c")):
                    value, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                    text = "".join(_plain(t.text) for t in inline.iter(f"{_NS}t")) if inline is not None else value.text if value is not None else None
                    cells[_place(c.get("r", ""), k)] = strings[int(text)] if c.get("t") == "s" and text is not None else text
                yield [cells.get(k) or None for k in range(max(cells, default=-1) + 1)]
            seen += 1
            for done in list(root):  # what is read goes, also from its parent
                done.clear()
            e.clear()


def row_count(z: zipfile.ZipFile) -> int:
    """Rows of the first sheet, by its row elements."""
    tag, n, rest = re.compile(rb"<(?:\w+:)?row[\s/>]"), 0, b""
    with z.open(_sheet(z)) as part:
        while block := part.read(1 << 20):
            block = rest + block
            cut = max(block.rfind(b"<"), 0)  # a tag may go on in the next block
            n += len(tag.findall(block[:cut]))
            rest = block[cut:]
    return n + len(tag.findall(rest))


def write(out, names: list[str], rows: Iterator) -> None:
    """A workbook with inline strings, to a path or a file."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        text = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
        sheet.write(f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
        for r in _chained(names, rows):
            sheet.write(f"<row>{''.join(map(cell, r))}</row>".encode())
        sheet.write(b"</sheetData></worksheet>")


def _chained(first, rest):
    yield first
    yield from rest


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Workbooks at a path, or in a folder; hidden names are left out."""
    system, own = _opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [own]
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(own)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class _Range(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, rows: int):
        self.path, self.names, self.rows = path, schema.names, rows

    def partitions(self) -> list[_Range]:
        system, _ = _opened(self.path)
        out = []
        for f in _files(self.path):
            with system.open_input_file(f) as file, zipfile.ZipFile(file) as z:
                n = row_count(z)
            out += [_Range(f, k, min(k + self.rows, n)) for k in range(1, n, self.rows)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        schema = pa.schema([(n, pa.string()) for n in self.names])
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as file, zipfile.ZipFile(file) as z:
            header = clean_names([str(c or "") for c in next(rows_of(z, 0, 1), [])])
            at = [header.index(n) if n in header else None for n in self.names]
            if None in at and not all(n.startswith("unnamed_") for n, k in zip(self.names, at) if k is None):
                raise ValueError(f"{partition.file} has other columns: {header}")
            held: list[list] = []
            for row in rows_of(z, partition.first, partition.last):
                held.append([row[k] if k is not None and k < len(row) else None for k in at])
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.names = path, schema.names
        system, own = _opened(path)
        if overwrite and system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir_contents(own)
        system.create_dir(own, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """One workbook for a task that has rows, under a name of its own."""
        system, own = _opened(self.path)
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        head = next(rows, None)
        if head is None:
            return _Written(None)
        made = io.BytesIO()
        write(made, self.names, _chained(head, rows))
        path = f"{own.rstrip('/')}/part-{uuid.uuid4().hex}.xlsx"
        with system.open_output_stream(path) as out:
            out.write(made.getbuffer())
        return _Written(path)

    def commit(self, messages: list) -> None:
        """A mark that the folder is whole."""
        system, own = _opened(self.path)
        with system.open_output_stream(f"{own.rstrip('/')}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class WorkbookSource(DataSource):
    """Options: path; rowsPerPartition. All columns are strings; a schema of some of the columns reads only these."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        path = self.options["path"]
        system, _ = _opened(path)
        for f in _files(path):
            with system.open_input_file(f) as file, zipfile.ZipFile(file) as z:
                names = clean_names([str(c or "") for c in next(rows_of(z, 0, 1), [])])
            return T.StructType([T.StructField(n, T.StringType()) for n in names])
        raise ValueError(f"no workbooks in {path}")

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema, int(self.options.get("rowsPerPartition", ROWS)))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark) -> None:
    """Makes format("workbook") known to a session."""
    spark.dataSource.register(WorkbookSource)
