"""Files as rows of cells: CSV, workbooks and ZIP members, without a header. One task reads a file; rows leave it in batches."""

from __future__ import annotations

import codecs
import csv
import io
import json
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargelens.sources import binary_workbook
from chargelens.sources.ranges import open_file

GRID = "path string, sheet string, active boolean, row_idx long, cells array<string>"
BATCH = 5000
HEAD_BYTES = 64 * 1024
#: Heads leave a task in batches of so many files, or of about so many characters.
HEAD_FILES, HEAD_CHARS = 1000, 4 << 20
# Cells that count as empty in chargemaster tables.
EMPTY_CELLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Chargemaster file names and sheet names.
TABLE_FILE, TABLE_FILE_NOT = r"(?i)cdm", r"(?i)pct[_\s-]*chg|common\s*\d+|25\s*most|top\s*\d+|comments?"
SHEET_NOT = r"(?i)instructions|summary|pcgr|contents|index|cover|revenue\s*summary|legend|readme|\btotals?\b"

#: What reading a damaged workbook or archive raises.
DAMAGED = (binary_workbook.NotAWorkbook, struct.error, IndexError, KeyError, ValueError, OverflowError, zipfile.BadZipFile, zlib.error, ET.ParseError, NotImplementedError, RuntimeError)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder. A file must be smaller than 2 GB."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def chargemaster_files(all_files: DataFrame) -> DataFrame:
    """Chargemaster candidates by name and size, with the year and hospital folder in their path."""
    name, lower = F.element_at(F.split("path", "/"), -1), F.lower("path")
    kept = name.rlike(TABLE_FILE) & ~name.rlike(TABLE_FILE_NOT) & ~name.startswith("~$") & lower.rlike(r"\.(xlsx|xlsm|xls|csv)$") & (F.col("length") >= 1024)
    year = F.regexp_extract("path", r"/(20\d{2})/", 1)
    return all_files.filter(kept & (year != "")).withColumns({"year": year.cast("int"), "hospital_folder": F.element_at(F.split("path", "/"), -2)})


def largest_per_owner(candidates: DataFrame, owner: str = "ccn") -> DataFrame:
    """The largest file of each owner; the last path wins a tie."""
    others = [c for c in candidates.columns if c != owner]
    return candidates.groupBy(owner).agg(F.max_by(F.struct(*others), F.struct("length", "path")).alias("f")).select(owner, "f.*")


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _cell(c: ET.Element, strings: _Strings) -> str | None:
    kind, v = c.get("t"), c.find(_MAIN + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_MAIN + "t"))
    if v is None or v.text is None:
        return None
    if kind == "b":
        return "True" if v.text == "1" else "False"
    return strings[int(v.text)] if kind == "s" else v.text


def _sheet_rows(stream, strings: _Strings) -> Iterator[tuple[int, list[str | None]]]:
    at = -1
    for _, row in ET.iterparse(stream):
        if row.tag != _MAIN + "row":
            continue
        at = int(row.get("r", at + 2)) - 1
        cells: list[str | None] = []
        for c in row.iter(_MAIN + "c"):
            k = _column(c.get("r")) if c.get("r") else len(cells)
            cells.extend([None] * (k - len(cells)))
            cells.append(_cell(c, strings))
        row.clear()
        yield at, cells


class _Strings:
    """A workbook's shared strings, read as far as they are asked for."""

    def __init__(self, z: zipfile.ZipFile):
        self.known: list[str] = []
        self.parsed = ET.iterparse(z.open("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in z.namelist() else iter(())

    def __getitem__(self, k: int) -> str:
        while len(self.known) <= k:
            _, item = next(self.parsed, (None, None))
            if item is None:
                raise IndexError(k)
            if item.tag == _MAIN + "si":
                self.known.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
                item.clear()
        return self.known[k]


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, bool, Iterator[tuple[int, list[str | None]]]]]:
    strings = _Strings(z)
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    view = book.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    for k, sheet in enumerate(book.find(_MAIN + "sheets")):
        with z.open(posixpath.normpath(posixpath.join("/xl", targets[sheet.get(_REL)])).lstrip("/")) as stream:
            yield sheet.get("name"), k == active, _sheet_rows(stream, strings)


def _open(file, member: str | None = None, kinds: tuple[str, ...] = (".csv", ".json")):
    """(container, inner name, stream) of an open file; the stream is None for workbooks and unreadable archives. Of an archive only the directory is read."""
    magic = file.read(8)
    file.seek(0)
    if magic.startswith(binary_workbook.MAGIC):
        return "xls", None, None
    if not magic.startswith(b"PK\x03\x04"):
        return "plain", None, file
    try:
        z = zipfile.ZipFile(file)
        if "[Content_Types].xml" in z.namelist():
            return "xlsx", None, None
        inner = next((n for n in z.namelist() if n.lower().endswith(kinds) and (member or "") in n.lower()), None)
        return ("zip", inner, z.open(inner)) if inner else ("unknown_zip", None, None)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
        return "bad_zip", None, None


def _csv_rows(stream) -> Iterator[tuple[int, list[str]]]:
    csv.field_size_limit(2**31 - 1)
    text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
    yield from enumerate(csv.reader(text))


def _table_rows(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """Rows as wide as the first at most, blank lines left out; bytes that aren't UTF-8 are Latin-1."""
    try:
        codecs.decode(data, "utf-8")
        encoding = "utf-8"
    except UnicodeDecodeError:
        encoding = "latin-1"
    try:
        chunks = pd.read_csv(io.BytesIO(data), header=None, dtype=str, encoding=encoding, on_bad_lines="skip", keep_default_na=False, chunksize=BATCH)
    except pd.errors.EmptyDataError:
        return
    at = 0
    for chunk in chunks:
        for row in chunk.itertuples(index=False):
            yield at, [c if isinstance(c, str) else None for c in row]
            at += 1


def _tables(data: bytes, table: bool, member: str | None) -> Iterator[tuple[str, bool, Iterator]]:
    kind, _, stream = _open(io.BytesIO(data), member, (".csv",))
    if kind == "xls":
        yield from binary_workbook.sheets(data)
    elif kind == "xlsx":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            yield from _sheets(z)
    elif stream is not None:
        yield "(csv)", True, _table_rows(stream.read()) if table else _csv_rows(stream)


def grid(source: DataFrame, head: int | None = None, table: bool = False, member: str | None = None) -> DataFrame:
    """All cells of all files, one row a line or sheet row.

    ``head`` stops after that many lines of each sheet. ``table`` reads CSV as chargemasters are read (lines wider than the
    first and blank lines are left out, UTF-8 else Latin-1); otherwise lines are kept as they are and undecodable bytes
    replaced. ``member`` is a part of the wanted archive member's lower-case name. Unreadable archives and workbooks and empty files give no rows, or those before the damage;
    the logs of price_files.parse() and chargemaster.parse() name them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    for sheet, active, rows in _tables(data or b"", table, member):
                        rows = islice(rows, head)
                        while part := list(islice(rows, BATCH)):
                            yield pd.DataFrame({"path": path, "sheet": sheet, "active": active, "row_idx": [i for i, _ in part], "cells": [c for _, c in part]})
                except DAMAGED:
                    continue

    return source.select("path", "content").mapInPandas(read, GRID)


def blank_to_null(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.when(~c.isin(*EMPTY_CELLS), c))


class _Counted(io.RawIOBase):
    """A file that counts the bytes read from it."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at, whence)

    def tell(self) -> int:
        return self.file.tell()

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(n)
        self.bytes_read += len(data)
        return data


def _head_of(file) -> tuple[str, str | None, str, list[list[str]]]:
    """(kind, inner name, text of the first 64 KB, first three rows)."""
    kind, inner, stream = _open(file)
    head, top = "", []
    if stream is not None:
        head = stream.read(HEAD_BYTES).decode("utf-8", "ignore").lstrip("\ufeff").lstrip()
        try:
            csv.field_size_limit(2**31 - 1)
            top = list(islice(csv.reader(io.StringIO(head)), 3))
        except csv.Error:
            kind = "bad_csv"
    elif kind == "xlsx":
        try:
            with zipfile.ZipFile(file) as z:
                for _, active, rows in _sheets(z):
                    if active:
                        top = [[c or "" for c in r] for _, r in islice(rows, 3)]
                        break
        except DAMAGED:
            kind = "bad_zip"
    return kind, inner, head, top


def heads(files: DataFrame) -> DataFrame:
    """(path, length, kind, inner, head, top, bytes_read) of each file: its container, the member that counts, the first 64 KB of text and the first three rows.

    files: path and length, as ranges.listing() gives them, and only these parts are read: the first bytes, an archive's directory, and of a workbook
    the first rows and the strings they need. With a column ``content`` that is used instead.
    """
    stored = "content" in files.columns
    columns = ["path", "length", "kind", "inner", "head", "top", "bytes_read"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chars = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                with io.BytesIO(row.content or b"") if stored else open_file(row.path, HEAD_BYTES) as opened:
                    file = _Counted(opened)
                    part.append((row.path, row.length, *(found := _head_of(file)), file.bytes_read))
                chars += len(found[2]) + sum(len(c) for r in found[3] for c in r)
                if len(part) >= HEAD_FILES or chars >= HEAD_CHARS:
                    yield pd.DataFrame(part, columns=columns)
                    part, chars = [], 0
        if part:
            yield pd.DataFrame(part, columns=columns)

    schema = "path string, length long, kind string, inner string, head string, top array<array<string>>, bytes_read long"
    return files.select("path", "length", *(["content"] if stored else [])).mapInPandas(read, schema)


def profile(source: DataFrame) -> DataFrame:
    """(path, length, file_format, schema_version, inner) of each file, from its head alone; see heads().

    Formats: json, empty, html, bad_csv, short_csv, kaiser_legacy, csv_tall, csv_wide, csv_minimal, xlsx, xls, unknown_zip, bad_zip."""
    return with_format(heads(source)).select("path", "length", "file_format", "schema_version", "inner")


def with_format(seen: DataFrame) -> DataFrame:
    """heads() with file_format and schema_version."""
    low = F.transform("top", lambda r: F.transform(r, lambda c: F.lower(F.trim(F.trim(c), F.lit('"')))))
    first, third = F.get(low, F.lit(0)), F.coalesce(F.get(low, F.lit(2)), F.array().cast("array<string>"))
    offers = F.exists(third, lambda c: c.contains("standard_charge|") & (F.size(F.split(c, r"\|")) >= 4))
    form = F.when(F.col("kind").isin("xlsx", "xls", "unknown_zip", "bad_zip"), F.col("kind")).when(F.col("head").rlike(r"^[\{\[]"), "json")
    form = form.when(F.col("head") == "", "empty").when(F.col("head").startswith("<"), "html").when(F.col("kind") == "bad_csv", "bad_csv")
    form = form.when(F.size("top") < 2, "short_csv").when(~F.array_contains(first, "hospital_name"), "kaiser_legacy")
    form = form.when(F.array_contains(third, "payer_name"), "csv_tall").when(offers, "csv_wide").otherwise("csv_minimal")
    cell = F.get(F.get("top", F.lit(1)), F.array_position(first, "version").cast("int") - 1)
    version = F.when(F.col("file_format") == "json", F.regexp_extract("head", r"(?i)\"version\"\s*:\s*\"([^\"]+)\"", 1)).when(F.col("file_format").isin("csv_tall", "csv_wide", "csv_minimal", "xlsx"), F.trim(cell))
    return seen.withColumn("file_format", form).withColumn("schema_version", F.coalesce(F.nullif(version, F.lit("")), F.lit("?")))


class _Incremental:
    """A JSON text read in pieces; ``value`` returns the next value's text."""

    def __init__(self, stream, piece: int = 1 << 20):
        self.text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace")
        self.buffer, self.at, self.piece, self.done = "", 0, piece, False
        self.decoder = json.JSONDecoder()

    def more(self) -> bool:
        add = "" if self.done else self.text.read(max(self.piece, len(self.buffer) - self.at))
        self.done = not add
        self.buffer, self.at = self.buffer[self.at :] + add, 0
        return bool(add)

    def peek(self) -> str:
        """The next character that isn't blank, or an empty string at the end."""
        while True:
            while self.at < len(self.buffer) and self.buffer[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.buffer) or not self.more():
                return self.buffer[self.at : self.at + 1]

    def skip(self, ch: str) -> bool:
        if self.peek() != ch:
            return False
        self.at += 1
        return True

    def value(self) -> str | None:
        self.peek()
        while True:
            try:
                _, end = self.decoder.raw_decode(self.buffer, self.at)
                if end < len(self.buffer) or not self.more():
                    out, self.at = self.buffer[self.at : end], end
                    return out
                continue
            except json.JSONDecodeError:
                if not self.more():
                    return None


def _items(stream, key: str) -> Iterator[str]:
    read = _Incremental(stream)
    if not read.skip("{"):
        return
    while (name := read.value()) is not None and read.skip(":"):
        if json.loads(name) == key and read.skip("["):
            while read.peek() not in ("]", "") and (item := read.value()) is not None:
                yield item
                read.skip(",")
            return
        if read.value() is None or not read.skip(","):
            return


def json_items(source: DataFrame, key: str) -> DataFrame:
    """(path, item text) of each element of a top-level array, read in pieces: no document is parsed whole. A broken tail ends its file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                _, _, stream = _open(io.BytesIO(data or b""), None, (".json",))
                items = _items(stream, key) if stream is not None else iter(())
                while part := list(islice(items, BATCH)):
                    yield pd.DataFrame({"path": path, "item": part})

    return source.select("path", "content").mapInPandas(read, "path string, item string")


def array_table(text: Column) -> Column:
    """Census answers: an array of arrays whose first row is the header, as an array of maps by column name."""
    rows = F.from_json(text, "array<array<string>>")
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_arrays(F.get(rows, F.lit(0)), r))


def positional(rows: DataFrame, skip: int, columns: dict[str, int]) -> DataFrame:
    """Named columns by position, after a number of preamble rows."""
    return rows.filter(F.col("row_idx") >= skip).select("path", "row_idx", *[F.get("cells", F.lit(i)).alias(n) for n, i in columns.items()])
