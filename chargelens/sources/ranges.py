"""Large files read in byte ranges, and heads of files read alone.

A range owns the records that start in it, and reads on to the end of its last one. Where the records start depends on what stands before
the range: a line of a CSV file may be inside a quoted cell, a comma of a JSON file inside a string or a deeper value. So a file
is read twice. The first time each range tells what it does to either state it may begin in; that is a row a range, and windows over these rows give
every range its true state and its first row's number. The second time each range parses its own records. No task holds more than a range's
piece and one record, and a file is read by as many tasks as it has ranges.

Executors open files themselves, through pyarrow's file systems (local, HDFS, S3, GCS), as Spark hands out no part of a binary file.
Compressed members of archives can't be entered in the middle: grid.grid() and grid.json_items() read these.
"""

from __future__ import annotations

import csv
import io
import json
import re
import urllib.parse
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargelens.operators.staging import staged

RANGE_BYTES, PIECE, BATCH = 64 << 20, 4 << 20, 5000
OUTSIDE, INSIDE = 0, 1
_FIELD = rb'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)'
#: Lines that leave no quoted cell open: one that begins outside, and one that begins inside a quoted cell.
_CLOSED = (re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+[\r\n]*+"), re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+(?:,' + _FIELD + rb")*+[\r\n]*+"))


def listing(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder, of any size; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "modificationTime", "length")


def open_file(path: str, buffer: int = 1 << 20):
    """A file at a path as Spark writes it, open for reading at any place, ``buffer`` bytes at a time."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:", path) and not path.startswith("file:"):
        from pyarrow import fs

        scheme, rest = path.split(":", 1)
        store, name = fs.FileSystem.from_uri(f"{scheme}:{urllib.parse.quote(rest, safe='/:@')}")
        return io.BufferedReader(store.open_input_file(name), buffer)
    return open(re.sub(r"^file:/*", "/", path), "rb", buffer)


def contents(files: DataFrame, gone_is_empty: bool = False) -> DataFrame:
    """(path, length, content) of whole files (path, length), each below 2 GB: those that can't be entered in the middle. A file that is no longer there is an error, or empty."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in batch.itertuples(index=False):
                try:
                    with open_file(path) as stream:
                        data = stream.read()
                except FileNotFoundError:
                    if not gone_is_empty:
                        raise
                    data = b""
                yield pd.DataFrame({"path": [path], "length": [length], "content": [data]})

    return files.select("path", "length").mapInPandas(read, "path string, length long, content binary")


def _dealt(rows: DataFrame) -> DataFrame:
    """Descriptors of ranges, a task each, up to 100,000 tasks. There is one for ``size`` bytes of input, so that dealing them out in turn is small work."""
    return rows.coalesce(1).repartition(int(min(max(rows.count(), 1), 100_000)))


def ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(path, lo, hi) of the ranges of ``size`` bytes of each file (path, length)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("lo")
    return files.where("length > 0").select("path", "length", starts).select("path", "lo", F.least(F.col("lo") + size, "length").alias("hi"))


def _each_range(rows: DataFrame, read, schema: str) -> DataFrame:
    """``read`` gives the result rows of one range, as tuples; they leave the task in batches."""
    names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = read(row)
                while part := list(islice(found, BATCH)):
                    yield pd.DataFrame(part, columns=names)

    return rows.mapInPandas(run, schema)


class Lines:
    """The lines that start at or after ``lo``, as bytes; ``at`` is where the next one starts. Lines end at line feeds; a lone carriage return ends a part of one."""

    def __init__(self, stream, lo: int):
        self.stream, self.parts = stream, []
        stream.seek(max(lo - 1, 0))
        if lo:
            stream.readline()
        self.at = stream.tell()

    def __iter__(self) -> Lines:
        return self

    def owned(self, hi: int) -> bool:
        """Whether the next part belongs to a line that starts before ``hi``."""
        return bool(self.parts) or self.at < hi

    def __next__(self) -> bytes:
        if not self.parts:
            start, line = self.at, self.stream.readline()
            if not line:
                raise StopIteration
            self.at += len(line)
            if not start and line.startswith(b"\xef\xbb\xbf"):
                line = line[3:]
            if b"\r" not in line[:-2]:
                return line
            self.parts = line.splitlines(True)[::-1]
            if not self.parts:
                return line
        return self.parts.pop()


def _after(line: bytes, state: int) -> int:
    """The state after a line: whether a quoted cell goes on."""
    return (OUTSIDE if _CLOSED[state].fullmatch(line) else INSIDE) if b'"' in line else state


def _csv_effect(row) -> Iterator[tuple]:
    """What a range does to either state, and how many rows start in it then."""
    with open_file(row.path) as stream:
        lines = Lines(stream, row.lo)
        state, starts = [OUTSIDE, INSIDE], [0, 0]
        while lines.owned(row.hi) and (line := next(lines, None)) is not None:
            for begun in (OUTSIDE, INSIDE):
                starts[begun] += state[begun] == OUTSIDE
            state = [_after(line, s) for s in state] if state[0] != state[1] else [_after(line, state[0])] * 2
    yield row.path, row.lo, row.hi, *state, *starts


def _csv_rows(row) -> Iterator[tuple]:
    csv.field_size_limit(2**31 - 1)
    with open_file(row.path) as stream:
        lines, state = Lines(stream, row.lo), row.state
        while state == INSIDE:  # the end of a row that an earlier range owns
            if not lines.owned(row.hi):
                return
            state = _after(next(lines, b'"'), state)
        rows = csv.reader(line.decode("utf-8", "replace") for line in lines)
        number = row.first_row
        while lines.owned(row.hi):
            try:
                cells = next(rows)
            except StopIteration:
                return
            yield row.path, "(csv)", True, number, cells
            number += 1


def csv_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(path, lo, hi, state, first_row) of each range: the first pass. A window over a file's ranges follows the states: a range keeps the state, sets it, or turns it round."""
    seen = _each_range(_dealt(ranges(files, size)), _csv_effect, "path string, lo long, hi long, after_out int, after_in int, rows_out long, rows_in long")
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("path").orderBy("lo")
    sets, turns = F.col("after_out") == F.col("after_in"), (F.col("after_out") > F.col("after_in")).cast("int")
    turned = seen.withColumn("turned", F.sum(turns).over(own))  # this range included
    turned = turned.withColumn("set_to", F.when(sets, F.col("after_out").bitwiseXOR(F.pmod("turned", F.lit(2)).cast("int"))))
    known = F.coalesce(F.last("set_to", ignorenulls=True).over(before), F.lit(OUTSIDE))
    state = known.bitwiseXOR(F.pmod(F.coalesce(F.max("turned").over(before), F.lit(0)), F.lit(2)).cast("int"))
    placed = turned.withColumn("state", state)
    starts = F.when(F.col("state") == OUTSIDE, F.col("rows_out")).otherwise(F.col("rows_in"))
    placed = placed.withColumn("first_row", F.coalesce(F.sum(starts).over(before), F.lit(0)))
    return placed.select("path", "lo", "hi", "state", "first_row")


def csv_grid(files: DataFrame, size: int = RANGE_BYTES, head: int | None = None) -> DataFrame:
    """All cells of plain CSV files (path, length), one row a line, with the columns of grid.grid(): path, sheet, active, row_idx, cells.

    Rows are those of Python's csv reader over the whole file, numbered as there: quoted cells may hold line ends, quotes inside an unquoted cell
    are plain, undecodable bytes are replaced. ``head`` keeps that many rows of each file. A file whose lines end in lone carriage returns is one range's work.
    """
    known = staged(csv_ranges(files, size))  # a row a range
    if head is not None:
        known = known.where(F.col("first_row") < head)
    rows = _each_range(_dealt(known), _csv_rows, "path string, sheet string, active boolean, row_idx long, cells array<string>")
    return rows if head is None else rows.where(F.col("row_idx") < head)


def _odd_backslash(stream, at: int) -> int:
    """1 if an odd number of backslashes stands right before ``at``, which then is escaped."""
    count, back = 0, 64
    while at - count > 0:
        lo = max(at - back, 0)
        stream.seek(lo)
        text = stream.read(at - lo)
        count = len(text) - len(text.rstrip(b"\\"))
        if count < len(text):
            break
        back *= 4
    return count & 1


def _quotes(buf: np.ndarray, escaped: int) -> np.ndarray:
    """Where the quotes stand that open or close a string. ``escaped``: the first byte is."""
    found = np.flatnonzero(buf == 34)
    slash = buf == 92
    if not len(found) or not (slash.any() or escaped):
        return found
    last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(buf))))  # the last byte that is no backslash
    previous = found - 1
    run = np.where(previous >= 0, previous - np.where(previous >= 0, last[previous], -1), 0)
    reaches = previous - run < 0
    return found[((run + np.where(reaches, escaped, 0)) & 1) == 0]


class Json:
    """A JSON text from ``lo`` on, in pieces: for each piece its offset, bytes, the brackets and commas outside strings, and the depth after each."""

    def __init__(self, stream, lo: int, in_string: int = 0, depth: int = 0):
        self.stream, self.at, self.in_string, self.depth = stream, lo, in_string, depth
        self.escaped = _odd_backslash(stream, lo) if lo else 0
        stream.seek(lo)
        self.quotes = 0

    def piece(self, most: int = PIECE) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(offset, bytes, places of structural characters, whether each is outside strings if the text began outside, change of depth)."""
        data = self.stream.read(most)
        if not data:
            return None
        buf, at = np.frombuffer(data, dtype=np.uint8), self.at
        quotes = _quotes(buf, self.escaped)
        tail = len(data) - len(data.rstrip(b"\\"))
        self.escaped = (tail + (self.escaped if tail == len(data) else 0)) & 1
        opens, closes = (buf == 91) | (buf == 123), (buf == 93) | (buf == 125)
        places = np.flatnonzero(opens | closes | (buf == 44))
        outside = (np.searchsorted(quotes, places) + self.quotes) % 2 == 0
        change = opens[places].astype(np.int64) - closes[places]
        self.quotes += len(quotes)
        self.at += len(data)
        return at, buf, places, outside, change

    def walk(self, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(offset, bytes, places of structural characters outside strings, depth after each), from the state known at the beginning."""
        while (p := self.piece(most)) is not None:
            at, buf, places, outside, change = p
            real = outside == (self.in_string == 0)
            after = self.depth + np.cumsum(change[real])
            if len(after):
                self.depth = int(after[-1])
            yield at, buf, places[real], after


def _json_effect(row) -> Iterator[tuple]:
    """Quotes of a range, and the change and least of the depth if it begins outside a string, and inside one."""
    with open_file(row.path) as stream:
        text = Json(stream, row.lo)
        depth, least = [0, 0], [0, 0]
        while text.at < row.hi and (p := text.piece(min(PIECE, row.hi - text.at))) is not None:
            _, _, _, outside, change = p
            for begun in (OUTSIDE, INSIDE):
                sums = np.cumsum(change[outside == (begun == OUTSIDE)])
                if len(sums):
                    least[begun] = min(least[begun], depth[begun] + int(sums.min()))
                    depth[begun] += int(sums[-1])
    yield row.path, row.lo, row.hi, text.quotes & 1, depth[0], depth[1], least[0], least[1]


def json_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(path, lo, hi, in_string, depth, least) of each range: the first pass. Quotes before a range tell whether it begins in a string, and so which depths count."""
    seen = _each_range(_dealt(ranges(files, size)), _json_effect, "path string, lo long, hi long, quotes int, net_out long, net_in long, least_out long, least_in long")
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("in_string", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    pick = lambda name: F.when(F.col("in_string") == OUTSIDE, F.col(f"{name}_out")).otherwise(F.col(f"{name}_in"))
    placed = placed.withColumn("depth", F.coalesce(F.sum(pick("net")).over(before), F.lit(0)))
    return placed.select("path", "lo", "hi", "in_string", "depth", (F.col("depth") + pick("least")).alias("least"))


def _array_events(key: str):
    """Where an array under ``key`` begins at the top level, and where arrays of that level end."""

    def read(row) -> Iterator[tuple]:
        with open_file(row.path) as stream, open_file(row.path) as back:
            for at, buf, places, after in Json(stream, row.lo, row.in_string, row.depth).walk():
                if at >= row.hi:
                    return
                for k in np.flatnonzero(((buf[places] == 91) & (after == 2)) | ((buf[places] == 93) & (after == 1))).tolist():
                    place = at + int(places[k])
                    if place >= row.hi:
                        return
                    if after[k] == 1:
                        yield row.path, False, place
                        continue
                    lo = max(place - 4096 - 12 * len(key), 0)
                    back.seek(lo)
                    named = re.search(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', back.read(place - lo))
                    try:
                        if named and json.loads(named[1]) == key:
                            yield row.path, True, place
                    except ValueError:
                        continue

    return read


def _elements(row) -> Iterator[tuple]:
    """The elements of the array [begins, ends) whose comma or opening bracket stands in the range."""
    with open_file(row.path) as stream:
        begun, held = None, b""
        for at, buf, places, after in Json(stream, row.lo, row.in_string, row.depth).walk():
            absolute = at + places
            kind = buf[places]
            edge = ((kind == 44) & (after == 2) & (absolute > row.begins)) | (absolute == row.begins) | (absolute == row.ends)
            done = 0
            for place in absolute[edge].tolist():
                if begun is not None:
                    text = (held + buf[done : place - at].tobytes()).decode("utf-8", "replace").strip()
                    if text:
                        yield row.path, begun, text
                held, begun, done = b"", place, place + 1 - at
                if place >= row.hi or place >= row.ends:
                    return
            if begun is None and at + len(buf) >= row.hi:
                return
            held = held + buf[done:].tobytes() if begun is not None else b""


def json_items(files: DataFrame, key: str, size: int = RANGE_BYTES) -> DataFrame:
    """(path, at, item): the text of each element of the top-level array ``key`` of plain JSON files (path, length), and where its comma or bracket stands.

    The first array under that key counts, as long as its name and colon stand within 4 KB. An element that the file's end cuts off gives no row.
    """
    known = staged(json_ranges(files, size))
    top = known.where("least <= 1")  # the few that reach the outermost level
    events = staged(_each_range(_dealt(top), _array_events(key), "path string, begins boolean, place long"))
    first = events.where("begins").groupBy("path").agg(F.min("place").alias("begins"))
    ends = events.where("not begins").withColumnRenamed("begins", "__b").join(first, "path").where("place > begins").groupBy("path").agg(F.min("place").alias("ends"))
    arrays = first.join(ends, "path", "left").withColumn("ends", F.coalesce("ends", F.lit((1 << 62))))
    wanted = known.join(arrays, "path").where("hi > begins and lo < ends")
    return _each_range(_dealt(wanted), _elements, "path string, at long, item string")
