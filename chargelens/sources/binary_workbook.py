"""Sheets of binary workbooks (the .xls files of 1997 to 2007): a compound file that holds one stream of records.

Only what a table needs is read: sheet names, the active sheet, and cells that hold text, numbers, booleans or a formula's last result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: What a compound file begins with.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
# Record types of the stream, and marks of the sector tables.
_BOF, _EOF, _SHEET, _STRINGS, _CONTINUE, _WINDOW = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x3D
_LABEL_SST, _LABEL, _NUMBER, _RK, _MULTI_RK, _BOOL, _FORMULA, _FORMULA_TEXT = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF


class NotAWorkbook(ValueError):
    pass


def _stream(data: bytes) -> bytes:
    """The workbook's record stream."""
    if not data.startswith(MAGIC) or len(data) < 512:
        raise NotAWorkbook("no compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_tables, first_dir = struct.unpack_from("<I4xI", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
    cutoff, first_small, _, next_list, _ = struct.unpack_from("<5I", data, 56)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    tables = list(struct.unpack_from("<109I", data, 76))
    seen = 0
    while next_list < _END and seen <= len(data) // size:
        more = struct.unpack(f"<{size // 4}I", sector(next_list))
        tables += more[:-1]
        next_list, seen = more[-1], seen + 1
    chain = [x for k in tables[: max(n_tables, 0)] if k < _END for x in struct.unpack(f"<{size // 4}I", sector(k).ljust(size, b"\xff"))]

    def follow(start: int, links: list[int], part) -> bytes:
        out, k = [], start
        while k < _END:
            if k >= len(links) or len(out) > len(links):
                raise NotAWorkbook("broken chain of sectors")
            out.append(part(k))
            k = links[k]
        return b"".join(out)

    entries = follow(first_dir, chain, sector)
    found, root = None, None
    for at in range(0, len(entries) - 127, 128):
        name = entries[at : at + max(struct.unpack_from("<H", entries, at + 64)[0] - 2, 0)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<I", entries, at + 116)[0], struct.unpack_from("<I", entries, at + 120)[0]
        if entries[at + 66] == 5:
            root = start
        elif name in ("Workbook", "Book") and (found is None or name == "Workbook"):
            found = start, length
    if found is None:
        raise NotAWorkbook("no workbook stream")
    start, length = found
    if length >= cutoff or root is None:
        return follow(start, chain, sector)[:length]
    links = follow(first_small, chain, sector)
    pool = follow(root, chain, sector)
    return follow(start, list(struct.unpack(f"<{len(links) // 4}I", links)), lambda k: pool[k * small : (k + 1) * small])[:length]


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, its data and that of the records that continue it)."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + length]
        at += 4 + length
        if kind == _CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = kind, [body]
    if held:
        yield held


class _Text:
    """Reads counted strings that may run over from one part to the next, where a new part begins with the width of its characters."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.k, self.at = parts, 0, at

    def raw(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if self.at >= len(self.parts[self.k]) and n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self, count_bytes: int = 2) -> str:
        count = int.from_bytes(self.raw(count_bytes), "little")
        flags = (self.raw(1) or b"\0")[0]
        runs = int.from_bytes(self.raw(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.raw(4), "little") if flags & 4 else 0
        out, wide = "", flags & 1
        while count and self.k < len(self.parts):
            here = self.parts[self.k][self.at :]
            n = min(count, len(here) // (2 if wide else 1))
            piece = here[: n * (2 if wide else 1)]
            out += piece.decode("utf-16-le" if wide else "latin-1", "replace")
            self.at, count = self.at + len(piece), count - n
            if count:
                self.k, self.at = self.k + 1, 0
                if self.k < len(self.parts):
                    wide = self.raw(1)[:1] == b"\1"
        self.raw(4 * runs + extra)
        return out


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _rk(k: int) -> float:
    x = float((k - (1 << 32) if k & 0x80000000 else k) >> 2) if k & 2 else struct.unpack("<d", struct.pack("<Q", (k & 0xFFFFFFFC) << 32))[0]
    return x / 100 if k & 1 else x


def _cells(stream: bytes, at: int, strings: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of a sheet, in the file's order."""
    waiting, depth = None, 0
    for kind, parts in _records(stream, at):
        body = parts[0]
        if kind == _BOF:
            depth += 1
        elif kind == _EOF:
            depth -= 1
            if depth <= 0:
                return
        elif depth > 1:  # a chart inside the sheet
            continue
        elif kind == _LABEL_SST:
            row, column, k = struct.unpack_from("<HH2xI", body)
            yield row, column, strings[k] if k < len(strings) else ""
        elif kind == _NUMBER:
            row, column, x = struct.unpack_from("<HH2xd", body)
            yield row, column, _number(x)
        elif kind == _RK:
            row, column, k = struct.unpack_from("<HH2xI", body)
            yield row, column, _number(_rk(k))
        elif kind == _MULTI_RK:
            row, column = struct.unpack_from("<HH", body)
            for i in range((len(body) - 6) // 6):
                yield row, column + i, _number(_rk(struct.unpack_from("<I", body, 6 + 6 * i)[0]))
        elif kind == _LABEL:
            yield *struct.unpack_from("<HH", body), _Text(parts, 6).string()
        elif kind == _BOOL and not body[7]:
            yield *struct.unpack_from("<HH", body), "True" if body[6] else "False"
        elif kind == _FORMULA:
            row, column = struct.unpack_from("<HH", body)
            if body[12:14] != b"\xff\xff":
                yield row, column, _number(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 1:
                yield row, column, "True" if body[8] else "False"
            waiting = (row, column) if body[12:14] == b"\xff\xff" and body[6] == 0 else None
        elif kind == _FORMULA_TEXT and waiting:
            yield *waiting, _Text(parts).string()
            waiting = None


def sheets(data: bytes) -> Iterator[tuple[str, bool, Iterator[tuple[int, list[str | None]]]]]:
    """(name, active, rows) of each sheet; rows are (row number, cells), rows without a cell are left out."""
    stream = _stream(data)
    strings: list[str] = []
    listed: list[tuple[int, str]] = []
    active = 0
    for kind, parts in _records(stream):
        body = parts[0]
        if kind == _SHEET and body[5] == 0:
            listed.append((struct.unpack_from("<I", body)[0], _Text([body], 6).string(1)))
        elif kind == _WINDOW:
            active = struct.unpack_from("<H", body, 10)[0]
        elif kind == _STRINGS:
            reader = _Text(parts, 8)
            strings = [reader.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == _EOF:
            break

    def rows(at: int) -> Iterator[tuple[int, list[str | None]]]:
        held: dict[int, dict[int, str]] = {}
        for row, column, text in _cells(stream, at, strings):
            held.setdefault(row, {})[column] = text
        for row in sorted(held):
            own = held[row]
            yield row, [own.get(c) for c in range(max(own) + 1)]

    for k, (at, name) in enumerate(listed):
        yield name, k == active, rows(at)
