"""Binary workbooks built here record by record: strings over several records, numbers in all forms, several sheets, damaged files."""

import struct

import pytest

from chargelens.sources import binary_workbook, grid


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def string(text, wide=None):
    wide = any(ord(c) > 255 for c in text) if wide is None else wide
    return struct.pack("<HB", len(text), int(wide)) + text.encode("utf-16-le" if wide else "latin-1")


def compound(stream):
    size = 512
    stream = stream.ljust(max(len(stream), 4096), b"\0")
    body = [stream[i : i + size].ljust(size, b"\0") for i in range(0, len(stream), size)]
    links = [*range(1, len(body)), 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFD]  # stream, directory, table
    assert len(links) <= size // 4
    entry = lambda name, kind, start, n: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(116, b"\0") + struct.pack("<II", start, n) + b"\0" * 4
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 0, len(stream)) + entry("", 0, 0, 0) * 2
    table = struct.pack(f"<{len(links)}I", *links).ljust(size, b"\xff")
    head = binary_workbook.MAGIC + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, len(body), 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<I", len(body) + 1) + b"\xff" * (4 * 108) + b"".join(body) + directory + table


def workbook():
    first = string("CPT Code") + string("Gross Charge")
    third = "Überweisung"  # runs over into the next record, where its characters get wider
    sst = struct.pack("<II", 4, 4) + first + struct.pack("<HB", len(third), 0) + third[:4].encode("latin-1")
    rest = b"\1" + third[4:].encode("utf-16-le") + struct.pack("<HBH", 3, 8, 1) + b"abc" + b"\0" * 4
    one = [
        record(0x809, b"\0" * 16), record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), record(0xFD, struct.pack("<HHHI", 0, 2, 0, 1)), record(0x203, struct.pack("<HHHd", 1, 0, 0, 99281.0)), record(0x203, struct.pack("<HHHd", 1, 1, 0, 12.5)),
        record(0x27E, struct.pack("<HHHI", 2, 0, 0, (1234 << 2) | 3)), record(0xBD, struct.pack("<HHHIHIH", 3, 1, 0, (7 << 2) | 2, 0, ((-5 & 0x3FFFFFFF) << 2) | 2, 2)),
        record(0x204, struct.pack("<HHH", 4, 0, 0) + string("label")), record(0x205, struct.pack("<HHHBB", 4, 1, 0, 1, 0)), record(0x06, struct.pack("<HHHd", 5, 0, 0, 0.5) + b"\0" * 8),
        record(0x06, struct.pack("<HHH", 5, 1, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8), record(0x207, string("made")), record(0xFD, struct.pack("<HHHI", 6, 0, 0, 2)), record(0xFD, struct.pack("<HHHI", 6, 1, 0, 3)), record(0x0A, b""),
    ]
    two = [record(0x809, b"\0" * 16), record(0xFD, struct.pack("<HHHI", 0, 0, 0, 3)), record(0x0A, b"")]
    name = lambda t: struct.pack("<BB", len(t), 0) + t.encode()

    def globals_(at1, at2):
        return b"".join([record(0x809, b"\0" * 16), record(0x3D, struct.pack("<5HH", 0, 0, 0, 0, 0, 1) + b"\0" * 6), record(0x85, struct.pack("<IH", at1, 0) + name("Prices")), record(0x85, struct.pack("<IH", at2, 0) + name("Other")), record(0xFC, sst), record(0x3C, rest), record(0x0A, b"")])

    start = len(globals_(0, 0))
    return compound(globals_(start, start + len(b"".join(one))) + b"".join(one) + b"".join(two))


def test_sheets_and_cells():
    got = [(n, a, list(r)) for n, a, r in binary_workbook.sheets(workbook())]
    assert got[0] == ("Prices", False, [(0, ["CPT Code", None, "Gross Charge"]), (1, ["99281", "12.5"]), (2, ["12.34"]), (3, [None, "7", "-5"]), (4, ["label", "True"]), (5, ["0.5", "made"]), (6, ["Überweisung", "abc"])])
    assert got[1] == ("Other", True, [(0, ["abc"])])


@pytest.mark.parametrize("keep", [8, 400, 600, 3000])
def test_damaged_files(keep):
    with pytest.raises((binary_workbook.NotAWorkbook, struct.error, IndexError)):
        for _, _, rows in binary_workbook.sheets(workbook()[:keep]):
            list(rows)


def test_grid_reads_binary_workbooks(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(workbook())
    (tmp_path / "b.xls").write_bytes(workbook()[:700])
    files = grid.files(spark, str(tmp_path))
    got = grid.grid(files).where("sheet = 'Prices'").orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(7)) and got[1].cells == ["99281", "12.5"]
    assert {r.file_format for r in grid.profile(files).collect()} == {"xls"}
