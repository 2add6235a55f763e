"""Files read in ranges against the serial readers."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from chargelens.sources import grid, ranges


def tricky_csv(seed, rows):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "é", "😀", '"', ",", "\n", "\r\n", "\r", " ", "x", "7"]) for _ in range(rng.randint(0, 9)))
    out = []
    for _ in range(rows):
        cells = []
        for _ in range(rng.randint(1, 5)):
            c = cell()
            kind = rng.random()
            if kind < 0.6:
                cells.append('"' + c.replace('"', '""') + '"' + ("tail" if rng.random() < 0.1 else ""))
            else:
                cells.append("".join(x for x in c if x not in ',\n\r').lstrip('"'))  # quotes inside are plain
        out.append(",".join(cells) + rng.choice(["\n", "\n", "\r\n", "\n\n"]))
    return "".join(out)


def serial_csv(path):
    import csv

    csv.field_size_limit(2**31 - 1)
    with open(path, "rb") as f:
        return [list(r) for r in csv.reader(io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline=""))]


@pytest.mark.parametrize("size", [7, 300])
def test_csv_rows_are_those_of_the_serial_reader(spark, tmp_path, size):
    files = {"a.csv": tricky_csv(1, 60), "b.csv": "﻿" + '"q\n"",x",1\n' * 20, "c.csv": 'x,"never closed\n' + "a,b\n" * 9, "d.csv": "\n\n", "e e.csv": "one", "g.csv": 'a\rb\r"c\rd"\re\nz\n'}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "f.csv").write_bytes(b"bad\xff,\xe2\x82\n\"\xc3\n\",z\n")
    got = {}
    for r in ranges.csv_grid(ranges.listing(spark, str(tmp_path)), size=size).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["row_idx"], list(r["cells"])))
    for name in [*files, "f.csv"]:
        assert sorted(got[name]) == list(enumerate(serial_csv(tmp_path / name))), (name, size)
    top = ranges.csv_grid(ranges.listing(spark, str(tmp_path), "a.csv"), size=size, head=3).collect()
    assert sorted((r["row_idx"], list(r["cells"])) for r in top) == sorted(got["a.csv"])[:3]


def value(rng, depth):
    kind = rng.randint(0, 7 if depth else 3)
    if kind == 0:
        return "".join(rng.choice(['"', "\\", "{", "]", ",", ":", "é", "a", "\n", "\\\\"]) for _ in range(rng.randint(0, 12)))
    if kind < 4:
        return rng.choice([None, True, 1, -2.5e3, ""])
    if kind < 6:
        return {value(rng, 0).__str__(): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]


@pytest.mark.parametrize("size", [5, 300])
def test_json_items_are_those_of_the_serial_reader(spark, tmp_path, size):
    rng = random.Random(9)
    docs = {}
    for k in range(4):
        items = [value(rng, 3) for _ in range(rng.randint(0, 25))]
        docs[f"{k}.json"] = json.dumps({"note": 'a "wanted": [ in text', "other": [[1, {"wanted": [0]}], "]"], "nested": {"wanted": [5, 6]}, "wanted": items, "after": [1, [2]]}, indent=rng.choice([None, 1]), ensure_ascii=k % 2 > 0)
    docs["none.json"] = '{"a": [1, 2], "wanted": 3}'
    docs["empty.json"] = '{"wanted": [ ], "x": [1]}'
    docs["bom.json"] = '﻿{"wanted" :\n [1,"\\\\",{"a":"\\""}]}'
    for name, text in docs.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "cut.json").write_bytes(b'{"wanted": [{"a": 1}, {"b": [2]}, {"c": "unfin')
    got = {}
    for r in ranges.json_items(ranges.listing(spark, str(tmp_path)), "wanted", size=size).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["at"], r["item"]))
    want = {}
    for r in grid.json_items(grid.files(spark, str(tmp_path)), "wanted").collect():
        want.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["item"])
    assert want["bom.json"] == ["1", '"\\\\"', '{"a":"\\""}']
    assert want["cut.json"] == ['{"a": 1}', '{"b": [2]}']
    assert {n: [i for _, i in sorted(x)] for n, x in got.items()} == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text('id,"text"\n' + "".join(f'{i},"line {i}\nsecond, line"\n' for i in range(20_000)))
    rows = ranges.csv_grid(ranges.listing(spark, str(tmp_path)), size=(tmp_path / "big.csv").stat().st_size // 8 + 1)
    tasks = rows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.min("row_idx").alias("lo")).collect()
    assert len(tasks) == 8
    assert max(t["n"] for t in tasks) < 2 * min(t["n"] for t in tasks)
    assert rows.agg(F.count("*"), F.countDistinct("row_idx"), F.max("row_idx")).first()[:] == (20_001, 20_001, 20_000)
