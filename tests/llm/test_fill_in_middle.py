import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chargelens.llm.fill_in_middle import encode, fill_in_middle, restored

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}


def brute(doc_id, text, unit="line", percent=100, spm=50):
    text, units = text or "", re.findall(PATTERNS[unit], text or "")
    sha = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", text, None, None
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, n, form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", len(p), len(m)


def texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["\n", "\n", "a", "é", "😀", " ", "\t", "\r", "<", "P", ">", "\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(count)]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_cuts_are_those_of_listed_units(unit):
    batch = [*texts(300, unit), "", None, "\n", "\n\n\n", "x"]
    runs = encode(batch, unit)
    listed = [re.findall(PATTERNS[unit], t or "") for t in batch]
    assert runs.units().tolist() == [len(x) for x in listed]
    rng = random.Random(3)
    picks = [rng.randint(0, len(x)) for x in listed]
    import numpy as np

    assert runs.cut(np.array(picks)).tolist() == [len("".join(x[:k])) for x, k in zip(listed, picks, strict=True)]


@pytest.mark.parametrize(("unit", "percent", "spm"), [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_outputs_are_those_of_brute_force_and_restore(spark, unit, percent, spm):
    data = [(i, t) for i, t in enumerate(texts(200, 5))]
    data += [(None, None), (None, "a\nb"), (7, "a\nb\n"), (7, "a\nb\n"), (901, "x<P>y\n"), (902, "<<\n<S<\n<\n"), (903, "line\n" * 30_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("N", F.lit("own"))
    got = fill_in_middle(docs, unit=unit, percent=percent, spm_percent=spm).withColumn("again", restored(F.col("output"), F.col("form")))
    assert "text" in got.columns
    assert [c for c in got.columns if c.lower() == "n"] == ["n"]
    rows = [r.asDict() for r in got.collect()]
    assert all(r["again"] == (r["text"] or "") for r in rows)
    want = sorted((brute(i, t, unit, percent, spm) for i, t in data), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in rows), key=str) == want
    assert len({r["form"] for r in rows}) >= 2


def test_other_sentinels_an_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "x")], "form long, output string, `my.column` string")
    got = fill_in_middle(docs, id_col="form", text_col="output", sentinels=("[pre]", "[suf]", "[mid]"))
    row = got.first()
    assert set(got.columns) == {"my.column", "n", "form", "output", "prefix_chars", "middle_chars"}
    assert row["form"] in ("psm", "spm")
    assert got.select(restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("t")).first()["t"] == "a\nb\nc"
    assert fill_in_middle(docs.limit(0), id_col="form", text_col="output").count() == 0
    with pytest.raises(ValueError, match="sentinels"):
        fill_in_middle(docs, sentinels=("<<P>", "<S>", "<M>"))
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(docs, unit="page")
