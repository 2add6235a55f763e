"""Readers and parsers against hand-written files and expected rows."""

import io
import zipfile

import pandas as pd
import pytest

from chargelens.sources import chargemaster, grid, legacy, price_files, ranges

TALL = """hospital_name,version,type_2_npi
Alpha,2.0.0,1234567890
description,code|1,code|1|type,code|2,code|2|type,setting,billing_class,modifiers,standard_charge|gross,standard_charge|discounted_cash,standard_charge|min,standard_charge|max,payer_name,plan_name,standard_charge|negotiated_dollar,standard_charge|negotiated_percentage,standard_charge|negotiated_algorithm,estimated_amount,standard_charge|methodology
"X-ray, chest",71045,CPT,0320,RC,outpatient,facility,,"$1,200.50",600,1,900,Acme,Gold,300,,,,fee schedule

"X-ray, chest",71045,CPT,,,outpatient,facility,,"1200.50",600,,,Acme,Silver,,,,,other
MRI,,,70551,CPT,both,,,N/A,,,,Bolt,,,45,,,
"""
WIDE = """hospital_name,version
Beta,3.0
description,code|1,code|1|type,standard_charge|gross,standard_charge|Acme|Gold|negotiated_dollar,standard_charge|Acme|Gold|methodology,standard_charge|Bolt|One|negotiated_percentage
Cast,29075,CPT,50,20,fee schedule,
Boot,L4360,HCPCS,,,,80
"""
JSON = """﻿{"hospital_name": "G", "other": [1, {"a": "]"}], "version": "3.0.0", "standard_charge_information": [
{"description": " Drug ", "code_information": [{"code": "", "type": "NDC"}, {"code": "J1", "type": "HCPCS"}], "setting": "both", "modifiers": ["A", "B"],
 "standard_charges": [{"gross_charge": 12.50, "setting": "", "payers_information": [{"payer_name": "Acme", "plan_name": "P"}, {"payer_name": "Bolt", "standard_charge_dollar": "7"}]}]},
{"description": "No charges"}, {"description": "Null", "standard_charges": [{"minimum": 3, "setting": "inpatient"}]}]}"""
LEGACY = "title\n\n\n\nCharge # (Px),Procedure Code (CPT / HCPCS),Default Modifier,Billing Code,Procedure Name,Gross Charge,Discounted Cash Price,Inpatient/Outpatient\n" + "9,99213,25,0510,Visit,$100.00,,Outpatient\n10,J0120,,0250,Drug,n/a,5,BOTH\n,,,,Free,,,\nfooter,x\n"
MISC_TALL = "My list\nprocedure_name,cpt_code,list_price,payer_name,negotiated_rate\nVisit,99213,100,Acme,50\nVisit,99213,100,Bolt,60\nScan,70551,0,Acme,5\nLab,80050,20,,7\n"
MISC_WIDE = "Description,CPT,Charge,Aetna PPO,Internal Number\nVisit,99213,100.00,55.10,12345\nScan,70551,900.00,,23456\n"


def workbook(sheets: dict[str, list[list]], active: int = 0) -> bytes:
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        tags = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{tags}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>shared</t></si></sst>')
        for i, rows in enumerate(sheets.values()):
            body = ""
            for r, row in enumerate(rows):
                cells = "".join(f'<c r="{chr(65 + k)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{r + 1}"><v>{v}</v></c>' for k, v in enumerate(row) if v is not None)
                body += f'<row r="{r + 1}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def zipped(name: str, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr(name, text)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    def put(**named):
        for name, data in named.items():
            (tmp_path / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path)

    return put


def owners(source):
    from pyspark.sql import functions as F

    return source.select("path", F.element_at(F.split("path", "/"), -1).alias("ccn"))


def test_profile(spark, folder):
    bad = b"PK\x03\x04broken"
    book = workbook({"S": [["hospital_name", "version"], ["A", "2.2"]]})
    path = folder(tall__csv=TALL, wide__csv="﻿" + WIDE, j__json=JSON, e__csv=" \n", h__csv="  <html>", s__csv="one line", k__zip=zipped("a.csv", LEGACY), t__zip=zipped("a.csv", TALL), bad__zip=bad, none__zip=zipped("a.bin", "x"), b__xlsx=book)
    got = {r.path.rsplit("/", 1)[1]: (r.file_format, r.schema_version) for r in grid.profile(grid.files(spark, path)).collect()}
    assert got == {
        "tall.csv": ("csv_tall", "2.0.0"), "wide.csv": ("csv_wide", "3.0"), "j.json": ("json", "3.0.0"), "e.csv": ("empty", "?"), "h.csv": ("html", "?"), "s.csv": ("short_csv", "?"),
        "k.zip": ("kaiser_legacy", "?"), "t.zip": ("csv_tall", "2.0.0"), "bad.zip": ("bad_zip", "?"), "none.zip": ("unknown_zip", "?"), "b.xlsx": ("xlsx", "2.2"),
    }


def test_federal_files(spark, folder):
    book = workbook({"Other": [["x"]], "Data": [["hospital_name", "version"], ["A", "2.2"], ["description", "code|1", "code|1|type", "standard_charge|gross", "modifiers", "payer_name", "standard_charge|negotiated_dollar", "estimated_amount"], ["Visit", 99213, "CPT", 10.5, "M", "Acme", 4, 3], [None], ["Free", "1", "CPT", None, None, "Acme", None, 9]]}, active=1)
    source = grid.files(spark, folder(tall__csv=TALL, wide__zip=zipped("in.csv", WIDE), j__json=JSON, b__xlsx=book, h__csv="<html>"))
    listed = owners(source).union(spark.createDataFrame([("nowhere/e.csv", "e.csv")], "path string, ccn string"))
    gross, negotiated, log = price_files.parse(source, listed)
    cells = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=str)
    assert cells(gross, "ccn", "description", "code", "code2", "gross_charge", "modifiers", "setting", "standard_charge_max") == sorted([
        ("tall.csv", "X-ray, chest", "71045", "0320", 1200.5, "", "outpatient", 900.0), ("tall.csv", "X-ray, chest", "71045", "", 1200.5, "", "outpatient", None),
        ("wide.zip", "Cast", "29075", "", 50.0, "", "", None), ("b.xlsx", "Visit", "99213", "", 10.5, "", "", None),
        ("j.json", "Drug", "J1", "", 12.5, "A,B", "both", None), ("j.json", "Null", "", "", None, "", "inpatient", None),
    ], key=str)
    assert cells(negotiated, "ccn", "code", "payer_name", "plan_name", "negotiated_dollar", "negotiated_percentage", "estimated_amount", "methodology") == sorted([
        ("tall.csv", "71045", "Acme", "Gold", 300.0, None, None, "fee schedule"), ("tall.csv", "70551", "Bolt", "", None, 45.0, None, ""),
        ("wide.zip", "29075", "Acme", "Gold", 20.0, None, None, "fee schedule"), ("wide.zip", "L4360", "Bolt", "One", None, 80.0, None, ""),
        ("b.xlsx", "99213", "Acme", "", 4.0, None, None, ""), ("j.json", "J1", "Acme", "P", None, None, None, ""), ("j.json", "J1", "Bolt", "", 7.0, None, None, ""),
    ], key=str)
    assert {r.ccn: r.status for r in log.collect()} == {"tall.csv": "ok", "wide.zip": "ok", "j.json": "ok", "b.xlsx": "ok", "h.csv": "skip:html", "e.csv": "skip:empty"}


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_json_in_pieces(piece, monkeypatch):
    import json

    made = grid._Incremental
    monkeypatch.setattr(grid, "_Incremental", lambda s: made(s, piece))
    items = [json.loads(x)["description"] for x in grid._items(io.BytesIO(JSON.encode()), "standard_charge_information")]
    assert items == [" Drug ", "No charges", "Null"]
    assert list(grid._items(io.BytesIO(b'{"k": [1, 2'), "k")) in (["1"], ["1", "2"])
    assert list(grid._items(io.BytesIO(b"[1]"), "k")) == list(grid._items(io.BytesIO(b""), "k")) == []


def test_legacy_archive(spark, folder):
    source = grid.files(spark, folder(a__zip=zipped("X_ChargeDescriptionMaster.csv", LEGACY), b__zip=zipped("other.csv", LEGACY)))
    got = sorted((r.ccn, r.code, r.code_type, r.code2, r.code2_type, r.gross_charge, r.discounted_cash, r.setting, r.modifiers) for r in legacy.legacy_archives(source, owners(source)).collect())
    assert got == [("a.zip", "99213", "CPT", "9", "kaiser_charge_id", 100.0, None, "outpatient", "25"), ("a.zip", "J0120", "HCPCS", "10", "kaiser_charge_id", None, 5.0, "both", "")]


def test_misc_tables(spark, folder):
    source = grid.files(spark, folder(t__csv=MISC_TALL, w__csv=MISC_WIDE, n__csv="a,b\n1,2\n3,4\n"))
    gross, negotiated = legacy.misc_tables(source, owners(source))
    assert sorted((r.ccn, r.description, r.gross_charge, r.file_format) for r in gross.collect()) == [("t.csv", "Lab", 20.0, "misc_tall"), ("t.csv", "Visit", 100.0, "misc_tall"), ("w.csv", "Scan", 900.0, "misc_wide"), ("w.csv", "Visit", 100.0, "misc_wide")]
    assert sorted((r.ccn, r.payer_name, r.negotiated_dollar) for r in negotiated.collect()) == [("t.csv", "Acme", 50.0), ("t.csv", "Bolt", 60.0), ("w.csv", "Aetna PPO", 55.1)]


def test_chargemaster(spark, tmp_path):
    place = tmp_path / "2019" / "Alpha"
    place.mkdir(parents=True)
    pad = "Effective,,,,\n" + "CPT Code,Description,I/P Charge,Charge,Rev Code\n"
    body = '99213,Visit,"($1,234.50)",N/A,0450\nj0120,Drug,5,TBD,9999\n12,Bad,1,2,\n' + "".join(f"9{i:04d},caf\xe9,{i},,\n" for i in range(100))
    (place / "106010735_CDM.csv").write_bytes((pad + body).encode("latin-1"))
    (place / "106010735_CDM_top 25.csv").write_bytes((pad + body).encode("latin-1"))
    sniff = [["a", "b", "Price"]] + [[f"9{i:04d}", "text", i] for i in range(60)]
    (place / "CDM_106010999.xlsx").write_bytes(workbook({"Summary": sniff, "List": sniff, "Text": [["x"], ["y"]]}))
    source = grid.chargemaster_files(grid.files(spark, str(tmp_path)))
    rows, log = chargemaster.parse(chargemaster.lines(source), source)
    rows = rows.toPandas()
    first = rows[rows.file_source.str.endswith("735_CDM.csv")]
    assert set(first.oshpd_id) == {"106010735"} and set(first.year) == {2019} and set(first.hospital_folder) == {"Alpha"} and set(first.header_row) == {1}
    top = first[first.procedure_code.isin(["99213", "J0120", "0450"])]
    assert sorted(zip(top.code_type, top.procedure_code, top.setting, top.charge.fillna(-1), strict=True)) == [("CPT", "99213", "IP", -1234.5), ("HCPCS", "J0120", "ALL", -1.0), ("HCPCS", "J0120", "IP", 5.0), ("REVCODE", "0450", "IP", -1234.5)]
    assert len(first) == 104 and "café" in set(first.description)
    assert {(r.sheet, r.status, r.n_matches) for r in log.collect()} == {("(csv)", "ok", 104), ("List", "ok", 60), ("Text", "low_score", 0)}


def test_census_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('[["NAME","pop"],["A","5"],["B",null]]',), ("[]",), (None,)], "t string")
    got = df.select(F.explode(grid.array_table(F.col("t"))).alias("m")).collect()
    assert [r.m for r in got] == [{"NAME": "A", "pop": "5"}, {"NAME": "B", "pop": None}]


def test_federal_files_in_ranges(spark, folder):
    """Plain files read by place, in ranges of 64 bytes, give what their contents give."""
    book = workbook({"Data": [["hospital_name", "version"], ["A", "2.2"], ["description", "code|1", "code|1|type", "standard_charge|gross"], ["Visit", 99213, "CPT", 10.5]]})
    damaged = book[:60] + b"\0" * 40 + book[100:]
    path = folder(tall__csv=TALL, w__csv=WIDE, wide__zip=zipped("in.csv", WIDE), j__json=JSON, zj__zip=zipped("in.json", JSON), b__xlsx=book, h__csv="<html>", d__xlsx=damaged)
    source, places = grid.files(spark, path), ranges.listing(spark, path)
    whole, parts = price_files.parse(source, owners(source)), price_files.parse(places, owners(places), range_bytes=64)
    assert sorted(whole[0].columns) == sorted(parts[0].columns)
    for a, b in zip(whole, parts, strict=True):
        found = [sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str) for df in (a, b)]
        assert found[0] == found[1]
        assert len(found[0]) > 2
    assert {r.ccn: r.status for r in parts[2].collect() if not r.status == "ok"} == {"h.csv": "skip:html", "d.xlsx": "skip:bad_zip"}


def test_heads_read_little(spark, tmp_path):
    rows = [["hospital_name", "version"], ["A", "2.2"]] + [[f"text {i}", i] for i in range(20_000)]
    (tmp_path / "b.xlsx").write_bytes(workbook({"S": rows}))
    (tmp_path / "t.csv").write_text(TALL + "x,1\n" * 200_000)
    (tmp_path / "j.zip").write_bytes(zipped("a.json", JSON + " " * 3_000_000))
    got = {r.path.rsplit("/", 1)[1]: r for r in grid.heads(ranges.listing(spark, str(tmp_path))).collect()}
    assert got["t.csv"].length > 800_000
    assert got["b.xlsx"].length > 100_000
    assert all(r.bytes_read <= 140_000 for r in got.values())
    assert [r[:2] for r in got["b.xlsx"].top[:2]] == rows[:2]
    same = {r.path.rsplit("/", 1)[1]: r for r in grid.heads(grid.files(spark, str(tmp_path))).collect()}
    assert all(same[k][1:6] == got[k][1:6] for k in got)


def test_identifiers_by_field(spark, folder):
    n = [f"{k}234567890" for k in range(1, 6)]
    files = {
        "two__csv": f'hospital_name,npi,"type_2_npi"\nA,{n[0]},{n[1]}|{n[2]}|{n[1]}\nx,y\n',
        "later__csv": f"hospital_name,type_2_npi,npi\nA,none,{n[0]}\n",
        "text__csv": f"hospital_name,notes\nA,the Hospital_NPI: {n[3]} and npi {n[4]}\n",
        "one__csv": f"npi {n[0]}\n",
        "array__json": f'{{"npi": "{n[0]}", "TYPE_2_NPI" : ["{n[1]}", "{n[2]}", "12"], "type_2_npi": "{n[1]}"}}',
        "late__json": f'{{"type_2_npi": [ "short" ], "npi":"{n[4]}"}}',
        "none__json": '{"npi": 1234567890}',
        "in__zip": zipped("x.json", f'{{"hospital_npi": ["{n[3]}"]}}'),
    }
    got = {r.path.rsplit("/", 1)[1]: r.numbers for r in price_files.identifiers(grid.heads(ranges.listing(spark, folder(**files)))).collect()}
    assert got == {"two.csv": n[1:3], "later.csv": [n[0]], "text.csv": [n[3]], "one.csv": [], "array.json": n[1:3], "late.json": [n[4]], "none.json": [], "in.zip": [n[3]]}


def test_a_ledger_names_the_files(spark, folder):
    places = ranges.listing(spark, folder(a__csv=TALL, b__csv=TALL, c__csv=TALL))
    root = places.first().path.rsplit("/", 1)[0]
    ledger = spark.createDataFrame([("1", f"{root}/a.csv", "ok"), ("1", f"{root}/a.csv", "ok"), ("2", f"{root}/b.csv", "already_present"), ("3", f"{root}/z.csv", "ok"), ("4", f"{root}/c.csv", None)], "ccn string, path string, status string")
    assert [tuple(r) for r in price_files.listed(ledger, places).collect()] == [(f"{root}/a.csv", "1")]


def test_unreadable_chargemasters_are_logged(spark, tmp_path):
    place = tmp_path / "2020" / "Beta"
    place.mkdir(parents=True)
    (place / "1_CDM.csv").write_text("CPT Code,Description,Charge\n" + "99213,Visit,5\n" * 200)
    (place / "2_CDM.xlsx").write_bytes(b"PK\x03\x04" + b"damaged" * 300)
    (place / "3_CDM.xls").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + b"damaged" * 300)
    source = grid.chargemaster_files(grid.files(spark, str(tmp_path)))
    _, log = chargemaster.parse(chargemaster.lines(source), source)
    assert {(r.path.rsplit("/", 1)[1], r.status) for r in log.collect()} == {("1_CDM.csv", "ok"), ("2_CDM.xlsx", "unreadable"), ("3_CDM.xls", "unreadable")}


def test_heads_leave_in_batches():
    class Files:
        columns = ["path", "length", "content"]

        def select(self, *_):
            return self

        def mapInPandas(self, read, _):
            return read

    def parts(contents):
        return list(grid.heads(Files())(iter([pd.DataFrame({"path": [str(i) for i in range(len(contents))], "length": [len(c) for c in contents], "content": contents})])))

    small = parts([b"a,b\n1,2\n"] * 2500)
    assert len(small) <= 10 and [p for part in small for p in part["path"]] == [str(i) for i in range(2500)]
    assert small[0].loc[0, ["kind", "head", "top"]].tolist() == ["plain", "a,b\n1,2\n", [["a", "b"], ["1", "2"]]]
    large = parts([b"x" * (100 << 10)] * 300)
    assert max(part["head"].str.len().sum() for part in large) <= 2 * (4 << 20) and sum(map(len, large)) == 300
    assert parts([]) == []
