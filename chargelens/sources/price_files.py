"""Federal price files (tall and wide CSV, workbooks, JSON) as gross and negotiated rows. Cells come from ``grid``; the rest is declarative.

Each file's layout is one row, found in its third line and joined to its cells by path, so that AQE may broadcast the
layouts or split a file that holds many of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.functions.text import clean_mrf
from chargelens.operators.staging import staged
from chargelens.sources import grid as G
from chargelens.sources import ranges

GROSS = ("ccn", "description", "code", "code_type", "code2", "code2_type", "billing_class", "setting", "drug_unit", "drug_type", "modifiers", "gross_charge", "discounted_cash", "standard_charge_min", "standard_charge_max", "schema_version", "file_format", "source_file")
NEGOTIATED = ("ccn", "description", "code", "code_type", "billing_class", "setting", "payer_name", "plan_name", "negotiated_dollar", "negotiated_percentage", "negotiated_algorithm", "estimated_amount", "methodology", "modifiers", "schema_version", "file_format", "source_file")
# Column names of the federal templates, beside the positions' names here.
COLUMNS = {
    "description": "description", "billing_class": "billing_class", "setting": "setting", "drug_unit": "drug_unit_of_measurement", "drug_type": "drug_type_of_measurement",
    "modifiers": "modifiers", "gross": "standard_charge|gross", "cash": "standard_charge|discounted_cash", "min": "standard_charge|min", "max": "standard_charge|max",
    "payer": "payer_name", "plan": "plan_name", "dollar": "standard_charge|negotiated_dollar", "percentage": "standard_charge|negotiated_percentage",
    "algorithm": "standard_charge|negotiated_algorithm", "estimate": "estimated_amount", "method1": "standard_charge|methodology", "method2": "methodology",
}
# Fields that state a hospital's provider number, in the order tried.
NUMBER_FIELDS = ("type_2_npi", "hospital_npi", "npi")
OFFER = r"(?i)^standard_charge\|([^|]+)\|([^|]+)\|(negotiated_dollar|negotiated_percentage|negotiated_algorithm|estimated_amount|methodology)$"
OFFER_FIELDS = {"dollar": "negotiated_dollar", "percentage": "negotiated_percentage", "algorithm": "negotiated_algorithm", "estimate": "estimated_amount", "method": "methodology"}
ITEM = """struct<description: string, billing_class: string, setting: string, drug_unit_of_measurement: string, drug_type_of_measurement: string, modifiers: array<string>,
code_information: array<struct<code: string, type: string>>, standard_charges: array<struct<gross_charge: string, discounted_cash: string, minimum: string, maximum: string,
setting: string, billing_class: string, payers_information: array<struct<payer_name: string, plan_name: string, standard_charge_dollar: string, standard_charge_percentage: string,
standard_charge_algorithm: string, estimated_amount: string, methodology: string>>>>>"""


def strip(c: Column) -> Column:
    """Without blanks at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def position(names: Column, name: Column | str) -> Column:
    """Zero-based position of the first equal name, or null."""
    return F.nullif(F.array_position(names, name), F.lit(0)).cast("int") - 1


def _known(cells: Column, test) -> Column:
    return F.filter(cells, test)


def layout(third: DataFrame) -> DataFrame:
    """(path, sheet, at, pairs, offers): positions of the template's columns, of code and type pairs, and of each payer's and plan's fields."""
    head = third.select("path", "sheet", F.transform("cells", lambda c: F.trim(strip(c), F.lit('"'))).alias("h"))
    head = head.withColumn("low", F.transform("h", F.lower))
    at = F.struct(*[position(F.col("low"), name).alias(k) for k, name in COLUMNS.items()])
    codes = _known(F.col("low"), lambda c: c.rlike(r"^code\|\d+$") & F.array_contains(F.col("low"), F.concat(c, F.lit("|type"))))
    pairs = F.transform(codes, lambda c: F.struct(position(F.col("low"), c).alias("code"), position(F.col("low"), F.concat(c, F.lit("|type"))).alias("type")))
    parts = F.transform("h", lambda c, i: F.struct(F.regexp_extract(c, OFFER, 1).alias("payer"), F.regexp_extract(c, OFFER, 2).alias("plan"), F.lower(F.regexp_extract(c, OFFER, 3)).alias("field"), i.alias("i")))
    head = head.withColumn("parts", F.filter(parts, lambda p: p["field"] != ""))

    def last(key: Column, field: str) -> Column:
        return F.array_max(F.transform(F.filter("parts", lambda p: (p["payer"] == key["payer"]) & (p["plan"] == key["plan"]) & (p["field"] == field)), lambda p: p["i"]))

    keys = F.array_distinct(F.transform("parts", lambda p: F.struct(p["payer"].alias("payer"), p["plan"].alias("plan"))))
    offers = F.transform(keys, lambda k: F.struct(k["payer"].alias("payer"), k["plan"].alias("plan"), *[last(k, f).alias(n) for n, f in OFFER_FIELDS.items()]))
    return head.select("path", "sheet", at.alias("at"), pairs.alias("pairs"), offers.alias("offers"))


def _cell(name: str) -> Column:
    return F.get("cells", F.col(f"at.{name}"))


def _priced(gross: DataFrame) -> DataFrame:
    return gross.filter(F.coalesce("gross_charge", "discounted_cash", "standard_charge_min", "standard_charge_max").isNotNull()).select(*GROSS)


def from_grid(lines: DataFrame, kinds: DataFrame, third: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gross and negotiated rows of CSV files and workbooks.

    ``kinds``: (path, ccn, file_format, schema_version). Workbooks carry no second code, drug fields, modifiers or estimates.
    Lines without any text are left out. A tall file's gross row comes once a line, so once a payer."""
    book = F.col("file_format") == "xlsx"
    plain = lambda c: F.when(book, F.lit("")).otherwise(strip(c))
    rows = lines.filter((F.col("row_idx") > 2) & F.exists("cells", lambda c: strip(c) != "")).join(layout(third).join(kinds, "path"), ["path", "sheet"])
    codes = F.filter(F.transform("pairs", lambda p: F.struct(strip(F.get("cells", p["code"])).alias("code"), strip(F.get("cells", p["type"])).alias("type"))), lambda p: p["code"] != "")
    rows = rows.withColumn("codes", codes).withColumn("wide", F.when(book, F.size("offers") > 0).otherwise(F.col("file_format") == "csv_wide"))
    code = lambda k, field: F.coalesce(F.get("codes", F.lit(k))[field], F.lit(""))
    shared = {
        "description": F.coalesce(_cell("description"), F.lit("")), "code": code(0, "code"), "code_type": code(0, "type"), "billing_class": strip(_cell("billing_class")),
        "setting": strip(_cell("setting")), "modifiers": plain(_cell("modifiers")), "source_file": F.col("path"),
    }
    rows = rows.withColumns(shared)
    gross = rows.withColumns({
        "code2": F.when(book, F.lit("")).otherwise(code(1, "code")), "code2_type": F.when(book, F.lit("")).otherwise(code(1, "type")),
        "drug_unit": plain(_cell("drug_unit")), "drug_type": plain(_cell("drug_type")), "gross_charge": clean_mrf(_cell("gross")), "discounted_cash": clean_mrf(_cell("cash")),
        "standard_charge_min": clean_mrf(_cell("min")), "standard_charge_max": clean_mrf(_cell("max")),
    })
    method = F.when(F.col("at.method1") > 0, F.col("at.method1")).otherwise(F.col("at.method2"))
    own = F.struct(strip(_cell("payer")).alias("payer"), strip(_cell("plan")).alias("plan"), *[F.col(f"at.{k}").alias(k) for k in ("dollar", "percentage", "algorithm", "estimate")], method.alias("method"))
    offers = rows.withColumn("offer", F.explode(F.when(F.col("wide"), F.col("offers")).otherwise(F.array(own))))
    offers = offers.filter(F.col("wide") | (F.col("offer.payer") != "") | (F.col("offer.plan") != ""))
    value = lambda k: F.get("cells", F.col(f"offer.{k}"))
    negotiated = offers.withColumns({
        "payer_name": F.col("offer.payer"), "plan_name": F.col("offer.plan"), "negotiated_dollar": clean_mrf(value("dollar")), "negotiated_percentage": clean_mrf(value("percentage")),
        "negotiated_algorithm": strip(value("algorithm")), "estimated_amount": F.when(~book, clean_mrf(value("estimate"))), "methodology": strip(value("method")),
    })
    some = F.coalesce("negotiated_dollar", "negotiated_percentage", "estimated_amount").isNotNull() | (F.col("negotiated_algorithm") != "")
    return _priced(gross), negotiated.filter(some).select(*NEGOTIATED)


def from_json(items: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gross and negotiated rows of (path, item) texts. Every payer entry gives a row, even without a value; a charge's setting and class fall back to its item's."""
    rows = items.select("path", F.from_json("item", ITEM).alias("i")).filter("i IS NOT NULL").join(kinds, "path")
    first, second = F.get("i.code_information", F.lit(0)), F.get("i.code_information", F.lit(1))
    lone = (strip(first["code"]) == "") & second.isNotNull()
    rows = rows.withColumns({
        "description": strip(F.col("i.description")), "code": strip(F.when(lone, second["code"]).otherwise(first["code"])), "code_type": strip(F.when(lone, second["type"]).otherwise(first["type"])),
        "code2": strip(F.when(~lone, second["code"])), "code2_type": strip(F.when(~lone, second["type"])), "drug_unit": strip(F.col("i.drug_unit_of_measurement")),
        "drug_type": strip(F.col("i.drug_type_of_measurement")), "modifiers": F.array_join(F.coalesce("i.modifiers", F.array().cast("array<string>")), ","), "source_file": F.col("path"),
        "c": F.explode("i.standard_charges"),
    })
    rows = rows.withColumns({k: strip(F.coalesce(F.nullif(F.col(f"c.{k}"), F.lit("")), F.col(f"i.{k}"))) for k in ("setting", "billing_class")})
    money = {"gross_charge": "gross_charge", "discounted_cash": "discounted_cash", "standard_charge_min": "minimum", "standard_charge_max": "maximum"}
    gross = rows.withColumns({k: clean_mrf(F.col(f"c.{f}")) for k, f in money.items()})
    paid = rows.withColumn("p", F.explode("c.payers_information"))
    negotiated = paid.withColumns({
        "payer_name": strip(F.col("p.payer_name")), "plan_name": strip(F.col("p.plan_name")), "negotiated_dollar": clean_mrf(F.col("p.standard_charge_dollar")),
        "negotiated_percentage": clean_mrf(F.col("p.standard_charge_percentage")), "negotiated_algorithm": strip(F.col("p.standard_charge_algorithm")),
        "estimated_amount": clean_mrf(F.col("p.estimated_amount")), "methodology": strip(F.col("p.methodology")),
    })
    return _priced(gross), negotiated.select(*NEGOTIATED)


def listed(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ccn) of the files that a download ledger (ccn, path, status) has as ``ok`` and that are there. A file that was there before the download isn't ``ok``."""
    return ledger.where("status = 'ok'").select("path", "ccn").distinct().join(files.select("path").distinct(), "path", "left_semi")


def identifiers(seen: DataFrame) -> DataFrame:
    """(path, numbers, bytes_read): the ten-digit provider numbers that each file's head states, each once. ``seen``: grid.heads().

    The fields are tried in order, and the first that has a number counts. JSON: a string or an array under the field. CSV: the cell below the field's name in the first
    row, else the first place of the text where a field's name stands right before a number.
    """
    none, number = F.array().cast("array<string>"), F.lit(r"\b(\d{10})\b")
    low = F.transform(F.get("top", F.lit(0)), lambda c: F.lower(F.trim(F.trim(strip(c)), F.lit('"'))))
    of_json, of_cell, of_text = none, none, none
    for field in reversed(NUMBER_FIELDS):
        entries = F.regexp_extract_all("head", F.lit(rf'(?i)"{field}"\s*:\s*(?:"\d{{10}}"|\[[^\]]+\])'), F.lit(0))
        found = F.flatten(F.transform(entries, lambda e: F.regexp_extract_all(e, number, F.lit(1))))
        of_json = F.when(F.size(found) > 0, found).otherwise(of_json)
        cell = F.coalesce(F.get(F.get("top", F.lit(1)), position(low, field)), F.lit(""))
        found = F.regexp_extract_all(cell, number, F.lit(1))
        of_cell = F.when(F.size(found) > 0, found).otherwise(of_cell)
        near = F.regexp_extract(F.lower("head"), rf"""{field}["']?\s*[,:=]?\s*["']?(\d{{10}})""", 1)
        of_text = F.when(near != "", F.array(near)).otherwise(of_text)
    rows = F.size("top") > 1
    numbers = F.when(F.col("head").rlike(r"^[\{\[]"), of_json).when(rows & (F.size(of_cell) > 0), of_cell).when(rows, of_text).otherwise(none)
    return seen.select("path", F.array_distinct(numbers).alias("numbers"), "bytes_read")


def parse(source: DataFrame, owners: DataFrame, range_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gross, negotiated, log) of all files. ``owners``: (path, ccn), the files a ledger lists.

    ``source`` has the files' contents (grid.files()), or only their places (ranges.listing()): then plain CSV and JSON files are read in ranges of ``range_bytes``, whatever
    their size, and archives and workbooks, which can't be, as whole files below 2 GB. The log holds each listed file's format, version and status: ok for a
    format parsed here, else ``skip:`` and the format; ``skip:unreadable`` for a workbook that gives no cell.
    Spark lists no file of 0 bytes, so a listed file that wasn't seen counts as empty."""
    seen = G.profile(source).withColumn("packed", F.col("inner").isNotNull() | F.col("file_format").isin("xlsx"))
    kinds = staged(seen.join(owners.select("path", "ccn"), "path"))  # a row a file
    few = kinds.select("path", "ccn", "file_format", "schema_version")
    parsed = ("csv_tall", "csv_wide", "csv_minimal", "xlsx", "json")
    tables, items = F.col("file_format").isin("csv_tall", "csv_wide", "csv_minimal", "xlsx"), F.col("file_format") == "json"
    stored = "content" in source.columns
    of = lambda which: source.join(kinds.where(which).select("path"), "path", "left_semi") if stored else ranges.contents(kinds.where(F.col("packed") & which))
    lines, top, elements = G.grid(of(tables)), G.grid(of(tables), head=3), G.json_items(of(items), "standard_charge_information")
    if not stored:
        plain, size = kinds.where("not packed").select("path", "length", "file_format"), range_bytes or ranges.RANGE_BYTES
        lines, top = lines.unionByName(ranges.csv_grid(plain.where(tables), size)), top.unionByName(ranges.csv_grid(plain.where(tables), size, head=3))
        elements = elements.unionByName(ranges.json_items(plain.where(items), "standard_charge_information", size).select("path", "item"))
    top = staged(top.filter("active"))  # three rows a file
    third = top.filter("row_idx = 2")
    g1, n1 = from_grid(lines.filter("active"), few, third)
    g2, n2 = from_json(elements, few)
    here = owners.select("path", "ccn").join(kinds.drop("ccn"), "path", "left").withColumns({"file_format": F.coalesce("file_format", F.lit("empty")), "schema_version": F.coalesce("schema_version", F.lit("?"))})
    log = here.join(top.select("path").distinct().withColumn("__rows", F.lit(True)), "path", "left")
    status = F.when((F.col("file_format") == "xlsx") & F.col("__rows").isNull(), "skip:unreadable").when(F.col("file_format").isin(*parsed), "ok").otherwise(F.concat(F.lit("skip:"), "file_format"))
    log = log.withColumn("status", status).select("path", "ccn", "length", "file_format", "schema_version", "inner", "status")
    return g1.unionByName(g2), n1.unionByName(n2), log
