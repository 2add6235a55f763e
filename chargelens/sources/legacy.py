"""Price files older than the federal templates: one hospital system's archives, and miscellaneous tables whose columns are found by words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.functions import text as T
from chargelens.sources import grid as G
from chargelens.sources.price_files import GROSS, NEGOTIATED, strip

# Words of miscellaneous column names, by role.
ROLES = {
    "cash": ("discounted_cash", "discounted cash", "cash_price", "cash price", "self_pay", "self pay"),
    "min": ("min_negotiated", "min negotiated", "minimum negotiated", "de-identified minimum", "de_identified_minimum", "deidentified minimum"),
    "max": ("max_negotiated", "max negotiated", "maximum negotiated", "de-identified maximum", "de_identified_maximum", "deidentified maximum"),
    "desc": ("procedure_name", "procedure name", "charge_description", "charge description", "description", "primary_code_description", "primary code description", "billdesc", "desc"),
    "code": ("primary_code", "cpt_hcpcs", "cpt/hcpcs", "cpt hcpcs", "hcpcs_code", "cpt_code", "hcpcs", "procedure_code", "procedure code", "cpt"),
    "rev": ("rev_code", "rev code", "revenue_code", "revenue code", "billing_code", "billing code", "chgcat"),
    "setting": ("billing_class", "billing class", "patient_type", "patient type", "pt_summary", "bill_type", "setting", "inpatient/outpatient", "inpatient / outpatient"),
    "payer": ("payer_name", "payer name", "insurance plan", "insurance_plan"),
    "rate": ("payer_negotiated_rate", "payer negotiated", "negotiated_rate", "negotiated rate", "standard_charge_negotiated"),
}
PRICE = ("gross_charge", "gross charge", "grosscharge", "lastprice", "list_price", "list price", "standard_charge", "cdmcharge", "cdm_charge")
BARE_PRICE = ("charge", "current charge", "price", "current price")
HEADER_WORDS = ("description", "procedure", "billdesc", "cdmdesc", "deptname")
# Words of columns that are no payer's, and of those that are.
NOT_PAYER = (
    "as of date", "line type", "line id", "charge code", "drg", "modifier", "ndc", "rev_code", "rev code", "active", "dept", "code type", "price tier", "rx_unit", "rx unit", "deptname",
    "barproc", "cpt4", "hcpcs", "primary_code", "primary code", "patient type", "patient_type", "pt_summary", "billdesc", "desc", "name", "location", "bill_type", "bill type", "modifiers",
)
PAYER = (
    "price", "rate", "negotiated", " $", "$ ", "payer", "aetna", "anthem", "blue ", "cigna", "humana", "united", "kaiser", "medicare", "medicaid", "tricare", "molina", "centene",
    "wellcare", "champva",
)
LEGACY_MEMBER = "chargedescriptionmaster"
HEADER_SCAN, PAYER_SAMPLE = 25, 200


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def _flat(cells: Column) -> Column:
    return F.transform(cells, lambda c: strip(F.regexp_replace(F.lower(strip(c)), "[\r\n]", " ")))


def _at(name: str) -> Column:
    return strip(F.get("cells", F.col(f"at.{name}")))


def _later(first: Column, second: Column) -> Column:
    """The first position unless it is missing or the file's first column."""
    return F.when(first > 0, first).otherwise(second)


def _table(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    numbers = ("gross_charge", "discounted_cash", "standard_charge_min", "standard_charge_max", "negotiated_dollar", "negotiated_percentage", "estimated_amount")
    empty = lambda c: F.lit(None).cast("double") if c in numbers else F.lit("")
    return rows.select(*[F.col(c) if c in rows.columns else empty(c).alias(c) for c in columns])


def legacy_archives(source: DataFrame, owners: DataFrame) -> DataFrame:
    """Gross rows of the archives' charge description master. The header is the first of ten lines with a gross charge and a
    procedure name or description; files without one, or of fewer than six lines, give no rows."""
    head = G.grid(source, head=10, member=LEGACY_MEMBER)
    flat = F.transform("cells", lambda c: F.lower(c))
    is_header = F.exists(flat, lambda c: c.contains("gross charge")) & F.exists(flat, lambda c: c.contains("procedure name") | c.contains("description"))
    top = head.groupBy("path").agg(F.count("*").alias("n"), F.min_by(F.struct("row_idx", "cells"), F.when(is_header, F.col("row_idx"))).alias("h"))
    h = F.transform("h.cells", lambda c: strip(F.regexp_replace(F.regexp_replace(F.lower(c), "\n", " "), "  ", " ")))
    find = lambda *words: T.first_containing_all(h, *words)
    at = F.struct(
        _later(find("charge", "px"), find("charge")).alias("id"), find("procedure", "code").alias("code"), find("default", "modifier").alias("modifier"), _later(find("billing", "code"), find("rev")).alias("rev"),
        find("procedure", "name").alias("name"), find("gross", "charge").alias("gross"), find("discounted", "cash").alias("cash"), find("inpatient", "outpatient").alias("setting"),
        find("minimum", "negotiated").alias("min"), find("maximum", "negotiated").alias("max"),
    )
    top = top.filter("n >= 6 AND h IS NOT NULL").select("path", F.col("h.row_idx").alias("top"), F.size("h.cells").alias("width"), at.alias("at")).filter("at.name IS NOT NULL AND at.gross IS NOT NULL")
    rows = G.grid(source, member=LEGACY_MEMBER).join(top.join(owners.select("path", "ccn"), "path"), "path").filter("row_idx > top AND NOT (size(cells) < width AND size(cells) <= 2)")
    rows = rows.withColumns({"name": _at("name"), "gross_charge": T.clean_legacy(_at("gross")), "discounted_cash": T.clean_legacy(_at("cash"))})
    rows = rows.filter((F.col("name") != "") & F.coalesce("gross_charge", "discounted_cash").isNotNull())
    s = F.upper(_at("setting"))
    both = s.contains("BOTH") | (s.contains("INPATIENT") & s.contains("OUTPATIENT"))
    setting = F.when(both, "both").when(s.contains("INPATIENT"), "inpatient").when(s.contains("OUTPATIENT"), "outpatient").otherwise("")
    second = F.when(_at("id") != "", _at("id")).otherwise(_at("rev"))
    rows = rows.withColumns({
        "description": F.substring("name", 1, 500), "code": F.substring(_at("code"), 1, 32), "code_type": T.legacy_code_type(_at("code")), "code2": F.substring(second, 1, 32),
        "code2_type": F.when(_at("id") != "", "kaiser_charge_id").when(_at("rev") != "", "rev_code").otherwise(""), "billing_class": setting, "setting": setting, "modifiers": _at("modifier"),
        "standard_charge_min": T.clean_legacy(_at("min")), "standard_charge_max": T.clean_legacy(_at("max")), "schema_version": F.lit("kaiser_2023"), "file_format": F.lit("kaiser_legacy"), "source_file": F.col("path"),
    })
    return _table(rows, GROSS)


def misc_layouts(head: DataFrame) -> DataFrame:
    """(path, top, at, payers, form) from the first lines of each file: tall with a payer or rate column, wide with columns of
    dollars (by name and a fifth of the cells, or a fifth of the cells and three tenths with a point or dollar sign), else chargemaster."""
    early = head.filter(F.col("row_idx") < HEADER_SCAN).withColumn("low", _flat(F.col("cells")))
    priced = F.exists("low", lambda c: c.rlike(_any(PRICE)) | c.isin(*BARE_PRICE))
    described = F.exists("low", lambda c: c.rlike(_any(HEADER_WORDS)) | c.isin("desc", "name"))
    top = early.filter(priced & described).groupBy("path").agg(F.min_by(F.struct("row_idx", "cells", "low"), "row_idx").alias("h"))
    bare = F.get(F.filter(F.transform("low", lambda c, i: F.when(c.isin(*BARE_PRICE), i)), lambda i: i.isNotNull()), F.lit(0))
    top = top.select("path", F.col("h.row_idx").alias("top"), F.transform("h.cells", strip).alias("names"), F.col("h.low").alias("low"))
    at = F.struct(F.coalesce(T.first_matching(F.col("low"), _any(PRICE)), bare).alias("gross"), *[T.first_matching(F.col("low"), _any(words)).alias(role) for role, words in ROLES.items()])
    top = top.withColumn("at", at).filter("at.gross IS NOT NULL AND at.desc IS NOT NULL")
    cells = head.join(top, "path").filter((F.col("row_idx") > F.col("top")) & (F.col("row_idx") <= F.col("top") + PAYER_SAMPLE))
    cells = cells.select("path", "low", "names", "at", F.posexplode("cells").alias("pos", "cell")).withColumn("h", F.get("low", F.col("pos")))
    taken = F.array(*[F.col(f"at.{r}") for r in ("gross", *ROLES)])
    cells = cells.filter((F.length("h") >= 4) & ~F.col("h").rlike(_any(NOT_PAYER)) & ~F.exists(taken, lambda i: i.eqNullSafe(F.col("pos"))))
    dollars = T.clean_misc(F.col("cell")).isNotNull()
    stats = cells.groupBy("path", "pos", "h", F.get("names", F.col("pos")).alias("name")).agg((F.count_if(dollars) / F.count("*")).alias("share"), (F.count_if(dollars & F.col("cell").rlike(r"[.$]")) / F.count("*")).alias("shaped"))
    stats = stats.filter((F.col("share") >= 0.20) & (F.col("h").rlike(_any(PAYER)) | (F.col("shaped") >= 0.30)))
    payers = stats.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", F.substring("name", 1, 200).alias("name")))).alias("payers"))
    form = F.when(F.coalesce("at.payer", "at.rate").isNotNull(), "tall").when(F.col("payers").isNotNull(), "wide").otherwise("chargemaster")
    return top.join(payers, "path", "left").select("path", "top", "at", "payers", form.alias("form"))


def misc_tables(source: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gross, negotiated) of miscellaneous tables. A tall file's gross rows are one a code and description, its first line's."""
    shapes = misc_layouts(G.grid(source, head=HEADER_SCAN + PAYER_SAMPLE + 1)).join(owners.select("path", "ccn"), "path")
    rows = G.grid(source).filter("active").join(shapes, "path").filter("row_idx > top")
    money = {"gross_charge": "gross", "discounted_cash": "cash", "standard_charge_min": "min", "standard_charge_max": "max"}
    rows = rows.withColumns({"desc": _at("desc"), **{k: T.clean_misc(_at(v)) for k, v in money.items()}}).filter((F.col("desc") != "") & F.coalesce(*money).isNotNull())
    s = F.lower(_at("setting"))
    inside, outside = s.contains("inpatient"), s.contains("outpatient")
    setting = F.when(inside & outside, "both").when(inside | s.startswith("ip"), "inpatient").when(outside | s.startswith("op"), "outpatient").when(s.contains("emergency"), "emergency").when(s.contains("professional"), "professional").otherwise("")
    code, rev = F.substring(_at("code"), 1, 32), F.substring(_at("rev"), 1, 32)
    rows = rows.withColumns({
        "description": F.substring("desc", 1, 500), "code": code, "code_type": T.legacy_code_type(code), "code2": rev, "code2_type": F.when(rev != "", "rev_code").otherwise(""),
        "setting": setting, "billing_class": F.when(setting == "emergency", "outpatient").otherwise(setting), "schema_version": F.concat(F.lit("misc_csv_"), "form"),
        "file_format": F.concat(F.lit("misc_"), "form"), "source_file": F.col("path"),
    })
    tall = _table(rows.filter("form = 'tall'").groupBy("path", "code", "desc").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("path", "code", "desc")]), "row_idx").alias("r")).select("code", "r.*"), GROSS)
    gross = tall.unionByName(_table(rows.filter("form <> 'tall'"), GROSS))
    own = F.struct(F.col("at.rate").cast("int").alias("pos"), F.substring(_at("payer"), 1, 200).alias("name"))
    offers = rows.filter("form <> 'chargemaster'").withColumn("o", F.explode(F.when(F.col("form") == "tall", F.array(own)).otherwise(F.col("payers"))))
    offers = offers.withColumns({"payer_name": F.col("o.name"), "negotiated_dollar": T.clean_misc(F.get("cells", F.col("o.pos")))})
    offers = offers.filter(F.col("negotiated_dollar").isNotNull() & ((F.col("form") == "wide") | (F.col("payer_name") != "")))
    return gross, _table(offers, NEGOTIATED)
