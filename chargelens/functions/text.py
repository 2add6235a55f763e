"""Column expressions for codes, charges, headers, settings and identifiers. JVM-side, null-safe, no UDF but name_similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Column-name patterns by code family, most specific first.
CODE_COLUMN_PATTERNS = (
    ("ICD10PCS", r"(?i)(?:\bicd[-\s]*10[-\s]*pcs\b|\bicd[-\s]*pcs\b|\bpcs\s*code\b|\bicd\d*\s*proc)"),
    ("NDC", r"(?i)\b(ndc|national\s*drug)\b"),
    ("DRG", r"(?i)\b(ms[-\s]*drg|drg)\b(?!\s*(?:desc|description|name|title|narrative|category))"),
    ("REVCODE", r"(?i)\b(revenue\s*code|rev\s*code|rev[-_]?cd|ub[-\s]*04|nubc)\b"),
    ("CPT_HCPCS", r"(?i)\b(cpt|hcpcs|cpt[\s/\-]*hcpcs|hcpcs[\s/\-]*cpt|proc(?:edure)?\s*code|billing\s*code|service\s*code|cpt\s*code|hcpcs\s*code)\b"),
    ("AMBIG", r"(?i)\bcode\b"),
)
# Shapes of normalised codes by family.
CODE_SHAPES = {"CPT": r"^\d{5}$", "HCPCS": r"^[A-Z]\d{4}$", "DRG": r"^\d{3}$", "NDC": r"^\d{10,11}$", "ICD10PCS": r"^[A-Z0-9]{7}$", "REVCODE": r"^(?:0\d{3}|\d{3})$"}
# Setting tags and the column names that mean them, in order.
SETTING_PATTERNS = (
    ("IP", r"(?i)inpatient|\bi[\s/\-]*p\b"),
    ("OP", r"(?i)outpatient|\bo[\s/\-]*p\b"),
    ("ER", r"(?i)emergency|\be[\s/\-]*r\b|\bed\b"),
    ("SB", r"(?i)standby|\bs[\s/\-]*b\b"),
    ("OR", r"(?i)operating.*room|\bo[\s/\-]*r\b"),
)
# Charge, description, unit and header words.
CHARGE_COLUMN = (
    r"(?i)(?!.*\b(charge\s*code|charge\s*desc|charge\s*num|code\s*number)\b)(gross\s*charges?|standard\s*charges?|average\s*charges?|avg\.?\s*charges?|list\s*prices?|cdm\s*prices?|billed\s*charges?|total\s*charges?|"
    r"\bi[\s/\-]*p\b|\bo[\s/\-]*p\b|\be[\s/\-]*r\b|\bs[\s/\-]*b\b|\bo[\s/\-]*r\b|inpatient|outpatient|emergency|standby|operating\s*room|\bcharges?\b|\bprices?\b|\bamounts?\b|\brates?\b|"
    r"\d{4}\s*prices?|\d{4}\s*charges?|standard\s*amounts?|cdm\s*amounts?)"
)
CHARGE_COLUMN_NOT = r"(?i)charge\s*code|charge\s*desc|code\s*number"
DESCRIPTION_COLUMN = r"(?i)\b(description|desc|procedure\s*name|service\s*name|item\s*name|narrative|procedure\s*description)\b"
UNIT_COLUMN = r"(?i)\b(unit|uom|per)\b"
HEADER_WORD = r"(?i)(cpt|hcpcs|code|charge|price|amount|description|desc|procedure|service|rate|cost|revenue|standard)"
# Tokens left out of hospital names before they are compared.
NAME_STOPWORDS = ("THE", "A", "AN", "OF", "AND", "INC", "INCORPORATED", "LLC", "LP", "MEDICAL", "CENTER", "HOSPITAL", "HOSPITALS", "HOSP", "HEALTH", "HEALTHCARE", "REGIONAL", "MEM", "MEMORIAL")
# Tokens left out of registry names, and of the tokens that a web address is looked for.
REGISTRY_STOPWORDS = ("THE", "INC", "INCORPORATED", "LLC", "LP", "OF", "AND", "A", "AN", "CORPORATION", "CORP")
ADDRESS_STOPWORDS = ("hospital", "medical", "center", "centre", "health", "healthcare", "system", "campus", "care", "regional", "community", "general", "the", "of", "st", "saint", "memorial", "incorporated", "inc", "llc", "mem", "med", "ctr", "and", "for", "a")
# Patterns of price file addresses, of links to them, and of hosts that are never a hospital's.
PRICE_FILE_URL = r"(?i)([0-9]{2}-?[0-9]{7}_.*?_standardcharges\.(?:json|csv|xml|xlsx?|zip|gz))|(/standardcharges?[^/?#]*\.(?:json|csv|xml|xlsx?|zip|gz))|(/machine[- ]?readable[^/?#]*\.(?:json|csv|xml|xlsx?|zip|gz))"
PRICE_LINK_TEXT = r"(?i)(standard\s*charges?|price\s*transparency|machine[- ]?readable|chargemaster|hospital\s*charges?|transparency|hpt|price\s*list)"
NEVER_A_HOSPITAL = (
    r"(?i)(wikipedia|yelp|healthgrades|facebook|linkedin|indeed|glassdoor|twitter|x\.com|instagram|youtube|tiktok|doximity|zocdoc|ratemds|vitals|webmd|medlineplus|google|bing|duckduckgo|"
    r"archive\.org|mapquest|yellowpages|usnews|niche|zillow|realtor|beckershospitalreview|hcahealthcare\.com/locations|medicare\.gov|cms\.gov|nih\.gov|cdc\.gov|"
    r"payerprice|mychart|hospitalpricecheck|turquoise\.health|hospitalpricingspecialists|careoperative|patientrightsadvocate|pricemdhealth|fairhealth|clearprice|hospitallookup|hospitalpricelookup|rippleeffect)"
)
# Shapes of facility ids, employer ids, provider ids, schema versions and ZIP codes.
FACILITY_ID_PATTERNS = (r"^(\d{9})[_\s]", r"(?i)OSHPD[_\s-]*(\d{9})", r"(?<!\d)(\d{9})(?!\d)")
EMPLOYER_ID = r"(?:^|/)(\d{2}-?\d{7})[-_]"
PROVIDER_ID = r"(?<!\d)(\d{10})(?!\d)"
SCHEMA_VERSION = r"(?i)\"version\"\s*:\s*\"([^\"]+)\""
ZIP_CODE = r"(\d{5})"
# Cells that mean "no number", by source.
PLACEHOLDERS = {
    "chargemaster": ("", "n/a", "na", "nan", "none", "-", ".", "tbd"),
    "mrf": ("", "na", "n/a", "none", "null", "-", "not applicable"),
    "legacy": ("", "note a", "not applicable", "none", "n/a", "na", "-"),
    "misc": ("", "n/a", "na", "note a", "not applicable", "none", "-", "--", ".", "0", "0.00", "$0.00", "$ -"),
}

#: What Python's float() takes; Spark's cast would also take 12D and 1.5f.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def clean_charge(raw: Column) -> Column:
    """Chargemaster cell: "(x)" is negative, zero stays."""
    s = F.trim(raw)
    inner = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(s, r"^\((.+)\)$", 1), F.lit("")), s), "[$,]", "")
    value = number(inner)
    return F.when(F.lower(s).isin(*PLACEHOLDERS["chargemaster"]), None).when(s.rlike(r"^\(.+\)$"), -value).otherwise(value)


def clean_mrf(raw: Column) -> Column:
    """Federal price-file cell: signed number, zero stays."""
    s = F.trim(F.regexp_replace(F.trim(raw), "[$,]", ""))
    return F.when(F.lower(s).isin(*PLACEHOLDERS["mrf"]), None).otherwise(number(s))


def clean_legacy(raw: Column) -> Column:
    """Legacy system cell: the first run of digits and points, so a sign is lost."""
    s = F.trim(raw)
    return F.when(F.lower(s).isin(*PLACEHOLDERS["legacy"]), None).otherwise(number(F.regexp_extract(F.regexp_replace(s, "[$,]", ""), r"[\d.]+", 0)))


def clean_misc(raw: Column) -> Column:
    """Miscellaneous cell: the first signed number in the text; zero means none."""
    s = F.trim(raw)
    bare = F.trim(F.btrim(F.lower(s), F.lit("$ ")))
    value = number(F.regexp_extract(F.regexp_replace(s, "[$,]", ""), r"-?\d+\.?\d*", 0))
    return F.when(bare.isin(*PLACEHOLDERS["misc"]), None).when(value != 0, value)


def clean_numeric(raw: Column) -> Column:
    """Any plain number with thousands separators, else null."""
    return number(F.regexp_replace(raw, ",", ""))


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))


def normalize_code(c: Column) -> Column:
    return F.regexp_replace(upper_trim(c), "[^A-Z0-9]", "")


def detect_code_type(code: Column) -> Column:
    return F.when(code.rlike(CODE_SHAPES["CPT"]), "CPT").when(code.rlike(CODE_SHAPES["HCPCS"]), "HCPCS")


def is_revenue_code(code: Column) -> Column:
    """0100 to 0999 with a category from 010 to 099; three digits have lost a leading zero."""
    four = F.when(F.length(code) == 3, F.concat(F.lit("0"), code)).otherwise(code)
    return code.rlike(CODE_SHAPES["REVCODE"]) & F.substring(four, 1, 3).between("010", "099")


def validate_code(code: Column, family: Column) -> Column:
    """The confirmed type of a normalised code in a column of a family, or null."""
    plain = family.isin("DRG", "NDC", "ICD10PCS")
    shape = F.coalesce(*[F.when((family == f) & code.rlike(CODE_SHAPES[f]), f) for f in ("DRG", "NDC", "ICD10PCS")])
    return F.when(family.isin("CPT_HCPCS", "AMBIG"), detect_code_type(code)).when(plain, shape).when((family == "REVCODE") & is_revenue_code(code), "REVCODE")


def legacy_code_type(code: Column) -> Column:
    """Letter first and at most 7 characters: HCPCS; five digits: CPT; else empty."""
    return F.when(code.rlike("^[A-Za-z]") & (F.length(code) <= 7), "HCPCS").when(code.rlike(r"^\d{5}$"), "CPT").otherwise("")


def classify_code_column(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, pattern in reversed(CODE_COLUMN_PATTERNS):
        out = F.when(name.rlike(pattern), family).otherwise(out)
    return F.when(name.isNotNull(), out)


def is_charge_column(name: Column) -> Column:
    return name.rlike(CHARGE_COLUMN) & ~name.rlike(CHARGE_COLUMN_NOT)


def setting_from_column(name: Column) -> Column:
    out = F.lit("ALL")
    for tag, pattern in reversed(SETTING_PATTERNS):
        out = F.when(name.rlike(pattern), tag).otherwise(out)
    return out


def normalize_setting(text: Column) -> Column:
    s = F.lower(F.coalesce(text, F.lit("")))
    ip, op = s.contains("inpatient") | s.rlike(r"\bip\b"), s.contains("outpatient") | s.rlike(r"\bop\b")
    return F.when((ip & op) | s.contains("both"), "both").when(ip, "inpatient").when(op, "outpatient").when(s.contains("emerg"), "emergency").when(s.contains("prof"), "professional").otherwise("")


def header_score(cells: Column) -> Column:
    """Five for each cell with a header word, one for each of two characters or more."""
    return 5 * F.size(F.filter(cells, lambda c: c.rlike(HEADER_WORD))) + F.size(F.filter(cells, lambda c: F.length(F.trim(c)) > 1))


def first_matching(cells: Column, pattern: str) -> Column:
    """Position of the first cell that a pattern matches, or null."""
    hits = F.filter(F.transform(cells, lambda c, i: F.when(c.rlike(pattern), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def first_containing_all(cells: Column, *needles: str) -> Column:
    """Position of the first cell that contains every needle, or null. Position 0 counts."""
    hits = F.filter(F.transform(cells, lambda c, i: F.when(F.forall(F.array(*map(F.lit, needles)), lambda n: F.lower(c).contains(n)), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def facility_id(name: Column) -> Column:
    """Nine digits: before an underscore or blank, after a tag, or alone."""
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in FACILITY_ID_PATTERNS]
    return F.coalesce(*found)


def tail6(c: Column) -> Column:
    return F.substring(c, -6, 6)


def zip5(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ZIP_CODE, 1), F.lit(""))


def pad_zip(c: Column) -> Column:
    return F.substring(F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c), 1, 5)


def ccn6(c: Column) -> Column:
    bare = F.ltrim(c, F.lit("0"))
    return F.when(F.length(bare) < 6, F.lpad(bare, 6, "0")).otherwise(bare)


def employer_id(*paths: Column) -> Column:
    """XX-XXXXXXX from the first path in which nine digits stand before a dash or underscore."""
    digits = F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_extract(p, EMPLOYER_ID, 1), "-", ""), F.lit("")) for p in paths])
    return F.when(F.length(digits) == 9, F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 7)))


def provider_ids(text: Column) -> Column:
    """Distinct ten-digit identifiers in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PROVIDER_ID), 1))


def schema_version_of(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, SCHEMA_VERSION, 1), F.lit("")), F.lit("?"))


def schema_bucket(v: Column) -> Column:
    """Coarse class of a version string; spelling and case count, and the first match wins."""
    return F.when(v.isin("1", "1.0.0"), "v1.x").when(v.like("2%"), "v2.x").when(v.isin("3", "3.0", "3.0.0", "3.0.1", "V3.0.0", "CSV Wide V3.0"), "v3.x").when(v.like("%kaiser%"), "kaiser_2023").when(v.like("misc%"), "misc_csv").otherwise("other")


def normalize_name(name: Column) -> Column:
    tokens = F.filter(F.split(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9 ]+", " "), " +"), lambda t: (t != "") & ~t.isin(*NAME_STOPWORDS))
    return F.array_join(tokens, " ")


def registry_name(name: Column) -> Column:
    """Upper-case tokens without punctuation at their ends or stop words, as registry names are compared."""
    tokens = F.transform(F.split(F.upper(F.coalesce(name, F.lit(""))), r"\s+"), lambda t: F.regexp_replace(t, r"^[,.()]+|[,.()]+$", ""))
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(*REGISTRY_STOPWORDS)), " ")


def address_tokens(name: Column) -> Column:
    """Distinct lower-case tokens of three characters or more that a hospital's web address may have."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*ADDRESS_STOPWORDS)))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two normalised names; it may depend on their order."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def role_list(columns: Column) -> Column:
    """name<role>|name<role> of an array of (name, role); empty without any."""
    return F.array_join(F.transform(columns, lambda c: F.concat(c["name"], F.lit("<"), c["role"], F.lit(">"))), "|")


def safe_file_name(url: Column) -> Column:
    """The last part of an address as a file name: without query, other characters as an underscore, 180 characters at most."""
    last = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)
    return F.substring(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), 1, 180)


def looks_like_html(head: Column) -> Column:
    """The first 64 characters begin a page."""
    s = F.lower(F.ltrim(F.substring(head, 1, 64)))
    return s.startswith("<!doctype html") | s.startswith("<html")


def anchors(html: Column) -> Column:
    """(href, text) of each link."""
    href = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>.*?</a>"), 1)
    text = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>(.*?)</a>"), 1)
    return F.transform(F.arrays_zip(href.alias("href"), text.alias("text")), lambda a: F.struct(a["href"].alias("href"), F.trim(F.regexp_replace(F.regexp_replace(a["text"], "<[^>]*>", " "), r"\s+", " ")).alias("text")))


def preferred_address(addresses: Column) -> Column:
    """(state, zip5, city) of the first practice location, else of the first address; empty strings where there is none.

    addresses: array of structs with address_purpose, state, postal_code, city.
    """
    practice = F.get(F.filter(addresses, lambda a: F.upper(a["address_purpose"]) == "LOCATION"), F.lit(0))
    chosen = F.coalesce(practice, F.get(addresses, F.lit(0)))
    field = lambda name: F.coalesce(chosen[name], F.lit(""))
    return F.struct(F.upper(field("state")).alias("state"), F.substring(field("postal_code"), 1, 5).alias("zip5"), F.upper(field("city")).alias("city"))


def price_file_links(index: Column) -> Column:
    """The lines of an index file that are links to price files, in order; null counts as an empty file."""
    lines = F.transform(F.split(F.coalesce(index, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x.startswith("http") & F.lower(x).contains("standardcharges"))
