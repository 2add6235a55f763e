"""Queries of column functions and ledger rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chargelens.functions import text
from chargelens.operators import ledgers
from chargelens.operators import relational as rel
from chargelens.plans import views as V
from chargelens.plans.registry import query

_HEADERS = [
    "CPT Code", "HCPCS", "cpt/hcpcs code", "Procedure Code", "Rev Code", "Revenue Code", "UB-04", "NDC", "National Drug Code", "MS-DRG", "DRG", "DRG Description", "ICD-10-PCS", "PCS Code", "Code", "Item Code",
    "Charge Code", "Charge Description", "Charge Num Price", "Code Number", "Gross Charges", "Standard Charge", "Average Charge", "Avg. Charges", "List Price", "2019 Price", "Amount", "Rate", "I/P Charge", "O/P", "Inpatient", "Outpatient Price",
    "Emergency", "E R", "Standby", "Operating Room", "OR", "Description", "Procedure Name", "Narrative", "Unit", "UOM", "Per", "Shipping", "", "Corporate", "IP",
]
_HEADERS_SQL = "SELECT p_partkey, [" + ", ".join(f"'{h}'" for h in _HEADERS) + f"][p_partkey % {len(_HEADERS)} + 1] || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_type WHEN p_partkey % 5 = 1 THEN ' ' || p_size ELSE '' END AS header FROM part"


@query(f"""SELECT p_partkey, header, CASE WHEN regexp_matches(header, '(?i)\\bicd[-\\s]*10[-\\s]*pcs\\b|\\bicd[-\\s]*pcs\\b|\\bpcs\\s*code\\b|\\bicd[0-9]*\\s*proc') THEN 'ICD10PCS' WHEN regexp_matches(header, '(?i)\\b(ndc|national\\s*drug)\\b') THEN 'NDC'
  WHEN regexp_matches(header, '(?i)\\bdrg\\b') AND NOT regexp_matches(header, '(?i)\\bdrg\\b\\s*(desc|name|title|narrative|category)') THEN 'DRG' WHEN regexp_matches(header, '(?i)\\b(revenue\\s*code|rev\\s*code|rev[-_]?cd|ub[-\\s]*04|nubc)\\b') THEN 'REVCODE'
  WHEN regexp_matches(header, '(?i)\\b(cpt|hcpcs|proc(edure)?\\s*code|billing\\s*code|service\\s*code)\\b') THEN 'CPT_HCPCS' WHEN regexp_matches(header, '(?i)\\bcode\\b') THEN 'AMBIG' END AS family,
  regexp_matches(header, '(?i)inpatient|outpatient|emergency|standby|operating\\s*room|\\bcharges?\\b|\\bprices?\\b|\\bamounts?\\b|\\brates?\\b|\\b[ioes][\\s/-]*[pb]\\b|\\be[\\s/-]*r\\b|\\bo[\\s/-]*r\\b') AND NOT regexp_matches(header, '(?i)charge\\s*code|charge\\s*desc|code\\s*number') AS is_charge,
  regexp_matches(header, '(?i)\\b(description|desc|procedure\\s*name|service\\s*name|item\\s*name|narrative)\\b') AS is_description, regexp_matches(header, '(?i)\\b(unit|uom|per)\\b') AS is_unit,
  CASE WHEN regexp_matches(header, '(?i)inpatient|\\bi[\\s/-]*p\\b') THEN 'IP' WHEN regexp_matches(header, '(?i)outpatient|\\bo[\\s/-]*p\\b') THEN 'OP' WHEN regexp_matches(header, '(?i)emergency|\\be[\\s/-]*r\\b|\\bed\\b') THEN 'ER' WHEN regexp_matches(header, '(?i)standby|\\bs[\\s/-]*b\\b') THEN 'SB'
    WHEN regexp_matches(header, '(?i)operating.*room|\\bo[\\s/-]*r\\b') THEN 'OR' ELSE 'ALL' END AS setting FROM ({_HEADERS_SQL})""")
def header_roles(s, d):
    h = F.col("header")
    k = F.col("p_partkey")
    more = F.when(k % 5 == 0, F.concat(F.lit(" "), "p_type")).when(k % 5 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("")
    rows = V.t(s, d, "part").select("p_partkey", F.concat(F.get(F.array(*map(F.lit, _HEADERS)), (k % len(_HEADERS)).cast("int")), more).alias("header"))
    return rows.select("p_partkey", "header", text.classify_code_column(h).alias("family"), text.is_charge_column(h).alias("is_charge"), h.rlike(text.DESCRIPTION_COLUMN).alias("is_description"), h.rlike(text.UNIT_COLUMN).alias("is_unit"), text.setting_from_column(h).alias("setting"))


@query(r"""WITH w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS code FROM documents)
SELECT code, CASE WHEN regexp_full_match(code, '[A-Za-z].*') AND len(code) <= 7 THEN 'HCPCS' WHEN regexp_full_match(code, '[0-9]{5}') THEN 'CPT' ELSE '' END AS legacy, CASE WHEN regexp_full_match(code, '[0-9]{5}') THEN 'CPT' WHEN regexp_full_match(code, '[A-Z][0-9]{4}') THEN 'HCPCS' END AS cpt,
  CASE WHEN regexp_full_match(code, '[0-9]{3}') THEN 'DRG' END AS drg, CASE WHEN regexp_full_match(code, '[0-9]{10,11}') THEN 'NDC' END AS ndc, CASE WHEN regexp_full_match(code, '[A-Z0-9]{7}') THEN 'ICD10PCS' END AS pcs,
  CASE WHEN regexp_full_match(code, '0?[0-9]{3}') AND lpad(code, 4, '0')[1:3] BETWEEN '010' AND '099' THEN 'REVCODE' END AS rev FROM w""")
def code_validation(s, d):
    c = F.col("code")
    words = V.t(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)).alias("w")).select(F.upper("w").alias("code")).distinct()
    families = {"cpt": "CPT_HCPCS", "drg": "DRG", "ndc": "NDC", "pcs": "ICD10PCS", "rev": "REVCODE"}
    return words.select("code", text.legacy_code_type(c).alias("legacy"), *[text.validate_code(c, F.lit(f)).alias(n) for n, f in families.items()])


_PATH_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'https://h.org/f/' || lpad((o_custkey * 97)::VARCHAR, 9, '1') || '_h_standardcharges.csv' WHEN 1 THEN lpad((o_custkey % 90 + 10)::VARCHAR, 2, '0') || '-' || lpad(o_orderkey::VARCHAR, 7, '0') || '-x.json' WHEN 2 THEN 'OSHPD-' || lpad(o_orderkey::VARCHAR, 9, '2') || ' cdm.xlsx' ELSE 'npi 1' || lpad(o_orderkey::VARCHAR, 9, '0') || ' and 12345678901, 1' || lpad(o_custkey::VARCHAR, 9, '0') END"


@query(rf"""WITH p AS (SELECT o_orderkey, {_PATH_SQL} AS path FROM orders), e AS (SELECT *, replace(regexp_extract(path, '(?:^|/)([0-9]{{2}}-?[0-9]{{7}})[-_]', 1), '-', '') AS nine FROM p)
SELECT o_orderkey, CASE WHEN nine <> '' THEN nine[1:2] || '-' || nine[3:9] END AS employer_id, CASE WHEN o_orderkey % 4 = 0 THEN regexp_extract(path, '[^0-9]([0-9]{{9}})_', 1) WHEN o_orderkey % 4 = 2 THEN regexp_extract(path, 'OSHPD-([0-9]{{9}})', 1) END AS facility_id,
  CASE WHEN o_orderkey % 4 = 3 THEN array_to_string(list_distinct(list_filter(regexp_extract_all(path, '[0-9]+'), lambda x: len(x) = 10)).list_sort(), ' ') ELSE '' END AS provider_ids FROM e""")
def identifiers_in_paths(s, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pad = lambda x, n, with_: F.lpad(x.cast("string"), n, with_)
    path = F.when(o % 4 == 0, F.concat(F.lit("https://h.org/f/"), pad(c * 97, 9, "1"), F.lit("_h_standardcharges.csv"))).when(o % 4 == 1, F.concat(pad(c % 90 + 10, 2, "0"), F.lit("-"), pad(o, 7, "0"), F.lit("-x.json")))
    path = path.when(o % 4 == 2, F.concat(F.lit("OSHPD-"), pad(o, 9, "2"), F.lit(" cdm.xlsx"))).otherwise(F.concat(F.lit("npi 1"), pad(o, 9, "0"), F.lit(" and 12345678901, 1"), pad(c, 9, "0")))
    rows = V.t(s, d, "orders").select("o_orderkey", path.alias("path"))
    own = F.when(o % 4 != 1, F.when(o % 4 != 3, text.facility_id(F.col("path"))))
    return rows.select("o_orderkey", text.employer_id(F.col("path")).alias("employer_id"), own.alias("facility_id"), F.array_join(F.array_sort(text.provider_ids(F.col("path"))), " ").alias("provider_ids"))


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'kaiser_2023' WHEN page_id % 4 = 1 THEN CASE WHEN page_id % 3 = 0 THEN 'v2.x' ELSE 'v3.x' END WHEN page_id % 4 = 2 THEN 'misc_csv' ELSE 'other' END AS bucket,
  CASE WHEN page_id % 2 = 0 THEN '?' ELSE (page_id % 3)::VARCHAR || '.0' END AS version FROM pages""")
def schema_buckets(s, d):
    i = F.col("page_id")
    named = F.when(i % 4 == 0, F.concat(F.lit("x_kaiser_"), i.cast("string"))).when(i % 4 == 1, F.when(i % 3 == 0, F.concat(F.lit("2."), (i % 7).cast("string"))).otherwise("3.0.1")).when(i % 4 == 2, "misc_wide").otherwise("v9")
    head = F.when(i % 2 == 0, "{}").otherwise(F.concat(F.lit('{ "VERSION" : "'), (i % 3).cast("string"), F.lit('.0", "x": 1')))
    return V.t(s, d, "pages").select("page_id", text.schema_bucket(named).alias("bucket"), text.schema_version_of(head).alias("version"))


@query("""SELECT c_custkey, right('00000' || c_custkey::VARCHAR, 6) AS ccn, right(lpad((c_custkey * 7919)::VARCHAR, 9, '0'), 6) AS tail, nullif(regexp_extract('CA ' || (c_custkey * 31)::VARCHAR || '-0001', '([0-9]{5})', 1), '') AS zip FROM customer""")
def key_padding(s, d):
    k = F.col("c_custkey")
    return V.t(s, d, "customer").select("c_custkey", text.ccn6(F.concat(F.lit("00000000"), k.cast("string"))).alias("ccn"), text.tail6(F.lpad((k * 7919).cast("string"), 9, "0")).alias("tail"), text.zip5(F.concat(F.lit("CA "), (k * 31).cast("string"), F.lit("-0001"))).alias("zip"))


_FORMATS = ["json", "csv_tall", "csv_wide", "csv_minimal", "xlsx", "html", "empty", "kaiser_legacy"]


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'resume_skip' WHEN f IN ('html', 'empty', 'kaiser_legacy') THEN 'skip:' || f WHEN o_orderkey % 5 = 0 THEN if(f = 'xlsx', 'xlsx_failed', 'parse_failed') ELSE 'ok' END AS status FROM (SELECT *, {_FORMATS!r}[o_orderkey % 8 + 1] AS f FROM orders)")
def ledger_parse_status(s, d):
    o = V.t(s, d, "orders").withColumn("f", F.get(F.array(*map(F.lit, _FORMATS)), (F.col("o_orderkey") % 8).cast("int")))
    return o.select("o_orderkey", ledgers.parse_status(F.col("f"), F.col("o_custkey") % 7 == 0, F.col("o_orderkey") % 5 == 0).alias("status"))


@query("""WITH x AS (SELECT c_custkey AS ccn, 'exempt:' || lower(c_mktsegment) AS method FROM customer WHERE c_custkey % 5 = 0), u AS (SELECT c_custkey AS ccn FROM customer WHERE c_custkey % 2 = 0), good AS (SELECT * FROM x WHERE ccn IN (FROM u))
SELECT * FROM good UNION ALL SELECT c_custkey, 'url' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT ccn FROM good)""")
def ledger_exemptions(s, d):
    c = V.t(s, d, "customer").withColumn("ccn", F.col("c_custkey"))
    exemptions = c.where("ccn % 5 = 0").select("ccn", F.concat(F.lit("exempt:"), F.lower("c_mktsegment")).alias("method"))
    return ledgers.exempt(c.where("ccn % 3 = 0").select("ccn", F.lit("url").alias("method")), exemptions, c.where("ccn % 2 = 0").select("ccn"))


@query("""WITH d AS (SELECT page_id AS ccn, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'already_present' ELSE 'http_404' END AS status FROM pages), land AS (SELECT page_id AS ccn FROM pages WHERE page_id % 4 < 2)
SELECT d.ccn, CASE WHEN land.ccn IS NOT NULL AND status <> 'http_404' THEN 'html_landing' ELSE status END AS status, CASE WHEN land.ccn IS NOT NULL AND status <> 'http_404' THEN 'exempt:portal_landing' ELSE 'crawl' END AS discovery_method FROM d LEFT JOIN land USING (ccn)""")
def ledger_landing_pages(s, d):
    p = V.t(s, d, "pages").withColumn("ccn", F.col("page_id"))
    i = F.col("ccn")
    downloads = p.select("ccn", F.when(i % 3 == 0, "ok").when(i % 3 == 1, "already_present").otherwise("http_404").alias("status"))
    heads = p.select("ccn", F.when(i % 4 == 0, "  <!DOCTYPE html><p>").when(i % 4 == 1, "<HTML lang=x>").when(i % 4 == 2, "code,price").otherwise(F.concat(F.repeat(F.lit(" "), F.lit(70)), F.lit("<html>"))).alias("head"))
    flipped, moved = ledgers.reclassify_landing(downloads, p.select("ccn", F.lit("crawl").alias("discovery_method")), heads)
    return flipped.join(moved, "ccn")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'exempt:federal_va' WHEN s_nationkey % 3 = 1 THEN 'exempt:federal_dod' END AS method, s_suppkey * 100 >= 5000 AND s_suppkey % 2 = 0 AS is_price_file FROM supplier")
def ledger_federal_and_portal(s, d):
    k = F.col("s_nationkey")
    owner = F.when(k % 3 == 0, "Veterans Health Administration").when(k % 3 == 1, "Department of Defense").otherwise("Voluntary non-profit")
    head = F.when(F.col("s_suppkey") % 2 == 0, "code,price").otherwise("<html>")
    return V.t(s, d, "supplier").select("s_suppkey", ledgers.federal_method(owner).alias("method"), ledgers.portal_file(F.col("s_suppkey") * 100, head).alias("is_price_file"))


@query("""SELECT c_nationkey AS k, CASE WHEN NOT (max(s) = 0 AND count(*) > 5) THEN max(c_name) FILTER (s = m) END AS best FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 3 ELSE 0 END AS s, max(CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 3 ELSE 0 END) OVER (PARTITION BY c_nationkey) AS m FROM customer) GROUP BY 1""")
def best_with_abstention(s, d):
    rows = V.t(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_name", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey") % 3).otherwise(0).alias("score"))
    return rel.best_with_abstention(rows, "k", "score", "c_name")


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT *, least(n, greatest(10, round_even(n * 200 / (SELECT sum(n) FROM c), 0)::BIGINT)) AS take FROM c)
SELECT o_orderpriority, least(n, greatest(take + CASE WHEN o_orderpriority = (SELECT o_orderpriority FROM c ORDER BY n DESC, o_orderpriority DESC LIMIT 1) THEN 200 - (SELECT sum(take) FROM a) ELSE 0 END, 0))::BIGINT AS n, TRUE AS own FROM a""")
def stratified_sample_sizes(s, d):
    orders = V.t(s, d, "orders")
    taken = rel.stratified_sample(orders, "o_orderpriority", "o_orderkey", 200, 10)
    kept = taken.join(orders.select("o_orderkey", F.col("o_orderpriority").alias("p")), "o_orderkey")
    return kept.groupBy("o_orderpriority").agg(F.countDistinct("o_orderkey").alias("n"), F.every(F.col("p") == F.col("o_orderpriority")).alias("own"))
