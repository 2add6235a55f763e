"""Queries about facilities: links, areas and tallies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chargelens.functions import stats, text
from chargelens.operators import areas, matching
from chargelens.operators import relational as rel
from chargelens.plans import views as V
from chargelens.plans.registry import query

_HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_NAMED = "The General Hospital of Ththre, Example M.", "Example"


@query(f"""WITH f AS (SELECT page_id % 15 AS k, page_id AS position, url, {_HOST_SQL} AS host FROM pages), h AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, host ORDER BY position) AS r FROM f WHERE host <> '' AND NOT contains(host, 'zillow') AND NOT contains(host, 'google')) WHERE r = 1
), p AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(regexp_replace(host, '^www\\.', ''), '[.\\-]'), lambda x: len(x) > 2)) AS parts FROM h
), scored AS (SELECT *, 3 * len(list_intersect(parts, ['ththre', 'example'])) + CASE WHEN contains(replace(replace(host, '.', ''), '-', ''), 'example') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(host, '\\.(org|health|hospital)$') THEN 2 WHEN regexp_matches(host, '\\.(edu|gov)$') THEN 1 ELSE 0 END AS score FROM p)
SELECT k, CASE WHEN starts_with(url, 'https') THEN 'https' ELSE 'http' END || '://' || host AS site, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, position) AS place FROM scored WHERE score >= 1) WHERE place = 1""")
def best_web_host(s, d):
    found = V.t(s, d, "pages").select((F.col("page_id") % 15).alias("k"), F.col("page_id").alias("position"), "url", text.url_host(F.col("url")).alias("host"))
    return matching.best_site(found.withColumns({"tokens": text.address_tokens(F.lit(_NAMED[0])), "city": F.lit(_NAMED[1])}), "k", text.NEVER_A_HOSPITAL)


_ZIP = "lpad((c_custkey * 37 % 100003)::VARCHAR, 5, '0')"


def _zips(s, d):
    return V.t(s, d, "customer").withColumn("zip", F.lpad((F.col("c_custkey") * 37 % 100003).cast("string"), 5, "0"))


@query(f"""SELECT c_custkey, {_ZIP} AS zip, {_ZIP} BETWEEN '90001' AND '96162' AS in_range, regexp_full_match({_ZIP}, '9[0-5][0-9]{{3}}|96[01][0-9]{{2}}') AS in_state, lpad({_ZIP}, 5, '0') AS padded FROM customer""")
def zip_filters(s, d):
    z = F.col("zip")
    return _zips(s, d).select("c_custkey", "zip", areas.in_range(z).alias("in_range"), areas.in_state(z).alias("in_state"), text.pad_zip(z).alias("padded"))


_AREA_SQL = """WITH charges AS (SELECT c_nationkey AS zip, o_totalprice AS charge, o_orderpriority AS code, o_custkey AS hospital, CASE WHEN o_orderkey % 3 = 0 THEN 'emergency' ELSE 'delivery' END AS grp FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 0),
a AS (SELECT zip, avg(charge) AS avg_price_all, median(charge) AS median_price_all, count(DISTINCT code) AS n_codes, count(DISTINCT hospital) AS n_hospitals FROM charges GROUP BY 1),
e AS (SELECT zip, avg(charge) AS avg_price_emerg FROM charges WHERE grp = 'emergency' GROUP BY 1), l AS (SELECT zip, avg(charge) AS avg_price_deliv FROM charges WHERE grp = 'delivery' GROUP BY 1),
c AS (SELECT s_nationkey AS zip, CASE WHEN s_nationkey % 6 <> 0 THEN avg(s_acctbal) END AS median_income, count(*) * 60 AS total_pop FROM supplier GROUP BY 1),
m AS (SELECT n_nationkey AS zip, n_regionkey + 5 AS deaths FROM nation WHERE n_nationkey % 2 = 0)
SELECT zip, round(avg_price_all, 4) AS avg_price_all, round(median_price_all, 4) AS median_price_all, n_codes, n_hospitals, round(avg_price_emerg, 4) AS avg_price_emerg, round(avg_price_deliv, 4) AS avg_price_deliv, round(median_income, 4) AS median_income, total_pop, deaths
FROM a LEFT JOIN e USING (zip) LEFT JOIN l USING (zip) LEFT JOIN c USING (zip) LEFT JOIN m USING (zip) WHERE median_income IS NOT NULL AND n_codes >= 3 AND avg_price_all >= 200 AND total_pop >= 100"""


@query(_AREA_SQL)
def area_price_panel(s, d):
    o, c = V.t(s, d, "orders"), V.t(s, d, "customer")
    group = F.when(F.col("o_orderkey") % 3 == 0, "emergency").otherwise("delivery")
    charges = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("zip"), F.col("o_totalprice").alias("charge"), F.col("o_orderpriority").alias("code"), F.col("o_custkey").alias("hospital"), group.alias("group"))
    people = V.t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("zip")).agg(F.avg("s_acctbal").alias("i"), (F.count("*") * 60).alias("total_pop")).select("zip", F.when(F.col("zip") % 6 != 0, F.col("i")).alias("median_income"), "total_pop")
    deaths = V.t(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("zip"), (F.col("n_regionkey") + 5).alias("deaths"))
    out = areas.quality_gates(areas.price_panel(charges, people, deaths))
    return out.withColumns({x: F.round(x, 4) for x in ("avg_price_all", "median_price_all", "avg_price_emerg", "avg_price_deliv", "median_income")})


@query("""WITH r AS (SELECT '  ' || (2020 + event_id % 6)::VARCHAR || ' ' AS year, CASE WHEN event_id % 3 = 2 THEN 'Age' ELSE 'Total Population' END AS strata, CASE WHEN event_id % 5 < 4 THEN 'ALL' ELSE 'HTD' END AS cause, CASE WHEN event_id % 7 < 6 THEN 'Residence' ELSE 'Occurrence' END AS geography_type,
  CASE WHEN user_id % 11 = 0 THEN 'unknown' ELSE lpad((user_id % 97)::VARCHAR, 5, '9') || '-0001' END AS zip_code, CASE WHEN event_id % 13 = 0 THEN '<11' ELSE (event_id % 50)::VARCHAR END AS count FROM events)
SELECT regexp_extract(zip_code, '(\\d{5})', 1) AS zip, sum(TRY_CAST("count" AS DOUBLE)) AS deaths FROM r WHERE trim(year) = '2024' AND strata = 'Total Population' AND cause = 'ALL' AND geography_type = 'Residence' AND regexp_matches(zip_code, '\\d{5}') AND TRY_CAST("count" AS DOUBLE) IS NOT NULL GROUP BY 1""")
def deaths_by_area(s, d):
    i, u = F.col("event_id"), F.col("user_id")
    zip_code = F.when(u % 11 == 0, "unknown").otherwise(F.concat(F.lpad((u % 97).cast("string"), 5, "9"), F.lit("-0001")))
    rows = V.t(s, d, "events").select(
        F.concat(F.lit("  "), (2020 + i % 6).cast("string"), F.lit(" ")).alias("year"), F.when(i % 3 == 2, "Age").otherwise("Total Population").alias("strata"), F.when(i % 5 < 4, "ALL").otherwise("HTD").alias("cause"),
        F.when(i % 7 < 6, "Residence").otherwise("Occurrence").alias("geography_type"), zip_code.alias("zip_code"), F.when(i % 13 == 0, "<11").otherwise((i % 50).cast("string")).alias("count"),
    )
    return areas.deaths(rows, 2024)


@query("""WITH p AS (SELECT upper(trim(p_brand)) AS code, CASE WHEN p_size % 3 <> 0 THEN p_size * 0.25::DOUBLE END AS total, CASE WHEN p_size % 2 = 0 THEN p_size * 0.125::DOUBLE END AS work, p_size * 0.0625::DOUBLE AS pe, CASE WHEN p_size % 5 = 0 THEN 1.5::DOUBLE END AS mp FROM part)
SELECT code, max(round_even(coalesce(total, coalesce(work, 0) + coalesce(pe, 0) + coalesce(mp, 0)) * 33.2875::DOUBLE, 2)) AS mpfs_national FROM p GROUP BY 1""")
def fee_schedule_fallback(s, d):
    z = F.col("p_size")
    rows = V.t(s, d, "part").select(text.upper_trim(F.col("p_brand")).alias("code"), F.when(z % 3 != 0, z * 0.25).alias("nf_total"), F.when(z % 2 == 0, z * 0.125).alias("work"), (z * 0.0625).alias("nf_pe"), F.when(z % 5 == 0, 1.5).alias("mp"))
    return rel.fee_schedule(rows, r"^[0-9A-Z#]+$")


@query("SELECT doc_id, quality = 0 OR toxic = 0 AS any_no FROM labels")
def audit_any_no(s, d):
    rows = V.t(s, d, "labels").select("doc_id", *[F.when(F.col(c) == 1, "y").when(F.col(c) == 0, "n").alias(c) for c in ("quality", "toxic")])
    return rows.select("doc_id", rel.any_is(["quality", "toxic"], "N").alias("any_no"))


@query("""SELECT year, o_orderkey, row_number() OVER (PARTITION BY year ORDER BY f NULLS LAST, o_orderpriority NULLS LAST, s NULLS LAST, o_orderkey) AS position
FROM (SELECT *, year(o_orderdate) AS year, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS f, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS s FROM orders)""")
def year_table_order(s, d):
    rows = V.t(s, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("f"), "o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("s"))
    order = [F.asc_nulls_last(c) for c in ("f", "o_orderpriority", "s")]
    return rows.select("year", "o_orderkey", F.row_number().over(Window.partitionBy("year").orderBy(*order, "o_orderkey")).alias("position"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def ten_most_frequent(s, d):
    return V.t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("SELECT s_suppkey, s_name AS name, n_name AS name_xw, s_acctbal FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0")
def left_join_with_suffix(s, d):
    left = V.t(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("key"), "s_acctbal")
    right = V.t(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return rel.left_join(left, right, ["key"], "_xw").drop("key")


@query("SELECT p_partkey, 'p_brand<' || CASE WHEN p_size % 2 = 0 THEN 'CPT' ELSE 'DRG' END || '>' || CASE WHEN p_size % 3 = 0 THEN '|p_type<AMBIG>' ELSE '' END AS code_cols, CASE WHEN p_partkey % 4 = 0 THEN 'emergency' ELSE 'delivery' END AS cpt_group FROM part")
def column_roles_and_groups(s, d):
    one = F.struct(F.lit("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "CPT").otherwise("DRG").alias("role"))
    two = F.struct(F.lit("p_type").alias("name"), F.lit("AMBIG").alias("role"))
    listed = F.when(F.col("p_size") % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    return V.t(s, d, "part").select("p_partkey", text.role_list(listed).alias("code_cols"), F.when(F.col("p_partkey") % 4 == 0, "emergency").otherwise("delivery").alias("cpt_group"))


@query(r"""WITH c AS (SELECT *, c_custkey % 97 AS k, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE '' END AS g FROM customer),
gm AS (SELECT g, count(*) AS ng, avg(k) AS kg, avg(c_acctbal) AS yg FROM c GROUP BY 1), s AS (SELECT sum((k - kg) * (k - kg)) AS sxx, sum((k - kg) * (c_acctbal - yg)) AS sxy FROM c JOIN gm USING (g)),
b AS (SELECT sxy / sxx AS b, sxx FROM s), o AS (SELECT ng AS no_, kg AS ko, yg AS yo FROM gm WHERE g = ''),
e AS (SELECT c.*, ng, kg, (c_acctbal - yg - b * (k - kg)) AS res, (c_acctbal - yg - b * (k - kg)) / (1 - 1.0 / ng - (k - kg) * (k - kg) / sxx) AS u, b, sxx, no_, ko, yo FROM c JOIN gm USING (g), b, o),
r AS (SELECT 1 - (SELECT sum(res * res) FROM e) / (SELECT var_pop(c_acctbal) * count(*) FROM customer) AS r2, (SELECT count(*) FROM customer) AS n),
se AS (SELECT 'const' AS term, any_value(yo - b * ko) AS beta, sqrt(sum(pow(((g = '')::INT / no_ - ko * (k - kg) / sxx) * u, 2))) AS se FROM e UNION ALL SELECT 'k', any_value(b), sqrt(sum(pow((k - kg) / sxx * u, 2))) FROM e
  UNION ALL SELECT 'is_' || lower(gm.g), any_value(gm.yg - e.b * gm.kg - (yo - e.b * ko)), sqrt(sum(pow(((e.g = gm.g)::INT / gm.ng - (e.g = '')::INT / no_ - (gm.kg - ko) * (k - e.kg) / sxx) * u, 2))) FROM e, gm WHERE gm.g <> '' GROUP BY gm.g)
SELECT term, round(beta, 4) AS beta, round(se, 4) AS se, round(beta / se, 4) AS z, n, round(r2, 6) AS r2 FROM se, r""")
def ols_hc3_fixed_effect(s, d):
    c = V.t(s, d, "customer")
    rows = c.select("c_acctbal", (F.col("c_custkey") % 97).alias("k"), *[(F.col("c_mktsegment") == m).cast("int").alias(f"is_{m.lower()}") for m in ("BUILDING", "MACHINERY")])
    found = stats.ols_hc3(rows, "c_acctbal", ["k", "is_building", "is_machinery"])
    return found.select("term", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"), F.round("z", 4).alias("z"), "n", F.round("r2", 6).alias("r2"))


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


@query("WITH x AS (SELECT " + ", ".join(f"CASE WHEN l_orderkey % {i + 5} > 0 THEN {c}::DOUBLE END AS {c}" for i, c in enumerate(_PROFILED)) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM x" for c in _PROFILED))
def column_profiles(s, d):
    rows = V.t(s, d, "lineitem").select(*[F.when(F.col("l_orderkey") % (i + 5) > 0, F.col(c)).alias(c) for i, c in enumerate(_PROFILED)])
    return rel.describe(rows, _PROFILED).withColumns({c: F.round(c, 6) for c in ("mean", "std")})
