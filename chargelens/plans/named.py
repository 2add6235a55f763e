"""Queries about names and links made from the keys of given tables, with SQL that compares names by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chargelens.functions import text
from chargelens.operators import areas, ledgers, matching
from chargelens.plans import views as V
from chargelens.plans.registry import query

_FIRST = ["Mercy", "Clark", "St. Mary's", "Lakeview", "Good Samaritan", "Riverside", "Valley", "Sutter", "Harbor", "Baptist", "Tide", "Kaiser Foundation"]
_SECOND = ["Memorial", "Regional", "County", "of Anderson", "Childrens", "Methodist", "Fresno", "Lodi", "Community", "Davis", "Orange"]
_LAST = ["Hospital", "Medical Center", "Health", "Clinic, Inc."]
_TYPES = ["Acute Care Hospitals", "Critical Access Hospitals", "Childrens", "Psychiatric", "Rehabilitation"]
_TAXONOMIES = ["General Acute Care Hospital", "Critical Access Hospital", "Children's Hospital", "Psychiatric Unit", "Clinic/Center"]


def _pick(words: list[str], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))


def _pick_sql(words: list[str], k: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][{k} % {len(words)} + 1]"


def _name(k: Column) -> Column:
    whole = F.concat_ws(" ", _pick(_FIRST, k), _pick(_SECOND, F.floor(k / 5)), _pick(_LAST, F.floor(k / 3)))
    return F.when(k % 7 == 0, F.replace(whole, F.lit("e"), F.lit(""))).when(k % 11 == 0, F.replace(whole, F.lit(" "), F.lit(""))).when(k % 13 == 0, F.reverse(whole)).otherwise(whole)


def _name_sql(k: str) -> str:
    whole = f"{_pick_sql(_FIRST, k)} || ' ' || {_pick_sql(_SECOND, f'({k} // 5)')} || ' ' || {_pick_sql(_LAST, f'({k} // 3)')}"
    return f"CASE WHEN {k} % 7 = 0 THEN replace({whole}, 'e', '') WHEN {k} % 11 = 0 THEN replace({whole}, ' ', '') WHEN {k} % 13 = 0 THEN reverse({whole}) ELSE {whole} END"


def _list_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


def _normal_sql(name: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(upper({name}), '[^A-Z0-9 ]+', ' ', 'g'), ' +'), lambda t: t <> '' AND NOT list_contains({_list_sql(text.NAME_STOPWORDS)}, t)), ' ')"


def _registry_sql(name: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array(upper({name}), '\\s+'), lambda t: regexp_replace(t, '^[,.()]+|[,.()]+$', '', 'g')), lambda t: t <> '' AND NOT list_contains({_list_sql(text.REGISTRY_STOPWORDS)}, t)), ' ')"


#: The longest substring that two texts share, as its length and place in the first: the earliest there.
_HIT = "list_filter(flatten(list_transform(range(least(len(a), len(b)), 0, -1), lambda l: list_transform(range(1, len(a) - l + 2), lambda i: {'l': l, 'i': i}))), lambda p: contains(b, a[p.i:p.i + p.l - 1]))[1]"


def ratios_sql(pairs: str) -> str:
    """CTEs ``seg`` and ``ratio`` (x, y, score): the Ratcliff-Obershelp ratio of each two texts of ``pairs`` (x, y), matched left and right of what they share."""
    return f"""seg AS (
  SELECT x, y, a, b, {_HIT} AS hit FROM (SELECT DISTINCT x, y, x AS a, y AS b FROM {pairs})
  UNION ALL SELECT x, y, a, b, {_HIT} AS hit FROM (SELECT x, y, unnest([{{'a': a[:hit.i - 1], 'b': b[:spot - 1]}}, {{'a': a[hit.i + hit.l:], 'b': b[spot + hit.l:]}}], recursive := true) FROM (SELECT *, position(a[hit.i:hit.i + hit.l - 1] IN b) AS spot FROM seg WHERE hit IS NOT NULL)) WHERE a <> '' AND b <> ''
), ratio AS (SELECT x, y, CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE 2 * coalesce(sum(hit.l), 0)::DOUBLE / (len(x) + len(y)) END AS score FROM seg GROUP BY x, y)"""


def _hospitals(s, d):
    k = F.col("s_suppkey")
    return V.t(s, d, "supplier").select(k.alias("ccn"), _name(k).alias("name"), F.lpad((k % 17 + 46000).cast("string"), 5, "0").alias("zip"), F.when(k % 3 == 0, "CA").otherwise("IN").alias("state"), _pick(_TYPES, k).alias("hospital_type"))


_HOSPITALS_SQL = f"hospitals AS (SELECT s_suppkey AS ccn, {_name_sql('s_suppkey')} AS name, (s_suppkey % 17 + 46000)::VARCHAR AS zip, if(s_suppkey % 3 = 0, 'CA', 'IN') AS state, {_pick_sql(_TYPES, 's_suppkey')} AS hospital_type FROM supplier)"


def _facilities(s, d):
    k = F.col("c_custkey")
    return V.t(s, d, "customer").select(k.alias("facility_id"), _name(k * 37 + 5).alias("facility_name"), (k % 19 + 46000).cast("string").alias("zip"))


_MATCHED_SQL = f"""{_HOSPITALS_SQL}, facilities AS (SELECT c_custkey AS facility_id, {_name_sql('(c_custkey * 37 + 5)')} AS facility_name, (c_custkey % 19 + 46000)::VARCHAR AS zip FROM customer),
pairs AS (SELECT ccn, facility_id, {_normal_sql('facility_name')} AS x, {_normal_sql('name')} AS y, h.zip = f.zip AS here FROM hospitals h, facilities f), {ratios_sql('pairs')},
best AS (SELECT ccn, min(facility_id) FILTER (here AND score = top_here) AS near, any_value(top_here) AS top_here, min(facility_id) FILTER (score = top) AS far, any_value(top) AS top
  FROM (SELECT *, max(score) FILTER (here) OVER (PARTITION BY ccn) AS top_here, max(score) OVER (PARTITION BY ccn) AS top FROM pairs JOIN ratio USING (x, y)) GROUP BY ccn),
matched AS (SELECT ccn, CASE WHEN top_here >= 0.65 THEN near WHEN top >= 0.85 THEN far END AS facility_id, round(CASE WHEN top_here >= 0.65 THEN top_here ELSE top END, 6) AS score,
  CASE WHEN top_here >= 0.9 THEN 'exact_zip+name' WHEN top_here >= 0.65 THEN 'zip_only_fuzzy' WHEN top >= 0.85 THEN 'name_only_fuzzy' ELSE 'unmatched' END AS method FROM best)"""


@query(f"WITH RECURSIVE {_MATCHED_SQL} SELECT ccn, facility_id, score, method FROM matched")
def name_similarity_best_match(s, d):
    found = matching.fuzzy_match(_hospitals(s, d), _facilities(s, d), "ccn", "name", "zip", "facility_id", "facility_name")
    return found.withColumn("score", F.round("score", 6))


def _registered(s, d):
    k = F.col("c_custkey")
    zip5 = (k % 23 + 46000).cast("string")
    return V.t(s, d, "customer").select(
        (k + 1000000000).cast("string").alias("npi"), F.concat(_name(k * 53 + 1), F.when(k % 10 == 3, " Holdings LLC").otherwise("")).alias("name"), F.when(k % 3 == 1, "CA").otherwise("IN").alias("state"),
        zip5.alias("zip5"), _pick(_TAXONOMIES, k).alias("taxonomy"), F.array(zip5, ((k + 4) % 23 + 46000).cast("string")).alias("zips"),
    )


def _terms_sql() -> str:
    return "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{x}')" for t, names in matching.TYPE_TAXONOMIES.items() for i, x in enumerate(names)) + ") t(hospital_type, place, term))"


_REGISTRY_SQL = f"""{_HOSPITALS_SQL}, registry AS (SELECT (c_custkey + 1000000000)::VARCHAR AS npi, {_name_sql('(c_custkey * 53 + 1)')} || CASE WHEN c_custkey % 10 = 3 THEN ' Holdings LLC' ELSE '' END AS named, if(c_custkey % 3 = 1, 'CA', 'IN') AS state, (c_custkey % 23 + 46000)::VARCHAR AS zip5,
  [(c_custkey % 23 + 46000)::VARCHAR, ((c_custkey + 4) % 23 + 46000)::VARCHAR] AS zips, {_pick_sql(_TAXONOMIES, 'c_custkey')} AS taxonomy FROM customer), {_terms_sql()},
pairs AS (SELECT ccn, npi, hospital_type, taxonomy, named, zip5, list_contains(zips, zip) AND zip5[1:3] = zip[1:3] AS here, {_registry_sql('name')} AS x, {_registry_sql('named')} AS y FROM hospitals JOIN registry USING (state) WHERE NOT contains(upper(named), 'HOLDINGS')),
{ratios_sql('pairs')}, scored AS (SELECT * FROM pairs JOIN ratio USING (x, y)),
typed AS (SELECT *, count(*) OVER (PARTITION BY ccn, place) AS n FROM scored JOIN terms USING (hospital_type) WHERE here AND contains(lower(taxonomy), lower(term))),
found AS (
  SELECT ccn, npi, place AS pass, if(n = 1, 1.0, score) AS score, if(n = 1, 'taxonomy:', 'taxonomy+name:') || term AS match_method, named, zip5 FROM typed WHERE n = 1 OR score >= 0.55
  UNION ALL SELECT ccn, npi, 1000, score, 'zip+name', named, zip5 FROM scored WHERE here AND score >= 0.55 UNION ALL SELECT ccn, npi, 2000, score, 'state+name', named, zip5 FROM scored WHERE score >= 0.85)"""


@query(f"WITH RECURSIVE {_REGISTRY_SQL} SELECT ccn, npi, match_method, round(score, 6) AS score, named AS registry_name, zip5 AS registry_zip FROM found QUALIFY row_number() OVER (PARTITION BY ccn ORDER BY pass, score DESC, npi) = 1")
def registry_match_in_passes(s, d):
    return matching.registry_match(_hospitals(s, d), _registered(s, d)).withColumn("score", F.round("score", 6))


def _ein(k: Column) -> Column:
    return F.concat(F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.when(k % 2 == 0, "-").otherwise(""), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"))


def _ein_sql(k: str) -> str:
    return f"lpad(({k} % 90 + 10)::VARCHAR, 2, '0') || '-' || lpad(({k} * 7919 % 10000000)::VARCHAR, 7, '0')"


_CROSSWALK_COLUMNS = "ccn, facility_id, match_score, match_method, employer_id, employer_id_source, provider_id, provider_id_source"
_CROSSWALK_SQL = f"""{_MATCHED_SQL}, x AS (SELECT ccn, CASE WHEN ccn % 29 = 3 THEN ccn + 900000 WHEN ccn % 23 = 5 OR ccn % 31 = 7 THEN NULL ELSE facility_id END AS facility_id,
  CASE WHEN ccn % 29 = 3 OR ccn % 23 = 5 OR ccn % 31 = 7 THEN NULL ELSE score END AS match_score, CASE WHEN ccn % 29 = 3 THEN 'manual_override' WHEN ccn % 23 = 5 THEN 'n/a (federal)' WHEN ccn % 31 = 7 THEN 'n/a (no counterpart)' ELSE method END AS match_method,
  CASE WHEN ccn % 2 = 0 OR ccn % 3 = 0 THEN {_ein_sql('(ccn + CASE WHEN ccn % 2 = 0 THEN 0 ELSE 1 END)')} END AS employer_id, CASE WHEN ccn % 2 = 0 THEN 'url_filename' WHEN ccn % 3 = 0 THEN 'local_filename' END AS employer_id_source,
  CASE WHEN ccn % 4 = 1 THEN (ccn + 1000000000)::VARCHAR WHEN ccn % 5 < 2 THEN (ccn + 5000000000)::VARCHAR END AS provider_id, CASE WHEN ccn % 4 = 1 THEN 'mrf_metadata' WHEN ccn % 5 = 0 THEN 'nppes:zip+name' WHEN ccn % 5 = 1 THEN 'nppes:?' END AS provider_id_source FROM matched)"""


def _crosswalk(s, d):
    own, k = _hospitals(s, d), F.col("ccn")
    file = lambda key, end: F.concat(F.lit("https://h.org/files/"), _ein(key), F.lit(end))
    urls = own.where("ccn % 2 = 0").select("ccn", text.employer_id(file(k, "_standardcharges.csv")).alias("ein"))
    local = own.where("ccn % 3 = 0").select("ccn", text.employer_id(file(k + F.when(k % 2 == 0, 0).otherwise(1), "-x.zip")).alias("ein"))
    stated = own.where("ccn % 4 = 1").select("ccn", (k + 1000000000).cast("string").alias("npi"))
    looked_up = own.where("ccn % 5 < 2").select("ccn", (k + 5000000000).cast("string").alias("npi"), F.when(k % 5 == 0, "zip+name").alias("how"))
    employer = [(urls, "ein", F.lit("url_filename")), (local, "ein", F.lit("local_filename"))]
    provider = [(stated, "npi", F.lit("mrf_metadata")), (looked_up, "npi", F.concat(F.lit("nppes:"), F.coalesce("how", F.lit("?"))))]
    given = own.where("ccn % 29 = 3").select("ccn", (k + 900000).alias("facility_id"))
    out = matching.crosswalk(own, _facilities(s, d), given, k % 23 == 5, k % 31 == 7, employer, provider)
    return out.select("ccn", "facility_id", F.round("match_score", 6).alias("match_score"), *_CROSSWALK_COLUMNS.split(", ")[3:])


@query(f"WITH RECURSIVE {_CROSSWALK_SQL} SELECT {_CROSSWALK_COLUMNS} FROM x")
def crosswalk_assembly(s, d):
    return _crosswalk(s, d)


@query(f"""WITH RECURSIVE {_CROSSWALK_SQL}, good AS (SELECT s_suppkey AS ccn FROM supplier WHERE s_nationkey % 2 = 0)
SELECT 'rows' AS name, 'universe' AS "over", count(*) AS n FROM x UNION ALL SELECT 'rows', 'good', count(*) FROM x WHERE ccn IN (FROM good)
UNION ALL SELECT 'employer_id', 'universe', count(employer_id) FROM x UNION ALL SELECT 'employer_id', 'good', count(employer_id) FROM x WHERE ccn IN (FROM good)
UNION ALL SELECT 'provider_id', 'universe', count(provider_id) FROM x UNION ALL SELECT 'provider_id', 'good', count(provider_id) FROM x WHERE ccn IN (FROM good)
UNION ALL SELECT 'method: ' || match_method, 'universe', count(*) FROM x GROUP BY match_method""")
def crosswalk_coverage(s, d):
    good = V.t(s, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("ccn"))
    return matching.coverage_tallies(_crosswalk(s, d), good.unionByName(good), "ccn", ["employer_id", "provider_id"])


_FILE_OF_SQL = "CASE page_id % 6 WHEN 0 THEN '/files/' || (page_id % 90 + 10) || '-' || lpad(page_id::VARCHAR, 7, '0') || '_ththre-example_standardcharges.csv' WHEN 1 THEN '/StandardCharges_2024.JSON' WHEN 2 THEN '/machine-readable_file.zip' WHEN 3 THEN '/prices-' || page_id || '.csv' WHEN 4 THEN '/de_-de-/ththre.csv' ELSE '' END"


@query(f"""WITH u AS (SELECT page_id, lower(split_part(url, '?', 1) || {_FILE_OF_SQL}) AS low FROM pages), f AS (SELECT *, regexp_extract(low, '([^/]*)$', 1) AS file FROM u)
SELECT page_id, 3 * len(list_filter(['ththre', 'example'], lambda t: contains(file, t))) + CASE WHEN contains(file, 'example') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(low, '[-_]de[-_.]') THEN 1 ELSE 0 END + CASE WHEN contains(file, 'standardcharges') THEN 1 ELSE 0 END AS score,
  CASE page_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS is_file FROM f""")
def price_url_scores(s, d):
    i, u = F.col("page_id"), F.col("url")
    file = F.when(i % 6 == 0, F.concat(F.lit("/files/"), (i % 90 + 10).cast("string"), F.lit("-"), F.lpad(i.cast("string"), 7, "0"), F.lit("_ththre-example_standardcharges.csv"))).when(i % 6 == 1, "/StandardCharges_2024.JSON").when(i % 6 == 2, "/machine-readable_file.zip")
    file = file.when(i % 6 == 3, F.concat(F.lit("/prices-"), i.cast("string"), F.lit(".csv"))).when(i % 6 == 4, "/de_-de-/ththre.csv").otherwise("")
    pages = V.t(s, d, "pages").select("page_id", F.concat(F.substring_index("url", "?", 1), file).alias("url"))
    tokens = text.address_tokens(F.lit("The General Hospital of Ththre, Example M."))
    return pages.select("page_id", matching.price_url_score(u, tokens, F.lit("Example"), F.lit("DE")).alias("score"), u.rlike(text.PRICE_FILE_URL).alias("is_file"))


_SYSTEMS = ["GLOBAL MEDICAL CENTER OF ORANGE", "ADVENTIST HEALTH LODI", "COUNTY HOSPITAL", "KECK HOSPITAL OF USC", "PRIME USC", "CHINO VALLEY WEST"]


@query(rf"""WITH x AS (SELECT CASE WHEN c_custkey % 17 <> 0 THEN {_pick_sql(_SYSTEMS, 'c_custkey')} || ' ' || c_custkey END AS name, if(c_nationkey % 2 = 0, 'CA', 'IN') AS state, CASE WHEN c_custkey % 4 = 1 THEN '12-' || (c_custkey % 400) END AS ein, if(c_custkey % 3 = 0, 'misc_csv', 'v2.x') AS bucket FROM customer)
SELECT 'system' AS kind, nullif(regexp_extract(name, '(GLOBAL MEDICAL CENTER|ADVENTIST HEALTH|COMMUNITY MEDICAL CENTER|COMMUNITY REGIONAL|KAWEAH|MONTEREY PENINSULA|PRIME|USC|CHINO VALLEY|HALSEN)', 1), '') AS value, count(*) AS n, NULL AS names FROM x GROUP BY 2
UNION ALL SELECT 'bucket x state', bucket || ' x ' || state, count(*), NULL FROM x GROUP BY 2
UNION ALL SELECT 'employer', ein, count(name), string_agg(name, ' | ' ORDER BY name) FROM x WHERE ein IS NOT NULL GROUP BY 2 HAVING count(name) > 1""")
def system_clustering(s, d):
    k = F.col("c_custkey")
    name = F.when(k % 17 != 0, F.concat(_pick(_SYSTEMS, k), F.lit(" "), k.cast("string")))
    ein = F.when(k % 4 == 1, F.concat(F.lit("12-"), (k % 400).cast("string")))
    own = V.t(s, d, "customer").select(name.alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "CA").otherwise("IN").alias("state"), ein.alias("ein"), F.when(k % 3 == 0, "misc_csv").otherwise("v2.x").alias("bucket"))
    return areas.system_clusters(own)


_KINDS = ["text/csv; charset=utf-8", "text/html", "application/vnd.ms-excel", "", "image/png", "application/json"]


@query(rf"""WITH l AS (SELECT page_id, CASE WHEN page_id % 9 = 8 THEN NULL WHEN page_id % 7 = 6 THEN 404 ELSE 200 END AS http, CASE WHEN page_id % 11 <> 10 THEN {_pick_sql(_KINDS, 'page_id')} END AS kind, CASE page_id % 4 WHEN 0 THEN split_part(url, '?', 1) || '/x.CSV?q=1' WHEN 1 THEN split_part(url, '?', 1) || '/x.gz' WHEN 2 THEN url END AS link FROM pages)
SELECT page_id, coalesce(http = 200 AND k <> 'text/html' AND (k IN ('', 'text/csv', 'application/json') OR coalesce(page_id % 4 < 2, FALSE)), FALSE) AS is_file FROM (SELECT *, trim(split_part(coalesce(kind, ''), ';', 1)) AS k FROM l)""")
def ledger_link_is_file(s, d):
    i = F.col("page_id")
    http = F.when(i % 9 == 8, None).when(i % 7 == 6, 404).otherwise(200)
    link = F.when(i % 4 == 0, F.concat(F.substring_index("url", "?", 1), F.lit("/x.CSV?q=1"))).when(i % 4 == 1, F.concat(F.substring_index("url", "?", 1), F.lit("/x.gz"))).when(i % 4 == 2, F.col("url"))
    return V.t(s, d, "pages").select("page_id", ledgers.link_is_file(http, F.when(i % 11 != 10, _pick(_KINDS, i)), link).alias("is_file"))
