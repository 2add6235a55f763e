"""All queries of the engine over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargelens.functions import stats, text
from chargelens.operators import ledgers
from chargelens.operators import ratios as R
from chargelens.operators import relational as rel
from chargelens.plans import views as V
from chargelens.plans.registry import QUERIES, SQL, query

def _hc(s: SparkSession, d: str) -> DataFrame:
    g, n = R.gross_by_hospital_code(V.gross(s, d)), R.negotiated_by_hospital_code(V.negotiated(s, d))
    return R.panel(g, n, V.hospitals(s, d), V.benchmark(s, d), V.STATES)


def _rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _nudged(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded with exact ties moved up, as engines round those differently."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in columns})


_RATIO_COLUMNS = ("gross_ratio", "cash_ratio", "neg_min_ratio", "neg_median_ratio")


@query("SELECT ccn, code, round(gross + 1e-10, 6) AS gross, round(cash + 1e-10, 6) AS cash FROM g", views=True)
def ratio_gross_by_hospital_code(s, d):
    return _nudged(R.gross_by_hospital_code(V.gross(s, d)), "gross", "cash")


@query("SELECT ccn, code, round(neg_min + 1e-10, 6) AS neg_min, round(neg_median + 1e-10, 6) AS neg_median, neg_n_payers FROM n", views=True)
def ratio_negotiated_by_hospital_code(s, d):
    return _nudged(R.negotiated_by_hospital_code(V.negotiated(s, d)), "neg_min", "neg_median")


@query("SELECT ccn, code, round(gross + 1e-10, 6) AS gross, round(cash + 1e-10, 6) AS cash, round(neg_min + 1e-10, 6) AS neg_min, round(neg_median + 1e-10, 6) AS neg_median, neg_n_payers, state, medicare_allowable, source FROM hc", views=True)
def ratio_panel_full_outer(s, d):
    return _nudged(_hc(s, d), *R.PRICES)


@query("SELECT state, " + ", ".join(f"round(max(cap) FILTER (price_type = '{p}'), 8) AS {p}_cap" for p in R.PRICES) + " FROM limits GROUP BY 1", views=True)
def ratio_caps_by_state(s, d):
    return _rounded(R.caps_by_state(_hc(s, d)), "gross_cap", "cash_cap", "neg_min_cap", "neg_median_cap")


@query("SELECT hc.ccn, hc.state, hc.code, " + ", ".join(f"round(max(r) FILTER (price_type = '{p}'), 8) AS {p}_ratio" for p in R.PRICES) + " FROM hc LEFT JOIN long_ratios USING (ccn, code) GROUP BY 1, 2, 3", views=True)
def ratio_trimmed_panel(s, d):
    return _rounded(R.trimmed(_hc(s, d)).select("ccn", "state", "code", *_RATIO_COLUMNS), *_RATIO_COLUMNS)


@query("SELECT state, price_type, count(*) AS n_pairs, round(quantile_cont(r, 0.25), 8) AS p25, round(quantile_cont(r, 0.5), 8) AS p50, round(quantile_cont(r, 0.75), 8) AS p75, round(avg(r), 8) AS mean FROM long_ratios GROUP BY 1, 2", views=True)
def ratio_state_summary(s, d):
    return _rounded(R.quartiles(R.trimmed_long(_hc(s, d), ["state"]), ["state", "price_type"]), "p25", "p50", "p75", "mean").orderBy("state", "price_type")


_PAYER_SQL = """, pairs AS (SELECT state, payer_name, nr.ccn, nr.code, min(negotiated_dollar) / any_value(medicare_allowable) AS r FROM neg_rows nr JOIN xw USING (ccn) JOIN mc ON mc.code = upper(trim(nr.code))
  WHERE negotiated_dollar > 0 AND trim(payer_name) <> '' GROUP BY 1, 2, 3, 4),
pcaps AS (SELECT state, quantile_cont(r, 0.995) AS cap FROM pairs GROUP BY 1),
payers AS (SELECT state, payer_name, count(*) AS n_pairs, quantile_cont(r, 0.25) AS p25_neg_ratio, quantile_cont(r, 0.5) AS p50_neg_ratio, quantile_cont(r, 0.75) AS p75_neg_ratio FROM pairs JOIN pcaps USING (state) WHERE r >= 0.01 AND r <= cap GROUP BY 1, 2 HAVING count(*) >= 100)
"""


@query(_PAYER_SQL + "SELECT state, payer_name, n_pairs, round(p25_neg_ratio, 8) AS p25_neg_ratio, round(p50_neg_ratio, 8) AS p50_neg_ratio, round(p75_neg_ratio, 8) AS p75_neg_ratio FROM payers", views=True)
def ratio_payer_state(s, d):
    return _rounded(R.payer_state(V.negotiated(s, d), V.hospitals(s, d), V.benchmark(s, d)), "p25_neg_ratio", "p50_neg_ratio", "p75_neg_ratio")


@query(_PAYER_SQL + "SELECT state, payer_name, round(p50_neg_ratio, 8) AS p50_neg_ratio, rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p50_neg_ratio, payer_name) AS rank FROM payers) WHERE rank <= 3", views=True)
def ratio_top_payers_per_state(s, d):
    payers = R.payer_state(V.negotiated(s, d), V.hospitals(s, d), V.benchmark(s, d))
    top = rel.top_k(payers, ["state"], 3, F.asc("p50_neg_ratio"), F.asc("payer_name"))
    return _rounded(top.select("state", "payer_name", "p50_neg_ratio", "rank"), "p50_neg_ratio")


_POLICIES = [("hard_2", 2.0, None), ("none", None, None), ("p98", None, 0.98), ("p995", None, 0.995)]
_POLICY_SQL = """, lim AS (SELECT state, price_type, quantile_cont(r, 0.98) AS p98, quantile_cont(r, 0.995) AS p995, 2.0::DOUBLE AS hard_2, 'inf'::DOUBLE AS "none" FROM priced GROUP BY ALL),
eff AS (SELECT state, price_type, policy, effective_cap FROM lim UNPIVOT (effective_cap FOR policy IN (p98, p995, hard_2, "none"))),
sweep AS (SELECT policy, state, price_type, count(*) AS n_pairs, median(r) AS p50_ratio, quantile_cont(r, 0.75) AS p75_ratio FROM priced JOIN eff USING (state, price_type) WHERE r >= 0.01 AND r <= effective_cap GROUP BY 1, 2, 3)
"""


@query(_POLICY_SQL + "SELECT policy, state, price_type, n_pairs, round(p50_ratio, 8) AS p50_ratio, round(p75_ratio, 8) AS p75_ratio FROM sweep", views=True)
def cap_policy_sweep(s, d):
    return _rounded(R.policy_sweep(_hc(s, d), _POLICIES).drop("effective_cap"), "p50_ratio", "p75_ratio")


@query(_POLICY_SQL + """SELECT price_type, state, round(max(p50_ratio) FILTER (policy = 'hard_2'), 8) AS hard_2, round(max(p50_ratio) FILTER (policy = 'none'), 8) AS "none",
  round(max(p50_ratio) FILTER (policy = 'p98'), 8) AS p98, round(max(p50_ratio) FILTER (policy = 'p995'), 8) AS p995 FROM sweep GROUP BY 1, 2""", views=True)
def cap_policy_pivot(s, d):
    names = [p[0] for p in _POLICIES]
    return _rounded(R.policy_sweep(_hc(s, d), _POLICIES).groupBy("price_type", "state").pivot("policy", names).agg(F.avg("p50_ratio")), *names)


@query("""SELECT ccn, count(*) AS n_codes, round(CASE WHEN count(*) >= 10 AND stddev_samp(ln(gross)) * stddev_samp(ln(neg_median)) > 0 THEN covar_samp(ln(gross), ln(neg_median)) / (stddev_samp(ln(gross)) * stddev_samp(ln(neg_median))) END, 6) AS r
FROM hc WHERE gross > 0 AND neg_median > 0 GROUP BY 1""", views=True)
def grouped_pearson_log_prices(s, d):
    rows = _hc(s, d).where("gross > 0 and neg_median > 0").select("ccn", F.ln("gross").alias("a"), F.ln("neg_median").alias("b"))
    return rows.groupBy("ccn").agg(F.count("*").alias("n_codes"), F.round(F.when(F.count("*") >= 10, stats.pearson("a", "b")), 6).alias("r"))


def _discounts(hc):
    rows = hc.where("gross > 0 and cash > 0").groupBy("ccn", "state").agg(F.count("*").alias("n_codes"), F.median(1 - F.col("cash") / F.col("gross")).alias("m"))
    return rows.select("ccn", "state", "n_codes", F.when(F.col("n_codes") >= 5, F.col("m")).alias("median_cash_discount"))


_DISCOUNT_SQL = ", disc AS (SELECT ccn, state, count(*) AS n_codes, CASE WHEN count(*) >= 5 THEN median(1 - cash / gross) END AS median_cash_discount FROM hc WHERE gross > 0 AND cash > 0 GROUP BY 1, 2) "


@query(_DISCOUNT_SQL + "SELECT ccn, state, n_codes, round(median_cash_discount, 8) AS median_cash_discount FROM disc", views=True)
def cash_discount_median_gated(s, d):
    return _rounded(_discounts(_hc(s, d)), "median_cash_discount")


@query(_DISCOUNT_SQL + """, th AS (SELECT unnest([0.03, 0.05, 0.06])::DOUBLE AS threshold)
SELECT threshold, state, count(median_cash_discount) AS n_evaluable, count(*) FILTER (median_cash_discount >= threshold) AS n_discounters, round(median(CASE WHEN median_cash_discount >= threshold THEN median_cash_discount END), 6) AS median_in_discounters FROM disc, th GROUP BY 1, 2""", views=True)
def discount_threshold_sweep(s, d):
    th = s.createDataFrame([(0.03,), (0.05,), (0.06,)], "threshold double")
    rows = _discounts(_hc(s, d)).crossJoin(F.broadcast(th))  # three thresholds
    hit = F.col("median_cash_discount") >= F.col("threshold")
    return rows.groupBy("threshold", "state").agg(F.count("median_cash_discount").alias("n_evaluable"), F.count_if(hit).alias("n_discounters"), F.round(F.median(F.when(hit, F.col("median_cash_discount"))), 6).alias("median_in_discounters"))


_SEGMENT_SQL = _DISCOUNT_SQL + """, gaps AS (SELECT ccn, state, median(ln(gross / cash)) AS gross_cash, median(ln(gross / neg_min)) AS gross_negmin, median(ln(cash / neg_min)) AS cash_negmin FROM hc WHERE gross > 0 AND cash > 0 AND neg_min > 0 GROUP BY 1, 2),
seg AS (SELECT gaps.*, median_cash_discount >= 0.05 AS discounter FROM gaps LEFT JOIN disc USING (ccn, state)),
long AS (SELECT ccn, state, discounter, 'gross_cash' AS pair, gross_cash AS v FROM seg UNION ALL SELECT ccn, state, discounter, 'gross_negmin', gross_negmin FROM seg UNION ALL SELECT ccn, state, discounter, 'cash_negmin', cash_negmin FROM seg),
tagged AS (SELECT *, 'all' AS segment FROM long UNION ALL SELECT *, CASE WHEN discounter THEN 'discounters' ELSE 'nondiscounters' END FROM long WHERE discounter IS NOT NULL)
SELECT state, segment, pair, count(*) AS n_hospitals, round(quantile_cont(v, 0.25), 8) AS p25, round(quantile_cont(v, 0.5), 8) AS p50, round(quantile_cont(v, 0.75), 8) AS p75, round(avg(v), 8) AS mean FROM tagged GROUP BY 1, 2, 3"""


@query(_SEGMENT_SQL, views=True)
def segment_pair_summary(s, d):
    gap = lambda a, b: F.median(F.ln(F.col(a) / F.col(b)))
    hc = _hc(s, d)
    gaps = hc.where("gross > 0 and cash > 0 and neg_min > 0").groupBy("ccn", "state").agg(gap("gross", "cash").alias("gross_cash"), gap("gross", "neg_min").alias("gross_negmin"), gap("cash", "neg_min").alias("cash_negmin"))
    rows = gaps.join(_discounts(hc).select("ccn", "state", (F.col("median_cash_discount") >= 0.05).alias("discounter")), ["ccn", "state"], "left")
    segments = F.array_compact(F.array(F.lit("all"), F.when(F.col("discounter"), "discounters").when(~F.col("discounter"), "nondiscounters")))
    long = rows.withColumn("segment", F.explode(segments)).unpivot(["state", "segment"], ["gross_cash", "gross_negmin", "cash_negmin"], "pair", "v")
    return _rounded(R.quartiles(long, ["state", "segment", "pair"], "v").withColumnRenamed("n_pairs", "n_hospitals"), "p25", "p50", "p75", "mean")


_BUCKET_SQL = ", f AS (SELECT l_suppkey AS ccn, split_part(p_type, ' ', 1) AS bucket, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), top AS (SELECT ccn, bucket, n FROM (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY n DESC, bucket) AS rk FROM f) WHERE rk = 1) "


def _top_bucket(s, d):
    p = V.t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("bucket"))
    counts = V.t(s, d, "lineitem").join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("ccn"), "bucket").agg(F.count("*").alias("n"))
    return rel.top_one(counts, ["ccn"], F.desc("n"), F.asc("bucket"))


@query(_BUCKET_SQL + "SELECT ccn, bucket, n FROM top", views=True)
def schema_bucket_top1(s, d):
    return _top_bucket(s, d)


@query(_BUCKET_SQL + "SELECT coalesce(bucket, 'unknown') AS bucket, price_type, count(*) AS n_pairs, round(quantile_cont(r, 0.25), 8) AS p25, round(median(r), 8) AS p50, round(quantile_cont(r, 0.75), 8) AS p75, round(avg(r), 8) AS mean FROM long_ratios LEFT JOIN top USING (ccn) GROUP BY 1, 2", views=True)
def bucket_stratified_summary(s, d):
    long = R.trimmed_long(_hc(s, d), ["ccn"]).join(_top_bucket(s, d), "ccn", "left").withColumn("bucket", F.coalesce("bucket", F.lit("unknown")))
    return _rounded(R.quartiles(long, ["bucket", "price_type"]), "p25", "p50", "p75", "mean")


@query(", q AS (SELECT code, quantile_cont(gross_charge, 0.99) AS q FROM gross_rows GROUP BY 1) SELECT code, count(*) AS n_kept, round(max(gross_charge), 6) AS highest FROM gross_rows JOIN q USING (code) WHERE gross_charge <= q.q GROUP BY 1", views=True)
def within_code_p99_filter(s, d):
    kept = rel.within_quantile(V.gross(s, d), ["code"], "gross_charge", 0.99)
    return kept.groupBy("code").agg(F.count("*").alias("n_kept"), F.round(F.max("gross_charge"), 6).alias("highest"))


@query(", h AS (SELECT state, nation, ccn, median(r) FILTER (price_type = 'gross') AS m FROM hc LEFT JOIN (SELECT ccn, code, price_type, r FROM long_ratios) USING (ccn, code) JOIN (SELECT ccn, nation FROM xw) USING (ccn) GROUP BY 1, 2, 3) SELECT state, nation, count(m) AS n_hospitals, round(median(m), 6) AS gross_ratio FROM h GROUP BY 1, 2", views=True)
def two_level_median(s, d):
    by_hospital = R.trimmed(_hc(s, d)).join(V.hospitals(s, d).select("ccn", "nation"), "ccn").groupBy("state", "nation", "ccn").agg(F.median("gross_ratio").alias("m"))
    return by_hospital.groupBy("state", "nation").agg(F.count("m").alias("n_hospitals"), F.round(F.median("m"), 6).alias("gross_ratio"))


@query("SELECT p_brand AS code, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def dedupe_keep_max(s, d):
    return rel.top_one(V.t(s, d, "part").select(F.col("p_brand").alias("code"), "p_partkey", "p_retailprice"), ["code"], F.desc("p_retailprice"), F.asc("p_partkey"))


@query("""WITH u AS (SELECT c_custkey AS k, c_name AS name, 0 AS precedence FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, upper(c_name), 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, lower(c_name), 2 FROM customer)
SELECT k, name, precedence FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY precedence, name) AS r FROM u) WHERE r = 1""")
def precedence_merge(s, d):
    c = V.t(s, d, "customer")
    a = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"))
    return rel.precedence_merge([a, b, c.select(F.col("c_custkey").alias("k"), F.lower("c_name").alias("name"))], "k", F.asc("name"))


@query("""WITH o AS (SELECT p_brand AS code, max(p_retailprice) AS opps_payment FROM part WHERE p_size % 2 = 0 AND p_partkey % 7 < 5 GROUP BY 1), m AS (SELECT p_type AS t, p_brand AS code, p_size FROM part WHERE p_partkey % 5 = 0), m2 AS (SELECT code, round_even(max(p_size)::DOUBLE * 33.2875::DOUBLE, 2) AS mpfs_national FROM m GROUP BY 1)
SELECT coalesce(o.code, m2.code) AS code, opps_payment, mpfs_national, coalesce(opps_payment, mpfs_national) AS medicare_allowable, CASE WHEN opps_payment IS NOT NULL AND mpfs_national IS NOT NULL THEN 'opps+mpfs' WHEN opps_payment IS NOT NULL THEN 'opps' ELSE 'mpfs' END AS source FROM o FULL JOIN m2 ON o.code = m2.code""")
def benchmark_outer_merge(s, d):
    p = V.t(s, d, "part")
    opps = p.where("p_size % 2 = 0 and p_partkey % 7 < 5").groupBy(F.col("p_brand").alias("code")).agg(F.max("p_retailprice").alias("opps_payment"))
    mpfs = p.where("p_partkey % 5 = 0").groupBy(F.col("p_brand").alias("code")).agg(rel.fee_schedule_price(F.max("p_size").cast("double")).alias("mpfs_national"))
    return rel.benchmark_merge(opps, mpfs)


@query("""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'X' || right(lpad(c_custkey::VARCHAR, 9, '0'), 6) ELSE lpad(c_custkey::VARCHAR, 9, '0') END AS id FROM customer),
r AS (SELECT lpad(s_suppkey::VARCHAR, 9, '0') AS id, s_name FROM supplier), e AS (SELECT id, min(s_name) AS s_name FROM r GROUP BY 1), tl AS (SELECT right(id, 6) AS tail, arg_min(s_name, id) AS s_name FROM r GROUP BY 1)
SELECT l.c_custkey, l.id, coalesce(e.s_name, tl.s_name) AS s_name, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN tl.s_name IS NOT NULL THEN 'tail' ELSE 'none' END AS match_kind FROM l LEFT JOIN e USING (id) LEFT JOIN tl ON e.id IS NULL AND tl.tail = right(l.id, 6)""")
def two_stage_fallback_join(s, d):
    padded = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    left = V.t(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("X"), text.tail6(padded("c_custkey")))).otherwise(padded("c_custkey")).alias("id"))
    return rel.fallback_join(left, V.t(s, d, "supplier").select(padded("s_suppkey").alias("id"), "s_name"), "id", ["s_name"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_resume(s, d):
    done = V.t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.t(s, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_filter(s, d):
    urgent = V.t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return V.t(s, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, upper(c_name), c_acctbal + 1 FROM customer WHERE c_custkey % 4 = 0")
def upsert_by_key(s, d):
    old = V.t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 4 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return rel.upsert(old, new, "c_custkey")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def status_crosstab(s, d):
    return rel.crosstab(V.t(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(""", k AS (SELECT xw.ccn, count(DISTINCT hc.code) FILTER (gross IS NOT NULL) AS n FROM xw LEFT JOIN hc ON hc.ccn = xw.ccn GROUP BY 1)
SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 9 THEN '1-9' WHEN n <= 19 THEN '10-19' WHEN n <= 39 THEN '20-39' ELSE '40+' END AS bin, count(*) AS n_hospitals FROM k GROUP BY 1""", views=True)
def binned_coverage(s, d):
    n = F.coalesce("n", F.lit(0))
    have = _hc(s, d).where("gross is not null").groupBy("ccn").agg(F.countDistinct("code").alias("n"))
    bins = F.when(n <= 0, "0").when(n <= 9, "1-9").when(n <= 19, "10-19").when(n <= 39, "20-39").otherwise("40+")
    return V.hospitals(s, d).join(have, "ccn", "left").groupBy(bins.alias("bin")).agg(F.count("*").alias("n_hospitals"))


@query("SELECT 5 + 2.5 * least(floor((l_quantity - 5) / 2.5), 18) AS bin_start, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 52.5 GROUP BY 1")
def histogram_bins(s, d):
    rows = V.t(s, d, "lineitem").where("l_quantity between 5 and 52.5")  # the last bin is closed
    return rows.groupBy((F.lit(5) + 2.5 * F.least(F.floor((F.col("l_quantity") - 5) / 2.5), F.lit(18))).cast("double").alias("bin_start")).agg(F.count("*").alias("n"))


@query("SELECT t.target, count(*) AS n FROM lineitem, (SELECT unnest([0, 2, 5, 8, 10])::DOUBLE AS target) t WHERE abs(l_discount * 100 - t.target) <= 0.5 GROUP BY 1")
def tolerance_band_counts(s, d):
    targets = s.createDataFrame([(float(x),) for x in (0, 2, 5, 8, 10)], "target double")
    return V.t(s, d, "lineitem").join(F.broadcast(targets), F.abs(F.col("l_discount") * 100 - F.col("target")) <= 0.5).groupBy("target").agg(F.count("*").alias("n"))  # five targets


@query("SELECT r_name, string_agg(n_name, ' | ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def string_agg_sorted(s, d):
    n, r = V.t(s, d, "nation"), V.t(s, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " | ").alias("nations"))


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT *, least(n, greatest(10, round_even(n * 200 / (SELECT sum(n) FROM c), 0)::BIGINT)) AS take FROM c)
SELECT o_orderpriority, n, least(n, greatest(take + CASE WHEN o_orderpriority = (SELECT o_orderpriority FROM c ORDER BY n DESC, o_orderpriority DESC LIMIT 1) THEN 200 - (SELECT sum(take) FROM a) ELSE 0 END, 0))::BIGINT AS take FROM a""")
def stratified_allocation(s, d):
    return rel.allocation(V.t(s, d, "orders"), "o_orderpriority", 200, 10)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(s, d):
    return V.t(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@query("""WITH l AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer), w AS (SELECT c_custkey, c_acctbal, greatest(lo, least(c_acctbal, hi)) AS w FROM customer, l), m AS (SELECT avg(w) AS m, stddev_samp(w) AS sd, min(c_acctbal) AS a, max(c_acctbal) AS b FROM w)
SELECT c_custkey, round((w - m) / sd, 6) AS z, round((c_acctbal - a) / (b - a) * 100, 4) AS scaled FROM w, m""")
def winsor_z_and_minmax(s, d):
    z = stats.winsor_z(V.t(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return stats.min_max(z, "c_acctbal", "s", 9).select("c_custkey", F.round("z_c_acctbal", 6).alias("z"), F.round("s", 4).alias("scaled"))


@query("""WITH c AS (SELECT r_name AS state, count(*) AS n, median(c_acctbal) AS med, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT a.state, a.n, round(a.med, 3) AS med, round(a.mean, 3) AS mean, round((a.mean - b.mean) / nullif(a.med - b.med, 0), 6) AS slope FROM c a, c b WHERE b.state = 'ASIA'""")
def centroids_and_between_slope(s, d):
    c, n, r = (V.t(s, d, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("state")).agg(F.count("*").alias("n"), F.median("c_acctbal").alias("med"), F.avg("c_acctbal").alias("mean"))
    base = rows.where("state = 'ASIA'").select(F.col("med").alias("bm"), F.col("mean").alias("ba"))
    both = rows.crossJoin(F.broadcast(base))  # one row
    return both.select("state", "n", F.round("med", 3).alias("med"), F.round("mean", 3).alias("mean"), F.round(F.try_divide(F.col("mean") - F.col("ba"), F.col("med") - F.col("bm")), 6).alias("slope"))


@query("""WITH x AS (SELECT ln(o_totalprice) AS y, c_acctbal / 1000 AS x FROM orders JOIN customer ON c_custkey = o_custkey), m AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2 FROM x)
SELECT 'const' AS term, round(a, 6) AS beta, n, round(r2, 6) AS r2 FROM m UNION ALL SELECT 'x', round(b, 6), n, round(r2, 6) FROM m""")
def ols_hc3(s, d):
    o, c = V.t(s, d, "orders"), V.t(s, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.ln("o_totalprice").alias("y"), (F.col("c_acctbal") / 1000).alias("x"))
    return stats.ols_hc3(rows, "y", ["x"]).select("term", F.round("beta", 6).alias("beta"), "n", F.round("r2", 6).alias("r2"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9$(),.+-]+')) AS w FROM documents), c AS (SELECT w, regexp_replace(upper(trim(w)), '[^A-Z0-9]', '', 'g') AS code FROM w)
SELECT w, code, CASE WHEN regexp_full_match(code, '[0-9]{5}') THEN 'CPT' WHEN regexp_full_match(code, '[A-Z][0-9]{4}') THEN 'HCPCS' END AS code_type,
  regexp_full_match(code, '0[0-9]{3}|[0-9]{3}') AND substr(CASE WHEN len(code) = 3 THEN '0' || code ELSE code END, 1, 3) BETWEEN '010' AND '099' AS is_revcode FROM c""")
def code_classify(s, d):
    w = V.t(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9$(),.+-]+"), 0)).alias("w")).distinct()
    code = text.normalize_code(F.col("w"))
    return w.select("w", code.alias("code"), text.detect_code_type(code).alias("code_type"), text.is_revenue_code(code).alias("is_revcode"))


_CELLS = ["", " ", "N/A", "n/a", "TBD", "-", ".", "--", "none", "null", "0", "0.00", "$0.00", "$ -", "1", "1.50", "$1,234.50", "($1,234.50)", "(12)", "-5", "$-5.25", "12D", "1e3", "abc", "12 units", "about $1,200.75 each", "not applicable", "note a", "+7", ".5", "5.", "1_000"]


_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: A part's cell: one of those above, or a price of its own in one of eight forms.
_FORMS = (("$", ""), ("(", ")"), ("-", ""), ("", " each"), ("about $", ""), ("", " "), ("$ ", ""), ("$-", ".5"))
_PRICE_SQL = "(p_partkey * 13 % 5000)::VARCHAR || '.25'"
_CELLS_SQL = "SELECT p_partkey, CASE p_partkey % 40 " + " ".join(f"WHEN {32 + i} THEN '{a}' || {_PRICE_SQL} || '{b}'" for i, (a, b) in enumerate(_FORMS)) + " ELSE [" + ", ".join("'" + c + "'" for c in _CELLS) + "][p_partkey % 40 + 1] END AS cell FROM part"


def _as_number(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}), '{_NUMBER}') THEN trim({x})::DOUBLE END"


@query(f"""WITH c AS (SELECT p_partkey, cell, trim(cell) AS t, lower(trim(cell)) AS low, replace(replace(trim(cell), '$', ''), ',', '') AS bare FROM ({_CELLS_SQL})),
p AS (SELECT *, trim(bare) AS flat, regexp_matches(t, '^\\(.+\\)$') AS negative, regexp_replace(bare, '^\\((.+)\\)$', '\\1') AS inside, regexp_extract(bare, '[0-9.]+') AS digits, regexp_extract(bare, '-?[0-9]+\\.?[0-9]*') AS signed, trim(trim(low, '$ ')) AS core FROM c)
SELECT p_partkey, cell, CASE WHEN low IN ('', 'n/a', 'na', 'nan', 'none', '-', '.', 'tbd') THEN NULL WHEN negative THEN -({_as_number('inside')}) ELSE {_as_number('inside')} END AS chargemaster,
  CASE WHEN lower(flat) NOT IN ('', 'na', 'n/a', 'none', 'null', '-', 'not applicable') THEN {_as_number('flat')} END AS mrf, CASE WHEN low NOT IN ('', 'note a', 'not applicable', 'none', 'n/a', 'na', '-') THEN {_as_number('digits')} END AS legacy,
  CASE WHEN core NOT IN ('', 'n/a', 'na', 'note a', 'not applicable', 'none', '-', '--', '.', '0', '0.00', '$0.00', '$ -') AND TRY_CAST(signed AS DOUBLE) <> 0 THEN {_as_number('signed')} END AS misc, {_as_number("replace(cell, ',', '')")} AS plain FROM p""")
def charge_clean(s, d):
    k, c = F.col("p_partkey"), F.col("cell")
    price = F.concat((k * 13 % 5000).cast("string"), F.lit(".25"))
    cell = F.get(F.array(*map(F.lit, _CELLS)), (k % 40).cast("int"))
    for i, (before, after) in enumerate(_FORMS):
        cell = F.when(k % 40 == 32 + i, F.concat(F.lit(before), price, F.lit(after))).otherwise(cell)
    cells = V.t(s, d, "part").select("p_partkey", cell.alias("cell"))
    return cells.select("p_partkey", "cell", text.clean_charge(c).alias("chargemaster"), text.clean_mrf(c).alias("mrf"), text.clean_legacy(c).alias("legacy"), text.clean_misc(c).alias("misc"), text.clean_numeric(c).alias("plain"))


@query(r"""SELECT p_type, CASE WHEN regexp_matches(p_type, '(?i)economy') THEN 'economy' ELSE 'other' END AS kind, CASE WHEN regexp_matches(p_type, '(?i)inpatient|\bi[\s/\-]*p\b') THEN 'IP' WHEN regexp_matches(p_type, '(?i)outpatient|\bo[\s/\-]*p\b') THEN 'OP' WHEN regexp_matches(p_type, '(?i)emergency|\be[\s/\-]*r\b|\bed\b') THEN 'ER'
  WHEN regexp_matches(p_type, '(?i)standby|\bs[\s/\-]*b\b') THEN 'SB' WHEN regexp_matches(p_type, '(?i)operating.*room|\bo[\s/\-]*r\b') THEN 'OR' ELSE 'ALL' END AS setting FROM (SELECT DISTINCT p_type FROM part)""")
def setting_from_name(s, d):
    types = V.t(s, d, "part").select("p_type").distinct()
    return types.select("p_type", F.when(F.col("p_type").rlike("(?i)economy"), "economy").otherwise("other").alias("kind"), text.setting_from_column(F.col("p_type")).alias("setting"))


@query("SELECT page_id, starts_with(lower(ltrim(substr(html, 1, 64))), '<!doctype html') OR starts_with(lower(ltrim(substr(html, 1, 64))), '<html') AS is_html FROM pages WHERE html IS NOT NULL")
def html_sniff(s, d):
    return V.t(s, d, "pages").where("html is not null").select("page_id", text.looks_like_html(F.col("html")).alias("is_html"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS n_links, regexp_extract(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1) AS first_href FROM pages""")
def anchor_extract(s, d):
    a = text.anchors(F.col("html"))
    return V.t(s, d, "pages").select("page_id", F.size(a).cast("long").alias("n_links"), F.coalesce(F.get(a, F.lit(0))["href"], F.lit("")).alias("first_href"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT) AS total FROM events GROUP BY 1")
def json_field_extract(s, d):
    k = F.from_json("props", "k long")["k"]
    return V.t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS q_min, median(l_quantity) AS q_median, max(l_quantity) AS q_max, round(avg(l_quantity), 6) AS q_mean, round(avg((l_returnflag = 'R')::INT), 6) AS returned_share FROM lineitem""")
def profile_columns(s, d):
    q = "l_quantity"
    return V.t(s, d, "lineitem").agg(F.count("*").alias("n_rows"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.min(q).alias("q_min"), F.median(q).alias("q_median"), F.max(q).alias("q_max"), F.round(F.avg(q), 6).alias("q_mean"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("returned_share"))


@query("SELECT l_shipmode_class AS class, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_class, count(*) AS n FROM lineitem GROUP BY 1)")
def percent_of_total(s, d):
    counts = V.t(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("class")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(whole)).select("class", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("share"))  # one row


@query("""SELECT state, count(*) AS n_hospitals, count(DISTINCT nation) AS n_nations, round(avg((s_acctbal > 0)::INT), 6) AS positive_share, round(stddev_samp(s_acctbal), 6) AS sd FROM xw GROUP BY 1""", views=True)
def named_aggregates(s, d):
    return V.hospitals(s, d).groupBy("state").agg(F.count("*").alias("n_hospitals"), F.countDistinct("nation").alias("n_nations"), F.round(F.avg((F.col("s_acctbal") > 0).cast("int")), 6).alias("positive_share"), F.round(F.stddev_samp("s_acctbal"), 6).alias("sd"))


@query("""SELECT CASE WHEN quality = 1 THEN 'Y' WHEN quality = 0 THEN 'N' END AS quality_label, count(*) AS n, count(*) FILTER (toxic = 1) AS y, count(*) FILTER (toxic = 0) AS n_no, round(count(*) FILTER (toxic = 1) / nullif(count(*) FILTER (toxic IN (0, 1)), 0), 6) AS precision FROM labels GROUP BY 1""")
def audit_precision(s, d):
    rows = V.t(s, d, "labels").select(*[F.when(F.col(c) == 1, "Y").when(F.col(c) == 0, "N").alias(f"{c}_label") for c in ("quality", "toxic")])
    return rows.groupBy("quality_label").agg(F.count("*").alias("n"), F.count_if(F.col("toxic_label") == "Y").alias("y"), F.count_if(F.col("toxic_label") == "N").alias("n_no"), F.round(rel.precision("toxic_label"), 6).alias("precision"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def largest_per_key(s, d):
    return rel.top_one(V.t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages""")
def url_parts(s, d):
    return V.t(s, d, "pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.slug(F.col("url")).alias("slug"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS http, length(html) * (1 + page_id % 40) AS size,
CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/csv' END AS kind FROM pages)
SELECT page_id, CASE WHEN http IS NULL THEN 'error' WHEN http <> 200 THEN 'http_' || http WHEN coalesce(size, 0) < CASE WHEN kind LIKE 'text/html%' THEN 10240 ELSE 1024 END THEN 'too_small'
WHEN kind LIKE 'text/html%' THEN 'html_response' ELSE 'ok' END AS status FROM p""")
def ledger_download_outcome(s, d):
    i = F.col("page_id")
    http, kind = F.when(i % 5 == 0, 404).when(i % 5 != 1, 200), F.when(i % 3 == 0, "text/html; charset=utf-8").when(i % 3 == 1, "text/csv")
    return V.t(s, d, "pages").select("page_id", ledgers.download_outcome(http, F.length("html") * (1 + i % 40), kind).alias("status"))


@query("""WITH n AS (SELECT c_custkey AS ccn, CASE WHEN c_nationkey % 4 <> 0 THEN c_name END AS mrf_url, 'seed' AS discovery_method FROM customer WHERE c_custkey % 3 <> 0),
o AS (SELECT c_custkey AS ccn, upper(c_name) AS mrf_url, CASE WHEN c_nationkey % 7 = 0 THEN 'exempt:other' ELSE 'old' END AS discovery_method FROM customer WHERE c_custkey % 2 = 0),
rescued AS (SELECT ccn FROM n WHERE mrf_url IS NULL AND ccn % 5 = 0), fresh AS (SELECT * FROM n WHERE ccn NOT IN (SELECT ccn FROM rescued) AND ccn NOT IN (SELECT ccn FROM o WHERE discovery_method LIKE 'exempt%'))
SELECT * FROM fresh UNION ALL SELECT * FROM o WHERE ccn NOT IN (SELECT ccn FROM fresh)""")
def ledger_seed_merge(s, d):
    c = V.t(s, d, "customer").withColumn("ccn", F.col("c_custkey"))
    new = c.where("ccn % 3 <> 0").select("ccn", F.expr("CASE WHEN c_nationkey % 4 <> 0 THEN c_name END AS mrf_url"), F.lit("seed").alias("discovery_method"))
    old = c.where("ccn % 2 = 0").select("ccn", F.upper("c_name").alias("mrf_url"), F.expr("CASE WHEN c_nationkey % 7 = 0 THEN 'exempt:other' ELSE 'old' END AS discovery_method"))
    return ledgers.seed_merge(new, old, c.select("ccn", F.when(F.col("ccn") % 5 == 0, "ok").otherwise("http_404").alias("status")))


@query("""SELECT o_orderkey AS file, o_custkey AS ccn, CASE WHEN o_custkey % 5 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'duplicate' ELSE 'move' END AS action FROM orders""")
def ledger_upload_actions(s, d):
    up = V.t(s, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("ccn"), F.length("o_orderpriority").alias("size"))
    placed = up.where("file % 2 = 0").withColumn("size", F.expr("size + CASE WHEN file % 3 = 0 THEN 1 ELSE 0 END"))
    known = up.select("ccn").where("ccn % 5 <> 0")
    return ledgers.upload_actions(up, placed, known).select("file", "ccn", "action")


@query("SELECT o_orderstatus AS status, o_orderpriority AS source, count(*) AS n, sum(o_orderkey)::BIGINT AS bytes FROM orders GROUP BY ALL")
def ledger_tallies(s, d):
    return ledgers.tallies(V.t(s, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("bytes")), "status", "source")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS n_indebted FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY 1, 2")
def aligned_counts(s, d):
    counts = V.t(s, d, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_indebted"))
    return rel.aligned(V.t(s, d, "nation").select("n_nationkey", "n_name"), counts, "n_nationkey", ["n_indebted"])


@query("SELECT median(n)::DOUBLE AS median_n, max(n) AS max_n, count(*) FILTER (n >= 10) AS n_dense FROM (SELECT ccn, count(DISTINCT payer_name) AS n FROM neg_rows GROUP BY 1)", views=True)
def payer_density(s, d):
    return rel.distinct_profile(V.negotiated(s, d), "ccn", "payer_name")


@query("""WITH z AS (
  SELECT c_nationkey AS zip, avg(c_acctbal) AS income, count(*) FILTER (c_acctbal < 0) AS deaths, count(*) AS people,
    count(*) FILTER (c_acctbal < 0) / count(*) AS poverty, count(*) FILTER (c_mktsegment = 'BUILDING') / count(*) AS elderly FROM customer GROUP BY 1
), r AS (SELECT *, deaths / people * 100000 AS rate, deaths / people * 100000 / nullif(elderly * 100, 0) AS proxy, 1000 / income * poverty AS burden FROM z
), q AS (SELECT quantile_cont(burden, 0.01) AS bl, quantile_cont(burden, 0.99) AS bh, quantile_cont(poverty, 0.01) AS pl, quantile_cont(poverty, 0.99) AS ph, quantile_cont(elderly, 0.01) AS el, quantile_cont(elderly, 0.99) AS eh FROM r
), w AS (SELECT r.*, greatest(bl, least(burden, bh)) AS wb, greatest(pl, least(poverty, ph)) AS wp, greatest(el, least(elderly, eh)) AS we FROM r, q
), h AS (SELECT *, coalesce((wp - avg(wp) OVER ()) / nullif(stddev_samp(wp) OVER (), 0), 0) + coalesce((we - avg(we) OVER ()) / nullif(stddev_samp(we) OVER (), 0), 0) AS hvi FROM w)
SELECT zip, round(rate, 6) AS deaths_per_100k, round(proxy, 6) AS mortality_proxy,
  round_even((wb - min(wb) OVER ()) / nullif(max(wb) OVER () - min(wb) OVER (), 0) * 100, 2) AS idx_burden, round_even((hvi - min(hvi) OVER ()) / nullif(max(hvi) OVER () - min(hvi) OVER (), 0) * 100, 2) AS idx_hvi FROM h""")
def area_indexes(s, d):
    c = V.t(s, d, "customer").groupBy(F.col("c_nationkey").alias("zip"))
    z = c.agg(F.avg("c_acctbal").alias("income"), F.count_if(F.col("c_acctbal") < 0).alias("deaths"), F.count("*").alias("people"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("older"))
    z = z.withColumns({"poverty": F.col("deaths") / F.col("people"), "elderly": F.col("older") / F.col("people"), "deaths_per_100k": stats.per_100k(F.col("deaths"), F.col("people"))})
    z = z.withColumns({"mortality_proxy": F.try_divide("deaths_per_100k", F.col("elderly") * 100), "burden": F.try_divide(F.lit(1000), "income") * F.col("poverty")})
    out = stats.z_index(stats.clipped_index(z, "burden", "idx_burden"), ["poverty", "elderly"], "idx_hvi")
    return _rounded(out.select("zip", "deaths_per_100k", "mortality_proxy", "idx_burden", "idx_hvi"), "deaths_per_100k", "mortality_proxy", digits=6)


def queries() -> dict:
    from chargelens.plans import expressions, facilities, named, read_back  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from chargelens.plans import expressions, facilities, named, read_back  # noqa: F401

    return dict(SQL)
