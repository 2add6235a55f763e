"""The driver's tables in the roles of the price model: hospitals, gross and negotiated prices, benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hospitals(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (t(spark, d, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("ccn"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("state"), "s_acctbal")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))
    return t(spark, d, "lineitem").join(p, "l_partkey")


def gross(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).where("l_returnflag = 'R'").withColumn("gross_charge", F.col("l_extendedprice") / F.col("l_quantity"))
    return rows.select(F.col("l_suppkey").alias("ccn"), "code", F.lit("CPT").alias("code_type"), "gross_charge", (F.col("gross_charge") * (1 - F.col("l_discount"))).alias("discounted_cash"))


def negotiated(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("payer_name"))
    rows = _lines(spark, d).where("l_returnflag <> 'R'").join(o, "l_orderkey").join(c, "c_custkey")
    return rows.select(F.col("l_suppkey").alias("ccn"), "code", F.lit("HCPCS").alias("code_type"), "payer_name", (F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).alias("negotiated_dollar"))


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").groupBy(F.upper(F.trim("p_brand")).alias("code")).agg(F.max("p_retailprice").alias("medicare_allowable"), F.max("p_size").alias("m"))
    return rows.select("code", "medicare_allowable", F.when(F.col("m") % 2 == 0, "opps").otherwise("mpfs").alias("source"))


#: The same roles in SQL, from their definitions: prices, benchmark, panel, then one row a positive price.
SQL = """
xw AS (SELECT s_suppkey AS ccn, s_name AS name, n_name AS nation, r_name AS state, s_acctbal FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey),
prices AS (SELECT l_suppkey AS ccn, p_brand AS code, l_orderkey, l_returnflag = 'R' AS listed, l_extendedprice / l_quantity AS full_price, l_extendedprice / l_quantity * (1 - l_discount) AS net_price FROM part JOIN lineitem ON l_partkey = p_partkey),
gross_rows AS (SELECT ccn, code, full_price AS gross_charge, net_price AS discounted_cash FROM prices WHERE listed),
neg_rows AS (SELECT ccn, code, c_mktsegment AS payer_name, net_price AS negotiated_dollar FROM prices JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE NOT listed),
mc AS (SELECT * FROM (SELECT upper(trim(p_brand)) AS code, max(p_retailprice) AS medicare_allowable, if(max(p_size) % 2 = 0, 'opps', 'mpfs') AS source FROM part GROUP BY ALL) WHERE medicare_allowable > 0 AND (medicare_allowable >= 10 OR source <> 'opps')),
g AS (SELECT ccn, upper(trim(code)) AS code, median(gross_charge) AS gross, median(discounted_cash) AS cash FROM gross_rows WHERE gross_charge > 0 GROUP BY ALL),
n AS (SELECT ccn, upper(trim(code)) AS code, min(negotiated_dollar) AS neg_min, median(negotiated_dollar) AS neg_median, count(DISTINCT payer_name) AS neg_n_payers FROM neg_rows WHERE negotiated_dollar > 0 GROUP BY ALL),
hc AS (SELECT ccn, code, gross, cash, neg_min, neg_median, neg_n_payers, state, medicare_allowable, source FROM g FULL JOIN n USING (ccn, code) JOIN xw USING (ccn) JOIN mc USING (code)
  WHERE state IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')),
priced AS (SELECT state, ccn, code, price_type, price / medicare_allowable AS r FROM hc UNPIVOT (price FOR price_type IN (gross, cash, neg_min, neg_median)) WHERE price > 0),
limits AS (SELECT state, price_type, quantile_cont(r, 0.995) AS cap FROM priced GROUP BY ALL),
long_ratios AS (SELECT state, ccn, code, price_type, r FROM priced JOIN limits USING (state, price_type) WHERE r BETWEEN 0.01 AND cap)
"""
