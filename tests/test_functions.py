import numpy as np
import pytest
from pyspark.sql import functions as F

from chargelens.functions import stats, text


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "c string").select(*[f(F.col("c")) for f in columns]).first()


@pytest.mark.parametrize(
    ("cell", "chargemaster", "mrf", "legacy", "misc"),
    [("$1,234.50", 1234.5, 1234.5, 1234.5, 1234.5), ("($5.00)", -5.0, None, 5.0, 5.0), ("-3", -3.0, -3.0, 3.0, -3.0), ("0", 0.0, 0.0, 0.0, None), ("TBD", None, None, None, None), ("12D", None, None, 12.0, 12.0), ("n/a", None, None, None, None), ("about 7 each", None, None, 7.0, 7.0), (None, None, None, None, None)],
)
def test_cleaners_stay_distinct(spark, cell, chargemaster, mrf, legacy, misc):
    assert tuple(one(spark, cell, text.clean_charge, text.clean_mrf, text.clean_legacy, text.clean_misc)) == (chargemaster, mrf, legacy, misc)


@pytest.mark.parametrize(("name", "family"), [("CPT Code", "CPT_HCPCS"), ("MS-DRG", "DRG"), ("MS-DRG Description", None), ("Revenue Code", "REVCODE"), ("NDC", "NDC"), ("ICD-10-PCS", "ICD10PCS"), ("Code", "AMBIG"), ("Price", None)])
def test_code_columns(spark, name, family):
    assert one(spark, name, text.classify_code_column)[0] == family


@pytest.mark.parametrize(("code", "ok"), [("0450", True), ("450", True), ("1450", False), ("050", False), ("0050", False), ("45", False)])
def test_revenue_codes(spark, code, ok):
    assert one(spark, code, text.is_revenue_code)[0] is ok


@pytest.mark.parametrize(("name", "tag"), [("I/P Charge", "IP"), ("Outpatient", "OP"), ("ER Price", "ER"), ("Gross Charge", "ALL")])
def test_settings(spark, name, tag):
    assert one(spark, name, text.setting_from_column)[0] == tag


def test_identifiers(spark):
    assert one(spark, "106010735_CDM_2024.xlsx", text.facility_id)[0] == "106010735"
    assert one(spark, "x/12-3456789_hospital.csv", text.employer_id)[0] == "12-3456789"
    assert one(spark, "050123", text.ccn6)[0] == "050123"
    assert one(spark, "The Mercy Medical Center, Inc.", text.normalize_name)[0] == "MERCY"


def test_hc3_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=200) * (1 + abs(x[:, 0]))
    got = stats.ols_hc3(spark.createDataFrame([(float(a), float(b), float(c)) for a, (b, c) in zip(y, x, strict=True)], "y double, a double, b double"), "y", ["a", "b"]).collect()
    m = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    e = (y - m @ beta) / (1 - np.einsum("ij,jk,ik->i", m, inv, m))
    se = np.sqrt(np.diag(inv @ (m.T * e**2) @ m @ inv))
    assert np.allclose([r["beta"] for r in got], beta) and np.allclose([r["se"] for r in got], se)
    assert stats.ols_hc3(spark.createDataFrame([(1.0, 2.0)], "y double, a double"), "y", ["a"]) is None


def test_preferred_address(spark):
    kind = "array<struct<address_purpose:string,state:string,postal_code:string,city:string>>"
    rows = [([("MAILING", "in", "46201", "Gary"), ("location", "ca", "940011234", "Palo Alto")],), ([("MAILING", "in", None, "Gary")],), ([],), (None,)]
    got = [tuple(r.a) for r in spark.createDataFrame(rows, f"x {kind}").select(text.preferred_address(F.col("x")).alias("a")).collect()]
    assert got == [("CA", "94001", "PALO ALTO"), ("IN", "", "GARY"), ("", "", ""), ("", "", "")]


def test_price_file_links(spark):
    index = "mrf-url:\r\n https://a.org/1_A_StandardCharges.csv \nhttp://a.org/other.csv\nsee standardcharges\nhttp://b.org/2_standardcharges.json"
    got = [r.a for r in spark.createDataFrame([(index,), ("",), (None,)], "x string").select(text.price_file_links(F.col("x")).alias("a")).collect()]
    assert got == [["https://a.org/1_A_StandardCharges.csv", "http://b.org/2_standardcharges.json"], [], []]


def test_group_quantiles_are_exact_for_any_group(spark):
    import numpy as np

    from chargelens.operators.quantiles import group_quantiles

    rng = np.random.default_rng(2)
    rows = [(None if k % 7 == 0 else "big" if k % 3 else f"g{k % 40}", None if k % 11 == 0 else float(rng.integers(0, 50))) for k in range(3000)]
    df = spark.createDataFrame([*rows, ("none", None)], "key string, v double")
    got = {r.key: r for r in group_quantiles(df, ["key"], "v", {"a": 0.0, "b": 0.25, "c": 0.995, "d": 1.0}).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n == len(values)
        assert np.allclose([got[k].a, got[k].b, got[k].c, got[k].d], np.quantile(values, [0, 0.25, 0.995, 1]))
    whole = group_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == np.median([v for _, v in rows if v is not None])
    assert group_quantiles(df.where("key = 'none'"), ["key"], "v", {"m": 0.5}).count() == 0


def test_a_benchmark_of_zero_divides_nothing(spark):
    from chargelens.operators import ratios

    rows = spark.createDataFrame([(1, "A", 0.0, "mpfs"), (1, "B", 20.0, "mpfs"), (1, "C", 5.0, "opps")], "ccn int, code string, medicare_allowable double, source string")
    gross = spark.createDataFrame([(1, c, 10.0, 5.0) for c in "ABC"], "ccn int, code string, gross double, cash double")
    negotiated = spark.createDataFrame([(1, "A", 1.0, 2.0, 3)], "ccn int, code string, neg_min double, neg_median double, neg_n_payers long")
    hospitals = spark.createDataFrame([(1, "CA")], "ccn int, state string")
    assert [r.code for r in ratios.panel(gross, negotiated, hospitals, rows.drop("ccn"), ["CA"]).collect()] == ["B"]


def test_predictions_along_one_variable():
    from chargelens.functions.stats import prediction_grid

    got = prediction_grid({"const": 1.0, "x": 2.0, "z": -1.0}, "x", 0.0, 10.0, {"z": 3.0}, points=3)
    assert got == [(0.0, -2.0), (5.0, 8.0), (10.0, 18.0)]


def test_the_largest_file_of_each_owner(spark):
    from chargelens.sources.grid import largest_per_owner

    files = spark.createDataFrame([("1", "a", 10), ("1", "b", 30), ("1", "c", 30), ("2", "d", 5)], "ccn string, path string, length long")
    assert sorted((r.ccn, r.path, r.length) for r in largest_per_owner(files).collect()) == [("1", "c", 30), ("2", "d", 5)]


def test_hc3_keeps_digits_of_nearly_collinear_columns(spark):
    """Columns far from zero that differ by a hundred-millionth: the cross products would have a condition of 1e16 and more."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=400) + 1e4
    b = a + rng.normal(size=400) * 1e-4
    y = 3.0 + 0.5 * a + rng.normal(size=400)
    df = spark.createDataFrame([(float(p), float(q), float(r)) for p, q, r in zip(y, a, b, strict=True)], "y double, a double, b double").repartition(9)
    got = {r.term: r for r in stats.ols_hc3(df, "y", ["a", "b"]).collect()}
    m = np.column_stack([np.ones(400), a - a.mean(), (b - b.mean()) - (a - a.mean())]).astype(np.longdouble)  # the same plane, in columns that numpy can tell apart
    inv = np.linalg.inv((m.T @ m).astype(float))
    g = inv @ (m.T @ (y - y.mean())).astype(float)
    e = (y - y.mean() - (m @ g).astype(float)) / (1 - np.einsum("ij,jk,ik->i", m.astype(float), inv, m.astype(float)))
    cov = inv @ (m.T.astype(float) * e**2) @ m.astype(float) @ inv
    assert abs(got["b"].beta / g[2] - 1) < 1e-6
    assert abs(got["a"].beta / (g[1] - g[2]) - 1) < 1e-6
    assert abs(got["b"].se / np.sqrt(cov[2, 2]) - 1) < 1e-6


def test_stratified_sample_is_that_of_sorted_strata(spark):
    from pyspark.sql import Window

    from chargelens.operators import relational as rel

    df = spark.range(30_000).select("id", F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").when(F.col("id") % 100 != 9, "c").alias("s"), (F.col("id") % 3).alias("__k"))
    got = sorted((r.s or "", r.id) for r in rel.stratified_sample(df, "s", "id", 300, 20).collect())
    w = Window.partitionBy("s").orderBy(F.xxhash64("id", F.lit(20260426)), "id")
    ranked = df.withColumn("r", F.row_number().over(w)).join(rel.allocation(df, "s", 300, 20).withColumnRenamed("s", "t"), F.expr("s <=> t")).where("r <= take")
    assert got == sorted((r.s or "", r.id) for r in ranked.collect())
    assert len(got) == 300


def test_describe(spark):
    from chargelens.operators import relational as rel

    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=500), "b": rng.integers(0, 4, 500).astype(float), "c": np.full(500, np.nan)}
    rows = [(float(x), float(y) if k % 7 else None, None) for k, (x, y) in enumerate(zip(data["a"], data["b"], strict=True))]
    got = {r.name: r for r in rel.describe(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    for name, x in (("a", data["a"]), ("b", data["b"][[k for k in range(500) if k % 7]])):
        want = (len(x), x.mean(), x.std(ddof=1), x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max())
        assert np.allclose(tuple(got[name])[1:], want)
    assert tuple(got["c"]) == ("c", 0, None, None, None, None, None, None, None)
