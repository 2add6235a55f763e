"""Matching against all pairs and the standard library's ratio, and the tables by area."""

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chargelens.functions import text
from chargelens.operators import areas, matching


def plain(name):
    return " ".join(t for t in re.sub("[^A-Z0-9 ]+", " ", (name or "").upper()).split() if t not in text.NAME_STOPWORDS)


def ratio(candidate, target):
    return SequenceMatcher(None, plain(candidate), plain(target)).ratio()


def all_pairs(hospitals, listed):
    out = []
    for k, name, block in hospitals:
        same = max(((ratio(m, name), -o) for o, m, b in listed if b == block and b is not None), default=(0, 0))
        best = max(((ratio(m, name), -o) for o, m, _ in listed), default=(0.0, 0))
        if same[0] >= 0.65:
            out.append((k, -same[1], same[0], "exact_zip+name" if same[0] >= 0.9 else "zip_only_fuzzy"))
        else:
            out.append((k, -best[1], best[0], "name_only_fuzzy") if best[0] >= 0.85 else (k, None, best[0], "unmatched"))
    return out


def matched(spark, hospitals, listed, **options):
    left, right = spark.createDataFrame(hospitals, "ccn int, name string, zip string"), spark.createDataFrame(listed, "o int, m string, zip string")
    return [(r.ccn, r.o, r.score, r.method) for r in matching.fuzzy_match(left, right, "ccn", "name", "zip", "o", "m", **options).orderBy("ccn").collect()]


def test_fuzzy_match_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = ["MERCY", "CLARK", "ST", "MARYS", "SAINT", "LAKE", "VIEW", "LAKEVIEW", "COUNTY", "GOOD", "SAM", "GENERAL", "TIDE", "DIET", "KAISER", "X"]
    name = lambda: None if rng.random() < 0.03 else "".join(rng.choice(words, rng.integers(0, 4)).tolist()) if rng.random() < 0.3 else " ".join(rng.choice(words, rng.integers(0, 4)).tolist())
    block = lambda: None if rng.random() < 0.05 else f"{rng.integers(0, 9)}"
    hospitals = [(k, name(), block()) for k in range(90)]
    listed = [(k, name(), block()) for k in range(120)]
    assert matched(spark, hospitals, listed) == all_pairs(hospitals, listed)
    short = matched(spark, hospitals, listed, report_from=0.85)
    assert [(k, o, m) for k, o, _, m in short] == [(k, o, m) for k, o, _, m in all_pairs(hospitals, listed)]
    assert matched(spark, [(1, "A", "9")], []) == [(1, None, 0.0, "unmatched")] and matched(spark, [], listed) == []


def test_the_ratio_depends_on_its_order(spark):
    df = spark.createDataFrame([("TIDE", "DIET")], "a string, b string")
    assert df.select(text.name_similarity("a", "b"), text.name_similarity("b", "a")).first()[:] == (0.25, 0.5)


def test_name_rules(spark):
    def one(value, f):
        return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]

    assert one("The Mercy Medical Corp., Inc.", text.registry_name) == "MERCY MEDICAL"
    assert sorted(one("Saint Mary's General Hospital of Lodi-Lodi", text.address_tokens)) == ["lodi", "mary"]
    assert one("https://a.org/x/My file (1).csv?v=2", text.safe_file_name) == "My_file_1_.csv"
    assert one("ACME HOLDINGS", matching.is_corporate) and not one("MERCY HOSPITAL", matching.is_corporate) and not one(None, matching.is_corporate)
    assert [one(c, text.is_charge_column) for c in ("Charge Num Price", "Charge Number", "Charge Code", "Gross Charges", "I/P", "My Charge Numbers Price", "Code")] == [True, True, False, True, True, True, False]
    assert [one(z, text.pad_zip) for z in ("501", "90210-1234", None)] == ["00501", "90210", None]
    assert one("x 12345-6789", text.zip5) == "12345" and one("a 1234567890 b 1234567890 c 9876543210", text.provider_ids) == ["1234567890", "9876543210"]
    assert one('{"Version" : "2.0.0"', text.schema_version_of) == "2.0.0"
    assert [one(v, text.schema_bucket) for v in ("1.0.0", "2.1", "V3.0.0", "kaiser_x", "misc_a", None)] == ["v1.x", "v2.x", "v3.x", "kaiser_2023", "misc_csv", "other"]
    assert [one(z, areas.in_state) for z in ("90000", "96199", "96200", "9000", "abcde", None)] == [True, True, False, False, False, False]
    assert [one(t, text.normalize_setting) for t in ("Inpatient", "OP", "inpatient/outpatient", "Emergency", "professional", None)] == ["inpatient", "outpatient", "both", "emergency", "professional", ""]


WORDS = "MERCY CLARK ST MARYS SAINT LAKE VIEW LAKEVIEW COUNTY GOOD SAM GENERAL TIDE DIET KAISER MEMORIAL REGIONAL VALLEY COMMUNITY SUTTER DAVIS HARBOR PSYCHIATRIC CHILDRENS METHODIST BAPTIST ANDERSON RIVERSIDE FRESNO LODI X".split()


def made(rng, n):
    def one():
        name = " ".join(rng.choice(WORDS, rng.integers(1, 5)).tolist())
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(name))
            name = name[:at] + rng.choice(list("AEX'")) + name[at + rng.integers(0, 2) :]
        return name

    return [one() for _ in range(n)]


def test_no_similar_pair_is_lost_and_few_are_compared(spark):
    rng = np.random.default_rng(8)
    left, right = made(rng, 400), made(rng, 500)
    left += ["", "A", "AB", "'", "É", "ABCDEFGH"]
    right += ["", "A", "AB", "É", "ABCDEFG", "HGFEDCBA"]
    a, c = (spark.createDataFrame(list(enumerate(x)), s) for x, s in ((left, "k int, n string"), (right, "o int, m string")))
    exact = {(k, o): SequenceMatcher(None, m, n).ratio() for k, n in enumerate(left) for o, m in enumerate(right)}
    for least in (0.95, 0.85, 0.75, 0.6, 0.3):
        met = [tuple(r) for r in matching.candidate_pairs(a, c, [], least).select("k", "o").collect()]
        assert len(met) == len(set(met))
        assert {p for p, s in exact.items() if s >= least} <= set(met)
        if least == 0.85:
            assert len(met) < 0.05 * len(exact)
    got = {(r.k, r.o): round(r.score, 9) for r in matching.similar_pairs(a, c, [], 0.75).collect()}
    assert got == {p: round(s, 9) for p, s in exact.items() if s >= 0.75}


def test_the_third_pass_compares_in_the_order_of_the_others(spark):
    hospitals = [("1", "GENERAL LAKE MEDICAL HOSPITAL", "IN", "46001", "x"), ("2", "MERCY CENTER MEDICAL MEMORIAL COUNTY", "CA", "90001", "x")]
    registry = [("11", "REGIONAL LAKE MEDICAL HOSPITAL", "IN", "47999", "t", ["47999"]), ("22", "MERCY ST VIEW MEDICAL MEMORIAL COUNTY", "CA", "95999", "t", ["95999"])]
    h = spark.createDataFrame(hospitals, "ccn string, name string, state string, zip string, hospital_type string")
    r = spark.createDataFrame(registry, "npi string, name string, state string, zip5 string, taxonomy string, zips array<string>")
    own = lambda x: spark.createDataFrame([(x,)], "x string").select(text.registry_name(F.col("x"))).first()[0]
    forward = [SequenceMatcher(None, own(a[1]), own(b[1])).ratio() for a, b in zip(hospitals, registry, strict=True)]
    backward = [SequenceMatcher(None, own(b[1]), own(a[1])).ratio() for a, b in zip(hospitals, registry, strict=True)]
    assert forward[0] >= 0.85 > backward[0]
    assert backward[1] >= 0.85 > forward[1]
    assert [(x.ccn, x.npi, round(x.score, 6)) for x in matching.registry_match(h, r).collect()] == [("1", "11", round(forward[0], 6))]


@pytest.fixture
def compared(spark, monkeypatch):
    """Counts the pairs of names whose similarity is computed."""
    n = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        n.add(len(a))
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    monkeypatch.setattr(matching, "name_similarity", counted)
    return n


TWO, THREE = ["MERCY LAKE VIEW", "GOOD SAM COUNTY"], ["MERCY LAKE VIEWS", "GOOD SAMS COUNTY", "HARBOR DAVIS"]


def test_registered_copies_are_compared_once(spark, compared):
    h = spark.createDataFrame([(f"{k:03}", TWO[k % 2], "IN", "46001", "Psychiatric") for k in range(60)], "ccn string, name string, state string, zip string, hospital_type string")
    r = spark.createDataFrame([(f"{k:03}", THREE[k % 3], "IN", "46001", "Psychiatric Unit", ["46001"]) for k in range(60)], "npi string, name string, state string, zip5 string, taxonomy string, zips array<string>")
    found = matching.registry_match(h, r).orderBy("ccn").collect()
    assert [(x.ccn, x.npi, x.match_method) for x in found] == [(f"{k:03}", f"{k % 2:03}", "taxonomy+name:Psychiatric") for k in range(60)]
    assert compared.value <= 24


def copies(spark):
    left = spark.createDataFrame([(k, TWO[k % 2], f"{k % 5}") for k in range(60)], "ccn int, name string, zip string")
    right = spark.createDataFrame([(k, THREE[k % 3], f"{k % 5}") for k in range(60)], "facility_id int, facility_name string, zip string")
    return left, right, [next(o for o in range(60) if o % 5 == k % 5 and o % 3 == k % 2) for k in range(60)]


def test_copies_in_a_zip_are_compared_once(spark, compared):
    left, right, expected = copies(spark)
    found = matching.fuzzy_match(left, right, "ccn", "name", "zip", "facility_id", "facility_name").orderBy("ccn").collect()
    assert [x.facility_id for x in found] == expected and {x.method for x in found} == {"exact_zip+name"}
    assert compared.value <= 24


def test_equal_names_of_any_length(spark):
    long = "AB" * 120
    got = matched(spark, [(1, "MERCY", "1"), (2, long, "1"), (3, "MERCY", None)], [(7, "MERCY", "1"), (6, "MERCY", "2"), (5, long, "1")])
    assert got == all_pairs([(1, "MERCY", "1"), (2, long, "1"), (3, "MERCY", None)], [(7, "MERCY", "1"), (6, "MERCY", "2"), (5, long, "1")])


def linked(spark):
    left, right, expected = copies(spark)
    none = left.select("ccn", F.lit(None).cast("string").alias("v"))
    return matching.crosswalk(left, right, spark.createDataFrame([(3, 900)], "ccn int, facility_id int"), F.col("ccn") == 4, F.col("ccn") == 5, [(none, "v", F.lit("x"))], [(none, "v", F.lit("x"))]), expected


def test_a_crosswalk_compares_names_once(spark, compared):
    out, expected = linked(spark)
    assert [x.facility_id for x in out.orderBy("ccn").collect()] == [*expected[:3], 900, None, None, *expected[6:]]
    assert compared.value <= 24


def test_a_crosswalk_normalises_copies_in_a_zip_once(spark, monkeypatch):
    n, normal = spark.sparkContext.accumulator(0), text.normalize_name

    @F.pandas_udf("string")
    def counted(a: pd.Series) -> pd.Series:
        n.add(len(a))
        return a

    monkeypatch.setattr(matching, "normalize_name", lambda name: normal(counted(name)))
    out, expected = linked(spark)
    assert [x.facility_id for x in out.orderBy("ccn").collect()] == [*expected[:3], 900, None, None, *expected[6:]]
    assert n.value <= 60 + 15


def test_coverage_compares_names_once(spark, compared):
    out, _ = linked(spark)
    got = {(x.name, x.over): x.n for x in matching.coverage_tallies(out, out.where("ccn < 10").select("ccn"), "ccn", ["facility_id"]).collect()}
    assert got[("rows", "universe")] == 60 and got[("facility_id", "good")] == 8 and got[("method: exact_zip+name", "universe")] == 57
    assert compared.value <= 24


def test_coverage_reads_the_crosswalk_once(spark):
    n = spark.sparkContext.accumulator(0)

    @F.pandas_udf("int")
    def counted(a: pd.Series) -> pd.Series:
        n.add(len(a))
        return a

    schema = "ccn int, row int, v string, match_method string"
    own = spark.createDataFrame([(k, k, "x" if k % 2 else None, "a" if k % 3 else None) for k in range(60)], schema)
    tallies = lambda rows: {(x.name, x.over): x.n for x in matching.coverage_tallies(rows, own.where("ccn < 10"), "ccn", ["v"]).collect()}
    expected = {("rows", "universe"): 60, ("rows", "good"): 10, ("v", "universe"): 30, ("v", "good"): 5, ("method: a", "universe"): 40, ("method: none", "universe"): 20}
    assert tallies(own.where(counted("row") >= 0)) == expected
    assert n.value == 60
    assert tallies(spark.createDataFrame([], schema)) == {k: 0 for k in expected if k[0] in ("rows", "v")}
