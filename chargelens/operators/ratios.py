"""Price-to-benchmark ratios: hospital x code medians, the full outer panel, caps, trimmed ratios and summaries.

The panel is far smaller than the price rows it comes from, so panel() writes it once; caps, ratios and summaries read it.
Quantiles of states, payers and price types are exact and by brackets (see quantiles): no task holds a whole state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.functions.text import upper_trim
from chargelens.operators.quantiles import group_quantiles
from chargelens.operators.staging import staged

PRICES = ("gross", "cash", "neg_min", "neg_median")


def _is_code(c: str = "code_type") -> Column:
    return F.col(c).isin("CPT", "HCPCS")  # case counts


def gross_by_hospital_code(rows: DataFrame) -> DataFrame:
    """Medians of gross and cash prices over rows with a positive gross price."""
    valid = rows.where(_is_code() & F.col("gross_charge").isNotNull() & (F.col("gross_charge") > 0))
    return valid.groupBy("ccn", upper_trim(F.col("code")).alias("code")).agg(F.median("gross_charge").alias("gross"), F.median("discounted_cash").alias("cash"))


def negotiated_by_hospital_code(rows: DataFrame) -> DataFrame:
    valid = rows.where(_is_code() & F.col("negotiated_dollar").isNotNull() & (F.col("negotiated_dollar") > 0))
    keyed = valid.groupBy("ccn", upper_trim(F.col("code")).alias("code"))
    return keyed.agg(F.min("negotiated_dollar").alias("neg_min"), F.median("negotiated_dollar").alias("neg_median"), F.countDistinct("payer_name").alias("neg_n_payers"))


def priced_codes(benchmark: DataFrame, least: float = 10.0) -> DataFrame:
    """Benchmark rows that prices are divided by: positive ones, but not the cheap ones of the outpatient schedule."""
    return benchmark.where((F.col("medicare_allowable") > 0) & ~((F.col("medicare_allowable") < least) & (F.col("source") == "opps")))


def panel(gross: DataFrame, negotiated: DataFrame, hospitals: DataFrame, benchmark: DataFrame, states: list[str]) -> DataFrame:
    """Full outer join of the two sides, with state and benchmark, written once. Both sides are aggregated before they meet."""
    both = gross.join(negotiated, ["ccn", "code"], "full_outer")
    own = hospitals.where(F.col("state").isin(*states)).select("ccn", "state")
    return staged(both.join(own, "ccn").join(priced_codes(benchmark), "code"))


def long_ratios(joined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, price_type, r) of every positive price of a panel."""
    columns = [F.when(F.col(p) > 0, F.col(p) / F.col("medicare_allowable")).alias(p) for p in PRICES]
    return joined.select(*keys, *columns).unpivot(keys, list(PRICES), "price_type", "r").where("r is not null")


def caps(joined: DataFrame, q: float = 0.995) -> DataFrame:
    """(state, price_type, cap): the q quantile of positive prices' ratios, taken before the floor."""
    return staged(group_quantiles(long_ratios(joined, ["state"]), ["state", "price_type"], "r", {"cap": q}).drop("n"))  # a row a state and price type


def caps_by_state(joined: DataFrame) -> DataFrame:
    """caps() with a column <price>_cap each."""
    return joined.select("state").distinct().join(caps(joined).groupBy("state").pivot("price_type", list(PRICES)).agg(F.max("cap")), "state", "left").select("state", *[F.col(p).alias(f"{p}_cap") for p in PRICES])


def trimmed_long(joined: DataFrame, keys: list[str], floor: float = 0.01) -> DataFrame:
    """(keys, price_type, r) of the ratios from the floor to their state's cap."""
    rows = long_ratios(joined, list(dict.fromkeys([*keys, "state"])))
    return rows.join(caps(joined), ["state", "price_type"]).where((F.col("r") >= floor) & (F.col("r") <= F.col("cap"))).select(*keys, "price_type", "r")


def trimmed(joined: DataFrame, floor: float = 0.01) -> DataFrame:
    """The panel with <price>_ratio: null where the price is not positive or its ratio is below the floor or over the state's cap."""
    out = joined.join(caps_by_state(joined), "state")
    for p in PRICES:
        r = F.col(p) / F.col("medicare_allowable")
        out = out.withColumn(f"{p}_ratio", F.when((F.col(p) > 0) & (r >= floor) & (r <= F.col(f"{p}_cap")), r))
    return out.drop(*[f"{p}_cap" for p in PRICES])


def quartiles(df: DataFrame, keys: list[str], value: str = "r") -> DataFrame:
    return group_quantiles(df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, mean="mean").withColumnRenamed("n", "n_pairs")


def payer_state(negotiated: DataFrame, hospitals: DataFrame, benchmark: DataFrame, least: int = 100, floor: float = 0.01, q: float = 0.995) -> DataFrame:
    """Quartiles by state and payer over (state, payer, hospital, code) minima, under the state's cap of those minima."""
    rows = negotiated.where(_is_code() & (F.col("negotiated_dollar") > 0) & (F.trim("payer_name") != "")).withColumn("code", upper_trim(F.col("code")))
    lowest = rows.groupBy("payer_name", "ccn", "code").agg(F.min("negotiated_dollar").alias("low"))  # before the joins: fewer rows, none lost
    pairs = staged(lowest.join(hospitals.select("ccn", "state"), "ccn").join(priced_codes(benchmark), "code").select("state", "payer_name", (F.col("low") / F.col("medicare_allowable")).alias("r")))
    limits = staged(group_quantiles(pairs, ["state"], "r", {"cap": q}).drop("n"))
    kept = pairs.join(limits, "state").where((F.col("r") >= floor) & (F.col("r") <= F.col("cap")))
    by = group_quantiles(kept, ["state", "payer_name"], "r", {"p25_neg_ratio": 0.25, "p50_neg_ratio": 0.5, "p75_neg_ratio": 0.75})
    return by.withColumnRenamed("n", "n_pairs").where(F.col("n_pairs") >= least)


def policy_sweep(joined: DataFrame, policies: list[tuple[str, float | None, float | None]], floor: float = 0.01) -> DataFrame:
    """Median and upper quartile under each (policy, hard cap, quantile cap); neither: no cap."""
    ratios = long_ratios(joined, ["state"])  # a projection of the panel, which is written
    qs = sorted({q for _, _, q in policies if q is not None})
    limits = group_quantiles(ratios, ["state", "price_type"], "r", {f"q{i}": q for i, q in enumerate(qs)})
    limits = staged(limits)
    caps = {n: F.lit(float("inf")) if h is None and q is None else F.lit(h) if h is not None else F.col(f"q{qs.index(q)}") for n, h, q in policies}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), c.cast("double").alias("effective_cap")) for n, c in caps.items()]))
    effective = limits.select("state", "price_type", each.alias("e")).select("state", "price_type", "e.policy", "e.effective_cap")
    kept = ratios.join(effective, ["state", "price_type"]).where((F.col("r") >= floor) & (F.col("r") <= F.col("effective_cap")))
    by = group_quantiles(kept, ["policy", "state", "price_type"], "r", {"p50_ratio": 0.5, "p75_ratio": 0.75}).withColumnRenamed("n", "n_pairs")
    return by.join(effective, ["policy", "state", "price_type"])
