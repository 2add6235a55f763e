"""Tables by ZIP area: price panels with people and deaths, quality gates, and hospitals by owner and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.functions.text import zip5

# The state's ZIP codes, as text and as numbers, and names that hospitals of one system share.
FIRST_ZIP, LAST_ZIP = "90001", "96162"
STATE_ZIPS = (90000, 96199)
SYSTEM_NAME = r"(GLOBAL MEDICAL CENTER|ADVENTIST HEALTH|COMMUNITY MEDICAL CENTER|COMMUNITY REGIONAL|KAWEAH|MONTEREY PENINSULA|PRIME|USC|CHINO VALLEY|HALSEN)"


def in_range(zip_code: Column) -> Column:
    """Between the state's first and last ZIP code, as text."""
    return zip_code.between(FIRST_ZIP, LAST_ZIP)


def in_state(zip_code: Column) -> Column:
    """One of the state's five-digit ZIP codes."""
    return F.coalesce(zip_code.rlike(r"^\d{5}$") & zip_code.try_cast("int").between(*STATE_ZIPS), F.lit(False))


def deaths(rows: DataFrame, year: int, strata: str = "Total Population", cause: str = "ALL", geography: str = "Residence") -> DataFrame:
    """(zip, deaths) of one year, stratum, cause and geography; suppressed counts and rows without a ZIP code don't count."""
    one = (F.trim("year") == str(year)) & (F.col("strata") == strata) & (F.col("cause") == cause) & (F.col("geography_type") == geography)
    counted = rows.where(one).select(zip5(F.col("zip_code")).alias("zip"), F.col("count").try_cast("double").alias("n"))
    return counted.where("zip is not null and n is not null").groupBy("zip").agg(F.sum("n").alias("deaths"))


def price_panel(charges: DataFrame, people: DataFrame, died: DataFrame) -> DataFrame:
    """A row an area with a positive charge: mean and median charge, codes, hospitals, mean of each group, people and deaths.

    charges: zip, charge, code, hospital, group (emergency or delivery). One pass over the charges gives all four of their tables.
    """
    mean_of = lambda g: F.avg(F.when(F.col("group") == g, F.col("charge")))
    prices = charges.where("charge > 0").groupBy("zip").agg(
        F.avg("charge").alias("avg_price_all"), F.median("charge").alias("median_price_all"), F.countDistinct("code").alias("n_codes"), F.countDistinct("hospital").alias("n_hospitals"),
        mean_of("emergency").alias("avg_price_emerg"), mean_of("delivery").alias("avg_price_deliv"),
    )
    return prices.join(people, "zip", "left").join(died, "zip", "left")


def quality_gates(panel: DataFrame, codes: int = 3, price: float = 200.0, people: int = 100) -> DataFrame:
    """Areas with a known income, enough codes and people, and a plausible mean price."""
    return panel.where(F.col("median_income").isNotNull() & (F.col("n_codes") >= codes) & (F.col("avg_price_all") >= price) & (F.col("total_pop") >= people))


def system_clusters(hospitals: DataFrame) -> DataFrame:
    """(kind, value, n, names): hospitals by the system in their name (null: none), by bucket and state, and by employer id where several share it.

    hospitals: name, state, ein, bucket.
    """
    none = F.lit(None).cast("string").alias("names")
    by_name = hospitals.groupBy(F.nullif(F.regexp_extract("name", SYSTEM_NAME, 1), F.lit("")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("system").alias("kind"), "value", "n", none)
    by_bucket = hospitals.groupBy(F.concat_ws(" x ", "bucket", "state").alias("value")).agg(F.count("*").alias("n")).select(F.lit("bucket x state").alias("kind"), "value", "n", none)
    owners = hospitals.where("ein is not null").groupBy(F.col("ein").alias("value")).agg(F.count("name").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("names"))
    return by_name.unionByName(by_bucket).unionByName(owners.where("n > 1").select(F.lit("employer").alias("kind"), "value", "n", "names"))
