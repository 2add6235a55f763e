"""Joins, dedupes, upserts, crosstabs and samples as reusable DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargelens.functions.text import tail6
from chargelens.operators.quantiles import group_quantiles


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within_quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Rows not over their group's quantile, which joins back: no group is held or sorted in one task."""
    limits = group_quantiles(df, keys, value, {"__q": q}).drop("n")
    return df.join(limits, keys).where(F.col(value) <= F.col("__q")).drop("__q")


def fallback_join(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join by the exact key, then by its last six characters for rows still unmatched; repeated tails take the smallest key."""
    exact = right.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    by_tail = right.groupBy(tail6(F.col(key)).alias("__tail")).agg(*[F.min_by(c, key).alias(f"__{c}") for c in columns])
    first = left.join(exact.withColumn("__hit", F.lit(True)), key, "left")
    out = first.withColumn("__tail", F.when(F.col("__hit").isNull(), tail6(F.col(key)))).join(by_tail, "__tail", "left")
    kind = F.when(F.col("__hit"), "exact").when(F.col(f"__{columns[0]}").isNotNull(), "tail").otherwise("none")
    return out.select(*left.columns, *[F.coalesce(c, f"__{c}").alias(c) for c in columns], kind.alias("match_kind"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns), allowMissingColumns=True)


def precedence_merge(frames: list[DataFrame], key: str, *tie: Column) -> DataFrame:
    """One row a key, from the first frame that has it."""
    tagged = [f.withColumn("precedence", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return top_one(out, [key], F.asc("precedence"), *tie)


def benchmark_merge(opps: DataFrame, mpfs: DataFrame) -> DataFrame:
    """Outer merge of two payment tables (code, opps_payment) and (code, mpfs_national): preferred value and provenance."""
    both = opps.join(mpfs, "code", "full_outer")
    source = F.when(F.col("opps_payment").isNotNull() & F.col("mpfs_national").isNotNull(), "opps+mpfs").when(F.col("opps_payment").isNotNull(), "opps").otherwise("mpfs")
    return both.select("code", "opps_payment", "mpfs_national", F.coalesce("opps_payment", "mpfs_national").alias("medicare_allowable"), source.alias("source"))


def fee_schedule_price(rvu: Column, factor: float = 33.2875) -> Column:
    """Conversion factor times relative value units, rounded half to even; only positive prices."""
    price = F.rint(rvu * factor * 100) / 100  # on the double, as NumPy rounds
    return F.when(price > 0, price)


def fee_schedule(rows: DataFrame, shape: str = r"^[0-9A-Z]{5}$", factor: float = 33.2875) -> DataFrame:
    """(code, mpfs_national): the highest positive price of each code of this shape, by its published total or, where there is none, by the sum of its parts.

    rows: code, nf_total, work, nf_pe, mp.
    """
    part = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.coalesce("nf_total", part("work") + part("nf_pe") + part("mp"))
    priced = rows.where(F.col("code").rlike(shape)).select("code", fee_schedule_price(total, factor).alias("mpfs_national")).where("mpfs_national is not null")
    return priced.groupBy("code").agg(F.max("mpfs_national").alias("mpfs_national"))


def left_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join in which columns of ``right`` that ``left`` also has get a suffix."""
    return left.join(right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in keys}), keys, "left")


def any_is(columns: list[str], label: str) -> Column:
    """Whether any of the columns holds the label, whatever its case; null counts as another."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.upper(c) == label, F.lit(False))
    return out


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def allocation(df: DataFrame, stratum: str, total: int, floor: int) -> DataFrame:
    """Sample size a stratum: its rounded share, ``floor`` at least, its rows at most; what is left goes to the largest."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("__all"))
    share = sizes.crossJoin(F.broadcast(whole)).withColumn("take", F.least(F.col("n"), F.greatest(F.lit(floor), F.bround(F.col("n") * total / F.col("__all")).cast("long"))))  # one row
    rest = share.agg((F.lit(total) - F.sum("take")).alias("__rest"), F.max(F.struct("n", stratum)).alias("__top"))
    out = share.crossJoin(F.broadcast(rest))  # one row
    extra = F.when(F.col(stratum) == F.col("__top")[stratum], F.col("__rest")).otherwise(0)
    return out.select(stratum, "n", F.least("n", F.greatest(F.col("take") + extra, F.lit(0))).alias("take"))


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, floor: int, seed: int = 20260426) -> DataFrame:
    """The rows of each stratum that come first by a hash of the key (ties: the key), as many as allocation() gives it. A null stratum is one too.

    No stratum is sorted. Rows are counted by the first 16 bits of their hash, at most 65,536 counts a stratum; they tell which of these
    shares is the last one taken. What is before it is in the sample, and only the rows of that share, one in 65,536, are put in order.
    """
    share = F.shiftright(F.col("__h"), 48)
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    counts = hashed.groupBy(F.col(stratum).alias("__s"), share.alias("__share")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy("__s").orderBy("__share").rowsBetween(Window.unboundedPreceding, 0)))
    sizes = allocation(df, stratum, total, floor).select(F.col(stratum).alias("__t"), F.col("take").alias("__take"))
    reached = counts.join(sizes, F.col("__s").eqNullSafe(F.col("__t"))).where((F.col("__upto") >= F.col("__take")) & (F.col("__upto") - F.col("__c") < F.col("__take")))
    last = reached.select("__s", F.col("__share").alias("__last"), (F.col("__take") - F.col("__upto") + F.col("__c")).alias("__more"))  # a row a stratum
    met = hashed.join(last, F.col(stratum).eqNullSafe(F.col("__s"))).where(share <= F.col("__last"))
    edge = met.where(share == F.col("__last")).withColumn("__k", F.row_number().over(Window.partitionBy("__s").orderBy("__h", key))).where(F.col("__k") <= F.col("__more"))
    return met.where(share < F.col("__last")).select(*df.columns).unionByName(edge.select(*df.columns))


def precision(label: str) -> Column:
    """Y / (Y + N), null without either."""
    yes, no = F.count_if(F.upper(label) == "Y"), F.count_if(F.upper(label) == "N")
    return F.try_divide(yes.cast("double"), yes + no)


def best_with_abstention(df: DataFrame, key: str, score: str, item: str, most: int = 5) -> DataFrame:
    """Best item by score; none if every score is 0 and there are more than ``most``."""
    best = df.groupBy(key).agg(F.max(score).alias("top"), F.count("*").alias("n"), F.max_by(item, F.struct(F.col(score), F.col(item))).alias("best"))
    return best.select(key, F.when(~((F.col("top") == 0) & (F.col("n") > most)), F.col("best")).alias("best"))


def aligned(universe: DataFrame, counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every row of ``universe``, with counts of 0 where ``counts`` has none for its key."""
    return universe.join(counts.select(key, *columns), key, "left").fillna(0, columns)


def distinct_profile(df: DataFrame, key: str, value: str, least: int = 10) -> DataFrame:
    """One row: median and largest number of distinct values a key, and keys with ``least`` or more."""
    n = df.groupBy(key).agg(F.countDistinct(value).alias("n"))
    return n.agg(F.median("n").alias("median_n"), F.max("n").alias("max_n"), F.count_if(F.col("n") >= least).alias("n_dense"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, count, mean, std, min, p25, p50, p75, max) of each column, nulls left out: the moments in one pass, the quartiles exact (see quantiles)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v")
    moments = long.groupBy("name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    found = group_quantiles(long, ["name"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    return moments.join(found, "name", "left").select("name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
