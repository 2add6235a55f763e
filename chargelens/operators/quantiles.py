"""Exact quantiles of groups of any size, in two passes and without a sort of the rows.

percentile() keeps a map of all distinct values of a group in one task. Here the first pass gives each group's size and, from a mergeable sketch whose
rank error is bounded, two values that each wanted rank lies between. The second pass counts what is below them, and counts the values between
them one by one: a few of a group's rows in ten thousand, however large it is, and a value that most of a group shares is one count a task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargelens.operators.staging import staged

#: The sketch errs by less than 1 / ACCURACY of a group's ranks; brackets reach three times as far. All values of smaller groups are counted.
ACCURACY = 10_000


def group_quantiles(df: DataFrame, keys: list[str], value: str, wanted: Mapping[str, float], mean: str | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, n, one column a name in ``wanted``, and ``mean`` if named): the values' count, quantiles, linear between neighbours, and mean.

    Null values count for nothing; a group without any is absent. Null keys are a group. Without keys: one row, or none. ``df`` is read twice.
    """
    own = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)] if keys else [F.lit(0).alias("__k0")]
    rows = df.where(F.col(value).isNotNull()).select(*named, F.col(value).cast("double").alias("__v"))
    at = sorted({x for q in wanted.values() for x in (max(q - 3 / accuracy, 0.0), min(q + 3 / accuracy, 1.0))})
    sketch = F.percentile_approx("__v", [float(x) for x in at], accuracy)
    seen = rows.groupBy(*own).agg(F.count("*").alias("__n"), F.sum("__v").alias("__sum"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), sketch.alias("__s"))

    def bracket(name: str, q: float) -> Column:
        low, high = max(q - 3 / accuracy, 0.0), min(q + 3 / accuracy, 1.0)
        few = F.col("__n") <= accuracy
        lo = F.when(few | (F.lit(low) == 0), F.col("__min")).otherwise(F.get("__s", F.lit(at.index(low))))
        hi = F.when(few | (F.lit(high) == 1), F.col("__max")).otherwise(F.get("__s", F.lit(at.index(high))))
        return F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("__n") - 1)).alias("at"), lo.alias("lo"), hi.alias("hi"))

    asked = F.array(*[bracket(name, q) for name, q in wanted.items()])
    groups = staged(seen.select(*[F.col(o).alias(f"{o}_") for o in own], "__n", "__sum", asked.alias("__asked")))  # a row a group; its size on disk decides how it is joined
    same = [F.col(o).eqNullSafe(F.col(f"{o}_")) for o in own]
    met = rows.join(groups, same).select(*own, "__n", "__sum", "__v", F.explode(F.filter("__asked", lambda b: F.col("__v") <= b["hi"])).alias("b"))
    group = [*own, "__n", "__sum", "name", "at"]  # those after the keys follow from them
    inside = F.when(F.col("__v") >= F.col("b.lo"), F.col("__v"))
    counts = met.select(*own, "__n", "__sum", F.col("b.name").alias("name"), F.col("b.at").alias("at"), inside.alias("w")).groupBy(*group, "w").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*own, "name").orderBy(F.asc_nulls_first("w")).rowsBetween(Window.unboundedPreceding, 0))
    first = lambda name, rank: F.min(F.when((F.col("name") == name) & (F.col("upto") > rank), F.coalesce("w", F.lit(float("-inf")))))
    placed = counts.repartition(*own).withColumn("upto", upto)  # by the keys alone: the window and the last aggregate need no other exchange
    ends = [f(F.col("at")) for f in (F.floor, F.ceil)]
    found = placed.groupBy(*own, "__n", "__sum").agg(*[first(name, rank).alias(f"{end}_{i}") for i, name in enumerate(wanted) for end, rank in zip(("lo", "hi"), ends, strict=True)])

    def quantile(i: int, q: float) -> Column:
        lo, hi, at = F.col(f"lo_{i}"), F.col(f"hi_{i}"), F.lit(float(q)) * (F.col("__n") - 1)
        between = F.when(hi > lo, (hi - lo) * (at - F.floor(at))).otherwise(0.0)
        outside = lo.isNull() | hi.isNull() | (lo == F.lit(float("-inf")))  # never, by the sketch's bound
        return F.when(outside, F.raise_error(F.lit("a rank outside its bracket"))).otherwise(lo + between)

    out = [F.col("__n").alias("n"), *[quantile(i, q).alias(name) for i, (name, q) in enumerate(wanted.items())]]
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=False)], *out, *([(F.col("__sum") / F.col("__n")).alias(mean)] if mean else []))
