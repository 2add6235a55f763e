"""Statistics over DataFrames: exact quantiles, correlations, indexes and robust regressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.operators.quantiles import group_quantiles


def pearson(a: str, b: str) -> Column:
    """Correlation, null where either column is constant (corr() would divide by zero under ANSI)."""
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when(spread > 0, F.try_divide(F.covar_samp(a, b), spread))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(lo, F.least(c, hi)))


def _limits(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """One row: lo_<column> and hi_<column>, two quantiles of each column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "__name", "__value") if len(columns) > 1 else df.select(F.lit(columns[0]).alias("__name"), F.col(columns[0]).cast("double").alias("__value"))
    found = group_quantiles(long, ["__name"], "__value", {"lo": low, "hi": high})
    return found.agg(*[F.max(F.when(F.col("__name") == c, F.col(n))).alias(f"{n}_{c}") for c in columns for n in ("lo", "hi")])


def winsor_z(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds z_<column>: the value clipped to two quantiles, less the mean, over the sample deviation of the clipped values."""
    limits = _limits(df, columns, low, high)
    clipped = df.crossJoin(F.broadcast(limits)).select(*df.columns, *[clip(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")).alias(f"w_{c}") for c in columns])  # one row
    moments = clipped.agg(*[f(f"w_{c}").alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    out = clipped.crossJoin(F.broadcast(moments))  # one row
    return out.select(*df.columns, *[F.try_divide(F.col(f"w_{c}") - F.col(f"mean_{c}"), F.col(f"sd_{c}")).alias(f"z_{c}") for c in columns])


def min_max(df: DataFrame, column: str, out: str, digits: int = 2) -> DataFrame:
    """Scales a column to 0..100, rounded half to even."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    scaled = df.crossJoin(F.broadcast(ends))  # one row
    return scaled.select(*df.columns, F.bround(F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 100, digits).alias(out))


def z_index(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Adds the sum of the winsorised z-scores, a missing one as 0, scaled to 0..100."""
    scored = winsor_z(df, columns).withColumn("__raw", sum((F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in columns), F.lit(0.0)))
    return min_max(scored, "__raw", out).select(*df.columns, out)


def clipped_index(df: DataFrame, column: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds the column clipped to two of its quantiles and scaled to 0..100."""
    limits = _limits(df, [column], low, high)
    clipped = df.crossJoin(F.broadcast(limits)).withColumn("__c", clip(F.col(column), F.col(f"lo_{column}"), F.col(f"hi_{column}")))  # one row
    return min_max(clipped, "__c", out).select(*df.columns, out)


def per_100k(events: Column, people: Column) -> Column:
    """Events per 100,000; null where nobody is counted."""
    return F.try_divide(events, people) * 100_000


def _triangles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The triangular factor of all rows of a task, as rows again: what least squares needs of them, whatever their number."""
    r = None
    for frame in frames:
        rows = frame.to_numpy(dtype=float)
        if len(rows):
            r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
    if r is not None:
        yield pd.DataFrame(r, columns=frame.columns)


def triangle(df: DataFrame) -> np.ndarray:
    """The triangular factor R of the rows of ``df`` (doubles without nulls): each task's own, then those of up to 64 groups of tasks, then one of these.

    R'R is the cross product, which is never formed: it would square the condition of the columns.
    """
    schema = ", ".join(f"`{c}` double" for c in df.columns)
    own = df.mapInPandas(_triangles, schema)
    few = own.withColumn("__g", F.pmod(F.spark_partition_id(), F.lit(64))).repartition(64, "__g").drop("__g").mapInPandas(_triangles, schema)
    rows = np.array([tuple(r) for r in few.collect()], dtype=float).reshape(-1, len(df.columns))  # 64 k rows of k numbers at most
    return np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, len(df.columns)))


def ols_hc3(df: DataFrame, y: str, xs: list[str], least: int = 15) -> DataFrame | None:
    """Least squares with an intercept and HC3 standard errors: one row a term (term, beta, se, z, p, n, r2); None below ``least`` rows.

    By orthogonal triangles, task by task and then together, so that columns far from zero or nearly collinear keep their digits: columns are centred, scaled, and
    then made orthonormal by the factor; leverages and the errors' sums are taken in those coordinates. Three passes; only sums and triangles reach the driver.
    """
    terms, k = ["const", *xs], len(xs) + 1
    data = df.select(F.col(y).cast("double").alias("__y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).na.drop()
    first = data.agg(F.count("*").alias("n"), *[f(c).alias(f"{m}_{c}") for c in data.columns for m, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    n = first["n"]
    if n < least:
        return None
    mean, sd = (np.array([first[f"{m}_{c}"] for c in data.columns], dtype=float) for m in ("mean", "sd"))
    sd = np.where(sd > 0, sd, 1.0)
    scaled = data.select(F.lit(1.0).alias("x_"), *[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(data.columns[1:], mean[1:], sd[1:], strict=True)], ((F.col("__y") - float(mean[0])) / float(sd[0])).alias("__y"))
    r = triangle(scaled)
    inverse = np.linalg.inv(r[:k, :k])  # triangular
    gamma = np.linalg.solve(r[:k, :k], r[:k, k])
    columns = scaled.columns[:k]
    q = [sum((F.col(c) * float(inverse[i, j]) for i, c in enumerate(columns[: j + 1])), F.lit(0.0)) for j in range(k)]
    rows = scaled.select((F.col("__y") - sum((F.col(c) * float(gamma[i]) for i, c in enumerate(columns)), F.lit(0.0))).alias("e"), "__y", *[x.alias(f"q{j}") for j, x in enumerate(q)])
    weight = (F.col("e") / (1 - sum((F.col(f"q{j}") ** 2 for j in range(k)), F.lit(0.0)))) ** 2
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.withColumn("w", weight).agg(F.sum(F.col("e") ** 2).alias("ssr"), F.sum(F.col("__y") ** 2).alias("total"), *[F.sum(F.col(f"q{i}") * F.col(f"q{j}") * F.col("w")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = sums[f"m{i}_{j}"]
    back = np.diag(sd[0] / np.concatenate([[1.0], sd[1:]]))  # from scaled columns to the given ones
    back[0, 1:] = -mean[1:] * sd[0] / sd[1:]
    beta = back @ gamma
    beta[0] += mean[0]
    half = back @ inverse
    se = np.sqrt(np.diag(half @ meat @ half.T))
    r2 = 1 - sums["ssr"] / sums["total"] if sums["total"] else None
    out = [(t, float(b), float(s), float(b / s), math.erfc(abs(b / s) / math.sqrt(2)), int(n), r2) for t, b, s in zip(terms, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, beta double, se double, z double, p double, n long, r2 double")


def prediction_grid(terms: dict[str, float], x: str, lo: float, hi: float, at: dict[str, float], points: int = 50) -> list[tuple[float, float]]:
    """(x, prediction) along one variable with the others held."""
    rest = terms["const"] + sum(terms[k] * v for k, v in at.items())
    return [(float(v), float(rest + terms[x] * v)) for v in np.linspace(lo, hi, points)]
