"""Ledgers and tables in CSV, and parts in Parquet: read as text, written back, extended row by row."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chargelens.sources import grid as G


def read_csv(spark: SparkSession, path: str | list[str], text_columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table with a header. All columns are text; with ``text_columns`` only these are (keys with leading zeros, say) and the others get the type that all their cells have.

    An empty cell is null. Quoted cells may hold line breaks. Files may have their columns in any order, or lack some: those are null there.
    """
    names = list(dict.fromkeys(c for p in ([path] if isinstance(path, str) else path) for c in spark.read.option("header", True).csv(p).columns))
    frames = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p) for p in ([path] if isinstance(path, str) else path)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if text_columns is None:
        return out.select(*[F.col(f"`{n}`") for n in names])
    whole, real = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    free = [n for n in names if n not in text_columns]
    fits = out.agg(*[f.alias(f"{k}_{i}") for i, n in enumerate(free) for k, f in (("w", F.coalesce(F.every(F.col(f"`{n}`").rlike(whole)), F.lit(False))), ("r", F.coalesce(F.every(F.col(f"`{n}`").rlike(real)), F.lit(False))))]).first() if free else {}
    kind = {n: "long" if fits[f"w_{i}"] else "double" if fits[f"r_{i}"] else "string" for i, n in enumerate(free)}
    return out.select(*[F.trim(F.col(f"`{n}`")).cast(kind[n]).alias(n) if kind.get(n, "string") != "string" else F.col(f"`{n}`") for n in names])


def empty_ledger(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of CSV files with a header each; with ``append`` rows are added to those that are there, null cells are empty."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_parts(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """All parts <prefix>_*.parquet of a folder as one table; a column that some parts lack is null there."""
    return spark.read.option("mergeSchema", True).parquet(posixpath.join(folder, f"{prefix}_*.parquet"))


def extract_archives(archives: DataFrame, wanted: str = r".") -> DataFrame:
    """(path, slot, member, length, content): the files inside ZIP archives, one slot (the archive's name) an archive.

    archives: path and content, as grid.files() gives them. Folders and members whose name doesn't match ``wanted`` are left out; a file that is no
    readable archive gives one row with a null member. Writing the rows is what extracts them; an anti join with the slots that are there skips what was extracted before.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                slot = posixpath.splitext(posixpath.basename(path))[0]
                try:
                    z = zipfile.ZipFile(io.BytesIO(data or b""))
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [path], "slot": [slot], "member": [info.filename], "length": [info.file_size], "content": [z.read(info)]})
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    yield pd.DataFrame({"path": [path], "slot": [slot], "member": [None], "length": [0], "content": [None]})

    found = archives.select("path", "content").mapInPandas(read, "path string, slot string, member string, length long, content binary")
    return found.where(F.col("member").isNull() | F.col("member").rlike(wanted))


def hospital_roots(all_files: DataFrame) -> DataFrame:
    """The chargemaster files of grid.chargemaster_files() with ``hospital_folder`` as the hospital's own folder.

    Below a year some archives have wrapper folders, one inside the other: as long as everything of a year is in one folder, that folder is a wrapper. The first level
    where a year has several entries is that of the hospitals.
    """
    files = G.chargemaster_files(all_files)
    parts = F.split(F.regexp_replace("path", r"^.*?/20\d{2}/", ""), "/")
    placed = files.withColumn("__parts", F.slice(parts, 1, F.size(parts) - 1))
    # How many leading folders all files of a year share: the smallest and the largest path tell.
    ends = placed.groupBy("year").agg(F.min(F.array_join("__parts", "/")).alias("low"), F.max(F.array_join("__parts", "/")).alias("high"))
    low, high = F.split("low", "/"), F.split("high", "/")
    differ = F.filter(F.sequence(F.lit(0), F.size(low)), lambda i: ~F.get(low, i).eqNullSafe(F.get(high, i)))
    depth = F.coalesce(F.get(differ, F.lit(0)), F.greatest(F.size(low) - 1, F.lit(0)))
    at = F.least(F.col("__depth"), F.greatest(F.size("__parts") - 1, F.lit(0)))
    out = placed.join(ends.select("year", depth.cast("int").alias("__depth")), "year")
    return out.withColumn("hospital_folder", F.coalesce(F.get("__parts", at), F.lit(""))).select(*files.columns)
