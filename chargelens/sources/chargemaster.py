"""Chargemaster sheets: the header found by score, column roles by name or by the share of valid codes, one row a code and charge.

Column samples are limited to 500 cells a column by rank, which Spark applies before the shuffle."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargelens.functions import text as T
from chargelens.operators.staging import staged
from chargelens.sources import grid as G
from chargelens.sources.price_files import strip

SHEET = ["path", "sheet"]
SAMPLE, LEAST_SAMPLE, SNIFF_RATE, AMBIGUOUS_RATE, HEADER_SCAN, SCORE_ROWS = 500, 50, 0.30, 0.50, 30, 50


def lines(source: DataFrame) -> DataFrame:
    """Cells of the sheets whose name is not dropped; empty cells are null. Worth writing as a table when it is parsed: it is read three times."""
    return G.grid(source, table=True).filter(~F.col("sheet").rlike(G.SHEET_NOT)).withColumn("cells", G.blank_to_null(F.col("cells")))


def header_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, header_row, header): the best score of the first 30 rows, the first of equals."""
    best = F.max_by(F.struct("row_idx", "cells"), F.struct(T.header_score(F.col("cells")), -F.col("row_idx")))
    found = cells.filter(F.col("row_idx") < HEADER_SCAN).groupBy(*SHEET).agg(best.alias("b"))
    return found.select(*SHEET, F.col("b.row_idx").alias("header_row"), F.col("b.cells").alias("header"))


def _samples(body: DataFrame) -> DataFrame:
    """Per column: sampled cells, those that are CPT or HCPCS codes, and whether one of the first 50 rows holds a valid code of the column's family."""
    cells = body.select(*SHEET, "row_idx", "header_row", "header", F.posexplode("cells").alias("pos", "cell")).filter("cell IS NOT NULL")
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(*SHEET, "pos").orderBy("row_idx"))).filter(F.col("rank") <= SAMPLE)
    code, family = T.normalize_code(F.col("cell")), T.classify_code_column(F.get("header", F.col("pos")))
    known = T.detect_code_type(code).isNotNull()
    early = (F.col("row_idx") <= F.col("header_row") + SCORE_ROWS) & F.when(family.isNull(), known).otherwise(T.validate_code(code, family).isNotNull())
    return ranked.groupBy(*SHEET, "pos").agg(F.count("*").alias("n"), F.count_if(known).alias("hits"), F.max(early).alias("early"))


def layouts(cells: DataFrame) -> DataFrame:
    """(path, sheet, header_row, codes, charges, description_at, unit_at, n_rows, status) of each sheet."""
    body = cells.join(header_rows(cells), SHEET).filter("row_idx > header_row")
    sizes = cells.groupBy(*SHEET).agg(F.max(F.size("cells")).alias("width"))
    counts = body.groupBy(*SHEET).agg(F.count("*").alias("n_rows"))
    sheets = header_rows(cells).join(sizes, SHEET).join(counts, SHEET, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    name = F.coalesce(strip_or_null(F.get("header", F.col("pos"))), F.concat(F.lit("_col"), "pos"))
    columns = sheets.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("name", name)
    columns = columns.join(_samples(body), [*SHEET, "pos"], "left").withColumn("rate", F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)))
    columns = columns.withColumn("family", T.classify_code_column(F.col("name"))).withColumn("is_charge", T.is_charge_column(F.col("name")))
    part = F.struct("pos", "name", "family", "rate", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("early", F.lit(False)).alias("early"), "is_charge")
    found = columns.groupBy(*SHEET, "header_row", "width", "n_rows").agg(F.sort_array(F.collect_list(part)).alias("c"))
    named, specific = F.exists("c", lambda x: x["family"].isNotNull()), F.exists("c", lambda x: x["family"].isNotNull() & (x["family"] != "AMBIG"))
    ambiguous = lambda x: x["family"].isNull() & (x["n"] >= LEAST_SAMPLE) & (x["rate"] >= SNIFF_RATE)
    code = F.when(specific, F.filter("c", lambda x: x["family"].isNotNull() & (x["family"] != "AMBIG")))
    code = code.when(named, F.filter("c", lambda x: (x["family"] == "AMBIG") & (x["rate"] >= AMBIGUOUS_RATE))).otherwise(F.filter("c", ambiguous))
    at = lambda pattern: F.get(F.filter("c", lambda x: x["name"].rlike(pattern)), F.lit(0))["pos"]
    score = (F.col("width") >= 3).cast("int") + (F.col("width") >= 5).cast("int") + 2 * named.cast("int") + 2 * F.exists("c", lambda x: x["early"]).cast("int")
    found = found.withColumns({
        "codes": F.transform(code, lambda x: F.struct(x["pos"].alias("pos"), F.coalesce(x["family"], F.lit("AMBIG")).alias("family"))),
        "charges": F.transform(F.filter("c", lambda x: x["is_charge"]), lambda x: F.struct(x["pos"].alias("pos"), x["name"].alias("name"))),
        "description_at": at(T.DESCRIPTION_COLUMN), "unit_at": at(T.UNIT_COLUMN), "score": F.when(F.col("n_rows") > 0, score).otherwise(0),
    })
    status = F.when(F.col("score") < 2, "low_score").when(F.size("codes") == 0, "no_code_col").when(F.size("charges") == 0, "no_charge_col").otherwise("ok")
    return found.select(*SHEET, "header_row", "codes", "charges", "description_at", "unit_at", "n_rows", status.alias("status"))


def strip_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), strip(c))


def parse(cells: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, log). ``owners``: (path, year, hospital_folder) as ``grid.chargemaster_files`` gives them.

    A row for each valid code and each charge cell that isn't empty, with the charge null where it is no number. The log has a row a sheet, and one with the
    status unreadable for each file of ``owners`` that gave no sheet at all."""
    shapes = layouts(cells)
    body = cells.join(shapes.filter("status = 'ok'"), SHEET).filter("row_idx > header_row").join(owners.select("path", "year", "hospital_folder"), "path")
    coded = body.withColumn("code", F.explode("codes")).withColumn("procedure_code", T.normalize_code(F.get("cells", F.col("code.pos"))))
    coded = coded.withColumn("code_type", T.validate_code(F.col("procedure_code"), F.col("code.family"))).filter("code_type IS NOT NULL")
    priced = coded.withColumn("ch", F.explode("charges")).withColumn("raw", F.get("cells", F.col("ch.pos"))).filter("raw IS NOT NULL")
    words = lambda c, n: F.substring(strip(F.get("cells", F.col(c))), 1, n)
    rows = priced.select(
        "year", T.facility_id(F.element_at(F.split("path", "/"), -1)).alias("oshpd_id"), "hospital_folder", F.col("path").alias("file_source"), F.col("sheet").alias("sheet_name"), "header_row",
        "code_type", "procedure_code", words("description_at", 500).alias("description"), F.substring(strip(F.regexp_replace("ch.name", r"\s+", " ")), 1, 80).alias("charge_column"),
        F.substring("raw", 1, 100).alias("charge_raw"), T.clean_charge(F.col("raw")).alias("charge"), T.setting_from_column(F.col("ch.name")).alias("setting"), words("unit_at", 60).alias("unit"),
    )
    matched = rows.groupBy(F.col("file_source").alias("path"), F.col("sheet_name").alias("sheet")).agg(F.count("*").alias("n_matches"))
    log = shapes.join(matched, SHEET, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    log = log.withColumn("status", F.when((F.col("status") == "ok") & (F.col("n_matches") == 0), "no_matches").otherwise(F.col("status")))
    lost = owners.select("path").distinct().join(shapes.select("path").distinct(), "path", "left_anti").withColumn("status", F.lit("unreadable")).withColumn("n_matches", F.lit(0).cast("long"))
    return rows, log.unionByName(lost, allowMissingColumns=True)


def write_by_year(rows: DataFrame, path: str, resume: bool = False) -> None:
    """One folder a year; only the years among the rows are replaced. With ``resume`` a year's old rows stay, but for those of files that are among the new rows.

    Rows of a file are sorted by facility, code and setting, nulls last.
    """
    spark, years = rows.sparkSession, rows.select("year").distinct()
    if resume:
        try:
            old = spark.read.parquet(path)
        except AnalysisException:  # nothing there yet
            old = None
        if old is not None:
            kept = old.join(years, "year", "left_semi").join(rows.select("file_source").distinct(), "file_source", "left_anti")
            rows = staged(rows.unionByName(kept, allowMissingColumns=True))  # written before its source is replaced
    order = [F.asc_nulls_last(c) for c in ("year", "oshpd_id", "procedure_code", "setting")]
    rows.repartition("year", "file_source").sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def read_by_year(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The tables that publish_by_year() published last, or as of a ``version``; None where nothing was."""
    try:
        pointers = spark.read.parquet(f"{path}/pointers")
    except AnalysisException:
        return None
    last = pointers.agg(F.max("version")).first()[0] if version is None else version
    folders: dict[str, list[int]] = {}
    for row in pointers.where(F.col("version") == last).collect():  # a row a year
        folders.setdefault(row["folder"], []).append(row["year"])
    out = None
    for folder, years in sorted(folders.items()):
        part = spark.read.parquet(f"{path}/data/{folder}").where(F.col("year").isin(years))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def publish_by_year(rows: DataFrame, path: str, resume: bool = False) -> int:
    """Like write_by_year(), but all years at once or none: returns the version that readers see from then on.

    The years among the rows are written to a folder of their own, and then one small file says which folder holds which year; the years not among
    the rows stay where they are. A run that ends before that file is there leaves the version before it, whole; its folder is read by nobody.
    Two runs at the same time must not publish to one path.
    """
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    old = read_by_year(spark, path)
    if resume and old is not None:
        kept = old.join(rows.select("year").distinct(), "year", "left_semi").join(rows.select("file_source").distinct(), "file_source", "left_anti")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    order = [F.asc_nulls_last(c) for c in ("year", "oshpd_id", "procedure_code", "setting")]
    rows.repartition("year", "file_source").sortWithinPartitions(*order).write.partitionBy("year").parquet(f"{path}/data/{folder}")
    written = spark.read.parquet(f"{path}/data/{folder}").select("year").distinct()
    version = 1
    pointers = written.withColumn("folder", F.lit(folder))
    if old is not None:
        known = spark.read.parquet(f"{path}/pointers")
        last = known.agg(F.max("version")).first()[0]
        version = last + 1
        pointers = pointers.unionByName(known.where(F.col("version") == last).select("year", "folder").join(written, "year", "left_anti"))
    pointers.coalesce(1).write.parquet(f"{path}/pointers/version={version}")  # one file, renamed into place
    return version
