"""Ledger rules: outcomes of downloads, links and parses, and the merges that keep one row a hospital. Each is a join on the ledger's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.functions.text import looks_like_html
from chargelens.operators.relational import upsert

LEAST_BYTES, LEAST_PAGE_BYTES, LEAST_PORTAL_BYTES = 1024, 10 * 1024, 5000
# Content types and endings of price files; statuses of a file that is there.
FILE_TYPES = ("text/csv", "text/plain", "application/csv", "application/json", "application/xml", "text/xml", "application/octet-stream")
FILE_ENDINGS = ("json", "csv", "xml", "jsonl", "gz", "zip")
PRESENT = ("ok", "already_present")


def download_outcome(http: Column, size: Column, content_type: Column) -> Column:
    """http_N, too_small, html_response or ok. A page is too small below 10 KB, another file below 1 KB; no status is an error."""
    page = F.lower(F.coalesce(content_type, F.lit(""))).startswith("text/html")
    small = F.coalesce(size, F.lit(0)) < F.when(page, LEAST_PAGE_BYTES).otherwise(LEAST_BYTES)
    return F.when(http.isNull(), "error").when(http != 200, F.concat(F.lit("http_"), http.cast("string"))).when(small, "too_small").when(page, "html_response").otherwise("ok")


def link_is_file(http: Column, content_type: Column, url: Column) -> Column:
    """A 200 with a file's content type or none; of other types, except pages, a file's ending decides."""
    kind = F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    known = kind.rlike("^(" + "|".join(FILE_TYPES) + ")") | (kind == "")
    ending = F.substring_index(F.substring_index(F.lower(url), "?", 1), ".", -1).isin(*FILE_ENDINGS)
    return F.coalesce((http == 200) & ~kind.startswith("text/html") & (known | ending), F.lit(False))


def parse_status(file_format: Column, done: Column, failed: Column) -> Column:
    """resume_skip, skip:format, xlsx_failed, parse_failed or ok."""
    parsed = file_format.isin("json", "csv_tall", "csv_wide", "csv_minimal", "xlsx")
    broken = F.when(failed, F.when(file_format == "xlsx", "xlsx_failed").otherwise("parse_failed"))
    return F.coalesce(F.when(done, "resume_skip"), F.when(~parsed, F.concat(F.lit("skip:"), file_format)), broken, F.lit("ok"))


def exempt(ledger: DataFrame, exemptions: DataFrame, universe: DataFrame, key: str = "ccn") -> DataFrame:
    """Exemptions replace the ledger's rows; those of unknown keys are skipped."""
    return upsert(ledger, exemptions.join(universe.select(key).distinct(), key, "left_semi"), key)


def federal_method(owner: Column) -> Column:
    """Exemption of federal hospitals by ownership, else null."""
    name = F.lower(owner)
    return F.when(name.contains("veterans health"), "exempt:federal_va").when(name.contains("department of defense"), "exempt:federal_dod")


def reclassify_landing(downloads: DataFrame, links: DataFrame, heads: DataFrame, key: str = "ccn") -> tuple[DataFrame, DataFrame]:
    """(downloads, links) with files that begin as pages flipped to html_landing, their links to exempt:portal_landing. ``heads``: (key, head)."""
    pages = heads.filter(looks_like_html(F.col("head"))).select(key).distinct().withColumn("landing", F.lit(True))
    good = F.col("status").isin(*PRESENT)
    flipped = downloads.join(pages, key, "left").withColumn("status", F.when(F.col("landing") & good, "html_landing").otherwise(F.col("status")))
    hit = flipped.filter("status = 'html_landing' AND landing").select(key).distinct().withColumn("hit", F.lit(True))
    moved = links.join(hit, key, "left").withColumn("discovery_method", F.when(F.col("hit"), "exempt:portal_landing").otherwise(F.col("discovery_method")))
    return flipped.select(*downloads.columns), moved.select(*links.columns)


def seed_merge(new: DataFrame, old: DataFrame, downloaded: DataFrame, key: str = "ccn") -> DataFrame:
    """One row a key: exempt old rows win; an old row stays where the new one has no link and a file is there; else the new one, else the old.

    Each input has one row a key, so one full join decides."""
    n, o = new.select(key, F.struct(*new.columns).alias("n")), old.select(key, F.struct(*new.columns).alias("o"))
    have = downloaded.filter(F.col("status").isin(*PRESENT)).select(key).distinct().withColumn("have", F.lit(True))
    both = n.join(o, key, "full").join(have, key, "left")
    keep_old = F.coalesce(F.col("o.discovery_method").startswith("exempt"), F.lit(False)) | F.col("n").isNull() | (F.col("n.mrf_url").isNull() & F.coalesce("have", F.lit(False)) & F.col("o").isNotNull())
    lost = F.col("n.mrf_url").isNull() & F.coalesce("have", F.lit(False)) & F.col("o").isNull() & F.col("n").isNotNull()
    return both.filter(~lost).select(F.when(keep_old, F.col("o")).otherwise(F.col("n")).alias("r")).select("r.*")


def upload_actions(uploads: DataFrame, placed: DataFrame, hospitals: DataFrame, key: str = "ccn") -> DataFrame:
    """What to do with each (key, file, size) upload: duplicate if the same name and size is placed, unknown without a hospital, else move."""
    there = placed.select(key, "file", F.col("size").alias("placed_size"))
    known = hospitals.select(key).distinct().withColumn("known", F.lit(True))
    same = F.coalesce(F.col("placed_size") == F.col("size"), F.lit(False))
    action = F.when(F.col("known").isNull(), "unknown").when(same, "duplicate").otherwise("move")
    return uploads.join(there, [key, "file"], "left").join(known, key, "left").select(*uploads.columns, action.alias("action"))


def portal_file(size: Column, head: Column) -> Column:
    return (size >= LEAST_PORTAL_BYTES) & ~looks_like_html(head)


def tallies(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
