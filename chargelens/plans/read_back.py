"""Queries over files that Spark writes from given tables and the readers of large files read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargelens.operators.staging import shared_folder
from chargelens.plans import views as V
from chargelens.plans.registry import query
from chargelens.sources import grid, price_files, ranges

#: Small, so that small tables too are read in several ranges.
_RANGE = 256 << 10


def _put(df: DataFrame, kind: str, **options) -> str:
    path = f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


@query("SELECT doc_id, source, lang, md5(coalesce(text, '')) AS text_md5, 4 AS n_cells FROM documents")
def csv_in_ranges(s, d):
    """Texts with line ends, commas and quotes, written as CSV and read back in ranges that begin anywhere in them."""
    docs = V.t(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    path = _put(docs, "csv", quoteAll=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    cells = ranges.csv_grid(ranges.listing(s, path, "*.csv"), size=_RANGE)
    at = lambda i: F.get("cells", F.lit(i))
    return cells.select(at(0).cast("long").alias("doc_id"), at(1).alias("source"), at(2).alias("lang"), F.md5(at(3)).alias("text_md5"), F.size("cells").alias("n_cells"))


def _wrapped(rows: DataFrame, group, order: str, item, head, tail) -> DataFrame:
    """(g, value): the lines of one JSON file a group: ``head``, the items with a comma each, ``tail``."""
    own = rows.select(group.alias("g"), F.col(order).cast("long").alias("at"), F.concat(item, F.lit(",")).alias("value"))
    ends = own.select("g").distinct().select("g", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("at"), head.alias("value")), F.struct(F.lit((1 << 62)).alias("at"), tail.alias("value")))).alias("e")).select("g", "e.at", "e.value")
    return own.unionByName(ends).repartition("g").sortWithinPartitions("g", "at").select("g", "value")


@query("SELECT page_id, md5(html) AS html_md5, url FROM pages WHERE html IS NOT NULL")
def json_in_ranges(s, d):
    """Pages as elements of a top-level array, one file a group of them, read back in ranges that begin anywhere in their strings."""
    pages = V.t(s, d, "pages").where("html is not null")
    item = F.to_json(F.struct("page_id", "url", "html"))
    files = _wrapped(pages, (F.col("page_id") % 7).alias("g"), "page_id", item, F.lit('{"note": "a \\"pages\\": [ in text", "x": [[1], {"pages": [0]}], "pages": ['), F.lit('{"page_id": null}], "after": [1]}'))
    path = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
    files.write.partitionBy("g").text(path)
    items = ranges.json_items(ranges.listing(s, path, "*.txt"), "pages", size=_RANGE)
    row = F.from_json("item", "page_id long, url string, html string")
    return items.select(row.alias("r")).where("r.page_id is not null").select("r.page_id", F.md5("r.html").alias("html_md5"), "r.url")


@query("""WITH c AS (SELECT *, c_custkey % 5 AS form FROM customer)
SELECT c_custkey, CASE form WHEN 0 THEN (3000000000 + c_custkey)::VARCHAR WHEN 1 THEN (3000000000 + c_custkey)::VARCHAR || ' ' || (4000000000 + c_custkey)::VARCHAR WHEN 2 THEN (4000000000 + c_custkey)::VARCHAR WHEN 3 THEN (5000000000 + c_custkey)::VARCHAR ELSE '' END AS numbers FROM c""")
def provider_numbers_in_heads(s, d):
    """Price files' heads, one a customer: the fields of provider numbers are tried in order, in JSON and in CSV."""
    k, form = F.col("c_custkey"), F.col("c_custkey") % 5
    n = lambda base: (k + base).cast("string")
    three, four, five = n(3_000_000_000), n(4_000_000_000), n(5_000_000_000)
    head = F.when(form == 0, F.concat(F.lit('{"npi": "'), four, F.lit('", "Type_2_NPI": "'), three, F.lit('"}')))
    head = head.when(form == 1, F.concat(F.lit('{"type_2_npi" : ["'), three, F.lit('", "'), four, F.lit('", "'), three, F.lit('"], "npi": "'), five, F.lit('"}')))
    head = head.when(form == 2, F.concat(F.lit("hospital_name,npi,hospital_npi\nA,"), three, F.lit(","), four, F.lit("\n1,2,3\n")))
    head = head.when(form == 3, F.concat(F.lit("hospital_name,notes\nA,npi "), five, F.lit(" of the hospital\n"))).otherwise(F.concat(F.lit('{"npi": '), three, F.lit("}")))
    rows = V.t(s, d, "customer").select(k.cast("string").alias("path"), F.length(head).cast("long").alias("length"), F.encode(head, "utf-8").alias("content"))
    found = price_files.identifiers(grid.heads(rows))
    return found.select(F.col("path").cast("long").alias("c_custkey"), F.array_join("numbers", " ").alias("numbers"))
