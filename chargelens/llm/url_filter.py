"""URL block lists with redirect equivalence.

Explicit rules decide first. Redirect (meta refresh) and canonical-link edges of the pages join urls into classes, found
as distributed connected components; a class passes its members' explicit decisions to those that no rule fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import components, cut, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path after the first "://".
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINKS, _METAS = r"(?is)(<link\b[^>]*>)", r"(?is)(<meta\b[^>]*>)"
_REFRESH = r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*['\"]?\s*([^'\"\s]+)"
# Character references that occur in urls.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. rules: (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _head(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments; .. takes the segment before it away, if there is one."""
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)).otherwise(F.concat(kept, F.array(x)))
    plain = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(plain, F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))).otherwise(path)


def node_of(url: Column) -> Column:
    """What makes a url one page: no fragment, scheme and host in lower case, no port that the scheme has anyway, no . and .. segments. Null without "://"."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.regexp_replace(F.translate(_head(bare), _UPPER, _LOWER), r"^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2")
    query = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*[^?]*(\?.*)$", 1)
    return F.when(bare.contains("://"), F.concat(head, _without_dots(F.regexp_extract(bare, _URL, 2)), query))


def absolute(to: Column, base: Column) -> Column:
    """An address as it stands in a page whose address is ``base``."""
    head, path = _head(base), F.regexp_extract(base, _URL, 2)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*)/", 1), F.lit("/"))
    out = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.regexp_extract(head, r"(?s)^(.*?:)//", 1), to)).when(to.startswith("/"), F.concat(head, to))
    return out.when(to.startswith("?"), F.concat(head, path, to)).when(to.startswith("#"), base).otherwise(F.concat(head, folder, to))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in double quotes, single quotes or none; null where it isn't there."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    value = F.when(found.rlike("^[\"']"), F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)
    for reference, character in _REFERENCES:
        value = F.replace(value, F.lit(reference), F.lit(character))
    return F.when(found != "", F.trim(value))


def link_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst) nodes: every canonical link and every meta refresh of each page, made absolute.

    A ``rel`` is a list of words; one of them has to be canonical. An address without a scheme is relative to the page, or to the first ``base`` it states.
    """
    some = pages.where(F.col(html).rlike("(?i)canonical|refresh") & F.col(url).contains("://"))
    link = lambda tag: F.when(F.array_contains(F.split(F.lower(F.coalesce(_attribute(tag, "rel"), F.lit(""))), r"\s+"), "canonical"), _attribute(tag, "href"))
    meta = lambda tag: F.when(F.lower(_attribute(tag, "http-equiv")) == "refresh", F.regexp_extract(_attribute(tag, "content"), _REFRESH, 1))
    to = F.concat(F.transform(F.regexp_extract_all(F.col(html), F.lit(_LINKS), 1), link), F.transform(F.regexp_extract_all(F.col(html), F.lit(_METAS), 1), meta))
    stated = _attribute(F.regexp_extract(F.col(html), r"(?is)<base\b[^>]*>", 0), "href")
    base = F.when(stated.isNull(), F.col(url)).otherwise(absolute(stated, F.col(url)))
    found = some.select(F.col(url).alias("src"), base.alias("base"), F.explode(F.array_distinct(to)).alias("to")).where("to <> ''")
    return found.select(node_of(F.col("src")).alias("src"), node_of(absolute(F.col("to"), F.col("base"))).alias("dst")).where("src <> dst")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, component (the smallest url of the page's class; null where no edge touches the url).

    The longest rule that fits the host (or a parent domain) and the path's beginning decides. A page without one takes
    its class's decision: allow if a member is explicitly allowed, else block if one is blocked, else allow; members are
    the urls of redirect and canonical edges, whether crawled or only linked to. A null url, or one without "://", has an
    empty host and path, fits no rule, belongs to no class and is allowed. Repeated pages repeat; a null html has no edges. An empty table stays
    empty. Other columns are ignored. ``edges`` (src, dst) adds known redirects to those found in the html. Urls are compared
    as they are (see node_of), never by a hash: each url of an edge gets a number of its own.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("hit", rule_column(F.col("host"), F.col("path"), rules))
    found = link_edges(pages, url_col, html_col)
    if edges is not None:
        found = found.unionByName(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src <> dst"))
    found = saved(found.distinct())
    if found.isEmpty():
        return judged.select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    nodes = saved(found.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))  # written, so that a number stays
    number = lambda end, name: nodes.select(F.col("node").alias(end), F.col("id").alias(name))
    classes = cut(components(found.join(number("src", "a"), "src").join(number("dst", "b"), "dst").select("a", "b")))
    verdict = rule_column(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    placed = nodes.withColumn("v", verdict).join(classes, "id")
    of_class = placed.groupBy("component").agg(F.min("node").alias("name"), F.max((F.col("v") == "allow").cast("int")).alias("allowed"), F.max((F.col("v") == "block").cast("int")).alias("blocked"))
    class_verdict = F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").otherwise("allow")
    passed = cut(placed.join(cut(of_class), "component").select("node", "name", class_verdict.alias("class_verdict")))
    out = judged.join(passed, "node", "left")
    return out.select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", "class_verdict", F.lit("allow")).alias("verdict"), F.col("name").alias("component"))
