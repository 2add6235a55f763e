"""The queries opN_* and pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargelens.llm.common import crc_mod, table

#: Target weights of op2_source_mixing by source; any other source has the weight 1.
MIX_WEIGHTS = {"src0": 5.0, "src1": 3.0, "src2": 3.0, "src3": 1.5, "src4": 1.5, "src5": 0.25}
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS, default_weight=1.0)
    return mixed.select("doc_id", "source", "mix_seq", "mix_block", "mix_slot", "mix_position")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.language_id import language_id

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    return language_id(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "phrase_rate")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.toxicity import toxicity, with_labels

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    scored = toxicity(docs, with_labels(docs.where(~held_out), labels), texts=docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "ratio")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chargelens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.quality import quality

    held_out = crc_mod("doc_id", 5) == 0
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "logit")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chargelens.llm.fill_in_middle import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict:
    found = [op1_exact_dedup, op2_source_mixing, op3_ngram_jaccard, op4_language_id, op5_toxicity, op6_embedding_dedup, op7_packing, op8_suffix_dedup, op9_url_filter, op10_license_scan, op11_collocations, op12_quality, op13_fill_in_middle]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op6_embedding_dedup": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_license_scan": op10_sql(), "op11_collocations": OP11_SQL, "op13_fill_in_middle": OP13_SQL}


OP1_SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.t
"""

OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8::DOUBLE * (x.n + y.n - shared) - 1e-9
), reach AS (WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a) SELECT a, min(b) AS low FROM walk GROUP BY a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(r.low, d.doc_id)) AS class_id, coalesce(c.n, 0) AS n_links, d.doc_id = least(d.doc_id, coalesce(r.low, d.doc_id)) AS kept, coalesce(n.n, 0) AS n_shingles
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN counted c ON c.a = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a) SELECT a, min(b) AS low FROM walk GROUP BY a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN reach r ON r.a = e.vec_id
"""

def op9_sql() -> str:
    """Rules by their longest fit; addresses made absolute and plain, and classes walked, in SQL's own terms."""

    def attribute(tag: str, name: str) -> str:
        return rf"""trim(regexp_extract({tag}, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"'' ')"""

    def head(url: str) -> str:
        return f"regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1)"

    def absolute(to: str, base: str) -> str:
        path = f"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
        return rf"""CASE WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {to} WHEN starts_with({to}, '//') THEN regexp_extract({head(base)}, '(?s)^(.*?:)//', 1) || {to}
    WHEN starts_with({to}, '/') THEN {head(base)} || {to} WHEN starts_with({to}, '?') THEN {head(base)} || {path} || {to} WHEN starts_with({to}, '#') THEN {base} ELSE {head(base)} || regexp_extract({path}, '(?s)^(.*)/', 1) || '/' || {to} END"""

    def node(url: str) -> str:
        bare = f"regexp_replace({url}, '(?s)#.*$', '')"
        lower = f"translate({head(bare)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        path = f"regexp_extract({bare}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
        dots = rf"""CASE WHEN regexp_matches({path}, '/\.{{1,2}}(/|$)') THEN array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda kept, x: CASE WHEN x[1] = '.' THEN kept
    WHEN x[1] = '..' THEN CASE WHEN len(kept) > 1 THEN kept[:len(kept) - 1] ELSE kept END ELSE list_concat(kept, x) END), '/') || CASE WHEN regexp_matches({path}, '/\.{{1,2}}$') THEN '/' ELSE '' END ELSE {path} END"""
        return rf"""CASE WHEN position('://' IN {bare}) > 0 THEN regexp_replace(regexp_replace({lower}, '^(http://[^:]*):80$', '\1'), '^(https://[^:]*):443$', '\1') || {dots} || regexp_extract({bare}, '(?s)^.*?://[^/?]*[^?]*(\?.*)$', 1) END"""

    base_tag = r"coalesce(regexp_extract(html, '(?is)<base\b[^>]*>'), '')"
    return rf"""
WITH p AS (
  SELECT page_id, html, url AS whole, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS base FROM pages
), j AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    {node('whole')} AS node, base, whole, html FROM p
), tags AS (
  SELECT node, CASE WHEN stated = '' THEN whole ELSE {absolute('stated', 'whole')} END AS whole, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM (SELECT *, replace({attribute(base_tag, 'href')}, '&amp;', '&') AS stated FROM j) WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')
), parts AS (
  SELECT *, lower({attribute('tag', 'rel')}) AS rel, lower({attribute('tag', 'http-equiv')}) AS equiv, {attribute('tag', 'href')} AS href, regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS content FROM tags
), targets AS (
  SELECT node, whole, replace(href, '&amp;', '&') AS target FROM parts WHERE regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(rel, '\s+'), 'canonical')
  UNION ALL SELECT node, whole, replace(regexp_extract(substr(content, 2, length(content) - 2), '(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*[''"]?\s*([^''"\s]+)', 1), '&amp;', '&') FROM parts WHERE regexp_matches(tag, '(?i)^<meta') AND equiv = 'refresh'
), e AS (SELECT node AS a, {node('t')} AS b FROM (SELECT node, {absolute('target', 'whole')} AS t FROM targets WHERE target <> '')
), both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b
), urls AS (SELECT DISTINCT a AS url, coalesce(regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1), '') AS host, coalesce(regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM both_ways
), ruled AS (
  SELECT url, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'allow' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'block' END AS v FROM urls
), seen AS (
  SELECT r.a, bool_or(u.v = 'allow') AS allowed, bool_or(u.v = 'block') AS blocked
  FROM (WITH RECURSIVE walk(a, b) AS (SELECT url, url FROM urls UNION SELECT w.a, x.b FROM walk w JOIN both_ways x ON w.b = x.a) SELECT * FROM walk) r JOIN ruled u ON u.url = r.b GROUP BY r.a
)
SELECT j.page_id, j.host, j.path, j.rule, CASE
    WHEN j.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN j.rule IS NOT NULL THEN 'block'
    WHEN coalesce(s.allowed, FALSE) THEN 'allow' WHEN coalesce(s.blocked, FALSE) THEN 'block' ELSE 'allow' END AS verdict
FROM j LEFT JOIN seen s ON s.a = j.node
"""


OP9_SQL = op9_sql()


def op10_sql() -> str:
    """Words by regular expression; phrases by position; templates by the distinct words of every run of words."""
    import math

    from chargelens.llm.license_scan import BASE_PHRASES, TEMPLATES, block_words

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = " UNION ALL ".join(f"SELECT {p.split()!r} AS p, '{label}' AS label" for p, label in BASE_PHRASES)
    rows = ((label, sorted(set(t.split())), block_words(t, 1.25)) for label, t in TEMPLATES)
    templates = " UNION ALL ".join(f"SELECT {own!r} AS t, '{label}' AS label, {size} AS size, {math.ceil(0.8 * len(own) - 1e-9)} AS need" for label, own, size in rows)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered}, '{word}') AS w FROM documents),
phrases AS ({phrases}), templates AS ({templates}),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, p, unnest(range(1, len(w) + 1)) AS i FROM d, phrases WHERE list_contains(w, p[1])) WHERE w[i:i + len(p) - 1] = p
),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, label, need, t, w[i:i + size - 1] AS b FROM (SELECT doc_id, w, label, need, t, size, unnest(range(1, len(w) + 1)) AS i FROM d, templates WHERE len(list_intersect(w, t)) >= need)
  WHERE list_contains(t, w[i])
),
shares AS (SELECT doc_id, label, len(list_intersect(list_distinct(b), t)) AS n, need, len(t) AS size FROM blocks),
found AS (SELECT doc_id, label, n / size AS share FROM shares WHERE n >= need),
named AS (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM places),
all_labels AS (SELECT doc_id, array_to_string(list_sort(list(label)), ',') AS labels FROM named GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels, CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(x.share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base b USING (doc_id) LEFT JOIN all_labels a USING (doc_id) LEFT JOIN best x USING (doc_id)
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), runs AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) lengths(k) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL
), total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k >= 2 AND a >= 10
), cuts AS (SELECT *, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.head AND x.k = cut JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.tail AND y.k = cuts.k - cut
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covered AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c g ON g.lang = s.lang AND g.k > s.k AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.a >= 50 * s.a
), kept AS (SELECT * FROM lowest ANTI JOIN covered USING (lang, phrase)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM documents
), h AS (
  SELECT *, len(lines) AS n, ('0x' || sha[1:8])::BIGINT AS h1, ('0x' || sha[9:16])::BIGINT AS h2, ('0x' || sha[17:24])::BIGINT AS h3, ('0x' || sha[25:32])::BIGINT AS h4 FROM d
), c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
