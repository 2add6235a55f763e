"""Matching of facilities by name, registry lookups in passes, identifiers with provenance, and link scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargelens.functions.text import name_similarity, normalize_name, pad_zip, registry_name
from chargelens.operators.staging import staged

# What a hospital type is called in the registry, in the order tried.
TYPE_TAXONOMIES = {
    "Acute Care Hospitals": ("General Acute Care Hospital",),
    "Acute Care - Department of Defense": ("Military Hospital", "General Acute Care Hospital"),
    "Acute Care - Veterans Administration": ("Military Hospital", "General Acute Care Hospital"),
    "Critical Access Hospitals": ("Critical Access Hospital", "General Acute Care Hospital"),
    "Childrens": ("Children", "General Acute Care Hospital"),
    "Psychiatric": ("Psychiatric Hospital", "Psychiatric"),
    "Rural Emergency Hospital": ("Rural Emergency Hospital", "General Acute Care Hospital"),
}
# Words in the names of organisations that own or manage hospitals but aren't one.
CORPORATE_WORDS = ("MANAGEMENT", "HOLDINGS", "HOLDING", "INVESTMENTS", "INVESTMENT", "PROPERTIES", "PARTNERS", "ENTERPRISES", "REAL ESTATE", "INSURANCE", "CONSULTING")
#: The characters of names, from rare to frequent; all others count as one. Any order gives the same pairs, this one gives fewer candidates.
_RARE_FIRST = "0123456789ZQJXKVWBFGYPMUDHCLSTNIROAE "
_KINDS = len(_RARE_FIRST) + 1
#: Below this similarity two names may match without a letter pair in common.
_PAIRS_FROM = 0.74
#: Similarities at which names are looked for before the least that counts: what has a name at one isn't compared at the next.
_HIGH_STEPS = (0.85, 0.75)
_CODES = ("__la", "__lc", "__sa", "__sc", "__pa", "__pc")


def is_corporate(name: Column) -> Column:
    return F.coalesce(F.upper(name).rlike("|".join(CORPORATE_WORDS)), F.lit(False))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where ``f`` may name the value many times, in functions of array elements too: it is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numbered(codes: Column) -> Column:
    """Codes with their occurrences, in order: two names share as many of these as they have codes in common."""
    seen = lambda all_, x, i: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda y: y == x))
    return _once(codes, lambda all_: F.array_sort(F.transform(all_, lambda x, i: x * 1024 + F.least(seen(all_, x, i), F.lit(1023)))))


def _codes(name: Column) -> Column:
    return F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.instr(F.lit(_RARE_FIRST), c))


def _letters(name: Column) -> Column:
    """The characters of a name as numbers, rare ones first."""
    return _numbered(_codes(name))


def _two_in_a_row(name: Column) -> Column:
    return _once(_codes(name), lambda code: F.transform(F.slice(code, 1, F.greatest(F.size(code) - 1, F.lit(0))), lambda x, i: x * _KINDS + F.get(code, i + 1)))


def _letter_pairs(name: Column, ranks: list[int]) -> Column:
    """Each two characters in a row as the rank of their frequency."""
    return _once(F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<int>"), lambda table: _numbered(F.transform(_two_in_a_row(name), lambda x: F.get(table, x))))


def _ranks(names: DataFrame) -> list[int]:
    """The rank of each letter pair, rare first, in the ``names`` (one column). There are 38 x 38 pairs, whatever the names."""
    two = names.select(F.explode(_two_in_a_row(F.col(names.columns[0]))).alias("p"))
    count = {r["p"]: r["n"] for r in two.groupBy("p").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(_KINDS * _KINDS), key=lambda p: (count.get(p, 0), p))
    ranks = [0] * len(order)
    for rank, p in enumerate(order):
        ranks[p] = rank
    return ranks


def _coded(rows: DataFrame, name: str, side: str, ranks: list[int]) -> DataFrame:
    """``rows`` with the letters, size and letter pairs of a name, each name coded once. Written, so that no later step codes it again."""
    own = rows.select(name).distinct().withColumn(f"__l{side}", _letters(F.col(name))).withColumn(f"__s{side}", F.size(f"__l{side}"))
    return staged(rows.join(own.withColumn(f"__p{side}", _letter_pairs(F.col(name), ranks)), name))


def candidate_pairs(left: DataFrame, right: DataFrame, on: list[str], least: float) -> DataFrame:
    """(k, o and the other columns) of the pairs of names that may have a similarity of ``least`` or more, in the same ``on``, each once.

    left: k, n, on ...; right: o, m, on ... A similarity t of names of a and b letters needs M = t (a + b) / 2 letters in common, in the same order, so at
    most (1 - t) (a + b) are inserted or deleted. Each of those breaks two letter pairs of its own name at most and one of the other's, which leaves
    3 M - a - b - 1 in common. Where that is two or more, the two first common pairs, in one order of all pairs, are among the first of either name, all but as many as
    are in common and two more: names meet by two pairs, rare ones first. Names too short for that, and all where t is below 0.74, meet by one of their rarest
    letters. What meets must have the lengths, letters, letter pairs and edit distance that ``least`` needs, all of which Spark tells without Python.
    """
    ranks = _ranks(left.select(F.col("n").alias("x")).unionByName(right.select(F.col("m").alias("x")))) if least >= _PAIRS_FROM else [0] * (_KINDS * _KINDS)
    return _meeting(_coded(left, "n", "a", ranks), _coded(right, "m", "c", ranks), on, least).drop(*_CODES)


def _meeting(a: DataFrame, c: DataFrame, on: list[str], least: float, all_of_on: bool = False) -> DataFrame:
    """candidate_pairs() of coded names. ``all_of_on``: all names of the same ``on`` meet, which is cheaper where few have it."""
    need, by_pairs = least / (2 - least), least >= _PAIRS_FROM
    lead = 1.5 * least - 1
    short = F.lit(3 / lead) if by_pairs else F.lit(float("inf"))  # names of fewer letters together may have less than two pairs in common

    def first_letters(side: str) -> Column:
        size = F.col(f"__s{side}")
        return F.slice(f"__l{side}", 1, F.greatest(F.lit(1), size - F.ceil(size * need - 1e-9).cast("int") + 1))

    def first_pairs(side: str) -> Column:
        size = F.col(f"__s{side}")
        common = F.greatest(F.lit(2), F.ceil(lead * (size + F.ceil(size * need - 1e-9)) - 1 - 1e-9).cast("int"))
        return F.slice(f"__p{side}", 1, F.greatest(F.lit(0), F.size(f"__p{side}") - common + 2))

    total = F.col("__sa") + F.col("__sc")
    low, high = F.least("__sa", "__sc"), F.greatest("__sa", "__sc")
    lengths = low >= high * need - 1e-9

    def meeting(of, keys, together: int) -> DataFrame:
        """Pairs whose prefixes have a key in common, in the row of their first one."""
        x = a.withColumn("__fa", of("a")).withColumn("__t", F.explode(keys(F.col("__fa"), F.col("__sa"))))
        y = c.withColumn("__fc", of("c")).withColumn("__t", F.explode(keys(F.col("__fc"), F.col("__sc"))))
        both = F.slice(F.array_intersect("__fa", "__fc"), 1, together)
        once = F.col("__t") == (both if together > 1 else F.coalesce(F.get(both, F.lit(0)), F.lit(0)))
        return x.join(y, [*on, "__t"]).where(lengths & once).drop("__t", "__fa", "__fc")

    one = lambda first, size: F.when(size == 0, F.array(F.lit(0))).when(size < short, first)
    if all_of_on:
        met = a.join(c, on).where(lengths)
    else:
        met = meeting(first_letters, one, 1)
    if by_pairs and not all_of_on:
        met = met.where(total < short)
        two = lambda first, size: F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda y: F.array(x, y))))
        met = met.unionByName(meeting(first_pairs, two, 2).where(total >= short))
    letters = 2 * F.size(F.array_intersect("__la", "__lc")) >= least * total - 1e-9
    if by_pairs:
        letters &= F.size(F.array_intersect("__pa", "__pc")) >= 3 * F.ceil(least * total / 2 - 1e-9) - total - 1
    distance = F.floor((1 - least) * total + 1e-9).cast("int")
    return met.where((total == 0) | (letters & (F.levenshtein("n", "m") <= distance)))


def similar_pairs(left: DataFrame, right: DataFrame, on: list[str], least: float, order: tuple[str, str] = ("m", "n")) -> DataFrame:
    """candidate_pairs() whose names, compared in this ``order``, have a similarity (``score``) of ``least`` or more. No such pair is lost."""
    return candidate_pairs(left, right, on, least).withColumn("score", name_similarity(*order)).where(F.col("score") >= least)


def _best(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def best_names(left: DataFrame, right: DataFrame, on: list[str], steps: Sequence[float], order: tuple[str, str] = ("m", "n"), all_of_on: bool = False) -> DataFrame:
    """(on ..., n, best, score): for each name of ``left`` the most similar one of ``right`` in the same ``on``, if it reaches the last of the falling ``steps``.

    left: on ..., n. right: on ..., m, best (anything that has an order; of equal scores the smallest counts). A name counts once, however often it comes:
    equal names are joined, the others compared at falling thresholds, each two names once, in however many ``on`` they meet. No null in ``on`` matches.
    ``all_of_on``: where few names have the same ``on``, as of a ZIP; else they meet as in candidate_pairs().
    """
    names = staged(right.groupBy(*on, "m").agg(F.min("best").alias("best")))
    own = left.select(*on, "n").dropna(subset=on) if on else left.select("n")
    same = staged(own.distinct().join(names.withColumnRenamed("m", "n"), [*on, "n"], "left"))
    found, rest = same.where("best IS NOT NULL").withColumn("score", F.lit(1.0)), same.where("best IS NULL").drop("best")
    if rest.isEmpty():
        return found
    ranks = _ranks(names.select(F.col("m").alias("x")).distinct())
    names = _coded(names.join(rest.select(*on).distinct(), on, "left_semi") if on else names, "m", "c", ranks)
    rest = _coded(rest, "n", "a", ranks)
    for at in steps:
        pairs = _meeting(rest, names, on, at, all_of_on).groupBy("n", "m").agg(F.collect_list(F.struct(*on, "best")).alias("__in"))
        scored = pairs.withColumn("score", name_similarity(*order)).where(F.col("score") >= at).select("n", "score", F.inline("__in"))
        first = scored.groupBy(*on, "n").agg(F.min(F.struct((-F.col("score")).alias("s"), "best")).alias("__first"))
        tried = staged(rest.join(first, [*on, "n"], "left").select(*rest.columns, "__first.best", (-F.col("__first.s")).alias("score")))
        found, rest = found.unionByName(tried.where("score IS NOT NULL").select(found.columns)), tried.where("score IS NULL").select(rest.columns)
        if rest.isEmpty():
            break
    return found


def _down_to(least: float) -> list[float]:
    return [*(x for x in _HIGH_STEPS if x > least), least]


def fuzzy_match(left: DataFrame, right: DataFrame, key: str, name: str, block: str, other_key: str, other_name: str, within: float = 0.65, strong: float = 0.9, anywhere: float = 0.85, report_from: float = 0.0, steps: Sequence[float] = (0.75, 0.6, 0.45, 0.3, 0.15, 0.0)) -> DataFrame:
    """One row a row of ``left``: key, other_key, score, method.

    The best name in the same block, if it reaches ``within`` (``exact_zip+name`` from ``strong`` on, else ``zip_only_fuzzy``); else the best of all, if it
    reaches ``anywhere`` (``name_only_fuzzy``); else ``unmatched`` with no other key and the best score, 0 where it is below ``report_from``. Ties go to the smallest other key. A null
    block has no others; a null name is an empty one.

    Both passes are complete (see candidate_pairs) and compare each name once, not each row (see best_names); equal names of ``right`` in a block are normalised once. The scores of unmatched rows are found at falling thresholds.
    """
    a = staged(left.select(F.col(key).alias("k"), F.col(block).alias("b"), normalize_name(F.col(name)).alias("n")))
    c = right.groupBy(F.col(block).alias("b"), F.col(other_name).alias("m")).agg(F.min(other_key).alias("o"))
    c = staged(c.groupBy("b", normalize_name(F.col("m")).alias("m")).agg(F.min("o").alias("o")).select("b", "m", F.struct("o").alias("best")))
    near = best_names(a, c, ["b"], _down_to(within), all_of_on=True).select("b", "n", F.col("best.o").alias("near"), F.col("score").alias("near_score"))
    rows = staged(a.join(near, ["b", "n"], "left"))
    least = min(report_from, anywhere)
    falling = [anywhere, *(x for x in steps if least < x < anywhere), *([least] if least < anywhere else [])]
    far = best_names(rows.where("near_score IS NULL"), c, [], falling).select("n", F.col("best.o").alias("far"), F.col("score").alias("far_score"))
    here, there = F.col("near_score").isNotNull(), F.coalesce(F.col("far_score") >= anywhere, F.lit(False))
    method = F.when(F.col("near_score") >= strong, "exact_zip+name").when(here, "zip_only_fuzzy").when(there, "name_only_fuzzy").otherwise("unmatched")
    other = F.when(here, F.col("near")).when(there, F.col("far"))
    return rows.join(far, "n", "left").select(F.col("k").alias(key), other.alias(other_key), F.coalesce("near_score", "far_score", F.lit(0.0)).alias("score"), method.alias("method"))


def registry_match(hospitals: DataFrame, registry: DataFrame, taxonomies: Mapping[str, Sequence[str]] = TYPE_TAXONOMIES, within: float = 0.55, anywhere: float = 0.85) -> DataFrame:
    """(ccn, npi, match_method, score, registry_name, registry_zip) of the hospitals found, by the first pass that has one.

    hospitals: ccn, name, state, zip, hospital_type. registry: npi, name, state, zip5, taxonomy, and ``zips``, all its addresses'. 1: an
    address in the hospital's ZIP and a taxonomy of its type, one type name after the other; the only candidate is taken as it is, of several the best
    name from ``within`` on. 2: an address in the ZIP, name from ``within`` on. 3: the state, name from ``anywhere`` on. In all of them the
    registered place is in the hospital's state, in 1 and 2 in its three-digit ZIP area, and corporate owners are left out. Ties go to the smallest number.

    A pass sees only the hospitals that those before it left, and compares names, not rows (see best_names).
    """
    spark, order = hospitals.sparkSession, ("n", "m")
    h = staged(hospitals.select(F.col("ccn").alias("k"), registry_name(F.col("name")).alias("n"), F.upper("state").alias("state"), F.substring("zip", 1, 5).alias("zip"), F.col("hospital_type").alias("type")))
    r = registry.where(~is_corporate(F.col("name"))).select(F.struct(F.col("npi").alias("o"), F.col("name").alias("named"), "zip5").alias("best"), registry_name(F.col("name")).alias("m"), F.upper("state").alias("state"), "zip5", "taxonomy", "zips")
    r = staged(r)
    here = r.withColumn("zip", F.explode(F.array_distinct(F.coalesce("zips", F.array("zip5"))))).where(F.substring("zip5", 1, 3) == F.substring("zip", 1, 3))
    here = staged(here.groupBy("state", "zip", "taxonomy", "m").agg(F.min("best").alias("best"), F.count("*").alias("n_rows")))
    terms = spark.createDataFrame([(t, i, x) for t, names in taxonomies.items() for i, x in enumerate(names)], "type string, place int, term string")  # a short list
    typed = here.join(F.broadcast(terms.select("term").distinct()), F.contains(F.lower("taxonomy"), F.lower("term")))
    typed = staged(typed.groupBy("state", "zip", "term", "m").agg(F.min("best").alias("best"), F.sum("n_rows").alias("n_rows")))
    wanted = h.join(F.broadcast(terms), "type")
    area = ["state", "zip", "term"]
    only = staged(typed.groupBy(*area).agg(F.sum("n_rows").alias("n_rows"), F.min("best").alias("best")).where("n_rows = 1").select(*area, "best"))
    several = best_names(wanted.join(only, area, "left_anti"), typed, area, _down_to(within), order, all_of_on=True)

    def tagged(rows: DataFrame, pass_no: Column, score: Column, method: Column) -> DataFrame:
        return rows.select("k", pass_no.alias("pass_no"), (-score).alias("s"), "best", method.alias("method"))

    score = F.col("score")
    alone = tagged(wanted.join(only, area), F.col("place"), F.lit(1.0), F.concat(F.lit("taxonomy:"), "term"))
    first = staged(alone.unionByName(tagged(wanted.join(several, [*area, "n"]), F.col("place"), score, F.concat(F.lit("taxonomy+name:"), "term"))))
    rest = staged(h.join(first, "k", "left_anti"))
    zipped = best_names(rest, here, ["state", "zip"], _down_to(within), order, all_of_on=True)
    second = staged(tagged(rest.join(zipped, ["state", "zip", "n"]), F.lit(1000), score, F.lit("zip+name")))
    rest = staged(rest.join(second, "k", "left_anti"))
    third = tagged(rest.join(best_names(rest, r, ["state"], [anywhere], order), ["state", "n"]), F.lit(2000), score, F.lit("state+name"))
    best = first.unionByName(second).unionByName(third).groupBy("k").agg(F.min(F.struct("pass_no", "s", "best", "method")).alias("x"))
    return best.select(F.col("k").alias("ccn"), F.col("x.best.o").alias("npi"), F.col("x.method").alias("match_method"), (-F.col("x.s")).alias("score"), F.col("x.best.named").alias("registry_name"), F.col("x.best.zip5").alias("registry_zip"))


def with_provenance(base: DataFrame, key: str, name: str, sources: Sequence[tuple[DataFrame, str, Column]]) -> DataFrame:
    """``base`` with ``name`` and <name>_source, from the first of ``sources`` that has a value for the key.

    Each source: (frame, column of the value, what the source is called). A key's smallest value counts where a source has several.
    """
    tagged = None
    for i, (frame, value, called) in enumerate(sources):
        own = frame.where(F.col(value).isNotNull() & (F.col(value) != "")).select(F.col(key).alias("__key"), F.struct(F.lit(i).alias("i"), F.col(value).cast("string").alias("value"), called.alias("source")).alias("__found"))
        tagged = own if tagged is None else tagged.unionByName(own)
    first = tagged.groupBy("__key").agg(F.min("__found").alias("__found"))
    return base.join(first, F.col(key) == F.col("__key"), "left").select(*base.columns, F.col("__found.value").alias(name), F.col("__found.source").alias(f"{name}_source"))


def crosswalk(hospitals: DataFrame, facilities: DataFrame, overrides: DataFrame, federal: Column, none_there: Column, employer: Sequence, provider: Sequence, report_from: float = 0.0) -> DataFrame:
    """Hospitals (ccn, name, zip, state ...) with facility id, score and method, employer id and provider id with their sources.

    ``report_from``: as in fuzzy_match(). ``overrides`` (ccn, facility_id) win; ``federal`` and ``none_there`` mark hospitals that the state's list can't have; the others are matched by name.
    """
    own = hospitals.withColumn("__zip", pad_zip(F.col("zip")))
    matched = fuzzy_match(own, facilities.withColumn("__zip", pad_zip(F.col("zip"))), "ccn", "name", "__zip", "facility_id", "facility_name", report_from=report_from)
    out = own.join(matched, "ccn", "left").join(overrides.select("ccn", F.col("facility_id").alias("__given")), "ccn", "left")
    never = F.when(federal, "n/a (federal)").when(none_there, "n/a (no counterpart)")
    method = F.when(F.col("__given").isNotNull(), "manual_override").otherwise(F.coalesce(never, F.col("method")))
    given, no = F.col("__given").isNotNull(), never.isNotNull()
    facility = F.when(given, F.col("__given")).when(~no, F.col("facility_id"))
    out = out.select(*hospitals.columns, facility.alias("facility_id"), F.when(~given & ~no, F.col("score")).alias("match_score"), method.alias("match_method"))
    return with_provenance(with_provenance(out, "ccn", "employer_id", employer), "ccn", "provider_id", provider)


def coverage_tallies(crosswalk: DataFrame, good: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(name, over, n): hospitals, by match method, and with a value in each column, over the universe and over the keys of ``good``. The crosswalk is read once."""
    own = crosswalk.join(good.select(key).distinct().withColumn("__good", F.lit(True)), key, "left")
    has = {c: F.col(c).isNotNull() for c in columns} | {"rows": F.lit(True)}
    over = {"universe": F.lit(True), "good": F.coalesce("__good", F.lit(False))}
    kinds = [(n, o) for n in has for o in over]
    method = F.concat(F.lit("method: "), F.coalesce("match_method", F.lit("none")))
    sums = own.groupBy(method.alias("__method")).agg(F.count("*").alias("__all"), *[F.count_if(has[n] & over[o]).alias(f"__{i}") for i, (n, o) in enumerate(kinds)])

    def tallies(n: Callable[[int], Column], *more: Column) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(o).alias("over"), n(i).alias("n")) for i, (name, o) in enumerate(kinds)], *more))

    by_method = sums.select(tallies(lambda i: F.col(f"__{i}"), F.struct(F.col("__method").alias("name"), F.lit("universe").alias("over"), F.col("__all").alias("n"))))
    none = crosswalk.sparkSession.range(1).select(tallies(lambda i: F.lit(0).cast("long")))  # a crosswalk without rows has tallies too
    return by_method.unionByName(none).groupBy("name", "over").agg(F.sum("n").alias("n"))


def _city(city: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(city, F.lit(""))), "[^a-z]", "")


def domain_score(host: Column, tokens: Column, city: Column) -> Column:
    """How well a host suits a hospital: 3 for each name token in it, 2 for the city, 2 or 1 for the ending; -1 without a host."""
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    parts = F.array_distinct(F.filter(F.split(bare, r"[.\-]"), lambda p: F.length(p) > 2))
    place = _city(city)
    ending = F.when(F.lower(host).rlike(r"\.(org|health|hospital)$"), 2).when(F.lower(host).rlike(r"\.(edu|gov)$"), 1).otherwise(0)
    score = 3 * F.size(F.array_intersect(tokens, parts)) + F.when((place != "") & F.contains(F.regexp_replace(bare, r"[.\-]", ""), place), 2).otherwise(0) + ending
    return F.when(F.coalesce(host, F.lit("")) == "", -1).otherwise(score)


def price_url_score(url: Column, tokens: Column, city: Column, state: Column) -> Column:
    """How well a price file's address suits a hospital: 3 for each name token in the file name, 2 for the city, 1 for the state, 1 for the usual name."""
    low = F.lower(url)
    file, place = F.substring_index(low, "/", -1), _city(city)
    named = 3 * F.size(F.filter(tokens, lambda t: F.contains(file, t)))
    in_city = F.when((F.length(place) > 3) & F.contains(file, place), 2).otherwise(0)
    in_state = F.when(F.regexp_like(low, F.concat(F.lit("[-_]"), F.lower(state), F.lit("[-_.]"))), 1).otherwise(0)
    return named + in_city + in_state + F.when(F.contains(file, F.lit("standardcharges")), 1).otherwise(0)


def best_site(found: DataFrame, key: str, blocked: str, least: int = 1) -> DataFrame:
    """(key, site, score): the best host among the search results of each key, and none below ``least``.

    found: key, position, url, host, tokens, city. A host counts once, at its first position; ties go to the earlier. ``blocked``: hosts that are never the hospital's.
    """
    hosts = _best(found.where((F.col("host") != "") & ~F.col("host").rlike(blocked)).withColumn("__kh", F.struct(key, "host")), "__kh", F.asc("position")).drop("__kh")
    scored = hosts.withColumn("score", domain_score(F.col("host"), F.col("tokens"), F.col("city"))).where(F.col("score") >= least)
    scheme = F.when(F.col("url").startswith("https"), "https").otherwise("http")
    return _best(scored, key, F.desc("score"), F.asc("position")).select(key, F.concat(scheme, F.lit("://"), "host").alias("site"), "score")
