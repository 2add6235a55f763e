import random
import re
from collections import Counter, defaultdict

import pytest

from chargelens.llm import collocations as own
from chargelens.llm.collocations import Lists, collocations, index


def brute(rows, max_words=3, min_count=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        held = set()
        for long, a in cand.items():
            for k in range(2, len(long)):
                held |= {long[i : i + k] for i in range(len(long) - k + 1) if 100 * a >= cover * count[long[i : i + k]]}
        ranked = []
        for p, a in cand.items():
            if p not in held:
                score, _, left, right = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, count=120):
    rng = random.Random(seed)
    vocab = ["New", "YORK", "city", "é", "a-b", "of", "the", "x\x00y", "日本", "zz"]
    rows = []
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["new", "york"], ["new", "york", "city"], [rng.choice(vocab)], ["the"], ["the", "the"]])
        rows.append((rng.choice(["en", "fr", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "!? "]) for w in words)))
    return [*rows, ("en", None), ("de", ""), (None, "  .. ")]


def got(spark, rows, **options):
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, w1 int, phrase string")
    return sorted(tuple(r) for r in collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{}, {"max_words": 5, "min_count": 3, "cover": 70}, {"max_words": 2, "top": 5}])
def test_phrases_are_those_of_brute_force(spark, options):
    rows = corpus(1)
    want = brute(rows, **options)
    assert want
    assert got(spark, rows, batch_chars=700, **{("cover_percent" if k == "cover" else k): v for k, v in options.items()}) == want


def test_a_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    rows = corpus(2, 60)
    monkeypatch.setattr(own, "passes", lambda found, words: words[:, 0] == words[:, 0])
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_words_of_one_hash_are_told_apart(spark):
    rows = [("en", "aa bb cc dd ee ff. " * 12), ("en", "gg hh ii jj kk ll mm nn oo. " * 11)]
    assert got(spark, rows, hash_bits=8) == brute(rows)  # 15 words, 256 hashes: several bases are tried


def test_empty_tables_give_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", "one two three")]) == []
    with pytest.raises(ValueError, match="two words"):
        got(spark, [], max_words=1)


def test_lists_hold_every_position():
    w, names, n, at = index(["b a b. a b", "A B\nb"])
    lists = dict(zip(names, [x.tolist() for x in __import__("numpy").split(at, n.cumsum()[:-1])], strict=True))
    assert lists == {"b": [0, 2, 5, 8, 10], "a": [1, 4, 7]}
    import numpy as np

    which = np.repeat(np.arange(2), n)
    order = np.argsort(at)
    postings = Lists(at[order], which[order], np.arange(2)[:, None])
    pairs = postings.extend(postings)
    found = Counter(tuple(names[i] for i in pairs.words[p]) for p in pairs.phrase.tolist())
    assert found == {("b", "a"): 1, ("a", "b"): 3}
    assert pairs.extend(postings).at.tolist() == [0]
