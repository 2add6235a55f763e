"""Each operator against brute force, on texts with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargelens.llm.exact_dedup import exact_dedup, keep_exact
from chargelens.llm.language_id import language_id
from chargelens.llm.license_scan import license_scan
from chargelens.llm.mixing import edf_period, mix_sources, plan, shares
from chargelens.llm.ngram_join import ngram_join
from chargelens.llm.suffix_dedup import suffix_dedup
from chargelens.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, run int, bucket string, id string, n string, digest string"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None if k % 5 == 4 else ("en" if k % 2 else "de"), "s" if k % 3 else None, 1, "b", "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def some_texts():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    near = [b + " tail" for b in base[:4]] + [base[0].replace("w1", "w1", 1)[:-3]]
    shared = " ".join(rng.choice(words, 30))
    return [None, "", "", "one", "one", "aaaa " * 40, "aaaa " * 41, *base, *near, *base[:3], *(f"{x} {shared} {x}" for x in base[6:9]), "é ü ß " * 30, "... !!", "x" * 300, "y" + "x" * 299]


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, bits):
    texts = some_texts()
    got = {r.doc_id: r for r in exact_dedup(docs(spark, texts), digest_bits=bits).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(r.doc_id for r in keep_exact(docs(spark, texts)).collect()) == sorted(max(v) for v in groups.values())
    assert exact_dedup(docs(spark, [])).count() == 0


def test_schedule_deviates_by_less_than_a_block():
    weights = {"a": 5, "b": 3, "c": 1.5, "d": 0.01}
    share = shares(weights)
    assert share == {"a": 500, "b": 300, "c": 150, "d": 1}
    slots = edf_period(share)
    assert sorted(np.concatenate(list(slots.values())).tolist()) == list(range(951))
    for s, at in slots.items():
        have = np.searchsorted(at, np.arange(952))
        assert np.abs(have - np.arange(952) * weights[s] / 9.51).max() < 1
    rounded = shares({"a": 1.0, "b": 0.123456789}, most=1000)
    assert sum(rounded.values()) == 1000
    with pytest.raises(ValueError, match="positive"):
        shares({"a": 0.0})


def test_mixing_keeps_the_target_over_a_million_blocks():
    """Less than a block off the target weights, whatever the number of blocks, until the first source ends; and after it, off those of the sources left."""
    weights = dict.fromkeys((f"src{k}" for k in range(20)), 1.0) | {"src0": 5.0, "src1": 3.0, "src2": 3.0, "src3": 1.5, "src4": 1.5, "src5": 0.25}
    total = sum(weights.values())
    blocks = {s: int(1_000_000 * w / total) + 1 + (k == 7) * 40_000 for k, (s, w) in enumerate(weights.items())}
    schedule = plan(blocks, weights, 1)
    place = {s: schedule.slot(s, np.arange(n)) for s, n in blocks.items()}
    assert sorted(np.concatenate(list(place.values())).tolist()) == list(range(sum(blocks.values())))
    end = min(int(x[-1]) for x in place.values())
    assert end > 999_000
    times = np.arange(end + 1)
    for s, at in place.items():
        assert np.abs(np.searchsorted(at, times) - times * weights[s] / total).max() < 1, s


def test_mixing_equals_a_slot_by_slot_schedule():
    """Earliest deadline first, slot by slot in fractions, over sources that end one after the other."""
    from fractions import Fraction

    weights, left = {"a": 0.7, "b": 1.25, "c": 0.05, "d": 2.0}, {"a": 40, "b": 31, "c": 9, "d": 5}
    schedule, t, done = plan(left, weights, 1), 0, dict.fromkeys(left, 0)
    got = {s: schedule.slot(s, np.arange(n)).tolist() for s, n in left.items()}
    want: dict = {s: [] for s in left}
    while live := [s for s in left if done[s] < left[s]]:
        total, t0, d0 = sum(Fraction(str(weights[s])) for s in live), t, dict(done)
        while all(done[s] < left[s] for s in live):
            rate = {s: Fraction(str(weights[s])) / total for s in live}
            ready = [(math.ceil((done[s] - d0[s] + 1) / rate[s]), s) for s in live if (done[s] - d0[s]) / rate[s] < t - t0 + 1 and math.floor((done[s] - d0[s]) / rate[s]) <= t - t0]
            s = min(ready)[1]
            want[s].append(t)
            done[s] += 1
            t += 1
    assert got == want


def test_mixing_places_every_row_once(spark):
    frame = docs(spark, some_texts() * 3, [k // 2 for k in range(3 * len(some_texts()))])
    got = mix_sources(frame, block_rows=4).collect()
    assert sorted(r.mix_position for r in got) == list(range(frame.count()))
    whole = plan({"s": 6, "__null__": 3}, {"s": 2, "__null__": 1}, 1)
    assert whole.slot("s", np.arange(6)).tolist() != sorted(range(6))
    many = spark.createDataFrame([(None if k % 50 == 0 else k, f"s{k % 23}", "own") for k in range(2300)], "doc_id long, source string, mix_seq string")
    got = mix_sources(many, block_rows=4, max_sources=6, default_weight=1.0).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(2300)) and isinstance(got[0].mix_seq, int)
    for t in range(0, 2300, 92):  # two levels of schedules: within two blocks of the share
        counts = Counter(r.source for r in got[:t])
        assert all(abs(counts[f"s{k}"] - t / 23) <= 2 * 4 for k in range(23))
    got = mix_sources(many, {"s0": 6.0, "s1": 0.5}, block_rows=1, default_weight=1.0).orderBy("mix_position").limit(100).collect()
    counts, total = Counter(r.source for r in got), 6.0 + 0.5 + 21
    assert abs(counts["s0"] - 100 * 6 / total) <= 1.5 and abs(counts["s1"] - 100 * 0.5 / total) <= 1.5 and abs(counts["s7"] - 100 / total) <= 1.5
    with pytest.raises(ValueError, match="no weight"):
        mix_sources(frame, {"s": 1.0})
    assert mix_sources(docs(spark, [])).count() == 0


def test_ngram_join(spark):
    texts = some_texts()
    got = {r.doc_id: r for r in ngram_join(docs(spark, texts), limit=2, block=3, recall=0.9999).collect()}

    def grams(t):
        import re

        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [grams(t) for t in texts]
    links = {i: {j for j in range(len(sets)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(len(sets))}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].class_id, got[i].kept) == (len(links[i]), min(seen), min(seen) == i), texts[i]
    assert ngram_join(docs(spark, [])).count() == 0


@pytest.mark.parametrize("repeat", [False, True])
def test_suffix_dedup(spark, repeat):
    texts = [t for t in some_texts()]
    ids = [k // 2 for k in range(len(texts))] if repeat else list(range(len(texts)))[::-1]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs(spark, texts, ids), chunk=2000, batch_chars=500).collect())
    blobs = [(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)]
    least: dict[bytes, int] = {}
    for i, b in blobs:
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(least.get(b[k : k + 50], i), i)
    want = []
    for i, b in blobs:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    assert suffix_dedup(docs(spark, [])).count() == 0


def test_suffix_dedup_of_a_passage_in_every_document(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefgh")
    passage = "".join(rng.choice(letters, 57))
    texts = ["".join(rng.choice(letters, 40)) + passage[: 57 - k % 4] + "".join(rng.choice(letters, 30)) for k in range(6000)]
    got = {r.doc_id: r for r in suffix_dedup(docs(spark, texts), chunk=20_000, batch_chars=5_000).collect()}
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        assert got[i].n_removed == gone.sum()


def test_suffix_dedup_tells_texts_of_one_checksum_apart(spark):
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    tail = "".join(np.random.default_rng(6).choice(list("abcdefgh"), 200))
    got = suffix_dedup(docs(spark, ["plumless" + tail, "plumless" + tail, "buckeroo" + tail], [1, None, None])).collect()
    assert sorted(r.n_removed for r in got) == [0, 200, 208]


def test_suffix_dedup_of_an_anchor_in_every_document(spark):
    """One run of 16 blanks everywhere, with other bytes around it in each document, but for a few that agree."""
    rng = np.random.default_rng(7)
    some = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    texts = [some(40) + " " * 16 + some(40) for _ in range(5000)]
    for k in range(0, 5000, 100):
        texts[k] = texts[k][:10] + texts[(k + 350) % 5000][10:]
    got = {r.doc_id: r.n_removed for r in suffix_dedup(docs(spark, texts), chunk=20_000, batch_chars=5_000).collect()}
    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        assert got[i] == gone.sum()
    assert sum(map(bool, got.values())) >= 20


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from chargelens.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [*some_texts(), " a  b\n c \t d ", "end<|endoftext|> of", "  x  y 日本 語 "]
    got: dict[int, list] = {}
    for r in pack(docs(spark, texts), path, longest=64, with_ids=True).collect():
        assert r.length == len(r.ids) <= 64 and r.length & (r.length - 1) == 0 and r.offset == 0 and r.bucket == r.length.bit_length() - 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        got.setdefault(r.doc_id, []).append((r.start, r.ids, r.sequence_id))
    assert len({s for x in got.values() for *_, s in x}) == sum(map(len, got.values()))
    for i, t in enumerate(texts):
        ids = [x for _, piece, _ in sorted(got[i]) for x in piece]
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing_of_odd_rows(spark):
    import public_tokenizers

    from chargelens.llm.packing import pack

    rows = [(None, "a b c", "own"), (None, None, "own"), (3, "a b c", "own"), (3, "a b c", "own"), (4, "word " * 60_000, "own")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, start string, sequence_id string")
    got = pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.length <= 2048 and r.offset == 0 for r in got)
    size = {k: sum(r.length for r in got if r.doc_id == k) for k in (None, 3, 4)}
    one = next(r.doc_tokens for r in got if r.doc_id == 3)
    assert size == {None: one + 1, 3: 2 * one, 4: next(r.doc_tokens for r in got if r.doc_id == 4)} and size[4] > 60_000
    assert pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_language_edges(spark):
    got = language_id(docs(spark, some_texts())).collect()
    assert len(got) == len(some_texts()) and all(0 <= r.lang_score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.text in (None, "", "... !!")) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert language_id(docs(spark, [])).count() == 0


def test_packing_refuses_positions_without_room(spark):
    import public_tokenizers

    from chargelens.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(1, "a b", (1 << 32) - 1), (2, "c", 0)], "doc_id long, text string, at long")
    ids = [r.sequence_id for r in pack(frame, path, position_col="at").collect()]
    assert len(set(ids)) == len(ids)
    assert sorted(r.doc_id for r in pack(frame, path, position_col="at").orderBy("sequence_id").limit(1).collect())
    with pytest.raises(Exception, match="positions go from 0"):
        pack(frame.withColumn("at", F.col("at") + 1), path, position_col="at").collect()


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}"><meta http-equiv="refresh" content="0; url={}">'
    pages = [(0, "HTTP://Bad.NET/x#f", ""), (1, "http://a.com/q", link.format("http://bad.net/x", "/r")), (2, "http://a.com/r", ""), (3, "http://b.com/", link.format("http://Example.net/en/1", "http://bad.net/y")), (4, "http://c.com", ""), (5, None, None), (6, "nothing", ""), (7, "http://bad.net", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), [("block", "net", "/"), ("allow", "example.net", "/en/")]).collect()}
    assert got == {0: ("bad.net", "/x", "net/", "block"), 1: ("a.com", "/q", None, "block"), 2: ("a.com", "/r", None, "block"), 3: ("b.com", "/", None, "allow"), 4: ("c.com", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("bad.net", "", None, "allow")}


LINKED = [
    (0, "http://a.org/q", '<link rel="alternate canonical" href="http://bad.net/x"><link rel=canonical href=http://b.org/two>'),
    (1, "HTTP://B.org/two#part", "<p>no link</p>"),
    (2, "http://c.org/in/here?x=1", "<META content='0;URL=there' HTTP-EQUIV='Refresh'><link href='/top' rel='Canonical'>"),
    (3, "http://c.org/in/there", ""),
    (4, "http://c.org/top", '<link rel="canonical" href="//example.net/en/9?a=1&amp;b=2">'),
    (5, "http://d.org/", '<link rel="nofollow" href="http://bad.net/x"><meta name="refresh" content="0; url=http://bad.net/x">'),
    (6, "http://e.org/a", '<link rel="canonical" href="?p=2"><link rel="canonical" href="#x">'),
    (7, "http://e.org/a?p=2", "<meta http-equiv=\"refresh\" content=\"5; url='http://example.com/de/'\">"),
    (8, "http://f.org", None),
    (8, "http://f.org", '<link rel="canonical" href="http://f.org#self">'),
    (9, "http://g.org/", '<link rel="canonical" href="http://h.org/">' + "x" * 200_000),
    (None, None, '<link rel="canonical" href="http://bad.net/x">'),
    (10, "http://i.org/en/deep/page", '<link rel="canonical" href="../../de/./q">'),
    (11, "http://i.org/de/q", '<link rel="canonical" href="http://bad.net:80/a/../x">'),
    (12, "http://k.org/p", '<base href="/sub/dir/x"><meta http-equiv="refresh" content="0;url=./y/..">'),
    (13, "http://k.org/sub/dir/", '<link rel="canonical" href="http://bad.net/../../x">'),
    (14, "https://l.org:443/..?a=../b", '<link rel="canonical" href="http://bad.net/x">'),
    (15, "https://l.org/?a=../b", ""),
]


def test_url_filter_follows_every_link_and_agrees_with_sql(spark):
    import duckdb

    from chargelens.llm.queries import OP9_SQL, URL_RULES

    pages = spark.createDataFrame([(*r, "own", "own") for r in LINKED], "page_id long, url string, html string, rule string, node string")
    out = url_filter(pages, URL_RULES)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(r) for r in LINKED])
    assert got == sorted(con.execute(OP9_SQL).fetchall(), key=str)
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[k] for k in (10, 11, 12, 13, 14, 15)] == ["block"] * 6
    assert [verdict[k] for k in (0, 1, 2, 3, 4, 5, 6, 7)] == ["block", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert {r.page_id: r.component for r in out.collect()}[3] == "http://c.org/in/here?x=1"
    assert url_filter(pages.limit(0), URL_RULES).count() == 0


def test_license_scan_edges(spark):
    got = {r.doc_id: r for r in license_scan(docs(spark, [None, "", "x\nReleased under the MIT License.\nGNU General Public License gnu general public license", "Licensed under the Apache License"])).collect()}
    assert (got[0].n_words, got[0].first_word, got[0].labels, got[0].score) == (0, None, "", 0.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].labels) == (3, 4, 10, "gpl,mit", "gpl,mit,mit-notice")
    assert (got[3].labels, got[3].n_base) == ("apache", 1)
    assert license_scan(docs(spark, [])).count() == 0


WRAPPED = [
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License\n * as published",
    "Licensed under the Apache License,\n  Version 2.0 (the License)",
    "Permission is hereby granted, free of\ncharge, to any person obtaining a\ncopy of this software " + "and so on " * 50_000,
    "all the rights of the people were reserved",
    "ALL RIGHTS\n\nRESERVED all rights reserved",
    "permission " * 30 + "is hereby granted free of charge",
]


def test_license_scan_of_wrapped_notices_agrees_with_sql(spark):
    import duckdb

    from chargelens.llm.queries import op10_sql

    rows = [(i, t) for i, t in enumerate(WRAPPED)] + [(0, WRAPPED[0]), (None, WRAPPED[2]), (50, None)]
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, labels string, score string")
    out = license_scan(frame)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert [got[k].labels for k in range(7)] == ["bsd", "gpl,gpl-notice", "apache,apache-2.0", "mit-grant", "", "rights-reserved", ""]
    assert [(m.first_word, m.n_words, m.containment) for m in got[0].matches] == [(0, 14, 1.0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows[: len(WRAPPED)] if r[0] != 3])
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for w in con.execute(f"SELECT {', '.join(columns)} FROM ({op10_sql()})").fetchall():
        assert list(w) == [got[w[0]][c] for c in columns]


def test_embeddings(spark):
    from chargelens.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x[30:50] = x[:20] + rng.normal(size=(20, 16)) * 0.1
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 16), (62, [float("nan")] * 16), (63, [float(v) for v in x[0]]), (64, []), (65, [1.0, None])]
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=2, recall=0.9999).collect()}
    good = np.vstack([x, x[:1]])
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    names = [*range(60), 63]
    for k, i in enumerate(names):
        assert got[i].n_links == near[k].sum()
        if near[k].any():
            assert got[i].component_id == min(i, *(names[j] for j in np.flatnonzero(near[k])))
    assert all(got[i].n_links == 0 and got[i].kept for i in (60, 61, 62, 64, 65)) and len(got) == len(rows)
