"""Each stage of the corpus pipeline against brute force on what its predecessor kept, and on edge cases."""

import re
from collections import Counter

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, Mix_Position string, class_id string, kept string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own", "own", "own") for r in rows], SCHEMA)


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = {lang: ["".join(rng.choice(list(letters), 6)) for _ in range(400)] for lang, letters in {"en": "aeiosrtnl", "de": "bugfhzkwm"}.items()}
    texts = [(" ".join(rng.choice(vocabulary[lang], rng.integers(20, 70))), lang) for lang in ("en", "de") for _ in range(60)]
    near = [(t + " once more", lang) for t, lang in texts[:20]] + [(" ".join(t.split()[1:]), lang) for t, lang in texts[55:70]]
    strange = "".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, 300))
    odd = [(None, "en"), ("", "en"), ("12 34 !!", None), (strange, None), ("kurz", None), ("x" * 150_000, "en"), ("é" * 90, "de")]
    every = [*texts, *near, *texts[:15], *texts[:5], *odd]
    rows = [(k, t, lang, ("web", "books", None)[k % 3], len(t or "")) for k, (t, lang) in enumerate(every)]
    return [*rows, rows[3], rows[80]]  # whole rows that repeat


def phrases(samples, text):
    """Phrases by language, in order, and folded bytes: each phrase grown byte by byte while some sample holds it."""
    fold = lambda t: re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", t.lower().encode())
    data, out = fold(text), {}
    for lang, own in sorted(samples.items()):
        blobs = [fold(t) for t in own]
        n = 0
        for at in range(0, len(data), 1024):
            held = b""
            n += 1
            for c in data[at : at + 1024]:
                one = bytes([c])
                if any(held + one in b for b in blobs):
                    held += one
                else:
                    n += 1
                    held = one if any(one in b for b in blobs) else b""
        out[lang] = n
    return out, len(data)


def parses(samples, text):
    n, size = phrases(samples, text)
    return min(n.values()), size


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark):
    from pyspark.sql import functions as F

    from chargelens.llm.language_id import sample_texts

    docs = frame(spark, corpus())
    rows = docs.collect()
    samples = sample_texts(docs, F.lit(True), "doc_id", "text", "lang", 48, 20_000)

    def strange(r):
        n, size = parses(samples, r.text)
        return n / size > 0.5

    want = [r for r in rows if r.text and any(c.isalpha() for c in r.text) and not (len(r.text) >= 200 and strange(r))]
    assert 4 <= len(rows) - len(want) <= 5  # null, empty, digits, and what parses into single bytes, as the text of x does unless it is sampled
    stage = pipeline.identify(spark, docs, "")
    assert stage.columns == docs.columns and as_rows(stage) == Counter(tuple(r) for r in want)

    largest = {}
    for r in want:
        largest[r.text] = max(largest.get(r.text, r.doc_id), r.doc_id)
    want = [r for r in want if r.doc_id == largest[r.text]]
    stage = pipeline.drop_copies(spark, stage, "")
    assert stage.columns == docs.columns and as_rows(stage) == Counter(tuple(r) for r in want)

    sets = {}
    for r in want:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    least = {i: i for i in sets}
    for _ in sets:
        new = {i: min([least[i], *(least[j] for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]) for i in sets}
        if new == least:
            break
        least = new
    want = [r for r in want if least[r.doc_id] == r.doc_id]
    stage = pipeline.drop_near_copies(spark, stage, "")
    assert 0 < len(want) < len(sets) and stage.columns == docs.columns and as_rows(stage) == Counter(tuple(r) for r in want)

    stage = pipeline.mix(spark, stage, "")
    assert stage.columns == docs.columns and as_rows(stage) == Counter(tuple(r) for r in want)

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths: dict[int, list] = {}
    for r in pipeline.pack_sequences(spark, stage, "").collect():
        lengths.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(lengths) == {r.doc_id for r in want}
    for r in want:
        n, at = len(tok.encode(r.text, add_special_tokens=False).ids) + 1, 0
        copies = sum(1 for x in want if x.doc_id == r.doc_id)
        for start, length, total in sorted(lengths[r.doc_id])[::copies]:
            assert (start, total) == (at, n) and length & (length - 1) == 0
            at += length
        assert at == n


@pytest.mark.parametrize("at_once", [32, 2, 1])
def test_language_predictions_follow_the_parse(spark, at_once):
    from pyspark.sql import functions as F

    from chargelens.llm.language_id import language_id, sample_texts

    own = [(i, t, lang, s, n) for i, t, lang, s, n in corpus() if len(t or "") < 1000]
    own += [(k + 500, t, "zz", s, n) for k, (_, t, lang, s, n) in enumerate(own[:4])]  # labels that tie
    own += [(0, "der schnelle fuchs", None, "web", 3), (None, "kein name", "de", "web", 3)]  # an id of another text, without a label
    docs = frame(spark, own)
    samples = sample_texts(docs, F.lit(True), "doc_id", "text", "lang", 48, 2000)
    assert not any("fuchs" in t for x in samples.values() for t in x) and all(sum(map(len, x)) <= 2000 for x in samples.values())
    got = language_id(docs, chars=2000, labels_at_once=at_once).select("doc_id", "text", "lang_pred", "lang_score", "phrase_rate").collect()
    assert len(got) == len(own)
    for r in got:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.lang_score, r.phrase_rate) == ("und", 0.0, None)
            continue
        counts, size = phrases(samples, r.text)
        two = sorted(counts.values())[:2]
        assert r.lang_pred == min(counts, key=lambda x: (counts[x], x))
        assert abs(r.lang_score - (1 - two[0] / two[1])) < 1e-9 and abs(r.phrase_rate - two[0] / size) < 1e-9


def test_mix_keeps_each_prefix_within_a_block(spark):
    docs = frame(spark, [(k, f"t{k}", "en", ("web", "books", None)[k % 3], 2) for k in range(3 * 640)])
    order = [r.source or "__null__" for r in pipeline.mix(spark, docs, "").collect()]
    for t in range(0, len(order) + 1, 64):
        got = Counter(order[:t])
        assert all(abs(got[s] - t / 3) < 64 for s in ("web", "books", "__null__"))


def test_run_chains_the_stages_and_takes_an_empty_table(spark, tmp_path):
    frame(spark, corpus()).write.parquet(str(tmp_path / "some/documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "some/documents.parquet"))
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    keys = ["doc_id", "start", "length", "ids_crc32"]
    got = pipeline.run(spark, str(tmp_path / "some")).select(keys)
    assert as_rows(got) == as_rows(docs.select(keys))
    frame(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    frame(spark, [(1, None, None, None, None), (1, None, None, None, None), (None, "", None, None, None)]).write.parquet(str(tmp_path / "nulls/documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "nulls")).count() == 0


def test_run_numbers_sequences_in_mix_order(spark, tmp_path):
    from chargelens.llm.mixing import mix_sources

    rng = np.random.default_rng(13)
    texts = [" ".join("".join(rng.choice(list("aeiosrtnl"), 6)) for _ in range(30)) for _ in range(600)]
    docs = frame(spark, [(k, t, "en", ("web", "books", None)[min(k % 5, 2)], len(t)) for k, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    position = {r.doc_id: r.mix_position for r in mix_sources(docs.select("doc_id", "source")).collect()}
    packed = pipeline.run(spark, str(tmp_path)).orderBy("sequence_id").collect()
    order = list(dict.fromkeys(r.doc_id for r in packed))
    assert len({r.sequence_id for r in packed}) == len(packed) and len(order) == len(texts)
    assert order == sorted(order, key=position.get)
    assert all(r.sequence_id % 64 == r.bucket for r in packed)
