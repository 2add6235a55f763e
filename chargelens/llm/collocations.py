"""Phrase collocations from vertical positional inverted lists.

Texts are indexed in blocks of one language: per word the sorted list of its positions, where the words of a piece have
consecutive positions and pieces are a gap apart. A phrase's list is the list of its first words merge-joined with the postings of the word
that stands right after them, so its length is the phrase's exact frequency in the block, and the sum over all blocks its frequency in
the language. No occurrence crosses a text, so blocks need nothing of each other: what is shuffled is a count a block and phrase.

Only lists of phrases whose first and last words are frequent everywhere are extended. A filter of bounded size tells that; where it is
wrong it lets a rare phrase through, which the exact counts then drop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargelens.llm.common import ROW_BITS, filter_bits, parts, runs_of
from chargelens.llm.kernels import LOWER, flatten, mix64, span_hash
from chargelens.operators.staging import staged

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that end a piece, and bytes that stand between the words of one.
_ENDS_PIECE, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True


@dataclass
class Lists:
    """Occurrences of phrases of one length in a block, by position: where each begins, and its phrase as a row of ``words``, numbers of the block's words."""

    at: np.ndarray
    phrase: np.ndarray
    words: np.ndarray

    def of(self, wanted: np.ndarray) -> Lists:
        """The lists of the phrases marked ``wanted``."""
        held = wanted[self.phrase]
        return Lists(self.at[held], (np.cumsum(wanted) - 1)[self.phrase[held]], self.words[wanted])

    def extend(self, postings: Lists) -> Lists:
        """Every list merge-joined with the postings of the words right after its phrase."""
        k = self.words.shape[1]
        after = np.searchsorted(postings.at, self.at + k)
        found = after < len(postings.at)
        found[found] = postings.at[after[found]] == self.at[found] + k
        key = self.phrase[found].astype(np.int64) * len(postings.words) + postings.phrase[after[found]]
        kinds, phrase = np.unique(key, return_inverse=True)
        words = np.column_stack([self.words[kinds // len(postings.words)], postings.words[kinds % len(postings.words)]]) if len(postings.words) else np.zeros((0, k + 1), dtype=np.int64)
        return Lists(self.at[found], phrase, words)


def _letters(seed: int) -> np.ndarray:
    """64 bits for each byte, others for each seed."""
    return mix64(np.arange(256, dtype=np.uint64) * _ODD + np.uint64(seed))


def index(texts: list[str], lang: str = "", seed: int = 0, bits: int = 64) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """The vertical index of a block: the words' hashes, the words, lengths of their lists, and the lists, one after the other.

    A word has another hash in each language. Words are told apart by a second hash too, so that two words of one hash are both listed.
    """
    raw, off = flatten(texts)
    buf = np.full(len(raw) + len(off), 10, dtype=np.uint8)  # a line's end after each text
    buf[np.arange(len(raw)) + np.repeat(np.arange(len(off) - 1), np.diff(off))] = LOWER[raw]
    ends = _ENDS_PIECE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~(ends | _BLANK[buf])]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    own = np.frombuffer(lang.encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)
    of_lang = span_hash(own, np.array([0]), np.array([len(own)]))
    h = mix64(span_hash(buf, start, end, _letters(2 * seed)) ^ of_lang) & np.uint64((1 << bits) - 1)
    other = span_hash(buf, start, end, _letters(2 * seed + 1))
    order = np.lexsort((other, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    first = order[new]
    names = [buf[i:j].tobytes().decode("utf-8", "surrogatepass") for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    at = np.arange(len(start)) + np.cumsum(ends)[start]
    return h[first].view(np.int64), names, np.diff(np.append(np.flatnonzero(new), len(order))), at[order].astype(np.int32)


def phrase_key(words: np.ndarray) -> np.ndarray:
    """A hash of each row of words' hashes, for the filters."""
    key = np.zeros(len(words), dtype=np.uint64)
    for column in words.T:
        key = mix64(key * _ODD + np.ascontiguousarray(column).view(np.uint64))
    return key


def filter_of(phrases: DataFrame, k: int, filter_bytes: int) -> np.ndarray:
    """A bit for the key of every row of ``phrases`` (w1 to wk): at most ``filter_bytes`` on the driver and each executor, whatever their number."""
    bits = filter_bits(phrases.count(), 8 * filter_bytes)

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = (phrase_key(frame.to_numpy()) & np.uint64(bits - 1)).astype(np.int64)
            yield pd.DataFrame({"slot": place // ROW_BITS, "bit": place % ROW_BITS})

    slots = phrases.select(*_words(k)).mapInPandas(places, "slot long, bit long").groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    out = np.zeros((bits // ROW_BITS, ROW_BITS // 8), dtype=np.uint8)
    for row in slots.collect():
        out[row["slot"]] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return out.reshape(-1)


def passes(found: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which rows of words' hashes the filter has."""
    place = phrase_key(words) & np.uint64(8 * len(found) - 1)
    return found[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def _words(k: int, begin: int = 1) -> list[str]:
    return [f"w{i}" for i in range(begin, begin + k)]


def _blocks(docs: DataFrame, seed: int, bits: int, batch_chars: int) -> DataFrame:
    """docs: (lang, text). One row a block: lang, the words' hashes w, the words, lengths n of their lists, and the lists."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                texts = part["text"].tolist()
                for lo, hi in runs_of(texts, batch_chars):
                    w, names, n, at = index(texts[lo:hi], lang, seed, bits)
                    yield pd.DataFrame({"lang": [lang], "w": [w], "word": [names], "n": [n.astype(np.int32)], "at": [at.tobytes()]})

    return docs.mapInPandas(run, "lang string, w array<long>, word array<string>, n array<int>, at binary")


def _summed(counts: list[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """The counts of several blocks as one: w1 to wk, n."""
    words, n = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])
    order = np.lexsort(words.T[::-1])
    words = words[order]
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])[: len(words)])
    n = np.add.reduceat(n[order], first) if len(first) else n
    return pd.DataFrame({c: words[first, i] for i, c in enumerate(_words(k))} | {"n": n})


def _counts(blocks: DataFrame, k: int, filters: list, together: int = 400_000) -> DataFrame:
    """(w1 to wk, n): how often each phrase of k words stands in some blocks, where its parts pass the filters of 1 to k - 1 words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for frame in frames:
            for w, n, at in frame.itertuples(index=False):
                w, at = np.asarray(w, dtype=np.int64), np.frombuffer(at, dtype=np.int32).astype(np.int64)
                which = np.repeat(np.arange(len(w)), n)
                order = np.argsort(at)
                postings = Lists(at[order], which[order], np.arange(len(w))[:, None])
                postings = postings.of(passes(filters[0].value, w[:, None]))
                lists = postings
                for size in range(2, k + 1):
                    if size > 2:  # its last words are a frequent phrase too
                        lists = lists.of(passes(filters[size - 2].value, w[lists.words]))
                    lists = lists.extend(postings)
                    if size > 2 and len(lists.words):
                        lists = lists.of(passes(filters[size - 2].value, w[lists.words[:, 1:]]))
                held.append((w[lists.words], np.bincount(lists.phrase, minlength=len(lists.words))))
                if sum(len(n) for _, n in held) >= together:
                    yield _summed(held, k)
                    held = []
        if held:
            yield _summed(held, k)

    return blocks.select("w", "n", "at").mapInPandas(run, f"{', '.join(f'{c} long' for c in _words(k))}, n long")


def _indexed(docs: DataFrame, hash_bits: int, batch_chars: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and (lang, w1, word, n) of all words. Where two words of a language share a hash, all is hashed anew by other bytes' values."""
    for seed in range(20):
        blocks = staged(_blocks(docs, seed, hash_bits, batch_chars))
        entry = blocks.select("lang", F.explode(F.arrays_zip("w", "word", "n")).alias("e"))
        words = staged(entry.groupBy("lang", F.col("e.w").alias("w1"), F.col("e.word").alias("word")).agg(F.sum("e.n").alias("n")))
        if words.groupBy("w1").count().where("count > 1").isEmpty():
            return blocks, words
    raise RuntimeError("no hash without a collision")


def _frequent(spark: SparkSession, blocks: DataFrame, words: DataFrame, max_words: int, min_count: int, filter_bytes: int) -> list[DataFrame]:
    """Per length k a table (w1 to wk, a) of the phrases that occur ``min_count`` times or more; words have their text and language too."""
    tables = [staged(words.where(F.col("n") >= min_count).select("lang", "w1", F.col("word").alias("phrase"), F.col("n").alias("a")))]
    filters: list = []
    for k in range(2, max_words + 1):
        filters.append(spark.sparkContext.broadcast(filter_of(tables[-1], k - 1, filter_bytes)))
        counted = _counts(blocks, k, filters).repartition(parts(spark), *_words(k))  # summed in the tasks already, so that nothing is held there once more
        counted = counted.groupBy(*_words(k)).agg(F.sum("n").alias("a"))
        tables.append(staged(counted.where(F.col("a") >= min_count)))
    return tables


def _scored(tables: list[DataFrame], k: int) -> DataFrame:
    """The phrases of k words: lang, w1 to wk, phrase, a, and l, r, score of their lowest cut. Each part is looked up among the phrases of its length."""
    out = tables[k - 1]
    for cut in range(1, k):
        here = cut == k - 1
        left = tables[cut - 1].select(*_words(cut), F.col("a").alias(f"l{cut}"), *(["lang", F.col("phrase").alias("__head")] if here else []))
        right = tables[k - cut - 1].select(*(F.col(c).alias(own) for c, own in zip(_words(k - cut), _words(k - cut, cut + 1), strict=True)), F.col("a").alias(f"r{cut}"), *([F.col("phrase").alias("__tail")] if here else []))
        out = out.join(left, _words(cut)).join(right, _words(k - cut, cut + 1))
    wide = "(cast({0} as decimal(19, 0)) * cast({1} as decimal(19, 0)))"  # products pass 64 bits
    score = lambda c: F.expr(f"(1000000 * {wide.format('a', 'a')}) div {wide.format(f'l{c}', f'r{c}')}")
    lowest = F.array_min(F.array(*(F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k))))
    out = out.withColumn("__low", lowest).withColumn("phrase", F.concat_ws(" ", "__head", "__tail"))
    return out.select("lang", *_words(k), "phrase", "a", "__low.l", "__low.r", "__low.score")


def _uncovered(phrases: DataFrame, longer: DataFrame, k: int, percent: int) -> DataFrame:
    """``phrases`` of k words without those that a phrase of k + 1 words holds and covers. What a still longer one covers, the one inside it covers too."""
    inside = F.explode(F.array(*(F.struct(*(F.col(c).alias(own) for c, own in zip(_words(k, begin), _words(k), strict=True))) for begin in (1, 2))))
    most = longer.select("a", inside.alias("e")).groupBy(*(F.col(f"e.{c}").alias(c) for c in _words(k))).agg(F.max("a").alias("most"))
    return phrases.join(most, _words(k), "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, cover_percent: int = 50, top: int | None = 2000, filter_bytes: int = 1 << 25, batch_chars: int = 500_000, hash_bits: int = 64) -> DataFrame:
    """Each language's phrases of 2 to ``max_words`` words, the ``top`` first (None: all): lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased; texts end in pieces at . , ; : ! ? and line ends, pieces are words between spaces and tabs. a is the number of all
    occurrences of the phrase inside pieces, n that of all words of the language. The phrase is cut where floor(10^6 a a / (l r)) is smallest, l and r the
    frequencies of the two parts, ties after fewer words. Phrases below ``min_count`` aren't looked at; a phrase is dropped if a longer
    one that holds its words has ``cover_percent`` of its frequency or more. Ranks go by score, frequency and the phrase's bytes.

    A null language is und, a null text empty; an empty table, or one without a frequent phrase, gives no rows. Repeated rows count as often as they
    stand there. Ids and other columns are ignored. A driver and executor hold at most ``filter_bytes`` of filters a length.
    """
    if max_words < 2:
        raise ValueError("phrases have two words or more")
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    blocks, words = _indexed(source, hash_bits, batch_chars)
    tables = _frequent(spark, blocks, words, max_words, min_count, filter_bytes)
    kept = None
    for k in range(2, max_words + 1):
        tables[k - 1] = staged(_scored(tables, k))
    for k in range(2, max_words + 1):
        own = _uncovered(tables[k - 1], tables[k], k, cover_percent) if k < max_words else tables[k - 1]
        own = own.select("lang", "phrase", "a", "l", "r", "score")
        kept = own if kept is None else kept.unionByName(own)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # the first of each share of a language, so that no task sorts the whole of it
        kept = kept.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(parts(spark))))
        kept = kept.withColumn("__first", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).where(F.col("__first") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
