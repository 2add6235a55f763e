"""Language identification by cross-parsing entropy.

Labelled text of each language (a bounded sample) becomes a suffix automaton. A text is cut greedily into the longest
phrases that occur in a language's sample; the language that needs the fewest phrases a byte wins. Automata are flat
transition tables, and the blocks of many texts walk them in step, a vector operation a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chargelens.llm.common import columns_of, runs_of, saved, set_aside, small_batches
from chargelens.llm.kernels import flatten

ADDED = ("lang_pred", "lang_score", "phrase_rate")
#: Phrases end at least every so many bytes.
BLOCK = 1024


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring (Blumer et al., 1985). State 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols.tolist():
        state = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[state] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return step


def fold(texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes in which every run of ASCII other than letters is one space, and where each text begins."""
    raw, off = flatten([t.lower() if t else "" for t in texts])
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[off[:-1]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= begins[:-1]
    count = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, raw, np.uint8(32))[keep], count[off]


@dataclass
class Parser:
    """Transition tables: entry = (next state's row << 1) + 1 where a phrase ends before this byte."""

    langs: list[str]
    classes: np.ndarray
    width: int
    tables: list[np.ndarray]

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Parser:
        folded = {lang: [x[0] for t in texts if len((x := fold([t]))[0])] for lang, texts in sorted(samples.items())}
        seen = np.unique(np.concatenate([np.zeros(0, dtype=np.uint8), *(b for x in folded.values() for b in x)]))
        classes = np.zeros(256, dtype=np.int32)  # 0: bytes of no sample, and what stands between two sample texts
        classes[seen] = np.arange(1, len(seen) + 1)
        width, tables = len(seen) + 1, []
        for blobs in folded.values():
            steps = suffix_automaton(np.concatenate([np.zeros(0, dtype=np.int32), *(np.append(classes[b], 0) for b in blobs)]))
            to = np.full((len(steps), width), -1, dtype=np.int64)
            for state, row in enumerate(steps):
                for c, nxt in row.items():
                    if c:
                        to[state, c] = nxt
            root = np.maximum(to[0], 0)
            tables.append((np.where(to >= 0, to * width << 1, (root * width << 1) | 1)).astype(np.int32).ravel())
        return cls(list(folded), classes, width, tables)

    def phrases(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) by language (columns), and its folded bytes."""
        flat, off = fold(texts)
        symbol = self.classes[flat]
        size = np.diff(off)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(size)), blocks)
        begin = off[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        length = np.minimum(off[owner + 1] - begin, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        live = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # lanes longer than each step
        out = np.zeros((len(size), len(self.langs)), dtype=np.int64)
        state = [np.zeros(len(owner), dtype=np.int32) for _ in self.langs]
        ended = [np.ones(len(owner), dtype=np.int32) for _ in self.langs]
        for k in range(BLOCK):
            if not (n := int(live[k])):
                break
            c = symbol[begin[:n] + k]
            for table, s, e in zip(self.tables, state, ended, strict=True):
                entry = table[s[:n] + c]
                e[:n] += entry & 1
                s[:n] = entry >> 1
        for column, e in enumerate(ended):
            out[:, column] = np.bincount(owner, weights=e, minlength=len(size)).astype(np.int64)
        return out, size


def sample_texts(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str, per_lang: int, chars: int) -> dict[str, list[str]]:
    """At most ``per_lang`` texts of each label, those with the smallest hashes, and ``chars`` characters of them together.

    A text is taken with the label of its own row. Ids, labels and hashes of the rows picked are sent to the texts:
    ``per_lang`` rows a label; what is collected is ``chars`` characters a label.
    """
    own = docs.where(train & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(11), id_col).alias("h"), F.xxhash64(F.lit(12), text_col).alias("g"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "g")
    ranked = own.select("doc_id", "lang", "h", "g", F.length("text").alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = ranked.withColumn("room", F.lit(chars) - before).where("room > 0").select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.col("g").alias("of"), "k", "room")
    texts = own.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")) & (F.col("g") == F.col("of")))
    out: dict[str, dict[int, str]] = {}
    for row in texts.select("lang", "k", F.expr("substring(text, 1, cast(room as int))").alias("text")).collect():
        out.setdefault(row["lang"], {})[row["k"]] = row["text"]  # rows that repeat as a whole are one text
    return {lang: [t for _, t in sorted(own.items())] for lang, own in sorted(out.items())}


_PARSED = "struct<lang:string,best:long,second:long,size:long>"


def _predictor(shared, batch_chars: int):
    @F.pandas_udf(_PARSED)
    def predict(texts: pd.Series) -> pd.DataFrame:
        """The label with the fewest phrases, its phrases, the runner-up's (-1: none), and the folded bytes."""
        model: Parser = shared.value
        lang = np.full(len(texts), None, dtype=object)
        best, second, folded = (np.full(len(texts), -1, dtype=np.int64) for _ in range(3))
        values = texts.tolist()
        for lo, hi in runs_of(values, batch_chars):
            counts, size = model.phrases(values[lo:hi])
            full = np.flatnonzero(size > 0)
            if not len(full):
                continue
            c = counts[full]
            two = np.sort(c, axis=1)[:, :2]
            lang[lo + full] = np.array(model.langs, dtype=object)[c.argmin(axis=1)]
            best[lo + full], folded[lo + full] = two[:, 0], size[full]
            if c.shape[1] > 1:
                second[lo + full] = two[:, 1]
        return pd.DataFrame({"lang": lang, "best": best, "second": second, "size": folded})

    return predict


def language_id(docs: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 48, chars: int = 20_000, batch_chars: int = 2_000_000, labels_at_once: int = 32) -> DataFrame:
    """``docs`` with lang_pred (string), lang_score (0 to 1) and phrase_rate (phrases a folded byte of the winner).

    Learned from the rows where ``train`` holds (all by default) and ``lang_col`` is not null, at most ``per_lang`` texts
    and ``chars`` characters a label; the parse takes every byte of every text. The score is 1 - best / second phrases (1 if
    only one label is known). A null text, one without a letter, or any text when nothing is labelled: ``und``, 0, and a null rate. Ties go to
    the label first in order. Columns of ``docs`` with one of the three names are replaced. Repeated rows and ids get equal results; an empty table stays empty.
    The automata of ``labels_at_once`` labels, about 10 MB each, are sent to the executors together; more labels take more passes over the table.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    samples = sample_texts(docs, F.lit(True) if train is None else train, id_col, text_col, lang_col, per_lang, chars)
    langs = list(samples)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out, parsed = docs, None
    for lo in range(0, len(langs), labels_at_once):
        shared = spark.sparkContext.broadcast(Parser.fit({lang: samples[lang] for lang in langs[lo : lo + labels_at_once]}))
        out = out.withColumn("__now", _predictor(shared, batch_chars)(text))
        if parsed is not None:  # labels are parsed in order, so that an earlier one wins a tie
            now, had = F.col("__now"), F.col("__p")
            won = now["best"] < had["best"]
            winner, loser = lambda name: F.when(won, now[name]).otherwise(had[name]), F.when(won, had["best"]).otherwise(now["best"])
            seconds = F.array_min(F.filter(F.array(loser, now["second"], had["second"]), lambda n: n >= 0))
            out = out.withColumn("__now", F.struct(winner("lang").alias("lang"), winner("best").alias("best"), seconds.alias("second"), now["size"].alias("size"))).drop("__p")
        out = out.withColumnRenamed("__now", "__p")
        parsed = True
        if lo + labels_at_once < len(langs):
            out = saved(out)
    if parsed is None:
        out = out.withColumn("__p", F.lit(None).cast(_PARSED))
    p = F.col("__p")
    seen = F.coalesce(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & p["lang"].isNotNull(), F.lit(False))
    score = F.when(p["second"] > 0, 1 - p["best"] / p["second"]).otherwise(1.0)
    return out.select(*columns_of(docs, *ADDED), F.when(seen, p["lang"]).otherwise("und").alias("lang_pred"), F.when(seen, score).otherwise(0.0).alias("lang_score"), F.when(seen, p["best"] / p["size"]).alias("phrase_rate"))


def keep_identified(docs: DataFrame, most_phrases: float = 0.5, least_chars: int = 200, **options) -> DataFrame:
    """``docs`` without those whose language can't be told: no letter, or ``least_chars`` characters or more and over ``most_phrases`` phrases a byte even in the best language."""
    text_col = options.get("text_col", "text")
    strange = (F.length(text_col) >= least_chars) & (F.coalesce("phrase_rate", F.lit(0.0)) > most_phrases)
    renamed, own = set_aside(docs, *ADDED)
    return language_id(renamed, **options).where((F.col("lang_pred") != "und") & ~strange).select(*own)
