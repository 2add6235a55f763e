"""Fill-in-the-middle transformation over run-length encoded texts.

A text is kept as its maximal runs of one character class, each with the number of units that have ended by its end. The run that holds
a cut is found by binary search in those counts, and the place of the cut inside the run follows by arithmetic: no unit is ever
listed. Runs, counts and searches are arrays over a batch of texts; pieces, forms, hashes and outputs are column functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import runs_of, set_aside

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: How many units end in a run: at each of its characters, once at its end, or nowhere (but for the end of the text).
EACH, ONCE, NONE = 0, 1, 2
#: Per unit: the code points of class 1, and what ends in a run of class 0 and in one of class 1.
#: line: [^\n]*\n|[^\n]+; word: [^ \t-\r]*[ \t-\r]+|[^ \t-\r]+; char: one code point.
UNITS = {"line": ((10,), NONE, EACH), "word": ((32, 9, 10, 11, 12, 13), NONE, ONCE), "char": ((), EACH, EACH)}


@dataclass
class Runs:
    """Maximal runs of a batch of texts: where each starts (code points of the batch), the units ended in the batch before it, and what ends in
    it. ``text[i]:text[i + 1]`` are the runs of text i; the last entry of ``start`` and ``before`` is the end."""

    start: np.ndarray
    before: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    def units(self) -> np.ndarray:
        return self.before[self.text[1:]] - self.before[self.text[:-1]]

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Code points of each text before its first ``units[i]`` units have ended."""
        begins = self.start[self.text[:-1]]
        if not len(self.ends):
            return np.zeros(len(begins), dtype=np.int64)
        goal = self.before[self.text[:-1]] + units
        run = np.clip(np.searchsorted(self.before, goal, side="left") - 1, 0, len(self.ends) - 1)  # before[run] < goal <= before[run + 1]
        inside = np.where(self.ends[run] == EACH, goal - self.before[run], self.start[run + 1] - self.start[run])
        return np.where(units > 0, self.start[run] + inside - begins, 0)


def encode(texts: list[str], unit: str = "line") -> Runs:
    """The runs of each text; None is an empty text."""
    breaks, plain, broken = UNITS[unit]
    size = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.zeros(len(points), dtype=bool)
    for point in breaks:
        kind |= points == point
    change = np.ones(len(points), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[edge[:-1][size > 0]] = True
    start = np.flatnonzero(change)
    length = np.diff(np.append(start, len(points)))
    ends = np.where(kind[start], broken, plain)
    text = np.searchsorted(start, edge)
    last = text[1:][size > 0] - 1
    ends[last[ends[last] == NONE]] = ONCE  # the end of the text ends its last unit
    count = np.where(ends == EACH, length, np.where(ends == ONCE, 1, 0))
    return Runs(np.append(start, len(points)), np.concatenate([[0], np.cumsum(count)]), ends, text)


def _cuts(unit: str, batch_chars: int):
    """Column function (text, h1, h2): the units of the text, and the code points before its two cuts."""

    @F.pandas_udf("n long, a long, b long")
    def cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        texts, out = text.tolist(), [np.zeros((3, 0), dtype=np.int64)]
        for lo, hi in runs_of(texts, batch_chars):
            runs = encode(texts[lo:hi], unit)
            n = runs.units()
            x, y = (h.iloc[lo:hi].to_numpy(dtype=np.int64) % (n + 1) for h in (h1, h2))
            out.append(np.stack([n, runs.cut(np.minimum(x, y)), runs.cut(np.maximum(x, y))]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["n", "a", "b"])

    return cuts


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from, by its form alone.

    A sentinel begins with a character that none holds again, so none can begin inside a piece and end in the next sentinel: the first
    one found is the one that was put there.
    """
    p, s, m = sentinels
    psm_prefix = F.substring(F.substring_index(output, s, 1), F.lit(len(p) + 1), F.length(output))
    psm_rest = F.substring(output, F.length(psm_prefix) + len(p) + len(s) + 1, F.length(output))
    psm_suffix = F.substring_index(psm_rest, m, 1)
    psm_middle = F.substring(psm_rest, F.length(psm_suffix) + len(m) + 1, F.length(output))
    spm_suffix = F.substring(F.substring_index(output, p, 1), F.lit(len(s) + 1), F.length(output))
    spm_rest = F.substring(output, F.length(spm_suffix) + len(s) + len(p) + 1, F.length(output))
    spm_prefix = F.substring_index(spm_rest, m, 1)
    spm_middle = F.substring(spm_rest, F.length(spm_prefix) + len(m) + 1, F.length(output))
    return F.when(form == "psm", F.concat(psm_prefix, psm_middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: str = "7", percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, batch_chars: int = 2_000_000) -> DataFrame:
    """The columns of ``docs`` with n, form, output, prefix_chars, middle_chars added, one row per row; nothing is shuffled.

    The SHA-256 of the seed, a colon and the id (decimal; null: nothing) deals the two cuts, between two of the n units, the
    share of texts that are transformed and the share of those that get the suffix first. A null text counts as empty. An empty text, or one
    that holds a sentinel, stays plain, as do those beyond ``percent``; lengths are null there. Rows that repeat an id are cut alike as far as
    their texts are; columns of ``docs`` that are named like the added ones are replaced. An empty table stays empty.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    if len(set(sentinels)) < 3 or any(not s or s[0] in s[1:] or any(s[0] in t[1:] or s in t for t in sentinels if t != s) for s in sentinels):
        raise ValueError("sentinels must differ, and none may hold what another begins with beyond its first character")
    added = ("n", "form", "output", "prefix_chars", "middle_chars")
    held, _ = set_aside(docs, *added)
    own = {c.lower(): f"__own_{c}" for c in docs.columns if c.lower() in added}
    id_name, text_name = (own.get(c.lower(), c) for c in (id_col, text_col))
    text = F.coalesce(F.col(f"`{text_name}`"), F.lit(""))
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_name}`").cast("long").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = held.withColumn("__text", text).withColumn("__h", F.array(*h))
    rows = rows.withColumn("__cut", _cuts(unit, batch_chars)(F.col("__text"), F.col("__h")[0], F.col("__h")[1]))
    t, a, b = F.col("__text"), F.col("__cut.a").cast("int"), F.col("__cut.b").cast("int")
    holds = F.lit(False)
    for s in sentinels:
        holds |= F.contains(t, F.lit(s))
    form = F.when((t == "") | holds | (F.col("__h")[2] % 100 >= percent), "plain").when(F.col("__h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("__form", form)
    prefix, middle, suffix = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t))
    p, s, m = (F.lit(x) for x in sentinels)
    output = F.when(F.col("__form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("__form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(t)
    plain = F.col("__form") == "plain"
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    lengths = [F.when(~plain, x.cast("long")).alias(name) for name, x in (("prefix_chars", a), ("middle_chars", b - a))]
    return rows.select(*kept, F.col("__cut.n").alias("n"), F.col("__form").alias("form"), output.alias("output"), *lengths)
