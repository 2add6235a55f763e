"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a random but repeatable order, form blocks. Block j of a source with weight w is released at slot
floor((j - 1) / w) and due by ceil(j / w); earliest deadline first over the released blocks keeps every source within one
block of its share at every slot. Weights are fractions as they are written, and a schedule repeats after as many slots as their
smallest whole multiples add up to: only one such period is simulated, in whole numbers, and a block's slot follows from its number, so the driver's work does
not depend on the rows, and no weight is rounded. A period ends early where a source has no more blocks.
When a source has no more blocks, a new phase begins with the weights of those left, so every row is placed.
More sources than one schedule takes are dealt to groups: each group's sources are mixed first, then the groups as sources of their
summed weights (supertasks), which keeps a source within two blocks of its share.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chargelens.llm.common import columns_of, cut, set_aside

NULL_SOURCE = "__null__"
ADDED = ("mix_seq", "mix_block", "mix_slot", "mix_position")


#: Slots of the longest period that is simulated.
MOST_SLOTS = 1 << 20


def shares(weights: Mapping[str, float], most: int = MOST_SLOTS) -> dict[str, int]:
    """The smallest whole numbers in the ratio of the weights, as these are written in decimals.

    Where they add up to more than ``most`` they are rounded to that sum (largest remainders, at least 1 each): a weight is off by less than 1 / ``most`` of all then.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    divisor = math.gcd(*whole.values())
    whole = {s: w // divisor for s, w in whole.items()}
    if (total := sum(whole.values())) <= most:
        return whole
    if len(whole) > most:
        raise ValueError("a period needs a slot a source")
    out = {s: max(1, w * most // total) for s, w in whole.items()}
    order = sorted(whole, key=lambda s: (-(whole[s] * most % total), s))
    k = 0
    while (gap := most - sum(out.values())) != 0:
        s = order[k % len(order)]
        if gap > 0 or out[s] > 1:
            out[s] += 1 if gap > 0 else -1
        k += 1
    return out


def edf_period(share: Mapping[str, int], slots_wanted: int | None = None) -> dict[str, np.ndarray]:
    """The slots of each source's blocks in one period, or in its first slots, by earliest deadline among released blocks."""
    period = sum(share.values())
    waiting = [(0, -(-period // a), s, 1) for s, a in sorted(share.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in share}
    for t in range(period if slots_wanted is None else min(period, slots_wanted)):
        while waiting and waiting[0][0] <= t:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        slots[s].append(t)
        if j < share[s]:
            heapq.heappush(waiting, (j * period // share[s], -(-(j + 1) * period // share[s]), s, j + 1))
    return {s: np.array(x, dtype=np.int64) for s, x in slots.items()}


@dataclass
class Schedule:
    """For each source its segments: first block, first slot, slots within a period, and the period."""

    block_rows: int
    rows: dict[str, int]
    segments: dict[str, list[tuple[int, int, np.ndarray, int]]] = field(default_factory=dict)
    short_slots: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    short_rows: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))

    def slot(self, source: str, block: np.ndarray) -> np.ndarray:
        firsts = np.array([s[0] for s in self.segments[source]])
        at = np.searchsorted(firsts, block, side="right") - 1
        out = np.zeros(len(block), dtype=np.int64)
        for k, (first, base, slots, period) in enumerate(self.segments[source]):
            mine = at == k
            j = block[mine] - first
            out[mine] = base + j // len(slots) * period + slots[j % len(slots)]
        return out

    def position(self, source: str, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.slot(source, seq // self.block_rows)
        missing = self.short_rows[np.searchsorted(self.short_slots, slot, side="left")]
        return slot, slot * self.block_rows - missing + seq % self.block_rows


def plan(rows: Mapping[str, int], weights: Mapping[str, float], block_rows: int) -> Schedule:
    """The schedule of all blocks: phases that each end when a source has none left."""
    out = Schedule(block_rows, dict(rows), {s: [] for s in rows})
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    done, base = dict.fromkeys(left, 0), 0
    while left:
        share = shares({s: weights[s] for s in left})
        period = sum(share.values())
        due = min(-(-n * period // share[s]) for s, n in left.items())  # a source has its last block by then
        slots = edf_period(share, due)
        end = min((left[s] - 1) // share[s] * period + int(slots[s][(left[s] - 1) % share[s]]) + 1 for s in left if due > period or len(slots[s]) >= left[s])
        for s in list(left):
            if len(slots[s]):
                out.segments[s].append((done[s], base, slots[s], period))
            taken = end // period * share[s] + int(np.searchsorted(slots[s], end % period))
            done[s] += taken
            left[s] -= taken
            if not left[s]:
                del left[s]
        base += end
    short = sorted((int(out.slot(s, np.array([(n - 1) // block_rows]))[0]), block_rows - (n - 1) % block_rows - 1) for s, n in rows.items() if n)
    out.short_slots = np.array([x[0] for x in short], dtype=np.int64)
    out.short_rows = np.concatenate([[0], np.cumsum([x[1] for x in short], dtype=np.int64)]).astype(np.int64)
    return out


@dataclass
class Mix:
    """One schedule of all sources, or schedules of groups of sources and one of the groups."""

    outer: Schedule
    group: dict[str, str] = field(default_factory=dict)
    inner: dict[str, Schedule] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Mapping[str, int], weights: Mapping[str, float], block_rows: int, most: int) -> Mix:
        if len(rows) <= most:
            return cls(plan(rows, weights, block_rows))
        n = -(-len(rows) // most)
        if n > most:
            raise ValueError(f"more than {most * most} sources")
        group = {s: f"{k % n}" for k, s in enumerate(sorted(rows, key=lambda s: (zlib.crc32(s.encode()), s)))}
        members: dict[str, list[str]] = {}
        for s, g in group.items():
            members.setdefault(g, []).append(s)
        inner = {g: plan({s: rows[s] for s in own}, weights, block_rows) for g, own in members.items()}
        sums = {g: float(sum(Fraction(str(weights[s])) for s in own)) for g, own in members.items()}
        return cls(plan({g: sum(rows[s] for s in own) for g, own in members.items()}, sums, block_rows), group, inner)

    def position(self, source: str, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.inner:
            return self.outer.position(source, seq)
        group = self.group[source]
        return self.outer.position(group, self.inner[group].position(source, seq)[1])


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 64, seed: int = 42, max_sources: int = 256, default_weight: float | None = None) -> DataFrame:
    """``docs`` with mix_seq (place within its source), mix_block, mix_slot and mix_position (0 .. rows - 1, no gaps).

    ``weights`` by source, equal for all if None; a source that it doesn't name has ``default_weight``, or is an error where that is None. A null source is the source
    "__null__". Every row is placed once, repeated rows included; an empty table stays empty. Rows of a source are
    ordered by a hash of the id (ties: the id); rows that repeat an id, or have none, are interchangeable. Numbering is by hash strata
    within a source, so a source with any share of all rows is spread over many groups. The strata counts are sent to all executors: 2^18 rows at most, about
    40 bytes each, whatever the number of sources, and a row a source. Over ``max_sources`` sources are mixed in groups; ``max_sources`` squared is the
    most. Columns of ``docs`` with one of the four names are replaced.
    """
    keyed = docs.withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit(NULL_SOURCE))).withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col)))
    totals = {r["__source"]: r["n"] for r in keyed.groupBy("__source").agg(F.count("*").alias("n")).limit(max_sources * max_sources + 1).collect()}
    if len(totals) > max_sources * max_sources:
        raise ValueError(f"more than {max_sources * max_sources} sources")
    strata = max(1, min(4096, (1 << 18) // max(len(totals), 1)))
    keyed = keyed.withColumn("__stratum", F.pmod(F.shiftrightunsigned("__h", 40), F.lit(strata)))
    weights = dict.fromkeys(totals, 1.0) if weights is None else {s: weights.get(s, default_weight) for s in totals}
    if missing := sorted(s for s, w in weights.items() if w is None):
        raise ValueError(f"no weight for {missing}")
    schedule = Mix.of(totals, weights, block_rows, max_sources)
    counts = cut(keyed.groupBy("__source", "__stratum").agg(F.count("*").alias("__n")))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__source").orderBy("__stratum").rowsBetween(Window.unboundedPreceding, -1))).select("__source", "__stratum", F.coalesce("__before", F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__source", "__stratum").orderBy("__h", id_col)) - 1
    numbered = keyed.withColumn("__place", place).join(F.broadcast(before), ["__source", "__stratum"])  # 2^18 rows, or one a source
    numbered = numbered.withColumn("mix_seq", (F.col("__place") + F.col("__before")).cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(schedule)

    @F.pandas_udf("struct<slot:long,position:long>")
    def placed(source: pd.Series, seq: pd.Series) -> pd.DataFrame:
        slot, position = np.zeros(len(seq), dtype=np.int64), np.zeros(len(seq), dtype=np.int64)
        for name, at in source.groupby(source).indices.items():
            slot[at], position[at] = shared.value.position(name, seq.to_numpy()[at])
        return pd.DataFrame({"slot": slot, "position": position})

    out = numbered.withColumn("__p", placed("__source", "mix_seq"))
    return out.select(*columns_of(docs, *ADDED), "mix_seq", F.floor(F.col("mix_seq") / block_rows).alias("mix_block"), F.col("__p.slot").alias("mix_slot"), F.col("__p.position").alias("mix_position"))


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in schedule order: written, its part files hold ranges of positions, each sorted; no row is lost or repeated."""
    renamed, own = set_aside(docs, *ADDED)
    mixed = mix_sources(renamed, **options)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*own)
