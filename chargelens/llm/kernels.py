"""NumPy kernels over the UTF-8 bytes of a batch of texts.

All kernels work on one flat byte buffer per batch, so that their cost per
byte is a fixed number of vector passes whatever the number or length of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = True
    word[128:] = True
    return lower, word


#: A-Z to a-z; word bytes: digits, a-z and every byte of a non-ASCII character.
LOWER, WORD = _byte_classes()


def flatten(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row (null: empty), and where each begins; one offset more than texts."""
    blobs = [(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t) if isinstance(t, (bytes, bytearray)) else b"") for t in texts]
    offsets = np.zeros(len(blobs) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in blobs], out=offsets[1:])
    return np.frombuffer(b"".join(blobs), dtype=np.uint8), offsets


@dataclass
class Words:
    """Lower-cased words of a batch. ``first[d]:first[d + 1]`` are the words of text d."""

    lowered: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts) -> Words:
    """Maximal runs of word bytes after A-Z are lower-cased, with a 64-bit hash of each.

    Texts are kept apart by a separator byte that no word contains.
    """
    raw, off = flatten(texts)
    n = len(off) - 1
    buf = np.zeros(len(raw) + n + 1, dtype=np.uint8)
    shifted = off + np.arange(n + 1)  # each text begins after one separator
    if len(raw):
        buf[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = LOWER[raw]
    is_word = WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[-1:].any():
        edge = np.append(edge, len(buf))
    start, end = edge[0::2], edge[1::2]
    h = span_hash(buf, start, end)
    first = np.searchsorted(start, shifted)
    return Words(buf, shifted + 1, start, end, first.astype(np.int64), h)


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers, from a table that grows by doubling and is kept."""
    have = _TABLES.get(int(base))
    if have is None or len(have) < n:
        have = _TABLES[int(base)] = powers(base, max(n, 1 << 16, 0 if have is None else 2 * len(have)))
    return have[:n]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every ``buf[start:end]``: a polynomial in an odd base, then mixed with the length. ``values``: 64 bits for each byte, for another hash."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1) if values is None else values[buf]) * _powers(_P_INV, len(buf)), out=total[1:], dtype=np.uint64)
    value = (total[end] - total[start]) * _powers(_P, len(buf) + 1)[np.maximum(end - 1, 0)]
    return mix64(value ^ mix64((end - start).astype(np.uint64)))


def word_ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of n words; a text of 1 to n - 1 words has one run, of them all."""
    doc, count = w.doc, np.diff(w.first)
    if not len(doc):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value = np.zeros(len(doc), dtype=np.uint64)
    padded = np.concatenate([w.hash, np.zeros(n, dtype=np.uint64)])
    dpad = np.concatenate([doc, np.full(n, -1)])
    for k in range(n):
        inside = dpad[k : k + len(doc)] == doc
        value = mix64(value * _P + np.where(inside, padded[k : k + len(doc)], np.uint64(0)))
    place = np.arange(len(doc)) - w.first[doc]
    keep = (place <= count[doc] - n) | (place == 0)
    return doc[keep], value[keep]


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over each window of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out
