"""Packing by power-of-two decomposition.

A document's ids, its end id included, are cut into pieces whose lengths are powers of two: full pieces of the sequence
length first, then the set bits of the rest from high to low. Each piece is a sequence of its own, so no sequence crosses
documents and none needs padding; sequences of one length form a bucket, from which batches are drawn.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import doc_columns, runs_of, small_batches
from chargelens.llm.kernels import flatten, span_hash


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class Encoder:
    """Ids of a byte-level BPE tokenizer file, through a table of the chunks seen.

    A space before a byte that is neither white space nor a digraph's possible start always begins a pre-token, so texts
    can be cut there and chunks encoded alone. Where the file's merges aren't in the order of the ids, or it isn't plain
    byte-level BPE, whole texts go to the ``tokenizers`` library instead. A text that holds a special token's string goes
    there too. ``most`` bounds the table.
    """

    #: The split pattern of the public byte-level vocabulary; a fixed value.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, most: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)
        self.most = most
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @cached_property
    def slow(self):
        """The ``tokenizers`` library's own, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _fast(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, letters = model["vocab"], _byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [vocab.get("".join(m), -1) for m in merges]
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges")
        if not plain or made != sorted(made):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one offset more than texts)."""
        odd = [self.fast is None or any(s in t for s in self.special) for t in texts]
        ids, count = self._chunks(["" if o else t for t, o in zip(texts, odd, strict=True)])
        if any(odd):
            split = np.split(ids, np.cumsum(count)[:-1])
            for k in np.flatnonzero(odd).tolist():
                split[k] = np.array(self.slow.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
            ids, count = np.concatenate(split), np.array([len(x) for x in split], dtype=np.int64)
        return ids, np.concatenate([[0], np.cumsum(count)])

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buf, off = flatten(texts)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        after = buf[1:]
        cut = np.zeros(len(buf), dtype=bool)
        cut[:-1] = (buf[:-1] == 32) & (((after > 32) & (after < 127)) | (after >= 0xC4) & ~((after >= 0xE1) & (after <= 0xE3)) | (after == 0xC3))
        cut[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        key = span_hash(buf, start, end)
        kinds, first, place = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, kinds), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != kinds) if len(self.keys) else np.arange(len(kinds))
        blob = buf.tobytes()
        encode = getattr(self.fast, "_core_bpe", self.fast).encode_ordinary  # without the wrapper's checks, where there is one
        found = [encode(blob[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
        size = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(size.sum()))
        keys, ids = np.concatenate([self.keys, kinds[new]]), np.concatenate([self.ids, flat])
        sizes, ats = np.concatenate([self.size, size]), np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        order = np.argsort(keys, kind="stable")
        keys, sizes, ats = keys[order], sizes[order], ats[order]
        if len(keys) <= self.most:
            self.keys, self.size, self.at, self.ids = keys, sizes, ats, ids
        k = np.searchsorted(keys, kinds)[place]
        n = sizes[k]
        begin = np.cumsum(n) - n
        out = ids[np.repeat(ats[k] - begin, n) + np.arange(int(n.sum()))]
        bound = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(bound[np.searchsorted(start, off)])


def pieces(n: int, longest: int) -> list[int]:
    """Power-of-two lengths that add up to n, none over ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


_ENCODERS: dict[str, Encoder] = {}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1, with_ids: bool = False, batch_chars: int = 500_000, position_col: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), and ids if wanted.

    A document is the ids of its text (null: empty) and ``end_id``; an empty text is one piece of one id. ``longest`` is a
    power of two. ``sequence_id % 64`` is the bucket; ids of sequences are distinct and come from the input partition and the
    place in it, so a task that is run again gives the same. With ``position_col``, distinct numbers from 0 to 2^32 - 1, they come from the
    row's position and the piece's place in it instead, and the order of sequence ids is that of positions. Rows that repeat an id are packed once each; an empty table
    gives no piece. No row moves between tasks. ``tokenizer_path`` must be readable on the executors (it is part of the
    installed vocabulary package), and each Python worker loads it once.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession, 500)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        sequence = (TaskContext.get().partitionId() << 31) * 64
        for frame in frames:
            if position_col and (frame["position"].to_numpy() >> 32).any():
                raise ValueError("positions go from 0 to 2^32 - 1: sequence ids of others would not be distinct")
            texts, doc_ids = frame["text"].tolist(), frame["doc_id"].to_numpy()
            for lo, hi in runs_of(texts, batch_chars):
                ids, off = encoder.encode(texts[lo:hi])
                row, start, length, crc, tokens, cuts, nth = [], [], [], [], [], [], []
                for k in range(hi - lo):
                    own = np.append(ids[off[k] : off[k + 1]], np.uint32(end_id)).astype("<u4")
                    at = 0
                    for j, n in enumerate(pieces(len(own), longest)):
                        nth.append(j)
                        row.append(lo + k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(own[at : at + n]))
                        tokens.append(len(own))
                        if with_ids:
                            cuts.append(own[at : at + n].astype(np.int64))
                        at += n
                bucket = np.log2(length).astype(np.int64)
                number = sequence + np.arange(len(row)) * 64 + bucket
                if position_col:
                    number = (frame["position"].to_numpy()[row] << 31) + np.array(nth, dtype=np.int64) * 64 + bucket
                sequence += len(row) * 64
                out = pd.DataFrame({"doc_id": doc_ids[row], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens, "sequence_id": number, "offset": 0, "bucket": bucket})
                yield out.assign(ids=cuts) if with_ids else out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<long>" * with_ids
    position = [F.col(position_col).cast("long").alias("position")] if position_col else []
    return doc_columns(docs, id_col, text_col, *position).mapInPandas(packed, schema)
