"""Byte-pair encoding of whole corpora with a public byte-level vocabulary.

Text is split by the vocabulary's pattern; each piece is encoded on its own. Within a piece a
segment tree over the byte positions holds, per position, the rank of the pair that starts
there, and in its root the leftmost of the least ranks. A merge replaces the pair, takes the
right neighbour out of the linked list of live positions and updates two leaves, O(log n)
each: a piece of n bytes costs O(n log n) however long it is. Pieces repeat, so their ids are
kept in a bounded table per task.

Null and empty texts have no ids (an empty list). Text that looks like a special token is
ordinary text: the vocabulary's ranks hold no special tokens. Lone surrogates cannot occur in
Spark strings. Any byte sequence has ids, as all single bytes are in the vocabulary.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from countweave.functions.partitions import spread

TOKENIZERS = os.environ.get("COUNTWEAVE_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pattern that splits text ahead of the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 62
SHIFT = 32
CACHE_PIECES, CACHE_BYTES = 200_000, 64  # pieces kept per task, and the longest of them


class Encoder:
    """Encodes text by one vocabulary of ranks (bytes -> id)."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: merge the leftmost pair of least rank until none is left."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        # leaf i: rank and position of the pair that starts at byte i, as one sortable number
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                tree[size + i] = r << SHIFT | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        end = list(range(1, n + 1))  # live token at i covers data[i:end[i]]
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] != NEVER:
            i = tree[1] & ((1 << SHIFT) - 1)
            j = end[i]  # the right partner, which dies
            e = end[j]
            end[i] = e
            put(j, NEVER)
            if e < n:
                before[e] = i
                r = ranks.get(data[i : end[e]])
                put(i, NEVER if r is None else r << SHIFT | i)
            else:
                put(i, NEVER)
            p = before[i]
            if p >= 0:
                r = ranks.get(data[p:e])
                put(p, NEVER if r is None else r << SHIFT | p)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        kept, out = self.kept, []
        for s in self.split(text):
            ids = kept.get(s)
            if ids is None:
                data = s.encode("utf-8")
                ids = tuple(self.piece(data))
                if len(data) <= CACHE_BYTES:
                    if len(kept) >= CACHE_PIECES:
                        kept.clear()
                    kept[s] = ids
            out += ids
        return out


def _work(path: str, keep: list[str], names: list[str], text: str, count_only: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            column = b.column(text)
            for lo in range(0, b.num_rows, 256):  # bounded output batches for long texts
                part = b.slice(lo, 256)
                lengths, flat = [], []
                for t in column.slice(lo, 256).to_pylist():
                    ids = encoder.encode(t) if t else []
                    lengths.append(len(ids))
                    if not count_only:
                        flat.append(np.array(ids, dtype=np.int32))
                if count_only:
                    out = pa.array(lengths, type=pa.int64())
                else:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, out], names=names)

    return work


def vocabulary(name: str = "byte_bpe_50k", root: str | None = None) -> str:
    return f"{root or TOKENIZERS}/{name}.tiktoken"


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids: array<int> of every row of df. The vocabulary's file must be on every worker."""
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    slim = spread(df.select(key, text), key)
    return slim.mapInArrow(_work(path or vocabulary(), [key], schema.names, text, False), schema)


def token_counts(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """keep, n_tokens: number of ids of every row's text."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("n_tokens", T.LongType())])
    slim = spread(df.select(*keep, *([text] if text not in keep else [])), keep[0])
    return slim.mapInArrow(_work(path or vocabulary(), keep, schema.names, text, True), schema)
