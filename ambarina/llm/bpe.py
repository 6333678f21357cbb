"""Encoding with a public byte-level BPE vocabulary: ids exactly as the vocabulary's own library gives them, without special tokens.

A text is parted by the vocabulary's pattern; within a part, bytes are merged by rank, always the lowest and of equal ones the leftmost.
A segment tree holds the rank of every adjacent pair: its root is that merge, and a merge changes three leaves, so a part of n bytes
takes O(n log n) however it is written. Parts recur, so each task keeps the ids of those it has met.

Null and empty texts have no ids: an empty list, count 0. Texts are taken whole and unaltered; a lone surrogate, which has no bytes,
counts as U+FFFD, as in the libraries.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread

#: Fixed value: the pattern that parts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of the parts a task remembers, about; then it starts anew. Longer parts than PART bytes are never kept.
REMEMBERED, PART = 48_000_000, 64
NONE = 1 << 62


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The file of a vocabulary: in ``folder``, else in $TOKENIZERS_DIR, else where the public tokenizers are installed."""
    folder = folder or os.environ.get("TOKENIZERS_DIR")
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return ranks_of(f.read())


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def _shipped(df: DataFrame, path: str | None):
    """The vocabulary file as a broadcast: read where the query is built, so the executors need no copy. Its size is that of the file."""
    with open(path or vocabulary_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


class PairTree:
    """The least of the pair ranks, and the leftmost place that has it, in a segment tree over the places."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        # a leaf is rank and place in one number, so the least number is the leftmost of the lowest rank
        self.tree = [NONE] * self.size + [NONE if r < 0 else r << 40 | i for i, r in enumerate(ranks)] + [NONE] * (self.size - len(ranks))
        t = self.tree
        for i in range(self.size - 1, 0, -1):
            a, b = t[2 * i], t[2 * i + 1]
            t[i] = a if a < b else b

    def lowest(self) -> int:
        """The place of the next merge, or -1."""
        root = self.tree[1]
        return -1 if root == NONE else root & ((1 << 40) - 1)

    def set(self, place: int, rank: int) -> None:
        t, i = self.tree, self.size + place
        t[i] = NONE if rank < 0 else rank << 40 | place
        i >>= 1
        while i:
            a, b = t[2 * i], t[2 * i + 1]
            low = a if a < b else b
            if t[i] == low:
                break
            t[i] = low
            i >>= 1


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.known: dict[str, array] = {}
        self.held = 0

    def merge(self, part: bytes) -> list[int]:
        """The ids of one part."""
        ranks = self.ranks
        if (whole := ranks.get(part)) is not None:
            return [whole]
        n = len(part)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        rank = lambda a, b: ranks.get(part[a : end[b]], -1)
        tree = PairTree([rank(i, i + 1) for i in range(n - 1)])
        while (a := tree.lowest()) >= 0:
            b = after[a]
            end[a], after[a] = end[b], after[b]
            if after[a] < n:
                before[after[a]] = a
                tree.set(a, rank(a, after[a]))
            else:
                tree.set(a, -1)
            if b < n - 1:
                tree.set(b, -1)
            if before[a] >= 0:
                tree.set(before[a], rank(before[a], a))
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i : end[i]]])
            i = after[i]
        return out

    def part(self, text: str) -> array:
        ids = array("i", self.merge(text.encode("utf-8", "replace") if text.isascii() or not any("\ud800" <= c <= "\udfff" for c in text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()))
        if len(text) <= PART:
            self.held += 150 + 4 * len(text)
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> array:
        out = array("i")
        if text:
            known, part, more = self.known, self.part, out.extend
            for p in self.split(text):
                ids = known.get(p)
                more(part(p) if ids is None else ids)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, part = self.known, self.part
        total = 0
        for p in self.split(text):
            ids = known.get(p)
            total += len(part(p) if ids is None else ids)
        return total


def encode(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids (array of int) of every row, without special tokens. Extra columns are dropped."""
    vocabulary = _shipped(df, path)
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    # the empty string and null leave as they are; Arrow carries lists as one buffer of values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_of(vocabulary.value))
        for batch in batches:
            values, offsets = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                values.extend(encoder.encode(t))
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return spread(df.select(key, text), key).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """key, the columns of ``keep`` and n_tokens of every row; 0 for null and empty texts."""
    vocabulary = _shipped(df, path)
    schema = T.StructType([df.schema[c] for c in (key, *keep)] + [T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_of(vocabulary.value))
        for batch in batches:
            n = pa.array([encoder.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[key, *keep, "n_tokens"])

    return spread(df.select(key, *keep, text), key).mapInArrow(run, schema)


def with_special(df: DataFrame, special: int, ids: str = "ids") -> DataFrame:
    """ids with the id of the end mark behind every text, the empty ones included."""
    return df.withColumn(ids, F.array_append(F.col(ids), F.lit(special)))
