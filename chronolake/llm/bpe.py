"""Problem 6: token ids of every text by a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's own pattern; each word's bytes are merged by rank. The merge order of one word
is kept in a segment tree over its byte positions whose nodes hold the leftmost least pair rank, so a merge costs a few
updates of logarithmic length on the live neighbours and a word of n bytes O(n log n), also for a run of one letter that is a
whole text long.

Cases: NULL and empty texts give an empty list; strings that look like special tokens are ordinary text; any character that
Parquet can hold is encoded by its bytes; repeated rows stay as many rows; extra columns are left out unless named in `keep`.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronolake.session import spread

#: Where the public vocabularies lie; a parameter of every operator here.
VOCABULARIES = os.environ.get("CHRONOLAKE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker keeps encoded; beyond that it starts anew. It changes the speed only.
KEPT_WORDS = 300_000
#: Texts that are answered from one Arrow batch at a time.
BATCH_TEXTS = 256

_NEVER = 1 << 60
# A single blank between two other characters always begins a new word, so texts can be cut there before the pattern runs.
_BLANK = re.compile(r"(?<=\S) (?=\S)")


class PairTree:
    """Segment tree over positions; each node holds the leftmost position of its least rank."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size, self.ranks = size, ranks + [_NEVER] * (size - len(ranks))
        self.best = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            self._pull(node)

    def _pull(self, node: int) -> None:
        left, right = self.best[2 * node], self.best[2 * node + 1]
        self.best[node] = left if self.ranks[left] <= self.ranks[right] else right

    def least(self) -> int:
        return self.best[1]

    def put(self, at: int, rank: int) -> None:
        self.ranks[at] = rank
        node = (at + self.size) // 2
        while node:
            self._pull(node)
            node //= 2


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word of the pattern."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        if n < 2:
            return [ranks[raw]]
        ends = list(range(1, n + 1))  # where the piece that starts here ends
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = PairTree([ranks.get(raw[i : i + 2], _NEVER) for i in range(n - 1)] + [_NEVER])
        while tree.ranks[at := tree.least()] < _NEVER:
            gone = after[at]
            ends[at], after[at] = ends[gone], after[gone]
            tree.put(gone, _NEVER)
            if after[at] < n:
                before[after[at]] = at
                tree.put(at, ranks.get(raw[at : ends[after[at]]], _NEVER))
            else:
                tree.put(at, _NEVER)
            if (left := before[at]) >= 0:
                tree.put(left, ranks.get(raw[left : ends[at]], _NEVER))
        out, at = [], 0
        while at < n:
            out.append(ranks[raw[at : ends[at]]])
            at = after[at]
        return out

    def part(self, part: str) -> tuple[int, ...]:
        """Ids of a stretch of text that begins and ends between words."""
        out: list[int] = []
        for word in self.words.findall(part):
            ids = self.kept.get(word)
            if ids is None:
                ids = tuple(self.word(word.encode()))
                if len(word) < 64:
                    if len(self.kept) >= KEPT_WORDS:
                        self.kept.clear()
                    self.kept[word] = ids
            out.extend(ids)
        return tuple(out)

    def _ids(self, part: str) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.part(part)
            if len(part) < 64:
                if len(self.parts) >= KEPT_WORDS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def encode(self, text: str | None, out: list[int] | None = None) -> list[int]:
        """The ids of text, appended to out."""
        out = [] if out is None else out
        if not text:
            return out
        first, *rest = _BLANK.split(text)
        find = self.parts.get
        out += self._ids(first)
        for part in rest:
            part = " " + part
            out += find(part) or self._ids(part)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARIES, name)


def _encoded(path: str, keep: list[str], text: str, count_only: bool, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(start, BATCH_TEXTS)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                flat: list[int] = []
                offsets = np.zeros(len(texts) + 1, np.int32)
                for i, one in enumerate(texts, 1):
                    offsets[i] = len(own.encode(one, flat))
                kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                if count_only:
                    made = pa.array(np.diff(offsets), pa.int32())
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*keep, name])

    return run


def encode(df: DataFrame, keep: list[str], text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """The columns of keep and the token ids of each row's text."""
    rows = spread(df.select(*dict.fromkeys([*keep, text])))
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encoded(path or vocabulary(), keep, text, False, ids), schema)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", n: str = "n_tokens", path: str | None = None) -> DataFrame:
    """The columns of keep and how many tokens each row's text has."""
    rows = spread(df.select(*dict.fromkeys([*keep, text])))
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(n, T.IntegerType())])
    return rows.mapInArrow(_encoded(path or vocabulary(), keep, text, True, n), schema)
