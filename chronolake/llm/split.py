"""Problem 3: cut oversized texts into pieces of at most `limit` words at natural boundaries, neighbours sharing `overlap` words.

The gap behind each word has a strength: paragraph end 6, line end before a list mark 5, line end 4, sentence end 3, clause end
(; :) 2, comma 1, otherwise 0. A sparse table over the strengths answers "the strongest gap of this window, the rightmost of
equals" in constant time after O(n log n) preparation; each piece ends at that gap of its permissible window (from least to
limit words), and the next begins `overlap` words before it. The last piece ends with the text.

A word is a maximal run of characters other than Unicode white space, so joining the words of all pieces without the shared ones
gives the words of the text.

Cases: NULL, empty and blank texts and texts up to the limit give no pieces; a text without any boundary is cut at the limit;
malformed JSON and segments without text give none, but a segment keeps its number among its neighbours; exact duplicate rows
count once; no bound on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST = 512, 64, 256
_RUN = regex.compile(r"\S+")
_MARK = regex.compile(r"(?:[-*•+–]|\(?(?:\d{1,3}|[a-zđ]|[ivx]{1,5})[.)]|#{1,6}|Điều)$")
_CLOSING = "\"'»”’)]}*_"
PIECES = (
    "provision_id string, segment_no int, piece_no int, word_start int, word_end int, cut_strength int, piece string"
)


class StrongestCut:
    """Sparse table of the rightmost maximum."""

    def __init__(self, strengths: np.ndarray):
        # The position as the lower digits makes equals break to the right.
        self.n = len(strengths)
        self.rows = [strengths.astype(np.int64) * self.n + np.arange(self.n)]
        width = 1
        while 2 * width <= self.n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[: self.n - 2 * width + 1], last[width : self.n - width + 1]))
            width *= 2

    def query(self, first: int, last: int) -> int:
        """Position of the strongest in first..last, both included."""
        k = (last - first + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[first], row[last - (1 << k) + 1]) % self.n)


def gaps(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The words' spans and the strength of the gap behind each."""
    spans = [m.span() for m in _RUN.finditer(text)]
    strengths = np.zeros(len(spans), np.int8)
    for i, (start, end) in enumerate(spans[:-1]):
        following = spans[i + 1]
        lines = text.count("\n", end, following[0])
        if lines > 1:
            strengths[i] = 6
        elif lines:
            strengths[i] = 5 if _MARK.match(text[following[0] : following[1]]) else 4
        else:
            last = text[start:end].rstrip(_CLOSING)[-1:]
            if last and last in ".?!…":
                # "3." and "a." before a word are marks of a list rather than sentence ends
                strengths[i] = 0 if _MARK.match(text[start:end]) else 3
            elif last and last in ";:":
                strengths[i] = 2
            elif last == ",":
                strengths[i] = 1
    return spans, strengths


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int, str]]:
    """First word, end word (not included), strength of the cut at its end (-1 for the text's end), text of each piece."""
    if not 0 <= overlap < least <= limit:
        raise ValueError("it must hold that 0 <= overlap < least <= limit")
    if not text or len(text) < 2 * limit + 1:
        return []
    spans, strengths = gaps(text)
    n = len(spans)
    if n <= limit:
        return []
    table, out, start = StrongestCut(strengths), [], 0
    while n - start > limit:
        end = table.query(start + least - 1, start + limit - 1) + 1
        out.append((start, end, int(strengths[end - 1]), text[spans[start][0] : spans[end - 1][1]]))
        start = end - overlap
    out.append((start, n, -1, text[spans[start][0] : spans[-1][1]]))
    return out


def _cut(limit: int, overlap: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(7)]
            for key, number, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k, piece in enumerate(pieces(text, limit, overlap, least), 1):
                    for column, value in zip(made, (key, number, k, *piece)):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            names = ("provision_id", "segment_no", "piece_no", "word_start", "word_end", "cut_strength", "piece")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds)], names=list(names))

    return run


def provision_texts(provisions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """provision_id, segment_no (0: the content), text of all that may be longer than the limit.

    More than `limit` words need at least 2 * limit + 1 characters, so shorter texts never leave the JVM.
    """
    shortest = 2 * limit + 1
    content = provisions.filter(F.length("content") >= shortest).select(
        "provision_id", F.lit(0).alias("segment_no"), F.col("content").alias("text")
    )
    segments = F.from_json("page_segments_json", "array<struct<text:string>>")
    segment = (
        provisions.filter(F.length("page_segments_json") >= shortest)
        .select("provision_id", F.posexplode(segments).alias("at", "segment"))
        .select("provision_id", (F.col("at") + 1).alias("segment_no"), F.col("segment.text").alias("text"))
        .filter(F.length("text") >= shortest)
    )
    return content.unionByName(segment).distinct()


def split_oversized(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """provision_id, segment_no, text -> the ordered pieces of every text longer than the limit."""
    return texts.select("provision_id", "segment_no", "text").mapInArrow(_cut(limit, overlap, least), PIECES)


def oversized(found: DataFrame) -> DataFrame:
    return found.filter("piece_no = 1").select("provision_id", "segment_no").distinct()
