"""Ranking of texts for batches of questions, with each question's statistics over only the texts eligible for it.

Questions go in blocks of a fixed number, whose words, phrases and boosts are numbered columns. For each block the texts are read
once, in Arrow batches, and kept as lists of the columns that they have. From these lists come

* the counts: for each distinct eligibility (date and basis) the texts, their words, and document frequencies of its questions'
  columns, each task's counts by one sort of (column, day) and two look-ups per figure, summed by slices in an exchange;
* floors: scores that k texts of a few tasks reach at least, and so the k best of all texts;
* the scores: a question's commonest columns are left aside as long as they can't lift a text to its floor, the rest goes through
  the lists of the texts that have each column, and only texts that may reach the floor are scored. All others can't be among the
  k best, so nothing is lost.

No text meets a question through an exchange, so no common term is a hot key, and what is broadcast is bounded by the block.

Score of an eligible text: BM25 over the question's words (repeated words count again), and for each distinct two- or three-word
phrase in common its idf (times 1.4 for three words); boosts for a document the question names and for stating its date where it
asks about effect, which also lift texts without a word in common. Scores are rounded to six places before they are compared, ties
go to the lesser id.

Cases: a question without a date finds nothing where eligibility needs one; k of zero or less finds nothing; NULL texts count as
empty ones, NULL ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.dates import date_basis, mentioned_dates
from chronolake.functions.text import named_docs
from chronolake.session import blocks, cut

K1, B = 1.5, 0.75
# Weights of phrases by length, boosts, and the words that ask about effect.
PHRASES = {2: 1.0, 3: 1.4}
DOCUMENT_BOOST, DATE_BOOST = 8.0, 20.0
ASKS_EFFECT = "hiệu lực|thi hành|áp dụng|bắt đầu"
#: Questions that pass over the texts together.
BLOCK = 16_384
#: Texts that are scored together, and those of them that have a part in the floors, in at most so many tasks.
TEXTS, FIRST, FIRST_TASKS = 16_384, 4_096, 16
#: Common columns of a batch that may be left aside, as a matrix.
DENSE = 512
#: Occurrences that are counted together, and counts a row.
COUNTED, SLICE = 1 << 22, 1 << 16
#: Questions whose eligible texts' mean lengths differ by less than this factor share bounds.
BAND = 1.05
#: More than the bounds' rounding errors.
SLACK = 1e-3
#: Share of a floor that the columns left aside may add at most. The less, the more lists are gone through, for fewer texts to look at.
ASIDE = 0.6

_WORD = re.compile(r"\w+")
ALWAYS, NEVER = -(1 << 30), 1 << 30
WORD, PHRASE, FIXED = 0, 1, 2


def _code_type(block: Block) -> type:
    return np.uint16 if len(block.kinds) <= 1 << 16 else np.int32


@dataclass
class Block:
    """Some questions. A column is a word, a phrase, a document or a date; an entry is a column of a question."""

    ids: list[str]
    words: dict[str, int]
    #: Sorted pairs (word, word) and triples (pair, word) as numbers, and their columns.
    pairs: tuple[np.ndarray, np.ndarray]
    triples: tuple[np.ndarray, np.ndarray]
    docs: dict[str, int]
    days: dict[int, int]
    kinds: np.ndarray
    #: Of the distinct eligibilities.
    day: np.ndarray
    by_issue: np.ndarray
    #: Of each question: its eligibility, and where its entries begin (one more at the end).
    group: np.ndarray
    at: np.ndarray
    #: Of each entry: column, weight, and its figure, one for each distinct (eligibility, column).
    column: np.ndarray
    weight: np.ndarray
    figure: np.ndarray
    figures: tuple[np.ndarray, np.ndarray]
    #: Of each eligibility: the mean length, NaN without a text. Of each question: a score that its k best reach at least.
    mean: np.ndarray | None = None
    floor: np.ndarray | None = None


def _block(rows: list, words: bool, phrases: bool) -> Block:
    rows = [r for r in rows if r["day"] is not None]
    split = [_WORD.findall((r["question"] or "").lower()) for r in rows]
    known: dict[str, int] = {}
    for own in split:
        for w in own:
            known.setdefault(w, len(known))
    width, kinds = len(known), [WORD] * len(known)
    pairs: dict[int, int] = {}
    triples: dict[int, int] = {}
    docs: dict[str, int] = {}
    days: dict[int, int] = {}
    group, groups, at, column, weight = [], {}, [0], [], []

    def number(of: dict, key, kind: int) -> int:
        if key not in of:
            of[key] = len(kinds)
            kinds.append(kind)
        return of[key]

    for r, own in zip(rows, split):
        entries: dict[int, float] = {}
        codes = [known[w] for w in own]
        if words:
            entries.update({c: float(n) for c, n in Counter(codes).items()})
        if phrases:
            two = [number(pairs, x * width + y, PHRASE) for x, y in zip(codes, codes[1:])]
            entries.update(dict.fromkeys(two, PHRASES[2]))
            entries.update({number(triples, p * width + z, PHRASE): PHRASES[3] for p, z in zip(two, codes[2:])})
        for d in r["docs"] or ():
            entries[number(docs, d, FIXED)] = DOCUMENT_BOOST
        if r["effect"]:
            entries[number(days, r["day"], FIXED)] = DATE_BOOST
        column += entries
        weight += entries.values()
        at.append(len(column))
        group.append(groups.setdefault((r["day"], bool(r["by_issue"])), len(groups)))
    table = lambda of: tuple(np.array(x, np.int64) for x in (zip(*sorted(of.items())) if of else ((), ())))
    at, group, column = np.array(at), np.array(group, np.int64), np.array(column, np.int64)
    keys, figure = np.unique(np.repeat(group, np.diff(at)) * max(len(kinds), 1) + column, return_inverse=True)
    return Block(
        [r["sample_id"] for r in rows], known, table(pairs), table(triples), docs, days, np.array(kinds, np.int8),
        np.array([d for d, _ in groups], np.int64), np.array([i for _, i in groups], bool), group, at, column, np.array(weight, np.float64), figure,
        tuple(np.divmod(keys, max(len(kinds), 1))),
    )


# --- texts as lists of columns --------------------------------------------------------------------------------------------


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """The columns of keys, -1 where there is none or it doesn't fit."""
    known, columns = table
    if not len(known):
        return np.full(len(keys), -1)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(fits & (known[place] == keys), columns[place], -1)


def _code(told, texts: int, words: bool):
    """Each text's length and its columns in ascending order, a word as often as it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = told.value
        get, width, kinds = block.words.get, len(block.words), len(block.kinds)
        for batch in _slices(batches, texts):
            found, lengths = [], []
            for text in batch.column(3).to_pylist():
                own = _WORD.findall(text.lower()) if text else ()
                lengths.append(len(own))
                found.extend([get(x, -1) for x in own])
            lengths, w = np.array(lengths, np.int64), np.array(found, np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            two = _look_up(block.pairs, w[:-1] * width + w[1:], (row[:-1] == row[1:]) & (w[:-1] >= 0) & (w[1:] >= 0))
            three = _look_up(block.triples, two[:-1] * width + w[2:], (row[:-2] == row[2:]) & (two[:-1] >= 0) & (w[2:] >= 0))
            phrases = np.unique(np.concatenate([row[: len(x)][x >= 0] * kinds + x[x >= 0] for x in (two, three)]))
            more = []
            if block.docs:
                more += [i * kinds + c for i, d in enumerate(batch.column(2).to_pylist()) if d is not None and (c := block.docs.get(d.upper())) is not None]
            if block.days:
                more += [i * kinds + c for i, stated in enumerate(batch.column(7).to_pylist()) for d in set(stated or ()) if (c := block.days.get(d)) is not None]
            once = row[w >= 0] * kinds + w[w >= 0] if words else row[:0]
            rows, columns = np.divmod(np.sort(np.concatenate([once, phrases, np.array(more, np.int64)])), kinds)
            ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(lengths)))] * np.dtype(_code_type(block)).itemsize
            codes = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(columns.astype(_code_type(block)).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 4, 5, 6)), pa.array(lengths.astype(np.int32)), codes, *batch.columns[8:]],
                names=["id", "group", "issued", "start", "end", "words", "codes", *batch.schema.names[8:]],
            )

    return run


_CODED = "id string, group string, issued int, start int, end int, words int, codes binary"


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of `most` rows, as far as there are."""
    held, n = [], 0
    for batch in _slices(batches, most):
        if n + batch.num_rows > most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


class _Texts:
    """Texts with their occurrences: row, column and how often, by row and then by column."""

    def __init__(self, table: pa.Table, block: Block):
        self.table = table
        self.issued, self.start, self.end, self.length = (table.column(c).to_numpy().astype(np.int64) for c in ("issued", "start", "end", "words"))
        parts = table.column("codes").to_pylist()
        codes = np.frombuffer(b"".join(parts), _code_type(block))
        keys = np.repeat(np.arange(len(parts)), [len(x) // codes.itemsize for x in parts]) * len(block.kinds) + codes
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.row, self.column = np.divmod(keys[new], max(len(block.kinds), 1))
        self.times = np.diff(np.r_[new, len(keys)])

    def eligible(self, rows: np.ndarray, day: int, by_issue: bool) -> np.ndarray:
        return rows[self.issued[rows] <= day if by_issue else (self.start[rows] <= day) & (self.end[rows] > day)]


# --- counts ---------------------------------------------------------------------------------------------------------------


def _days(column: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Numbers that sort by column and then by day."""
    return (column << 32) + (day + (1 << 31))


def _count(told, texts: int):
    """Counts in slices: of each figure's texts, then of each eligibility's texts, then of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = told.value
        of, column = block.figures
        total = np.zeros(len(of) + 2 * len(block.day), np.int64)
        figures, groups = total[: len(of)], total[len(of) :].reshape(2, -1)

        def add(held: list[_Texts]) -> None:
            for field, sign, by_issue in (("issued", 1, True), ("start", 1, False), ("end", -1, False)):
                which, whose = np.flatnonzero(block.by_issue == by_issue), np.flatnonzero(block.by_issue[of] == by_issue)
                if not len(which):
                    continue
                keys, day, length = [], [], []
                for t in held:
                    fits = np.full(len(t.length), True) if by_issue else t.start < t.end
                    fits &= getattr(t, field) < NEVER
                    keys.append(_days(t.column, getattr(t, field)[t.row])[fits[t.row]])
                    day.append(getattr(t, field)[fits])
                    length.append(t.length[fits])
                keys, day, length = np.sort(np.concatenate(keys)), np.concatenate(day), np.concatenate(length)
                order = np.argsort(day)
                upto = np.searchsorted(day[order], block.day[which], "right")
                groups[0, which] += sign * upto
                groups[1, which] += sign * np.r_[0, np.cumsum(length[order])][upto]
                wanted = column[whose]
                figures[whose] += sign * (np.searchsorted(keys, _days(wanted, block.day[of[whose]]), "right") - np.searchsorted(keys, wanted << 32))

        held, n = [], 0
        for table in _gathered(batches, texts):
            held.append(_Texts(table, block))
            n += len(held[-1].row)
            if n > COUNTED:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        if total.any():
            cuts = range(0, len(total), SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // SLICE for i in cuts], pa.int32()), pa.array([total[i : i + SLICE].tobytes() for i in cuts], pa.binary())], names=["part", "counts"]
            )

    return run


def _summed(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
    return pa.table({"part": rows.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _weigh(block: Block, counted: list) -> None:
    """Means, and idf into the weights; each question's commonest columns come first."""
    of, _ = block.figures
    total = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(counted, key=lambda r: r["part"])]) if counted else np.zeros(len(of) + 2 * len(block.day), np.int64)
    df, (texts, words) = total[: len(of)], total[len(of) :].reshape(2, -1)
    block.mean = np.where(texts > 0, words / np.maximum(texts, 1), np.nan)
    n, df = texts[of[block.figure]].astype(np.float64), df[block.figure].astype(np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    block.weight = block.weight * np.where(block.kinds[block.column] == FIXED, 1.0, idf)
    order = np.lexsort((-df, np.repeat(np.arange(len(block.ids)), np.diff(block.at))))
    block.column, block.weight = block.column[order], block.weight[order]
    block.floor = np.zeros(len(block.ids))


# --- scores ---------------------------------------------------------------------------------------------------------------


def _bands(block: Block, least_mean: float) -> list[tuple[float, float, np.ndarray]]:
    """Questions with something eligible, by near means: least and greatest mean, the questions."""
    mean = np.maximum(block.mean[block.group], least_mean)
    some = np.flatnonzero(np.isfinite(mean) & (mean > 0))
    band = np.floor(np.log(mean[some]) / np.log(BAND))
    return [(mean[own].min(), mean[own].max(), own) for b in np.unique(band) if len(own := some[band == b])]


class _Lists:
    """For each column the rows that have it, with what it adds there for a mean length, apart from the question's weight."""

    def __init__(self, texts: _Texts, block: Block):
        self.texts, width = texts, len(block.kinds)
        self.order = np.argsort(texts.column, kind="stable")
        self.row, column = texts.row[self.order], texts.column[self.order]
        self.at = np.searchsorted(column, np.arange(width + 1))
        self.word = block.kinds[column] == WORD
        self.times, self.length = texts.times[self.order].astype(np.float32), texts.length[self.row].astype(np.float32)
        self.column = column
        many = np.diff(self.at)
        self.dense = np.full(width, -1)
        common = np.argsort(-many, kind="stable")[:DENSE]
        self.dense[common] = np.arange(len(common))

    def values(self, mean: float) -> np.ndarray:
        return np.where(self.word, self.times * (K1 + 1) / (self.times + K1 * (1 - B + B * (self.length / np.float32(mean)))), np.float32(1))

    def most(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.at) - 1, np.float64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            out[some] = np.maximum.reduceat(values, self.at[some])
        return out

    def matrix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((min(DENSE, len(self.dense)), len(self.texts.length)), np.float32)
        place = self.dense[self.column]
        out[place[place >= 0], self.row[place >= 0]] = values[place >= 0]
        return out

    def sums(self, columns: np.ndarray, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What some columns add to each row."""
        begin, end = self.at[columns], self.at[columns + 1]
        spans = [(i, j) for i, j in zip(begin.tolist(), end.tolist()) if i < j]
        if not spans:
            return np.zeros(len(self.texts.length))
        many = end - begin
        rows = np.concatenate([self.row[i:j] for i, j in spans])
        return np.bincount(rows, np.concatenate([values[i:j] for i, j in spans]) * np.repeat(weights, many), len(self.texts.length))


def _floors(told, k: int, least_mean: float, texts: int, every: int):
    """For each question k scores at most, of different groups, that some texts reach at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        if task and task.partitionId() % every:
            return
        block: Block = told.value
        out: list[tuple] = []
        for table in _gathered(batches, min(texts, FIRST)):
            some = _Texts(table, block)
            lists, groups = _Lists(some, block), table.column("group").to_pylist()
            for least, _, questions in _bands(block, least_mean):
                values = lists.values(least)
                for q in questions.tolist():
                    own = slice(block.at[q], block.at[q + 1])
                    sums = lists.sums(block.column[own], block.weight[own], values)
                    g = block.group[q]
                    rows = some.eligible(np.flatnonzero(sums), block.day[g], block.by_issue[g])
                    # rows of one group may crowd out others; then the floor is lower, never too high
                    if len(rows) > 4 * k:
                        rows = rows[np.argpartition(-sums[rows], 4 * k)[: 4 * k]]
                    best: dict = {}
                    for i in rows[np.argsort(-sums[rows])].tolist():
                        best.setdefault(groups[i], sums[i])
                        if len(best) == k:
                            break
                    out += [(q, x, s) for x, s in best.items()]
            break
        q, x, s = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(x, pa.string()), pa.array(s, pa.float64())], names=["q", "group", "score"])

    return run


def _raise(block: Block, coded: DataFrame, k: int, least_mean: float, texts: int) -> None:
    """Floors of the questions, from the first texts of some tasks."""
    told = coded.sparkSession.sparkContext.broadcast(block)
    every = -(-max(coded.rdd.getNumPartitions(), 1) // FIRST_TASKS)
    found = coded.mapInArrow(_floors(told, k, least_mean, texts, every), "q int, group string, score double")
    best = found.groupBy("q", "group").agg(F.max("score").alias("score")).groupBy("q").agg(F.get(F.sort_array(F.collect_list("score"), False), k - 1).alias("floor"))
    for r in best.filter("floor is not null").collect():
        block.floor[r["q"]] = r["floor"] - SLACK


def _exact(texts: _Texts, rows: np.ndarray, starts: np.ndarray, weights: np.ndarray, words: np.ndarray, mean: float) -> np.ndarray:
    """Scores of some rows; weights by column."""
    many = starts[rows + 1] - starts[rows]
    begin = np.cumsum(many) - many
    of = np.repeat(starts[rows] - begin, many) + np.arange(many.sum())
    column = texts.column[of]
    weight = weights[column]
    met = np.flatnonzero(weight)
    which, of, column = np.repeat(np.arange(len(rows)), many)[met], of[met], column[met]
    tf = texts.times[of].astype(np.float64)
    parts = np.where(words[column], tf * (K1 + 1) / (tf + K1 * (1 - B + B * (texts.length[texts.row[of]] / mean))), 1.0)
    return np.round(np.bincount(which, parts * weight[met], len(rows)), 6)


def _aside(block: Block, questions: np.ndarray, most: np.ndarray, dense: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each question how many of its first entries may be left aside, and what these add at most."""
    many = block.at[questions + 1] - block.at[questions]
    begin = np.cumsum(many) - many
    entries = np.repeat(block.at[questions] - begin, many) + np.arange(many.sum())
    column = block.column[entries]
    upto = np.cumsum(block.weight[entries] * most[column])
    upto -= np.repeat(np.r_[0.0, upto][begin], many)
    stops = np.flatnonzero((upto + 2 * SLACK >= ASIDE * np.repeat(floor, many)) | (dense[column] < 0))
    place = np.searchsorted(stops, begin)
    first = np.minimum(np.r_[stops, len(entries)][place], begin + many)
    return first - begin, np.where(first > begin, np.r_[upto, 0.0][first - 1], 0.0)


def _score(told, k: int, least_mean: float, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = told.value
        best: list[list[tuple]] = [[] for _ in block.ids]
        floor = block.floor.copy()
        words, weights = block.kinds == WORD, np.zeros(len(block.kinds))
        for table in _gathered(batches, texts):
            some = _Texts(table, block)
            lists, starts = _Lists(some, block), np.searchsorted(some.row, np.arange(len(some.length) + 1))
            ids, groups = table.column("id").to_pylist(), table.column("group").to_pylist()
            for _, greatest, questions in _bands(block, least_mean):
                values = lists.values(greatest)
                most, matrix = lists.most(values), lists.matrix(values)
                aside, add = _aside(block, questions, most, lists.dense, floor[questions])
                for q, n, rest in zip(questions.tolist(), aside.tolist(), add.tolist()):
                    begin, end, g = block.at[q], block.at[q + 1], block.group[q]
                    sums = lists.sums(block.column[begin + n : end], block.weight[begin + n : end], values)
                    rows = some.eligible(np.flatnonzero((sums + rest >= floor[q] - SLACK) & (sums > 0)), block.day[g], block.by_issue[g])
                    if n and len(rows):
                        full = sums[rows] + block.weight[begin : begin + n] @ matrix[lists.dense[block.column[begin : begin + n], None], rows]
                        rows = rows[full >= floor[q] - SLACK]
                    if not len(rows):
                        continue
                    weights[block.column[begin:end]] = block.weight[begin:end]
                    scores = _exact(some, rows, starts, weights, words, max(block.mean[g], least_mean))
                    weights[block.column[begin:end]] = 0.0
                    better = np.flatnonzero((scores > 0) & (scores >= floor[q]))
                    if len(better) > 0:
                        own = best[q] + [(scores[i], ids[rows[i]], groups[rows[i]]) for i in better]
                        best[q] = own = _kept(own, k)
                        if len(own) == k:
                            floor[q] = max(floor[q], own[-1][0])
        rows = [(block.ids[q], i, g, float(s)) for q, own in enumerate(best) for s, i, g in own]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["sample_id", "id", "group", "score"])

    return run


def _kept(found: list[tuple], k: int) -> list[tuple]:
    """The best of each group, of the k best groups."""
    out, seen = [], set()
    for one in sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or "")):
        if one[2] not in seen:
            seen.add(one[2])
            out.append(one)
            if len(out) == k:
                break
    return out


def rank(
    texts: DataFrame, questions: DataFrame, k: int, *, dated: bool = True, words: bool = True, phrases: bool = False, boosts: bool = False,
    one_per: str | None = None, least_mean: float = 0.0, block: int = BLOCK, keep: tuple[str, ...] = (),
) -> DataFrame:
    """sample_id, id, score, rank_no of the k best texts for each question.

    texts: id, text and, if dated, effective_from, effective_to (and issued_date, logical_doc_id). questions: sample_id, question
    and, if dated, t and basis (issued, status: texts issued by t; else texts in force at t). one_per: a column of which each value
    takes one place only. words, phrases: what counts. keep: columns of the texts that the result has too; then ids must be distinct."""
    spark = texts.sparkSession
    day = lambda c: F.unix_date(F.col(c))
    has = set(texts.columns)
    nothing = F.lit(None).cast("string")
    ready = texts.select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(F.col(one_per).cast("string") if one_per else nothing, F.col("id").cast("string")).alias("group"),
        F.col("logical_doc_id") if "logical_doc_id" in has else nothing.alias("logical_doc_id"),
        "text",
        (F.coalesce(day("issued_date"), F.lit(NEVER)) if "issued_date" in has else F.lit(NEVER)).cast("int").alias("issued"),
        (F.coalesce(day("effective_from"), F.lit(NEVER)) if dated else F.lit(ALWAYS)).cast("int").alias("start"),
        (F.coalesce(day("effective_to"), F.lit(NEVER)) if dated else F.lit(NEVER)).cast("int").alias("end"),
        (F.transform(mentioned_dates(F.col("text")), F.unix_date) if boosts else F.lit(None).cast("array<int>")).alias("stated"),
        *(F.col(c).alias(f"kept_{c}") for c in keep),
    )
    asked = questions.select(
        "sample_id", "question",
        (day("t") if dated else F.lit(0)).alias("day"),
        (F.coalesce(F.col("basis").isin("issued", "status"), F.lit(False)) if "basis" in questions.columns else F.lit(False)).alias("by_issue"),
        (named_docs(F.col("question")) if boosts else F.lit(None).cast("array<string>")).alias("docs"),
        (F.lower("question").rlike(ASKS_EFFECT) if boosts else F.lit(False)).alias("effect"),
    )
    out, first, context, size = None, None, spark.sparkContext, TEXTS
    form = ", ".join([_CODED, *(f"kept_{c} {ready.schema[f'kept_{c}'].dataType.simpleString()}" for c in keep)])
    for part in blocks(asked.distinct(), "sample_id", block) if k > 0 else ():
        made = _block(part, words, phrases)
        if not len(made.kinds):
            continue
        coded = cut(ready.mapInArrow(_code(context.broadcast(made), size, words), form))
        first = coded if first is None else first
        coded = coded.drop(*(f"kept_{c}" for c in keep))
        counted = coded.mapInArrow(_count(context.broadcast(made), size), "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary")
        _weigh(made, counted.collect())
        _raise(made, coded, k, least_mean, size)
        found = coded.mapInArrow(_score(context.broadcast(made), k, least_mean, size), "sample_id string, id string, group string, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], ", ".join(["sample_id string, id string, score double, rank_no int", *(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)]))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    best = out.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id", "group").orderBy(*order))).filter("_n = 1")
    ranked = best.withColumn("rank_no", F.row_number().over(Window.partitionBy("sample_id").orderBy(*order)))
    ranked = ranked.filter(F.col("rank_no") <= k).select("sample_id", "id", "score", "rank_no")
    return ranked.join(first.select("id", *(F.col(f"kept_{c}").alias(c) for c in keep)), "id") if keep else ranked


# --- the temporal retriever -----------------------------------------------------------------------------------------------

SCOPES = ("chunk_id", "provision_id", "provision_path")


def superseding(rules: DataFrame) -> DataFrame:
    """The rules that bring an end forward: a document, at least one of chunk, provision and path, and the end; others are an
    error, as an end without a scope would repeal more than it says."""
    told = [F.coalesce(F.col(f"target_{c}"), F.lit("")) != "" for c in SCOPES]
    fine = (F.coalesce(F.col("target_logical_doc_id"), F.lit("")) != "") & (told[0] | told[1] | told[2]) & F.col("effective_to").isNotNull()
    return rules.select(
        *(F.when(F.col(f"target_{c}") != "", F.col(f"target_{c}")).alias(f"target_{c}") for c in ("logical_doc_id", *SCOPES)),
        F.when(fine, F.col("effective_to")).otherwise(F.raise_error(F.lit("a supersession rule needs a document, a scope and an end"))).alias("rule_end"),
    ).distinct()


def ends_brought_forward(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """The chunks with effective_to as the rules that fit them bring it forward: same document, and every scope told agrees.

    Rules meet chunks by document and by the first scope they tell, so that a document with many chunks and many rules is no hot key;
    each chunk goes into the join once for each scope, so that the chunks are made once for all three. Ends are made one per chunk
    before they come back."""
    known = superseding(rules)
    first = F.coalesce(*(F.when(F.col(f"target_{c}").isNotNull(), F.struct(F.lit(at).alias("at"), F.col(f"target_{c}").alias("told"))) for at, c in enumerate(SCOPES)))
    known = known.withColumn("first", first).select("*", "first.at", "first.told").drop("first")
    ids = chunks.select("chunk_id", "logical_doc_id", "provision_id", "provision_path").distinct()
    each = ids.select("*", F.explode(F.array(*(F.struct(F.lit(at).alias("at"), F.col(c).alias("told")) for at, c in enumerate(SCOPES)))).alias("one"))
    each = each.select("*", F.col("one.at").alias("own_at"), F.col("one.told").alias("own")).drop("one").filter("own is not null")
    found = each.join(known, (F.col("logical_doc_id") == F.col("target_logical_doc_id")) & (F.col("own_at") == F.col("at")) & (F.col("own") == F.col("told")))
    for c in SCOPES[1:]:
        found = found.filter(F.col(f"target_{c}").isNull() | F.coalesce(F.col(f"target_{c}") == F.col(c), F.lit(False)))
    ends = found.groupBy("chunk_id").agg(F.min("rule_end").alias("rule_end"))
    return chunks.join(ends, "chunk_id", "left").withColumn("effective_to", F.least("effective_to", "rule_end")).drop("rule_end")


def temporal(chunks: DataFrame, questions: DataFrame, k: int = 5, rules: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each question, one per provision, among those its date and basis make eligible.

    chunks: chunk_id, logical_doc_id, provision_id, provision_path, text, issued_date, effective_from, effective_to. questions:
    sample_id, question, t and, if any, basis; without, the question's wording tells it. Gives sample_id, rank_no, chunk_id,
    provision_id, score, date_basis, effective_from, effective_to and whether the chunk was in force at t (NULL: unknown)."""
    asked = questions if "basis" in questions.columns else questions.withColumn("basis", date_basis(F.col("question")))
    closed = ends_brought_forward(chunks, rules) if rules is not None else chunks
    about = ("logical_doc_id", "provision_id", "provision_path", "issued_date", "effective_from", "effective_to")
    ranked = rank(closed.withColumnRenamed("chunk_id", "id"), asked, k, phrases=True, boosts=True, one_per="provision_id", least_mean=1.0, keep=about)
    joined = ranked.join(asked.select("sample_id", "t", F.col("basis").alias("date_basis")), "sample_id")
    at, start, end = F.col("t"), F.col("effective_from"), F.col("effective_to")
    return joined.select(
        "sample_id", "rank_no", F.col("id").alias("chunk_id"), "logical_doc_id", "provision_id", "provision_path", "score", "date_basis", "issued_date", "effective_from", "effective_to",
        F.when(start.isNotNull(), (start <= at) & (end.isNull() | (at < end))).alias("in_force"),
    )
