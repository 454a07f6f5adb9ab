"""Problem 1: repair the text of scanned pages into continuous paragraphs.

Three statistics of the whole collection, each page counted once, make the model: how often each word and each pair of neighbours
occurs, and how often each shape of a line stands at the edge of pages; shapes common there are then counted everywhere. Their size is bounded by a share of the whole: there can
be no more than 1 / share entries of at least that share, so they may be sent to all tasks at any size of the collection.

* Running heads: lines in a page's first or last few whose shape (letters without accents) is one that the
  collection has at the edges of pages of several numbers, on later pages too, and hardly elsewhere; or which hold the document's own number in the
  form of a head. Shapes that only first pages have belong to the heading block. Misread heads are matched by similarity.
* Page numbers: a line at an edge with nothing but a number in any form that is this page's, or a dressed number.
* Broken words: a break mark at a line's end where the halves joined are a word, or where no word or code could end so.
* Misread words: a noisy channel. Candidates of a word are the lexicon's words within one edit or one confusion of several
  characters; the channel's probability for each pair of characters is estimated from rare words that differ by it from a much
  more frequent one; neighbours' counts give the language model; Viterbi decodes each line that has a suspicious word.

Cases: NULL and empty texts have no lines; blank lines count in line numbers; pages loaded twice with the same text count once;
NULL parts of a page's key are kept as NULL; any length of a line; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm import unify
from chronolake.session import cut, spread

#: Least share of all words that an entry of the lexicon, of the neighbours and of the shapes needs.
WORD_SHARE, PAIR_SHARE, SHAPE_SHARE = 5e-7, 4e-7, 2e-4
LEAST_COUNT = 3
#: Share of a head's lines that stand at the edges of pages.
HEADS = 0.9
#: Lines from a page's top and bottom that may belong to the printing.
EDGE = 3
#: A word is taken for another one's misreading in the estimate of the channel if that is so many times as frequent.
RARER = 50
#: A word that many times as frequent rules another: their neighbours in common are laid to misreading up to one in so many.
RULES = 20
FLUSH = 300_000

FIELDS = ("raw_text", "markdown_content")
# Several characters that recognition takes for one, or one for several.
SEVERAL = (("rn", "m"), ("nn", "m"), ("ri", "n"), ("ii", "n"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("cl", "đ"), ("ir", "ư"), ("iu", "m"), ("vv", "w"), ("lc", "k"), ("ni", "m"), ("in", "m"), ("rr", "n"), ("fi", "n"))
STRAY = "•¦|~^*_`´¨\\<>{}#$@"
LOST = "�"
BREAKS = "-¬=‐‑\xad­"

_USUAL = "".join(
    unicodedata.normalize("NFC", base + mark + tone)
    for base, marks in {"a": ["", "̆", "̂"], "e": ["", "̂"], "i": [""], "o": ["", "̂", "̛"], "u": ["", "̛"], "y": [""]}.items()
    for mark in marks
    for tone in ("", "̀", "́", "̉", "̃", "̣")
)
_SEEN = re.compile(f"[^\\x00-\\x7f{_USUAL}{_USUAL.upper()}đĐ–…“”«»°²½�•¦¬]")
_PUNCT = ".,;:()[]\"'«»“”‘’…!?–-"
_LETTERS = re.compile(r"^[^\W\d_]+$")
_NUMBER = re.compile(r"^[\d.,/%:+-]+$")
_SUFFIXED = re.compile(r"^\d+[a-zđ]$")
_COMMENT = re.compile(r"^\s*<!--.*-->\s*$")
_DRESSED = re.compile(r"^(?:(?:trang|page|tr\.?)\s*(\w{1,5})(?:\s*/\s*\w{1,5})?|[-–—]\s*(\w{1,5})\s*[-–—]|[\[(]\s*(\w{1,5})\s*[\])]|(\w{1,5})\s*/\s*\w{1,5})$", re.I)
_PLAIN_OF = {c: c for c in range(128)} | {ord(c): unicodedata.normalize("NFD", c)[0] for c in _USUAL} | {ord("đ"): "d"} | dict.fromkeys(range(0x300, 0x370))
_NO_LETTERS = re.compile(r"[^a-z]+")
_LISTED = re.compile(r"^(?:\d{1,3}[.)]\s|[a-zđ]\)\s|Điều\s)", re.I)
_ITEM = re.compile(r"^\s*(?:#{1,6}\s|\|)|^\s*(?:Điều\s+\d+\w?\.|Chương\s|Mục\s|\d{1,3}[.)]\s|[a-zđ]\)\s|[-+•]\s)", re.I)
_DIGIT_LIKE = str.maketrans("oOlIiSsBbgqZz", "0011155869922"[:13])


def cleaned(text: str) -> str:
    """The text in the plain form of problem 5, look-alikes of mixed tokens as the usual letters, its lines kept."""
    if not _SEEN.search(text) and unicodedata.is_normalized("NFC", text):
        return text
    text = unify.plain(text)
    usual = {token: forms[0] for token in unify.mixed(text) if (forms := [f for f in unify.proposals(token) if unify.script(f[0]) == "latin"])}
    return unify.exchanged(text, usual) if usual else text


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.lower().translate(_PLAIN_OF)


def shape(line: str) -> str:
    return " ".join(_NO_LETTERS.sub(" ", fold(line)).split())


def bare(chunk: str) -> str:
    """The word that a chunk between blanks holds, in lower case."""
    return chunk.lower().strip(_PUNCT)


def code(word: str) -> str:
    """The word as the language model knows it: numbers and codes are one word each."""
    if _LETTERS.match(word):
        return word
    if not word or _NUMBER.match(word):
        return "#"
    return "#c" if any(c.isdigit() for c in word) and not any(c in word for c in STRAY + LOST) and ("/" in word or "-" in word or _SUFFIXED.match(word)) else word


def unmarked(line: str) -> str:
    """A line without the marks of headings and bold type."""
    line = line.strip()
    return line.lstrip("#").strip().strip("*").strip() if line[:1] in ("#", "*") else line


_codes: dict[str, str] = {}


def coded_chunks(chunks: list[str]) -> list[str]:
    """code(bare(c)) of every chunk; the same chunks come again and again."""
    try:
        return list(map(_codes.__getitem__, chunks))
    except KeyError:
        pass
    out, get = [], _codes.get
    for c in chunks:
        w = get(c)
        if w is None:
            if len(_codes) > FLUSH:
                _codes.clear()
            w = _codes[c] = code(bare(c))
        out.append(w)
    return out


class Coded(dict):
    """The number of the word in a chunk between blanks, worked out once; 0 stands for numbers and halves of words."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = ["#"]
        self.of_word: dict[str, int] = {"#": 0}

    def __missing__(self, chunk: str) -> int:
        word = code(bare(chunk))
        got = self.of_word.get(word)
        if got is None:
            got = self.of_word[word] = len(self.words)
            self.words.append(word)
        self[chunk] = got
        return got


Key = tuple[str, int, bool]


def coded_lines(lines: list[str], number: Coded, kept: dict[str, tuple[list[int], bool]]) -> tuple[list[int], list[Key]]:
    """The words of the lines, halves of words cut by a line's end as numbers, and for each line with words what its words and
    pairs depend on: its text, the word that follows it (-1: none) and whether it begins with half a word. Lines are coded once
    into kept."""
    coded: list[int] = []
    keys: list[Key] = []
    cut_off = False
    last: tuple[str, bool] | None = None
    for line in lines:
        got = kept.get(line)
        if got is None:
            chunks = line.split()
            own = list(map(number.__getitem__, chunks))
            halved = bool(chunks) and len(chunks[-1]) > 1 and chunks[-1][-1] in BREAKS
            if halved:
                own[-1] = 0
            got = kept[line] = own, halved
        own, halved = got
        if own:
            at = len(coded)
            coded += own
            if cut_off:
                coded[at] = 0
            if last is not None:
                keys.append((last[0], coded[at], last[1]))
            last, cut_off = (line, cut_off), halved
    if last is not None:
        keys.append((last[0], -1, last[1]))
    return coded, keys


def edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Numbers of the first and of the last lines that are neither blank nor a comment."""
    return list(islice(_written(lines, range(len(lines))), EDGE)), list(islice(_written(lines, range(len(lines) - 1, -1, -1)), EDGE))[::-1]


def _written(lines: list[str], order: Iterable[int]) -> Iterator[int]:
    for i in order:
        line = lines[i]
        if line and not line.isspace() and not (line.lstrip()[:4] == "<!--" and _COMMENT.match(line)):
            yield i


def written(lines: list[str]) -> list[int]:
    """Numbers of the lines that are neither blank nor a comment."""
    return [i for i, line in enumerate(lines) if line and not line.isspace() and not (line.lstrip()[:4] == "<!--" and _COMMENT.match(line))]


def edge_shapes(lines: list[str]) -> Counter:
    """Shapes of the lines at a page's edges that may be heads."""
    top, bottom = edges(lines)
    near = [lines[i] for i in {*top, *bottom}]
    return Counter(s for line in near if len(line) <= 160 and not _LISTED.match(unmarked(line)) and (s := shape(line)))


# --- statistics -----------------------------------------------------------------------------------------------------------


#: Words of pages that are counted at once.
COUNTED_WORDS = 2_000_000


class _Counts:
    """Counts of the words and of the pairs of neighbours, by word numbers; -1 parts what are no neighbours."""

    def __init__(self) -> None:
        self.flat: list[int] = []
        # Of a page's two texts, the lines that only one has: what the second has more often than the first counts too.
        self.sides: tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]] = ([], []), ([], [])
        self.page = 0
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, coded: list[int]) -> None:
        self.flat += coded
        self.flat.append(-1)

    def differ(self, first: list[Key], second: list[Key], kept: dict[str, tuple[list[int], bool]]) -> None:
        known, other = Counter(first), Counter(second)
        self.page += 1
        for (flat, pages), rest in zip(self.sides, (known - other, other - known)):
            before = len(flat)
            for (line, following, halved), n in rest.items():
                own = kept[line][0]
                for _ in range(n):
                    at = len(flat)
                    flat += own
                    if halved:
                        flat[at] = 0
                    flat += (-2 - following, -1) if following >= 0 else (-1,)
            pages += [self.page] * (len(flat) - before)

    def __len__(self) -> int:
        return len(self.flat) + sum(len(flat) for flat, _ in self.sides)

    def count(self) -> None:
        flat = np.array(self.flat, np.int64)
        self.words.append(np.unique(flat[flat >= 0], return_counts=True))
        self.pairs.append(np.unique(_pairs(flat)[0], return_counts=True))
        found = []
        for flat, pages in self.sides:
            flat, page = np.array(flat, np.int64), np.array(pages, np.int64)
            key, at = _pairs(flat)
            # What follows a line, written as -2 - word, is part of a pair but not a word of the line.
            found.append([(page[flat >= 0], flat[flat >= 0]), (page[:-1][at], key)])
        for total, (page, one), (page_, two) in zip((self.words, self.pairs), *found):
            known, more = (_by_page(p, k) for p, k in ((page, one), (page_, two)))
            at = np.searchsorted(known[0], more[0])
            same = at < len(known[0])
            same[same] = known[0][at[same]] == more[0][same]
            n = more[1].copy()
            n[same] -= known[1][at[same]]
            total.append((more[2][n > 0], n[n > 0]))
        self.flat, self.sides, self.page = [], (([], []), ([], [])), 0


def _pairs(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours as one number, and where they stand."""
    word = np.where(flat < -1, -2 - flat, flat)
    at = (flat[:-1] >= 0) & (word[1:] >= 0)
    return (flat[:-1][at] << 32) | word[1:][at], at


def _by_page(page: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each page's distinct keys in order (numbered by page and by key), their counts and the keys themselves."""
    names, number = np.unique(key, return_inverse=True)
    # Both sides must number alike, so keys are mixed with their page instead of ranked.
    with np.errstate(over="ignore"):
        mixed = (page.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (names.astype(np.uint64)[number] * np.uint64(0xC2B2AE3D27D4EB4F))
    own, first, n = np.unique(mixed, return_index=True, return_counts=True)
    return own, n, key[first]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, number = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(number, weights=np.concatenate([n for _, n in parts]), minlength=len(key)).astype(np.int64)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, counts = Coded(), _Counts()
    shapes: Counter = Counter()

    def flush() -> pa.RecordBatch:
        counts.count()
        words = pa.array(number.words, pa.string())
        word, n = _summed(counts.words)
        pair, m = _summed(counts.pairs)
        a = pa.concat_arrays([words.take(pa.array(word)), words.take(pa.array(pair >> 32)), pa.array(list(shapes), pa.string())])
        b = pa.concat_arrays([pa.array([""] * len(word), pa.string()), words.take(pa.array(pair & 0xFFFFFFFF)), pa.array([""] * len(shapes), pa.string())])
        kind = pa.array(["word"] * len(word) + ["pair"] * len(pair) + ["shape"] * len(shapes), pa.string())
        every = pa.array(np.concatenate([n, m, np.array(list(shapes.values()), np.int64)]))
        return pa.RecordBatch.from_arrays([kind, a, b, every], names=["kind", "a", "b", "n"])

    for batch in batches:
        for raw, marked in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
            # Heads, words and pairs may stand in one of the two texts only; of what both have, the more counts.
            # The lines that both have, in the same surroundings, cancel out of that difference.
            first: tuple[list[int], list[Key]] | None = None
            kept: dict[str, tuple[list[int], bool]] = {}
            at_edge: Counter = Counter()
            for text in dict.fromkeys((raw, marked)):
                if not text:
                    continue
                lines = cleaned(text).split("\n")
                at_edge |= edge_shapes(lines)
                coded, keys = coded_lines(lines[1:] if _COMMENT.match(lines[0]) else lines, number, kept)
                if first is None:
                    first = coded, keys
                    counts.add(coded)
                elif coded != first[0]:
                    counts.differ(first[1], keys, kept)
            shapes.update(at_edge)
            if len(counts) > COUNTED_WORDS:
                counts.count()
            if len(number) + len(shapes) > FLUSH or sum(len(k) for k, _ in counts.pairs) > 20 * FLUSH:
                yield flush()
                number, counts = Coded(), _Counts()
                shapes.clear()
    yield flush()


class _Shapes(dict):
    """The words in the shape of a chunk between blanks, worked out once."""

    def __missing__(self, chunk: str) -> list[str]:
        if len(self) > FLUSH:
            self.clear()
        got = self[chunk] = shape(chunk).split()
        return got

    def of(self, line: str, begins: set[tuple[str, str]], first: set[str]) -> str:
        """The line's shape if it begins with two of these words, the first of which are told too."""
        chunks = line.split(None, 1)
        if not chunks or (begun := self[chunks[0]]) and begun[0] not in first:
            return ""
        out: list[str] = []
        for chunk in line.split(None, 4)[:4]:
            out += self[chunk]
            if len(out) > 1:
                if (out[0], out[1]) not in begins:
                    return ""
                break
        return " ".join([w for chunk in line.split() for w in self[chunk]])


def _standing(told):
    """How often the told shapes stand anywhere, at edges, on later pages, and on pages of which numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: set[str] = told.value
        begins, known = {tuple(s.split(" ", 2)[:2]) for s in asked}, _Shapes()
        begin = {first for first, _ in begins}
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for page, raw, marked in zip(*(batch.column(i).to_pylist() for i in range(3))):
                later, on = (page or 0) > 1, 1 << (page or 0) % 60
                one: Counter = Counter()
                at_edge: Counter = Counter()
                kept: dict[str, str] = {"": ""}
                for text in dict.fromkeys((raw, marked)):
                    if not text:
                        continue
                    lines = cleaned(text).split("\n")
                    for line in lines:
                        if line not in kept:
                            s = known.of(line, begins, begin)
                            kept[line] = s if s in asked and not _LISTED.match(unmarked(line)) else ""
                    found = [(i, s) for i, s in enumerate(map(kept.__getitem__, lines)) if s]
                    if found:
                        top, bottom = edges(lines)
                        near = {i for i in (*top, *bottom) if len(lines[i]) <= 160}
                        one |= Counter(s for _, s in found)
                        at_edge |= Counter(s for i, s in found if i in near)
                for s, n in one.items():
                    own = counts[s]
                    own[0] += n
                    own[1] += at_edge[s]
                    own[2] += later * n
                    own[3] |= on
        columns = [list(counts), *(list(c) for c in zip(*counts.values()))] if counts else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "n", "m", "k", "on"])

    return run


@dataclass
class Model:
    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    total: int
    heads: set[str]
    edits: dict[tuple[str, str], float] = field(default_factory=dict)
    deletions: dict[str, list[str]] = field(default_factory=dict)
    head_sizes: dict[int, list[tuple[str, frozenset[str]]]] = field(default_factory=dict)
    kept: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    ruled: dict[str, list[str]] = field(default_factory=dict)
    steps: dict[tuple[str, str], float] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)
    chunk_numbers: dict[str, int] = field(default_factory=dict)
    sound_at: np.ndarray | None = None
    pair_keys: np.ndarray | None = None

    def prepare(self) -> Model:
        """Indexes of the lexicon and the channel's probabilities."""
        index = defaultdict(list)
        for word in self.words:
            if len(word) < 24 and _LETTERS.match(word):
                index[word].append(word)
                for i in range(len(word)):
                    index[word[:i] + word[i + 1 :]].append(word)
        self.deletions = dict(index)
        counts: Counter = Counter()
        for word, n in self.words.items():
            if _LETTERS.match(word):
                near = [v for v in self._near(word) if self.words[v] >= RARER * n]
                for v in near:
                    counts[edit(v, word)] += 1 / len(near)
        for word, n in self.words.items():
            if len(word) > 1 and word[0] != "#":
                over = [v for v in self._near(word) if self.words[v] >= RULES * n and _LETTERS.match(v)]
                if over:
                    self.ruled[word] = over
        self.numbers = _Numbers((w, i) for i, w in enumerate(dict.fromkeys(["#", "#c", *self.words])))
        self.chunk_numbers = _ChunkNumbers(self.numbers)
        self.sound_at = np.array([w not in self.ruled for w in self.numbers] + [False])
        size = len(self.sound_at)
        known = (self.numbers[a] * size + self.numbers[b] for a, b in self.pairs if a in self.numbers and b in self.numbers)
        self.pair_keys = np.array(sorted(known) or [-1], np.int64)
        least = sum(counts.values()) or 1.0
        self.edits = {e: c / least for e, c in counts.items()}
        for s in sorted(self.heads):
            words = s.split()
            self.head_sizes.setdefault(len(words), []).append((s, frozenset(words)))
        return self

    def _near(self, word: str) -> set[str]:
        """Words of the lexicon one edit away, or one confusion of several characters."""
        found = set(self.deletions.get(word, ()))
        for i in range(len(word)):
            found.update(self.deletions.get(word[:i] + word[i + 1 :], ()))
        found = {v for v in found if abs(len(v) - len(word)) <= 1 and one_edit(v, word)}
        for several, one in SEVERAL:
            for read, meant in ((several, one), (one, several)):
                at = word.find(read)
                while at >= 0:
                    v = word[:at] + meant + word[at + len(read) :]
                    if v in self.words:
                        found.add(v)
                    at = word.find(read, at + 1)
        found.discard(word)
        return found

    def channel(self, meant: str, read: str) -> float:
        """log P(read | meant)."""
        return math.log(3e-4) + math.log(self.edits.get(edit(meant, read), 0.0) + 1e-4) / 2

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """Other words that this may be a misreading of, with the channel's log probability."""
        got = self.kept.get(word)
        if got is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            own = self.words.get(word, 0)
            if any(c in word for c in STRAY + LOST):
                plain = "".join(c for c in word if c not in STRAY)
                found = {plain} if plain in self.words else set()
                if LOST in plain and plain.count(LOST) <= 2:
                    parts = re.compile(re.escape(plain).replace(re.escape(LOST), "(?:.|)"))
                    key = plain.replace(LOST, "", 1)
                    pool = self.deletions.get(key, ()) if plain.count(LOST) == 1 else self.words
                    found |= {v for v in pool if parts.fullmatch(v)}
            else:
                found = {v for v in self._near(word) if self.words[v] > own}
            got = [(v, self.channel(v, word)) for v in found if _LETTERS.match(v)]
            got = sorted(got, key=lambda c: -c[1] - math.log(self.words[c[0]]))
            self.kept[word] = got
        return got

    def beside(self, before: str, word: str) -> float:
        """How often the two are neighbours, less what misreadings of a ruling word explain."""
        n = self.pairs.get((before, word), 0)
        if n:
            if word in self.ruled:
                n -= max(self.pairs.get((before, v), 0) for v in self.ruled[word]) / RULES
            if before in self.ruled:
                n -= max(self.pairs.get((v, word), 0) for v in self.ruled[before]) / RULES
        return n

    def follows(self, before: str, word: str) -> float:
        got = self.steps.get((before, word))
        if got is None:
            if len(self.steps) > FLUSH:
                self.steps.clear()
            n = self.beside(before, word)
            if n > 0:
                got = math.log(n / max(self.words.get(before, n), n))
            else:
                got = math.log(0.05 * (0.5 if word in self.ruled else self.words.get(word, 0.5)) / self.total)
            self.steps[before, word] = got
        return got


def edit(meant: str, read: str) -> tuple[str, str]:
    """The characters in which two words differ, of the first and of the second."""
    i = 0
    while i < min(len(meant), len(read)) and meant[i] == read[i]:
        i += 1
    j = 0
    while j < min(len(meant), len(read)) - i and meant[-1 - j] == read[-1 - j]:
        j += 1
    return meant[i : len(meant) - j], read[i : len(read) - j]


def one_edit(a: str, b: str) -> bool:
    x, y = edit(a, b)
    return max(len(x), len(y)) <= 1


def train(pages: DataFrame) -> Model:
    """The model of the whole collection; its size is bounded by the shares above, not by the collection."""
    one = pages.dropDuplicates(["logical_doc_id", "part_no", "physical_page"])
    one = one.select(F.coalesce("global_page", "physical_page").alias("page"), "raw_text", "markdown_content")
    counted = one.mapInArrow(_statistics, "kind string, a string, b string, n long")
    summed = cut(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    whole = summed.groupBy("kind").agg(F.sum("n").alias("n")).collect()
    total = {r["kind"]: r["n"] for r in whole}
    n = max(total.get("word", 0), 1)
    least = {"word": max(LEAST_COUNT, n * WORD_SHARE), "pair": max(LEAST_COUNT, n * PAIR_SHARE), "shape": max(LEAST_COUNT, one.count() * SHAPE_SHARE)}
    # Of the shapes at edges that are common enough there, all lines are counted, wherever they stand.
    least["shape"] *= HEADS
    limit = F.create_map(*(F.lit(x) for k, v in least.items() for x in (k, float(v))))
    model = Model({}, {}, n, set())
    asked: set[str] = set()
    for r in summed.filter(F.col("n") >= limit[F.col("kind")]).toLocalIterator():
        if r["kind"] == "word":
            model.words[r["a"]] = r["n"]
        elif r["kind"] == "pair":
            model.pairs[r["a"], r["b"]] = r["n"]
        elif len(r["a"].split()) >= 2:
            asked.add(r["a"])
    if asked:
        told = pages.sparkSession.sparkContext.broadcast(asked)
        standing = one.mapInArrow(_standing(told), "a string, n long, m long, k long, on long").groupBy("a")
        standing = standing.agg(*(F.sum(c).alias(c) for c in "nmk"), F.bit_count(F.bit_or("on")).alias("pages"))
        heads = (F.col("n") * HEADS >= least["shape"]) & (F.col("m") >= HEADS * F.col("n")) & (F.col("k") >= 0.5 * F.col("n"))
        model.heads = {r["a"] for r in standing.filter(heads & (F.col("pages") >= LEAST_COUNT)).collect()}
    return model


# --- one page -------------------------------------------------------------------------------------------------------------

_ROMAN = re.compile(r"^(?=[ivxlc])(x{0,3}|xl|lx{0,3}|xc|c{1,3})(ix|iv|v?i{0,3})$")


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


def number_of(text: str) -> int | None:
    """A number that may have been misread."""
    folded = text.translate(_DIGIT_LIKE)
    return int(folded) if folded.isdigit() and folded.isascii() and any(c.isdigit() for c in text + "1"[: text in ("l", "ll", "I", "O")]) else None


def is_page_number(line: str, numbers: set[int]) -> bool:
    text = unmarked(line)
    if not text or len(text) > 24:
        return False
    text = " ".join(text.split())
    text = "".join(c for c in text if c not in "•¦|~^*_`").strip()
    if text.isdigit():
        return int(text) in numbers
    if text.lower() in {roman(n) for n in numbers if 0 < n < 400}:
        return True
    if re.fullmatch(r"[\dlIOoSBg]{1,4}", text):
        return number_of(text) in numbers
    if m := _DRESSED.match(text):
        inner = next(g for g in m.groups() if g)
        return number_of(inner) is not None or inner.lower() in {roman(n) for n in numbers if 0 < n < 400}
    words = fold(text).split()
    if len(words) == 2 and difflib.SequenceMatcher(None, words[0], "trang").ratio() >= 0.75:
        return number_of(re.split("/", words[1])[0]) is not None
    return False


def is_head(line: str, model: Model, doc: str, rank: int) -> bool:
    text = unmarked(line)
    if not text or len(text) > 160:
        return False
    s = shape(text)
    if s in model.heads:
        return True
    folded = fold(text)
    own = fold(doc or "")
    if own and rank < 2:
        at = folded.find(own)
        if at < 0 and len(folded) >= len(own) and sum(map(str.isdigit, folded)) > 4:
            # a misread number of the document: the same length, a few characters off
            for k in range(0, min(30, len(folded) - len(own) + 1)):
                off = sum(a != b for a, b in zip(folded[k : k + len(own)], own))
                if off <= 2:
                    at = k
                    break
        if at >= 0:
            before = folded[:at].split()
            if not (before and before[-1] in ("so", "s0", "sõ")) and len(before) <= 3:
                return True
    words = s.split()
    if len(words) < 2:
        return False
    own_words = set(words)
    for size in range(len(words) - 2, len(words) + 3):
        for h, its in model.head_sizes.get(size, ()):
            if len(own_words & its) * 2 >= len(its):
                alike = difflib.SequenceMatcher(None, h, s, autojunk=False)
                if alike.real_quick_ratio() >= 0.82 and alike.quick_ratio() >= 0.82 and alike.ratio() >= 0.82:
                    return True
    return False


def _is_head(line: str, model: Model, doc: str | None, rank: int, kept: Kept) -> bool:
    key = line, doc, rank < 2
    got = kept.heads.get(key)
    if got is None:
        got = kept.heads[key] = is_head(line, model, doc, rank)
    return got


def _word_like(word: str, model: Model) -> bool:
    return model.words.get(word, 0) > 0


def broken(line: str, following: str, model: Model) -> str | None:
    """The joined word if the line ends in a word cut in two."""
    end = line.rstrip()
    if len(end) < 2 or end[-1] not in BREAKS:
        return None
    half = end[:-1].split()[-1:] or [""]
    first = half[0].lower().lstrip(_PUNCT)
    if not first or end[-2].isspace():
        return None
    rest = following.split()[:1] or [""]
    second = rest[0].lower().rstrip(_PUNCT)
    if "/" in first or any(c.isdigit() for c in first) and any(c.isdigit() for c in second):
        return None
    joined = first + second
    if not re.search(r"[^\W\d_]$", first):
        return joined if end[-1] != "-" and joined in model.words else None
    if end[-1] != "-":
        return joined
    if _word_like(joined, model):
        # both may be: a compound's own hyphen only where the compound is known as such
        return None if model.words.get(f"{first}-{second}", 0) > model.words[joined] else joined
    if model.words.get(f"{first}-{second}", 0):
        return None
    if "-" in first or not second or not re.match(r"[^\W\d_]", second):
        return joined if not _word_like(first, model) else None
    if model.candidates(joined):
        return joined
    return None if _word_like(first, model) and _word_like(second, model) else joined


class _Numbers(dict):
    """Word numbers; an unknown word has -1."""

    def __missing__(self, word: str) -> int:
        return -1


class _ChunkNumbers(dict):
    """The word number of a chunk between blanks, worked out once."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, chunk: str) -> int:
        if len(self) > FLUSH:
            self.clear()
        got = self[chunk] = self.numbers[code(bare(chunk))]
        return got


def suspicious(numbers: list[int], model: Model) -> list[int]:
    """Positions of words that are unknown, ruled by a commoner one, or seen with neither neighbour; numbers never are."""
    own = np.array(numbers, np.int64)
    out = ~model.sound_at[own]
    if len(own) > 1:
        keys = own[:-1] * len(model.sound_at) + own[1:]
        seen = model.pair_keys[np.minimum(np.searchsorted(model.pair_keys, keys), len(model.pair_keys) - 1)] == keys
        out[1:-1] |= ~seen[:-1] & ~seen[1:]
    out &= (own < 0) | (own > 1)
    return np.flatnonzero(out).tolist()


def decode(coded: list[str], suspects: set[int], model: Model) -> list[str]:
    """The likeliest words of a line, by Viterbi over the candidates of its suspicious words."""
    options = {i: model.candidates(coded[i]) for i in suspects}
    if not any(options.values()):
        return coded
    # Certain words part the line, so only the stretches around open ones need decoding.
    out, at = list(coded), 0
    opened = sorted(i for i, c in options.items() if c)
    while at < len(opened):
        to = at
        while to + 1 < len(opened) and opened[to + 1] - opened[to] <= 1:
            to += 1
        first, last = max(opened[at] - 1, 0), min(opened[to] + 1, len(coded) - 1)
        out[first : last + 1] = _viterbi([[(coded[i], _STAYS), *options.get(i, ())] for i in range(first, last + 1)], model)
        at = to + 1
    return out


_STAYS = math.log(0.998)


def _viterbi(lattice: list[list[tuple[str, float]]], model: Model) -> list[str]:
    best = [(model.follows("#", w) if len(lattice[0]) > 1 else 0.0, None, w) for w, _ in lattice[0]]
    best = [(score + emit, back, w) for (score, back, w), (_, emit) in zip(best, lattice[0])]
    trail = [best]
    for own in lattice[1:]:
        last, now = trail[-1], []
        for w, emit in own:
            score, back = max((s + model.follows(v, w), k) for k, (s, _, v) in enumerate(last))
            now.append((score + emit, back, w))
        trail.append(now)
    k = max(range(len(trail[-1])), key=lambda j: trail[-1][j][0])
    out = []
    for column in reversed(trail):
        _, back, w = column[k]
        out.append(w)
        k = back
    return out[::-1]


_SYMBOL_IN_WORD = re.compile(r"[^\W\d_][•¦|~^*_�`\\]+[^\W\d_]|[^\W\d_]�|�[^\W\d_]")
_NUMBER_MISREAD = re.compile(r"^(?=.*\d)(?=.*[lIOoSBZ])[\dlIOoSBZ]{2,6}$")


class Kept:
    """What has been worked out for the lines of a page, whose two texts share most of them."""

    def __init__(self) -> None:
        self.heads: dict[tuple, bool] = {}
        self.numbers: dict[str, tuple[list[str], list[int]]] = {}
        self.decoded: dict[tuple, list[str]] = {}


def read_page(
    text: str, doc: str | None, numbers: set[int], model: Model, repair: bool = True, kept: Kept | None = None
) -> tuple[list[tuple[int, str]], str | None]:
    """(line number, kind) of what is wrong with a page's text, and its paragraphs put right, if they are wanted."""
    kept = kept or Kept()
    lines = cleaned(text).split("\n")
    found: list[tuple[int, str]] = []
    full = written(lines)
    top, bottom = full[:EDGE], full[-EDGE:]
    printing: set[int] = set()
    for zone in (top, bottom[::-1]):
        for rank, i in enumerate(zone):
            if i in printing:
                continue
            if is_page_number(lines[i], numbers):
                found.append((i + 1, "page_number"))
            elif _is_head(lines[i], model, doc if zone is top else "", rank, kept):
                found.append((i + 1, "running_head"))
            else:
                break
            printing.add(i)
    body = [i for i in full if i not in printing]
    joined: dict[int, str] = {}
    for at, i in enumerate(body):
        line = lines[i]
        if (line[-1] in BREAKS or line[-1].isspace() and line.rstrip()[-1:] in BREAKS) and (word := broken(line, lines[body[at + 1]] if at + 1 < len(body) else "", model)):
            joined[i] = word
            found.append((i + 1, "broken_word"))
    paragraphs: list[list[str]] = []
    carried: str | None = None
    last = -2
    number = model.chunk_numbers.__getitem__
    split: dict[int, list[str]] = {}
    numbered: dict[int, list[int]] = {}
    for i in body:
        got = kept.numbers.get(lines[i])
        if got is None:
            chunks = lines[i].split()
            got = kept.numbers[lines[i]] = chunks, list(map(number, chunks))
        split[i], numbered[i] = got
    flat: list[int] = []
    start: dict[int, int] = {}
    halved: set[int] = set()  # lines that begin with the second half of a word, maybe of the page before
    if body and split[body[0]][0][:1].islower() and numbered[body[0]][0] < 0:
        halved.add(body[0])
    for at, i in enumerate(body):
        start[i] = len(flat)
        flat += numbered[i]
        if at and body[at - 1] in joined:
            halved.add(i)
        if i in halved:
            flat[start[i]] = 0
        if i in joined:
            flat[-1] = 0

    def words_of(i: int) -> list[str]:
        own = coded_chunks(split[i])
        if i in halved:
            own[0] = "#"
        if i in joined:
            own[-1] = "#"
        return own

    def word_at(i: int, end: int) -> str:
        """The first (0) or the last (-1) word of a line."""
        if i in (joined if end else halved) or len(split[i]) == 1 and (i in joined or i in halved):
            return "#"
        return coded_chunks(split[i][end : end + 1 or None])[0]

    suspects_of: dict[int, list[int]] = {}
    place: dict[int, int] = {}
    at = 0
    for k in suspicious(flat, model) if flat else ():
        while at + 1 < len(body) and start[body[at + 1]] <= k:
            at += 1
        suspects_of.setdefault(body[at], []).append(k)
        place[body[at]] = at
    for i in body if repair else suspects_of:
        chunks, suspects = split[i], [k - start[i] for k in suspects_of.get(i, ())]
        own = decoded = words_of(i) if suspects else []
        suspects = [k for k in suspects if len(own[k]) > 1]
        if suspects:
            before = [word_at(body[place[i] - 1], -1)] if place[i] else []
            after = [word_at(body[place[i] + 1], 0)] if place[i] + 1 < len(body) else []
            ahead = len(before)
            line = [*before, *own, *after]
            asked = (lines[i], i in halved, i in joined, *before, None, *after, None, *suspects)
            decoded = kept.decoded.get(asked)
            if decoded is None:
                decoded = kept.decoded[asked] = decode(line, {k + ahead for k in suspects}, model)
            decoded = own if decoded is line or decoded == line else [d if k in suspects else own[k] for k, d in enumerate(decoded[ahead : ahead + len(own)])]
        misread, out = False, chunks
        if decoded is not own and not repair:
            misread = decoded != own
        elif decoded is not own:
            out = list(chunks)
            for k, now in enumerate(decoded):
                if now != own[k]:
                    misread = True
                    chunk, word = chunks[k], bare(chunks[k])
                    spot = chunk.lower().find(word)
                    if spot >= 0:
                        out[k] = chunk[:spot] + _cased(now, word, chunk[spot : spot + len(word)]) + chunk[spot + len(word) :]
        misread = misread or any(_odd(chunks[k]) for k in suspects)
        if misread:
            found.append((i + 1, "misread"))
        if not repair:
            carried = "" if i in joined else None
            continue
        if carried is not None and out:
            begun = carried
            carried = None
            if paragraphs:
                paragraphs[-1][-1] = begun + out[0]
                out = out[1:]
                if out:
                    paragraphs[-1] += out
            out = []
        elif out:
            if not paragraphs or i > last + 1 and any(not lines[j].strip() for j in range(last + 1, i)) or _ITEM.match(lines[i]) or lines[i].lstrip().startswith("|"):
                paragraphs.append(out)
            else:
                paragraphs[-1] += out
        if i in joined and paragraphs and paragraphs[-1]:
            carried = paragraphs[-1][-1].rstrip(BREAKS)
            paragraphs[-1][-1] = carried
        last = i
    return found, "\n\n".join(" ".join(p) for p in paragraphs if p) if repair else None


_odds: dict[str, bool] = {}


def _odd(chunk: str) -> bool:
    """Whether a chunk has a stray or lost character within a word or a letter for a digit."""
    got = _odds.get(chunk)
    if got is None:
        if len(_odds) > FLUSH:
            _odds.clear()
        table_cell = "|" in (chunk[:1], chunk[-1:])
        got = _odds[chunk] = bool(_SYMBOL_IN_WORD.search(chunk) and not table_cell or _NUMBER_MISREAD.match(chunk.strip(_PUNCT)))
    return got


def _cased(now: str, word: str, written: str) -> str:
    if written.isupper() and len(written) > 1:
        return now.upper()
    return now[:1].upper() + now[1:] if written[:1].isupper() else now


_READ = "logical_doc_id string, part_no int, physical_page int, field string, lines array<int>, kinds array<string>, repaired string"


def _read(told, repair: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        if not model.deletions:
            model.prepare()
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc, part, page, whole, raw, marked in zip(*(batch.column(i).to_pylist() for i in range(6))):
                numbers, kept = {n for n in (page, whole) if n is not None}, Kept()
                for name, text in zip(FIELDS, (raw, marked)):
                    if text:
                        found, repaired = read_page(text, doc, numbers, model, repair, kept)
                        row = (doc, part, page, name, [n for n, _ in found], [k for _, k in found], repaired)
                        for column, value in zip(columns, row):
                            column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())
            names = [c.split()[0] for c in _READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def read_pages(pages: DataFrame, repair: bool = True) -> DataFrame:
    """One row per page and field: what is wrong in which lines, and the repaired paragraphs (NULL unless they are wanted)."""
    model = train(pages)
    told = pages.sparkSession.sparkContext.broadcast(model)
    key = ["logical_doc_id", "part_no", "physical_page"]
    rows = pages.select(*key, F.coalesce("global_page", "physical_page").alias("global_page"), *FIELDS)
    return spread(rows).mapInArrow(_read(told, repair), _READ)


def found_lines(read: DataFrame) -> DataFrame:
    key = ["logical_doc_id", "part_no", "physical_page", "field"]
    each = read.select(*key, F.explode(F.arrays_zip("lines", "kinds")).alias("one"))
    return each.select(*key, F.col("one.lines").alias("line_no"), F.col("one.kinds").alias("kind")).distinct()


def repaired_pages(read: DataFrame) -> DataFrame:
    return read.select("logical_doc_id", "part_no", "physical_page", "field", "repaired").distinct()
