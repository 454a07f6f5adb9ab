"""Problem 4: all pairs of texts whose sets of three-word shingles share at least `threshold` of their union, exactly.

Texts of at least `least_words` words count. The universe of shingles is hashed into segments, as many as the size band of the
set asks for, so that a segment of a set holds `load` shingles on average. For a pair with |x| <= |y| the overlap o that the
threshold demands leaves at most |x| - o shingles of x out of y; each of them spoils one segment of x at most, so of any
|x| - o + 1 of x's segments one at least lies wholly in y (pigeonhole).

* Index: each set offers its segments' subsets with their one-deletion neighbourhoods, taken again until one shingle is left, so
  whatever part of a segment another set holds can be looked up.
* Allocation: each set looks up only the |x| - o + 1 of its segments that cost least, by counts of all index entries in a table
  that grows with the entries up to a bound. It looks in the band of its own size and the next, which hold all sizes that can
  reach the threshold. The larger y, the fewer segments x may spoil, so each look-up, the cheapest first, has a largest size of y
  beyond which the cheaper ones do; the dearest only meet sets of hardly more than x's own size.
* Signatures meet in parts, which are ranges of their hash within source and band, so that a set's entries go to few parts. A
  part gets each set's parities once and, per entry, three bytes, with one more for the size that a look-up reaches; sets are
  named by five bytes within their batch.
* Entries of too common signatures are salted: the index rows are dealt out, the look-ups sent to every share.
* A match first passes an exact bound: the parities of many segments differ in no more places than the sets differ in shingles.
* Every remaining pair is then verified by the shingle sets themselves.

Equal texts are one entry with many ids until the end. Nothing but counts of fixed size reaches the driver.

Cases: NULL, empty and short texts and NULL ids have no pairs; a pair of rows with one id is none; exact duplicate rows count
once; an empty table gives an empty result; extra columns are ignored. Shingles and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.session import cut

THRESHOLD = Fraction(3, 5)
LEAST_WORDS = 70
SHINGLE = 3
#: Shingles of a set that share a segment, on average.
LOAD = 0.8
#: Size bands: the smallest size and the ratio (1 / threshold at least, so that two bands hold all partners).
FIRST_BAND = 40
#: Entries of the table of index counts (4 bytes each): one for so many index entries, within these bounds.
COUNTERS, MOST_COUNTERS, ENTRIES_OF_COUNTER = 1 << 20, 1 << 23, 32
CHUNKS = 64
#: Index entries of one signature in one share.
SHARE = 20_000
#: Index entries that a task of the look-up takes.
TASK_ENTRIES = 8_000_000
#: Pairs looked at in one block, which bounds a task's memory whatever the skew.
BLOCK_PAIRS = 1_000_000
#: Candidate ids up to which the sets are picked by a broadcast instead of an exchange (8 bytes each).
BROADCAST_IDS = 500_000
KEPT_WORDS = 200_000
#: Bytes kept of a shingle's hash.
BYTES = 6
#: Bytes kept of a signature within its part; by chance equal ones only cost a look at two sets' parities.
SHORT = 3
#: Sets that are worked on at once.
BATCH_SETS = 4096

_WORD = regex.compile(r"\S+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        text = text.lower()
        return _WORD.findall(text) if _CONTROL.search(text) else text.split()

    def __call__(self, text: str, least: int = LEAST_WORDS, size: int = SHINGLE) -> np.ndarray | None:
        words = self.words(text)
        if len(words) < max(least, size):
            return None
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        kept = self.kept
        for word in set(words):
            if word not in kept:
                kept[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.array([kept[w] for w in words], np.uint64)
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(codes) - size + 1, np.uint64)
            for i in range(size):
                rolled = mix(rolled * _A + codes[i : len(codes) - size + 1 + i] + _B)
        return np.unique(rolled & np.uint64((1 << 8 * BYTES) - 1))


def packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // BYTES, 8), np.uint8)
    wide[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return wide.view("<u8").ravel()


def _sets(least: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sources, docs, texts = (batch.column(i).to_pylist() for i in range(3))
            kept, made = [], []
            for i, text in enumerate(texts):
                if (own := shingles(text, least, size)) is not None:
                    kept.append(i)
                    made.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sources[i] for i in kept], pa.int32()),
                    pa.array([docs[i] for i in kept], pa.int64()),
                    pa.array(list(map(packed, made)), pa.binary()),
                ],
                names=["source", "doc", "shingles"],
            )

    return run


def reach(n: np.ndarray, spoiled: np.ndarray, t: Fraction) -> np.ndarray:
    """The largest set that a set of n shingles can reach the threshold with if it lacks `spoiled` of them."""
    return (n - spoiled) * (t.numerator + t.denominator) // t.numerator - n


def needed(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Shingles that sets of sizes a and b must share to reach the threshold."""
    total = (np.asarray(a, np.int64) + np.asarray(b, np.int64)) * t.numerator
    return -(-total // (t.numerator + t.denominator))


class Bands:
    def __init__(self, t: Fraction, load: float, most: int = 1 << 30):
        starts = [0, FIRST_BAND]
        while starts[-1] < most:
            starts.append(-(-starts[-1] * t.denominator // t.numerator))
        self.starts = np.array(starts, np.int64)
        middle = np.sqrt(np.maximum(self.starts[:-1], 8.0) * self.starts[1:])
        self.segments = np.maximum(1, np.round(middle / load)).astype(np.uint64)
        # Three 64-bit words times a power of two for each band, so that longer bits can be folded.
        self.words = 3 * np.maximum(1, 2 ** np.ceil(np.log2(1.2 * self.starts[1:] / 192))).astype(np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, side="right") - 1


class Sets:
    """The sets of one Arrow batch as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.source = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        self.no = batch.column(1).to_numpy(zero_copy_only=False)
        raw = batch.column(2).to_pylist()
        self.n = np.array([len(r) // BYTES for r in raw], np.int64)
        self.shingles = unpacked(b"".join(raw))
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def runs(self, bands: Bands, band: np.ndarray, rows: np.ndarray | None = None):
        """Mixed shingles in order of row and segment, each run's start, length and row."""
        row, shingles = self.row, self.shingles
        if rows is not None:
            keep = rows[row]
            row, shingles = row[keep], shingles[keep]
        segment = mix(shingles ^ _C) % bands.segments[band[row]]
        key = (row.astype(np.uint64) << np.uint64(32)) | segment
        order = np.argsort(key, kind="stable")
        key, value = key[order], mix(shingles[order] + _B)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, len(key)])
        return value, first, length, row[order][first] if len(key) else np.zeros(0, np.int64)

    def salt(self, band: np.ndarray) -> np.ndarray:
        return mix(self.source * _A + band.astype(np.uint64) * _C + _B)

    def index(self, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of every subset of every segment, their rows and bands."""
        band = bands.of(self.n)
        value, first, length, row = self.runs(bands, band)
        signatures, rows = [], []
        for size in np.unique(length):
            own = length == size
            at, who = first[own], row[own]
            for members in range(1, 1 << int(size)):
                subset = np.zeros(len(at), np.uint64)
                for bit in range(int(size)):
                    if members >> bit & 1:
                        subset = subset + value[at + bit]
                signatures.append(subset)
                rows.append(who)
        if not signatures:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.concatenate(rows)
        return mix(np.concatenate(signatures) ^ self.salt(band)[rows]), rows, band[rows]

    def lookups(self, bands: Bands, counts: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of each set's cheapest segments, as many as the pigeonhole needs, in its band and the next; their rows,
        bands and the largest size of a set they are to find: the larger the other set, the fewer segments it may spoil, so the
        dearest look-ups are for sets of hardly more than the own size."""
        signatures, rows, of, largest = [], [], [], []
        own = bands.of(self.n)
        for step in (0, 1):
            band = own + step
            smallest = np.maximum(self.n, bands.starts[band])
            spare = self.n - needed(self.n, smallest, t)
            asking = spare >= 0
            value, first, length, row = self.runs(bands, band, asking)
            if not len(first):
                continue
            whole = mix(np.add.reduceat(value, first) ^ self.salt(band)[row])
            order = np.lexsort((counts[whole & np.uint64(len(counts) - 1)], row))
            whole, row = whole[order], row[order]
            start = np.searchsorted(row, np.arange(len(self.n)))
            rank = np.arange(len(row)) - start[row]
            chosen = rank <= spare[row]
            signatures.append(whole[chosen])
            rows.append(row[chosen])
            of.append(band[row[chosen]])
            largest.append(reach(self.n[row[chosen]], rank[chosen], t))
            found = np.bincount(row, minlength=len(self.n))
            few = asking & (found <= spare)
            if few.any():  # fewer segments than the pigeonhole needs: any shingle in common will do
                keep = few[self.row]
                who = self.row[keep]
                signatures.append(mix(mix(self.shingles[keep] + _B) ^ self.salt(band)[who]))
                rows.append(who)
                of.append(band[who])
                largest.append(reach(self.n[who], found[who], t))
        if not signatures:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(signatures), np.concatenate(rows), np.concatenate(of), np.concatenate(largest)

    def parities(self, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
        """All sets' bits in 64-bit words, and each set's number of words: the parity of its shingles in each segment of the
        universe, with about as many more segments than shingles as tells sets apart."""
        words = bands.words[bands.of(self.n)]
        start = np.cumsum(words) - words
        spot = mix(self.shingles * _C + _A) % (words[self.row] * 64).astype(np.uint64)
        flat = np.zeros(int(words.sum()), np.uint64)
        at = start[self.row] + (spot >> np.uint64(6)).astype(np.int64)
        np.bitwise_xor.at(flat, at, np.uint64(1) << (spot & np.uint64(63)))
        return flat, words


def apart(flat: np.ndarray, start: np.ndarray, words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many segments the parities of sets x and y differ; the longer bits are folded to the length of the shorter."""
    out = np.zeros(len(x), np.int64)
    # All lengths are multiples of three words, and rows of three are fetched several times as fast as single words.
    rows, start = flat.reshape(-1, 3), start // 3
    both = words[x] << 32 | words[y]
    codes = np.unique(both)
    for code in codes:
        own = np.flatnonzero(both == code) if len(codes) > 1 else slice(None)
        wx, wy = int(code) >> 32, int(code) & 0xFFFFFFFF
        low = min(wx, wy) // 3
        sides = [(start[who[own]], w // 3) for who, w in ((x, wx), (y, wy))]
        for piece in range(low):
            folded = np.zeros((1, 3), np.uint64)
            for first, w in sides:
                for fold in range(piece, w, low):
                    folded = folded ^ rows.take(first + fold, axis=0)
            bits = np.bitwise_count(folded)
            out[own] += bits[:, 0] + bits[:, 1] + bits[:, 2]
    return out


def _count(t: Fraction, load: float, counters: int):
    """The table in chunks; chunk -1 - group has the entries of a group, which is source * GROUPS + band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, counts, groups = Bands(t, load), np.zeros(counters, np.int64), np.zeros(0, np.int64)
        for batch in _batches(batches):
            if batch.num_rows:
                sets = Sets(batch)
                signatures, row, band = sets.index(bands)
                counts += np.bincount((signatures & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
                own = np.bincount(sets.source[row].astype(np.int64) * GROUPS + band)
                groups = np.pad(groups, (0, max(0, len(own) - len(groups))))
                groups[: len(own)] += own
        parts = counts.reshape(CHUNKS, -1) if len(groups) else np.zeros((0, 1))
        found = np.flatnonzero(groups)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*range(len(parts)), *(-1 - found).tolist()], pa.int32()),
                pa.array([*(p.astype("<u8" if p.max() >> 32 else "<u4").tobytes() for p in parts), *(groups[g : g + 1].astype("<u8").tobytes() for g in found)], pa.binary()),
            ],
            names=["chunk", "counts"],
        )

    return run


def _add(width: int):
    import pandas as pd

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        chunk = frame["chunk"].iloc[0]
        n = 1 if chunk < 0 else width
        summed = sum(np.frombuffer(c, "<u4" if len(c) == 4 * n else "<u8").astype(np.int64) for c in frame["counts"])
        return pd.DataFrame({"chunk": [chunk], "counts": [(summed.astype("<u8") if chunk < 0 else np.minimum(summed, 2**32 - 1).astype("<u4")).tobytes()]})

    return total


#: More than there are size bands.
GROUPS = 64


class Parts:
    """Which part an entry goes to: each group has its share of the range of parts, and within it the hash decides."""

    def __init__(self, entries: dict[int, int], parts: int):
        names = sorted(entries)
        self.parts, whole = parts, max(1, sum(entries.values()))
        self.start, self.width = (np.zeros(max(names, default=0) + 2 + GROUPS) for _ in range(2))
        done = 0
        for g in names:
            self.start[g], self.width[g] = done / whole, entries[g] / whole
            done += entries[g]

    def of(self, source: np.ndarray, band: np.ndarray, spot: np.ndarray) -> np.ndarray:
        group = np.minimum(source.astype(np.int64) * GROUPS + band, len(self.start) - 1)
        within = (spot >> np.uint64(32)).astype(np.float64) / 2.0**32
        return np.minimum(((self.start[group] + within * self.width[group]) * self.parts).astype(np.int64), self.parts - 1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_SETS):
            yield batch.slice(start, BATCH_SETS)


def _emit(t: Fraction, load: float, told, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, (table, parts) = Bands(t, load), told.value
        buckets = np.uint64(len(table) - 1)
        for batch in _batches(batches):
            sets = Sets(batch)
            if len(sets.no) and sets.no[-1] - sets.no[0] != len(sets.no) - 1:
                raise RuntimeError("a task's sets must be numbered in a row")
            parity, words = sets.parities(bands)
            parity_start = np.cumsum(words) - words
            index, index_row, index_band = sets.index(bands)
            ask, ask_row, ask_band, ask_reach = sets.lookups(bands, table, t)
            shares = np.maximum(1, -(-table[index & buckets].astype(np.int64) // share)).astype(np.uint64)
            index_salt = mix(sets.no[index_row].view(np.uint64) + _A) % shares
            shares = np.maximum(1, -(-table[ask & buckets].astype(np.int64) // share))
            ask, ask_row, ask_band, ask_reach = (np.repeat(a, shares) for a in (ask, ask_row, ask_band, ask_reach))
            ask_salt = (np.arange(len(ask)) - np.repeat(np.cumsum(shares) - shares, shares)).astype(np.uint64)
            row = np.concatenate([index_row, ask_row])
            asks = np.r_[np.zeros(len(index), np.int64), np.ones(len(ask), np.int64)]
            spot = mix(np.concatenate([index, ask]) + np.concatenate([index_salt, ask_salt]) * _A)
            part = parts.of(sets.source[row], np.concatenate([index_band, ask_band]), spot)
            order = np.lexsort((asks, row, part))
            steps = np.r_[np.zeros(len(index), np.uint8), steps_up(sets.n[ask_row], ask_reach, t)]
            spot, part, row, asks, steps = spot[order], part[order], row[order], asks[order], steps[order]
            short = spot.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]
            # Runs of a set's index entries and of its look-ups in a part, cut where a head can count no further.
            group = (part * len(sets.n) + row) * 2 + asks
            new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
            since = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
            first = np.flatnonzero(since % MOST == 0)
            heads = np.zeros(len(first), _HEAD)
            who, own = row[first], part[first]
            heads["row"], heads["n"] = who, np.minimum(sets.n[who], 0xFFFF)
            heads["many"] = np.diff(np.r_[first, len(group)]) | asks[first] << 7
            fresh = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (who[1:] != who[:-1])]) if len(who) else np.zeros(0, np.int64)
            numbers = np.unique(own)
            asked, steps = part[asks == 1], steps[asks == 1]
            bounds = [(np.searchsorted(a, numbers, "left").tolist(), np.searchsorted(a, numbers, "right").tolist()) for a in (own, own[fresh], part, asked)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers.astype(np.int32)),
                    pa.array([int(sets.no[0]) if len(sets.no) else 0] * len(numbers), pa.int64()),
                    pa.array([heads[a:b].tobytes() for a, b in zip(*bounds[0])], pa.binary()),
                    # Sizes that a head cannot hold, and all parities, once for each set.
                    pa.array([(n := sets.n[who[fresh[a:b]]])[n >= 0xFFFF].astype("<u4").tobytes() for a, b in zip(*bounds[1])], pa.binary()),
                    pa.array([_gather(parity, parity_start, words, who[fresh[a:b]]).tobytes() for a, b in zip(*bounds[1])], pa.binary()),
                    pa.array([short[a:b].tobytes() for a, b in zip(*bounds[2])], pa.binary()),
                    pa.array([steps[a:b].tobytes() for a, b in zip(*bounds[3])], pa.binary()),
                ],
                names=["part", "base", "heads", "large", "parities", "signatures", "steps"],
            )

    return run


#: Of a set in a part: its row in the batch, its size, and how many entries follow (127 at most; the high bit marks look-ups).
_HEAD = np.dtype([("row", "<u2"), ("n", "<u2"), ("many", "u1")])
MOST = 127
_EMITTED = "part int, base long, heads binary, large binary, parities binary, signatures binary, steps binary"


#: Steps from a set's own size to the largest that the threshold allows, and the size up to which an index is in its order.
STEPS, MOST_SIZE = 255, (1 << 20) - 1


def steps_up(n: np.ndarray, largest: np.ndarray, t: Fraction) -> np.ndarray:
    """A byte from which size_up makes `largest` again, or a little more."""
    return (-((n - largest) * (STEPS * t.numerator) // (n * max(1, t.denominator - t.numerator)))).astype(np.uint8)


def size_up(n: np.ndarray, steps: np.ndarray, t: Fraction) -> np.ndarray:
    return n + steps * (n * (t.denominator - t.numerator)) // (STEPS * t.numerator)


def _gather(flat: np.ndarray, start: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The stretches of the given rows, one after the other."""
    many = lengths[rows]
    return flat[np.arange(int(many.sum())) + np.repeat(start[rows] - (np.cumsum(many) - many), many)]


def _match(t: Fraction, load: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sizes, parts, bits, rows, asking, signatures, steps, sets = [], [], [], [], [], [], [], [], 0
        for batch in batches:
            for part, base, head, large, parity, raw, up in zip(*(batch.column(i).to_pylist() for i in range(7))):
                own = np.frombuffer(head, _HEAD)
                fresh = np.r_[True, own["row"][1:] != own["row"][:-1]]
                many = (own["many"] & MOST).astype(np.int64)
                rows.append((np.repeat(np.cumsum(fresh) - 1, many) + sets).astype(np.int32))
                asking.append(np.repeat(own["many"] > MOST, many))
                first = own[fresh]
                n = first["n"].astype(np.int32)
                n[n == 0xFFFF] = np.frombuffer(large, "<u4")
                numbers.append(base + first["row"].astype(np.int64))
                sizes.append(n)
                parts.append(np.full(len(raw) // SHORT, part, np.int32))
                bits.append(np.frombuffer(parity, "<u8"))
                wide = np.zeros((len(raw) // SHORT, 4), np.uint8)
                wide[:, :SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
                signatures.append(wide.view("<u4").ravel())
                steps.append(np.frombuffer(up, np.uint8))
                sets += len(first)
        if not sets:
            return
        no, n, part, flat, parity, row, asks, steps = (np.concatenate(a) for a in (numbers, sizes, parts, signatures, bits, rows, asking, steps))
        del numbers, sizes, parts, signatures, bits, rows, asking
        bands = Bands(t, load)
        words = bands.words[bands.of(n)]
        parity_start = np.cumsum(words) - words
        # One signature space for each part, should one task hold several; entries of a signature in order of their sets' sizes.
        size = np.minimum(n, MOST_SIZE).astype(np.int64)
        key = (part.astype(np.int64) << 24 | flat) << 20
        index_row = row[~asks]
        index_key = key[~asks] | size[index_row]
        order = np.argsort(index_key)
        index_key, index_row = index_key[order], index_row[order]
        ask_key, ask_row = key[asks], row[asks]
        del key, row, asks, flat, part
        # Look-ups in the order of the index find it in the processor's cache.
        order = np.argsort(ask_key)
        ask_key, ask_row = ask_key[order], ask_row[order]
        largest = np.minimum(size_up(n[ask_row].astype(np.int64), steps[order].astype(np.int64), t), MOST_SIZE)
        low = np.searchsorted(index_key, ask_key | size[ask_row], side="left")
        many = np.searchsorted(index_key, ask_key | largest, side="right") - low
        del ask_key, index_key, largest
        keep = many > 0
        low, many, ask_row = low[keep], many[keep], ask_row[keep]
        total = np.cumsum(many)
        found: list[np.ndarray] = []
        at = 0
        while at < len(many):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + BLOCK_PAIRS, side="right")))
            # one look-up alone may meet more than a block; its matches are then taken in slices
            for cut_from in range(0, int(many[at]) if to == at + 1 else 1, BLOCK_PAIRS):
                if to == at + 1:
                    width = min(BLOCK_PAIRS, int(many[at]) - cut_from)
                    x = np.full(width, ask_row[at])
                    y = index_row[low[at] + cut_from : low[at] + cut_from + width]
                else:
                    m = many[at:to]
                    x = np.repeat(ask_row[at:to], m)
                    y = index_row[np.arange(len(x)) + np.repeat(low[at:to] - (np.cumsum(m) - m), m)]
                nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
                ok = (nx < ny) | ((nx == ny) & (no[x] < no[y]))
                ok &= nx * t.denominator >= ny * t.numerator
                x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
                ok = apart(parity, parity_start, words, x, y) <= nx + ny - 2 * needed(nx, ny, t)
                if ok.any():
                    found.append(np.unique((x[ok].astype(np.int64) << 32) | y[ok].astype(np.int64)))
            if len(found) > 64:
                found = [np.unique(np.concatenate(found))]
            at = to
        if found:
            pairs = np.unique(np.concatenate(found))
            x, y = pairs >> 32, pairs & 0xFFFFFFFF
            # A set may have come in several batches' rows of one part, so pairs are not yet distinct by number.
            pairs = np.unique(np.stack([no[x], no[y]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["x", "y"])

    return run


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            sides = []
            for column in (3, 4):
                raw = batch.column(column).to_pylist()
                n = np.array([len(r) // BYTES for r in raw], np.int64)
                # A batch holds far fewer than 2^16 pairs, so a pair's number fits above its shingles.
                sides.append((n, unpacked(b"".join(raw)) | (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(8 * BYTES))))
            (nx, xs), (ny, ys) = sides
            every = np.sort(np.concatenate([xs, ys]))
            shared = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(8 * BYTES)).astype(np.int64), minlength=len(nx))
            good = shared * t.denominator >= (nx + ny - shared) * t.numerator
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(3)], names=["source", "x", "y"])

    return run


def similar_texts(
    texts: DataFrame,
    threshold: Fraction = THRESHOLD,
    least_words: int = LEAST_WORDS,
    shingle: int = SHINGLE,
    load: float = LOAD,
    counters: int | None = None,
    share: int = SHARE,
    parts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """source (int), id, text -> (members: source, doc, id; pairs of different texts: source, x, y).

    doc stands for a text; equal texts have one. The size of the table of counts and the number of parts follow the entries
    unless they are given.
    """
    spark = texts.sparkSession
    t = Fraction(threshold)
    rows = texts.filter(F.col("id").isNotNull() & (F.length("text") >= 2 * least_words - 1)).select(
        F.col("source").cast("int").alias("source"), "id", F.xxhash64("text").alias("doc"), "text"
    )
    own = rows.groupBy("source", "doc").agg(F.first("text").alias("text"))
    sets = own.select("source", "doc", "text").mapInArrow(_sets(least_words, shingle), "source int, doc long, shingles binary")
    # The number stands for a set on its way; rows of a task have consecutive ones.
    sets = cut(sets.withColumn("no", F.monotonically_increasing_id()))
    # One exchange of the ids serves their distinctness and every join on the text.
    members = rows.select("source", "doc", "id").repartition("source", "doc").distinct()
    members = members.join(sets.select("source", "doc"), ["source", "doc"], "left_semi")

    numbered = sets.select("source", "no", "shingles")
    shingles = (numbered.agg(F.sum(F.length("shingles"))).first()[0] or 0) // BYTES
    counters = counters or int(np.clip(1 << max(0, int(shingles * 1.5 / ENTRIES_OF_COUNTER)).bit_length(), COUNTERS, MOST_COUNTERS))
    counted = numbered.mapInArrow(_count(t, load, counters), "chunk int, counts binary")
    width = counters // CHUNKS
    counts, groups = np.zeros(counters, np.uint32), {}
    for c in counted.groupBy("chunk").applyInPandas(_add(width), "chunk int, counts binary").collect():
        if c["chunk"] < 0:
            groups[-1 - c["chunk"]] = int(np.frombuffer(c["counts"], "<u8")[0])
        else:
            counts[c["chunk"] * width : (c["chunk"] + 1) * width] = np.frombuffer(c["counts"], "<u4")
    entries = sum(groups.values())
    parts = parts or max(spark.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES))
    # A counter holds other signatures' entries too; what they alone explain is no reason to deal a signature out.
    share = max(share, 8 * entries // counters)
    told = spark.sparkContext.broadcast((counts, Parts(groups, parts)))
    emitted = numbered.mapInArrow(_emit(t, load, told, share), _EMITTED)
    candidates = cut(emitted.repartitionById(parts, F.col("part")).mapInArrow(_match(t, load), "x long, y long").distinct())

    ids = candidates.select(F.col("x").alias("no")).union(candidates.select("y")).distinct()
    few = candidates.count() <= BROADCAST_IDS // 2
    picked = sets.join(F.broadcast(ids) if few else ids, "no", "left_semi")
    left = picked.select("source", F.col("no").alias("x"), F.col("doc").alias("xd"), F.col("shingles").alias("xs"))
    right = picked.select(F.col("source").alias("y_source"), F.col("no").alias("y"), F.col("doc").alias("yd"), F.col("shingles").alias("ys"))
    both = candidates.join(left, "x").join(right, "y").filter("source = y_source")
    both = both.select("source", F.col("xd").alias("x"), F.col("yd").alias("y"), "xs", "ys")
    return members, both.mapInArrow(_verify(t), "source int, x long, y long")


SOURCES = ("silver_provisions", "naive_q100")


def legal_texts(provisions: DataFrame, chunks: DataFrame) -> DataFrame:
    return provisions.select(F.lit(0).alias("source"), F.col("provision_id").alias("id"), F.col("content").alias("text")).unionByName(
        chunks.select(F.lit(1).alias("source"), F.col("chunk_id").alias("id"), "text")
    )


def id_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """source_table, id_a, id_b with id_a < id_b: all pairs of different ids, of equal texts too."""
    many = members.groupBy("source", "doc").count().filter("count > 1").select("source", "doc")
    copies = members.join(many, ["source", "doc"], "left_semi")
    a = members.select("source", F.col("doc").alias("x"), F.col("id").alias("i"))
    b = members.select("source", F.col("doc").alias("y"), F.col("id").alias("j"))
    between = pairs.join(a, ["source", "x"]).join(b, ["source", "y"]).select("source", "i", "j")
    equal = copies.withColumnRenamed("id", "i").join(copies.withColumnRenamed("id", "j"), ["source", "doc"]).filter("i < j")
    equal = equal.select("source", "i", "j")
    name = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("source") + 1)
    return (
        between.unionByName(equal)
        .filter("i <> j")
        .select(name.alias("source_table"), F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
        .distinct()
    )


def groups(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """source, doc, group_doc, n_links of every text with a partner: connected components by stars.

    Each round links every node's greater neighbours, then its smaller ones, to the least it knows, until nothing changes; all of
    it joins and aggregations whose lineage is cut in the shared folder, and no component is ever held in one place.
    """
    links = pairs.select("source", F.col("x").alias("u"), F.col("y").alias("v"))
    both = cut(links.unionByName(links.select("source", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    degree = both.groupBy("source", F.col("u").alias("doc")).agg(F.count("*").alias("n_links"))
    edges, before = both.filter("u > v"), None
    for _ in range(rounds):
        sides = edges.unionByName(edges.select("source", F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("source", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.filter("v > u").join(least, ["source", "u"]).select("source", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("source", "u").agg(F.min("v").alias("m"))
        small = large.join(down, ["source", "u"]).filter("v <> m").select("source", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(down.select("source", "u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("source", "u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    root = edges.select("source", F.col("u").alias("doc"), F.col("v").alias("group_doc"))
    return degree.join(root, ["source", "doc"], "left").withColumn("group_doc", F.coalesce("group_doc", "doc"))


def id_groups(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """source_table, id, group_id (the least id of the group), n_links to different texts; copies of one text share a group."""
    many = members.groupBy("source", "doc").count().filter("count > 1").select("source", "doc")
    every = grouped.unionByName(
        many.join(grouped, ["source", "doc"], "left_anti").select("source", "doc", F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("group_doc"))
    )
    joined = members.join(every, ["source", "doc"])
    name = joined.groupBy("source", "group_doc").agg(F.min("id").alias("group_id"))
    label = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("source") + 1)
    return joined.join(name, ["source", "group_doc"]).select(label.alias("source_table"), "id", "group_id", "n_links").distinct()
