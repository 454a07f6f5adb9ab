"""Problem 7: fill containers of fixed capacity with texts, leaving as little room as possible.

Only the histogram of the sizes, which has no more bins than the capacity, ever reaches the driver. There it is planned:

1. Sizes are put into classes of equal width. Shallow combinations (2 to `depth` classes) whose middles fill the window around
   the capacity are the columns of a non-negative least-squares problem whose unknowns are how often each is repeated and whose
   right side is the histogram; the solution is rounded down and laid out with the largest sizes of the classes, the last of which is the
   one that leaves no room at all. Items so small that they fit nearly everywhere take no part: they are kept to fill what room
   is left.
2. What is left over, and the room left in the combinations' containers, is packed greedily, largest first into the fullest
   container that still takes it, whole runs of equal containers at a time, so the work does not grow with the rows.

The plan is then carried out on the cluster: items get their rank among those of their size by two counted passes in buckets of
bounded length (a size may hold a third of all rows), and size and rank point into the plan.

An item larger than the capacity fills containers of its own and its rest is an item like others; no other item is split.

Cases: items of size 0 (empty and NULL texts) take no room and have no container; NULL ids are items too; repeated rows are items
of their own; equal sizes are ranked by id; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm import bpe
from chronolake.session import cut

CAPACITY = 4096
CLASSES = 64
DEPTH = 3
#: Items below this share of the capacity are kept for filling.
SMALL = 1 / 16
#: Rows of one size that are ranked within one task.
BUCKET_ROWS = 100_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The x >= 0 that makes |ax - b| least, by the active-set method."""
    columns = a.shape[1]
    x, active = np.zeros(columns), np.zeros(columns, bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds or 3 * sum(a.shape)):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient)) if columns else 0
        if not columns or gradient[best] <= scale:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            solved = np.linalg.lstsq(a[:, chosen], b, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[chosen] = solved
                break
            old = x[chosen]
            down = solved <= 0
            step = np.min(old[down] / np.maximum(old[down] - solved[down], 1e-300))
            x[chosen] = old + step * (solved - old)
            out = chosen[(x[chosen] <= 1e-12) & down]
            x[out] = 0
            active[out] = False
            if not active.any():
                break
    return x


def combinations(present: list[int], full: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to depth classes, largest first, whose items' middles (a half below the class number) sum to the capacity
    within half a class."""
    found: list[tuple[int, ...]] = []

    def grow(at: int, chosen: tuple[int, ...], room: float) -> None:
        if len(chosen) > 1 and abs(room) <= 0.5:
            found.append(chosen)
        if len(chosen) == depth:
            return
        left = depth - len(chosen)
        for i in range(at, -1, -1):
            c = present[i]
            if (c - 0.5) * left < room - 0.5:
                break  # even the most repeats of this and smaller ones stay below the window
            if c - 0.5 <= room + 0.5:
                grow(i, (*chosen, c), room - (c - 0.5))

    grow(len(present) - 1, (), float(full))
    return found


@dataclass
class Plan:
    """Runs of equal containers: the sizes in one, how many of them, the first one's number."""

    capacity: int
    runs: list[tuple[tuple[int, ...], int, int]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(n for _, n, _ in self.runs)

    def slots(self) -> np.ndarray:
        """size, first rank, container of the first rank, offset in the container; by size and rank."""
        used: dict[int, int] = {}
        out = []
        for sizes, n, first in self.runs:
            at = 0
            for size in sizes:
                rank = used.get(size, 0)
                out.append((size, rank, first, at))
                used[size] = rank + n
                at += size
        table = np.array(out, np.int64).reshape(-1, 4)
        return table[np.lexsort((table[:, 1], table[:, 0]))]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    opened: dict[int, list[list]] = {}  # by room: [sizes, containers]
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], n: int) -> None:
        if room not in opened:
            opened[room] = []
            insort(rooms, room)
        opened[room].append([sizes, n])

    width = max(1, -(-capacity // classes))
    full = -(-capacity // width)
    least = max(1, int(capacity * SMALL))
    target = np.zeros(full + 1)
    for size in np.flatnonzero(left):
        if size >= least:
            target[-(-int(size) // width)] += left[size]
    columns = combinations([c for c in range(1, full + 1) if target[c]], full, depth)
    if columns:
        a = np.zeros((full + 1, len(columns)))
        for j, combination in enumerate(columns):
            for c in combination:
                a[c, j] += 1
        # Missing a large item costs more room than missing a small one.
        weight = np.sqrt(np.arange(full + 1) / full)[:, None]
        total = max(1.0, target.sum())
        repeats = np.floor(nnls(a * weight, target / total * weight[:, 0]) * total + 1e-6).astype(np.int64)

        def pair(c: int, room: int, taken: dict[int, int]) -> tuple[int, int] | None:
            """The largest size of class c, and the size that fills the room beside it to the last token."""
            first = np.arange(min(c * width, room - least), max(least, (c - 1) * width + 1) - 1, -1)
            if len(first):
                free = left.copy()
                for size, n in taken.items():
                    free[size] -= n
                rest = room - first
                good = (free[first] > 0) & (rest <= capacity) & (free[np.minimum(rest, capacity)] > (rest == first))
                if good.any():
                    size = int(first[np.argmax(good)])
                    return size, room - size
            return None

        def chosen(combination: tuple[int, ...]) -> dict[int, int] | None:
            """How many of which sizes make one container of these classes, if there are such sizes left."""
            taken: dict[int, int] = {}
            room = capacity
            for c in combination[:-2]:
                bottom = max(least, (c - 1) * width + 1)
                free = [s for s in (np.flatnonzero(left[bottom : min(c * width, room) + 1]) + bottom).tolist() if left[s] > taken.get(s, 0)]
                if not free:
                    return None
                taken[free[-1]] = taken.get(free[-1], 0) + 1
                room -= free[-1]
            two = pair(combination[-2], room, taken)
            for size in two or ():
                taken[size] = taken.get(size, 0) + 1
            return taken if two else None

        for combination, wanted in sorted(zip(columns, repeats.tolist()), key=lambda p: (-p[1], p[0])):
            while wanted > 0 and (taken := chosen(combination)):
                n = min(wanted, *(int(left[s]) // k for s, k in taken.items()))
                for s, k in taken.items():
                    left[s] -= n * k
                put(0, tuple(size for size, k in taken.items() for _ in range(k)), n)
                wanted -= n
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(n, capacity // size)
                many = n // each
                put(capacity - each * size, (size,) * each, many)
                n -= each * many
                continue
            room = rooms[at]
            sizes, many = opened[room].pop()
            if not opened[room]:
                del opened[room], rooms[at]
            each = min(n, room // size)
            filled = min(many, n // each)
            if filled < many:
                put(room, sizes, many - filled)
            put(room - each * size, (*sizes, *(size,) * each), filled)
            n -= each * filled
    plan, first = Plan(capacity), 0
    for room in rooms:
        for sizes, n in opened[room]:
            plan.runs.append((tuple(sorted(sizes, reverse=True)), n, first))
            first += n
    return plan


def _place(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = told.value
        keys = (slots[:, 0] << 44) | slots[:, 1]
        for batch in batches:
            size = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(4).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (size << 44) | rank, side="right") - 1
            container = slots[at, 2] + rank - slots[at, 1]
            columns = [*(batch.column(i) for i in range(3)), pa.array(size, pa.int32()), pa.array(container), pa.array(slots[at, 3], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece_no", "token_start", "n_tokens", "container_id", "container_offset"])

    return run


def pack(sized: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """id (bigint), size -> id, piece_no, token_start, n_tokens, container_id, container_offset."""
    sized = cut(sized.select(F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size")))
    items = sized.filter("size > 0").select(
        "id", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))).alias("at"), "size"
    ).select(
        "id",
        (F.col("at") + 1).cast("int").alias("piece_no"),
        (F.col("at") * capacity).cast("long").alias("token_start"),
        F.least(F.lit(capacity), F.col("size") - F.col("at") * capacity).cast("int").alias("n_tokens"),
    )
    histogram = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, capacity, classes, depth)
    # Each size has as many buckets as keep one bucket's rows within bucket_rows or so.
    most = max(histogram.values(), default=1)
    buckets = max(1, -(-most // bucket_rows))
    placed = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("n_tokens", "bucket").orderBy(F.col("id").asc_nulls_last(), "piece_no")
    ranked = placed.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "bucket"])
    ranked = ranked.select("id", "piece_no", "token_start", "n_tokens", (F.col("at") + F.col("earlier")).alias("rank"))
    # The plan's size is bounded by the capacity: a few runs a size and combination.
    told = sized.sparkSession.sparkContext.broadcast(plan.slots())
    out = ranked.mapInArrow(_place(told), "id long, piece_no int, token_start long, n_tokens int, container_id long, container_offset int")
    none = sized.filter("size = 0 or size is null").select(
        "id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("token_start"), F.lit(0).alias("n_tokens"),
        F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("container_offset"),
    )
    return out.unionByName(none)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The documents in containers of `capacity` tokens of the given vocabulary file."""
    counted = bpe.token_counts(documents, ["doc_id"], path=vocabulary)
    return pack(counted.select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size")), capacity).withColumnRenamed("id", "doc_id")
