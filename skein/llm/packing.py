"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

Only the histogram of lengths (at most `capacity` rows) comes to the driver. Patterns of a few lengths that fill a
container exactly or nearly are enumerated from it, repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and what the rounding leaves is packed best-fit by length. Every pattern then owns ranges of
ranks per length, and each document finds its container by its rank among the documents of its length; ranks are
counted in parts, so a length that a third of all documents share is not ranked in one task.

Defined cases: null and empty texts have length 0 and lie in no container (container null); a text longer than the
capacity is cut into full containers and a rest that is packed like any other text, and no other text is cut; equal
lengths are ranked by part, id and row; repeated rows are packed each on its own.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import stage

#: Parts in which the documents of one length are ranked: at least PARTS, and one more per PART_ROWS documents.
PARTS, PART_ROWS = 64, 500_000
#: Lengths in a pattern, and patterns kept for each longest length.
MOST, EACH = 4, 6
#: Passes of the fit at most; it ends before that when no count moves by a hundredth.
PASSES = 60


def nnls(columns: list[tuple[tuple[int, int], ...]], b: list[float], passes: int = PASSES) -> list[float]:
    """x >= 0 with least |ax - b| by cyclic coordinate descent; a column of a is its (row, value) entries."""
    x, r = [0.0] * len(columns), list(b)
    norm = [sum(k * k for _, k in c) for c in columns]
    for _ in range(passes):
        most = 0.0
        for j, c in enumerate(columns):
            step = sum(k * r[i] for i, k in c) / norm[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                for i, k in c:
                    r[i] -= step * k
                if step > most or -step > most:
                    most = abs(step)
        if most < 0.01:
            break
    return x


def patterns(hist: dict[int, int], capacity: int, most: int = MOST, each: int = EACH) -> list[tuple[int, ...]]:
    """Patterns of at most `most` (one to four) lengths with the least room left; up to `each` for every longest length.

    For every longest length all second lengths are tried, each with the greatest third and fourth that still fit, and
    with two of equal share; beside these, each length gets the pattern that repeats it.
    """
    lengths = np.array(sorted(hist), np.int64)
    out: set[tuple[int, ...]] = set()

    def under(room: np.ndarray) -> np.ndarray:
        """The greatest length that fits, 0 for none."""
        i = np.searchsorted(lengths, room, "right")
        return np.where(i > 0, lengths[np.maximum(i - 1, 0)], 0)

    for big in lengths.tolist():
        found: set[tuple[int, ...]] = {(big,), (big,) * min(most, capacity // big)}
        room = capacity - big
        m = lengths[lengths <= room]
        if most > 1 and len(m):
            found.add((big, int(m[-1])))
            rows = []
            if most > 2:
                k = under(room - m)
                rows.append(np.stack([m, k, np.zeros_like(m)], 1))
                if most > 3:
                    rows.append(np.stack([m, k, under(room - m - k)], 1))
                    half = under((room - m) // 2)
                    rows.append(np.stack([m, half, under(room - m - half)], 1))
                tried = np.concatenate(rows)
                left = room - tried.sum(1)
                # Several writings of one pattern may be among the best, six at most.
                for i in np.argsort(left, kind="stable")[: 6 * each].tolist():
                    found.add((big, *(x for x in tried[i].tolist() if x)))
        ok = {tuple(sorted(p, reverse=True)) for p in found}
        out |= set(sorted(ok, key=lambda p: (capacity - sum(p), len(p), p))[:each])
    return sorted(out)


def fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly: the fitted patterns, then best-fit ones for the rest."""
    left = Counter({k: v for k, v in hist.items() if v})
    out: list[tuple[tuple[int, ...], int]] = []
    if left:
        pats = patterns(left, capacity)
        rows = {n: i for i, n in enumerate(sorted(left))}
        # Only patterns that leave next to no room are fitted; on the second round to what the first left.
        tight = [p for p in pats if sum(p) >= capacity - max(1, capacity // 512)]
        columns = [tuple((rows[n], k) for n, k in Counter(p).items()) for p in tight]
        for _ in range(2 if tight else 0):
            x = nnls(columns, [float(left[n]) for n in rows])
            for j in sorted(range(len(tight)), key=lambda j: capacity - sum(tight[j])):
                need = Counter(tight[j])
                times = min([int(x[j] + 1e-9), *(left[n] // k for n, k in need.items())])
                if times > 0:
                    out.append((tight[j], times))
                    for n, k in need.items():
                        left[n] -= k * times
    rests = (fill_up(left, capacity), best_fit(left, capacity))
    return out + min(rests, key=lambda plan: sum(t for _, t in plan))


def best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: containers with equal contents are kept as one group."""
    groups: dict[int, list[list]] = {}  # room: [contents, number of containers]
    rooms: list[int] = []
    for n in sorted((k for k, v in left.items() if v > 0), reverse=True):
        c = left[n]
        while c:
            i = bisect.bisect_left(rooms, n)
            room = rooms[i] if i < len(rooms) else capacity
            if i < len(rooms):
                inside, times = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                inside, times = (), c
            per = min(room // n, c)
            use = min(times, c // per)
            c -= use * per
            for r, x, t in ((room - per * n, (*inside, *([n] * per)), use), (room, inside, times - use if inside else 0)):
                if t:
                    if r not in groups:
                        groups[r] = []
                        bisect.insort(rooms, r)
                    groups[r].append([x, t])
    return [(x, t) for g in groups.values() for x, t in g]


def fill_up(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fill container by container: the longest length left, then always the longest that fits; equal containers at once.

    The number of steps follows the number of different lengths, not of documents.
    """
    left = Counter({k: v for k, v in left.items() if v > 0})
    lengths = sorted(left)
    out = []
    while lengths:
        room, used = capacity, Counter()
        i = len(lengths)
        while i:
            i = bisect.bisect_right(lengths, room, 0, i)
            if not i:
                break
            n = lengths[i - 1]
            k = min(left[n], room // n)
            used[n] += k
            room -= k * n
            i -= 1
        times = min(left[n] // k for n, k in used.items())
        out.append((tuple(sorted(used.elements(), reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
    return out


def ranges(plan: list[tuple[tuple[int, ...], int]], base: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per length: (first rank, first container, offset in the container), in order of rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    for pattern, times in plan:
        at = 0
        for n in pattern:
            out.setdefault(n, []).append((used[n], base, at))
            used[n] += times
            at += n
        base += times
    return out


def pack(docs: DataFrame, doc: str, n_tokens: str, capacity: int = 2048) -> DataFrame:
    """(doc, part, first_token, length, container, start): every piece of every document and where it lies."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("bigint").alias("n"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "packing-lengths")
    full = F.floor(F.col("n") / capacity)
    rest = rows.select("doc", "row", "n", full.alias("part"), (F.col("n") - full * capacity).alias("length"))
    # Ranks among the pieces of one length: counted inside parts, each part starting where the parts before it end.
    parts = max(PARTS, rows.count() // PART_ROWS)
    part = F.pmod(F.xxhash64("row"), F.lit(parts))
    small = stage(rest.filter("length > 0").withColumn("bin", part), "packing-rests")
    sizes = small.groupBy("length", "bin").agg(F.count("*").alias("k"))
    first = sizes.select("length", "bin", (F.sum("k").over(Window.partitionBy("length").orderBy("bin")) - F.col("k")).alias("before"))
    hist = {r["length"]: r["k"] for r in sizes.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    plan = fit(hist, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(ranges(plan, 0))
    packed = sum(t for _, t in plan)
    ranked = small.withColumn("r", F.row_number().over(Window.partitionBy("length", "bin").orderBy("doc", "row"))).join(first, ["length", "bin"])
    ranked = ranked.select("doc", "part", (F.col("part") * capacity).alias("first_token"), "length", (F.col("before") + F.col("r") - 1).alias("rank"))
    kind = docs.schema[doc].dataType.simpleString()
    schema = f"doc {kind}, part bigint, first_token bigint, length bigint, container bigint, start bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = {n: tuple(np.array(c) for c in zip(*v, strict=True)) for n, v in shared.value.items()}
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            container, start = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for x in np.unique(n):
                mine = n == x
                lo, base, at = where[int(x)]
                i = np.searchsorted(lo, rank[mine], "right") - 1
                container[mine], start[mine] = base[i] + rank[mine] - lo[i], at[i]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(container), pa.array(start)], names=["doc", "part", "first_token", "length", "container", "start"])

    placed = ranked.mapInArrow(place, schema)
    # Full containers: numbered by the row they come from, behind all packed ones.
    over = rows.filter(F.col("n") >= capacity).withColumn("bin", part).withColumn("k", F.floor(F.col("n") / capacity))
    binned = over.groupBy("bin").agg(F.sum("k").alias("k"))
    begin = binned.select("bin", (F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("bin")) - F.col("k")).alias("before"))
    run = F.sum("k").over(Window.partitionBy("bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    over = over.withColumn("base", F.coalesce(run, F.lit(0))).join(begin, "bin")
    fulls = over.select("doc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("part"), (F.col("base") + F.col("before")).alias("base"))
    fulls = fulls.select("doc", "part", (F.col("part") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("length"), (F.col("base") + F.col("part") + packed).alias("container"), F.lit(0).cast("bigint").alias("start"))
    none = F.lit(None).cast("bigint")
    empty = rows.filter("n = 0").select("doc", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("length"), none.alias("container"), none.alias("start"))
    return placed.unionByName(fulls).unionByName(empty)
