"""Packing token pieces into sequences by bin completion.

Lengths are small integers, so the packing problem is solved on the histogram of
lengths, whose size does not grow with the data: a solution is a list of fillings
(lengths of one sequence), each with the number of times it is used.  Pieces then
find their places by their number among the pieces of their length.

Bin completion (Korf 2003): the largest remaining length opens a sequence and the
undominated fillings of the rest are enumerated, fullest first; a branch ends when
the waste so far exceeds what the number of sequences sought allows.  Best-fit
decreasing gives the first incumbent, and the waste bound (all tokens over the
capacity) ends the search early.  The search has budgets, which are parameters;
without them it is exhaustive, and its result the least number of sequences.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import map_arrow, small_or_shuffled, written
from .tokens import Shipped

Filling = tuple[int, ...]
#: Budgets: fillings tried for one sequence; nodes looked at for one list of fillings; choices of a whole search, besides two for each length.
BRANCH, NODES, STEPS = 6, 400, 60_000


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram of lengths."""
    open_: dict[int, list[tuple[Filling, int]]] = defaultdict(list)  # by room left
    rooms = np.zeros(capacity + 1, bool)
    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                filling, times = open_[room].pop()
                rooms[room] = bool(open_[room])
                used = min(times, left)
                if used < times:
                    open_[room].append((filling, times - used))
                    rooms[room] = True
                new, to = (*filling, size), room - size
            else:
                each = capacity // size
                used = left // each if left >= each else 1
                new, to = (size,) * min(each, left), capacity - size * min(each, left)
            open_[to].append((new, used))
            rooms[to] = True
            left -= used if len(fits) else used * len(new)
    return [x for some in open_.values() for x in some]


def _spread(bits: int, reach: int) -> int:
    """Every set bit also set in the `reach` places above it."""
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        bits |= bits << step
        done += step
    return bits


def _dominated(chosen: Filling, waste: int, free: int) -> bool:
    """Whether one free length could stand for some of those chosen, being as long as their sum or longer, within the waste.

    free: a bit for each length of which a piece is left.
    """
    one, more = 0, 0  # sums of one length, and of several
    for x in chosen:
        more |= (one | more) << x
        one |= 1 << x
    better = _spread(more, waste)
    if waste:  # a single length, or none, gives way only to a longer one
        better |= _spread((one | 1) << 1, waste - 1)
    return bool(better & free)


def _fillings(counts: list[int], room: int, most: int, branch: int | None, nodes: int | None) -> list[Filling]:
    """Undominated fillings of a room that waste at most `most`, fullest first; all of them without budgets."""
    sizes = [x for x in range(1, min(room, len(counts) - 1) + 1) if counts[x]]
    mass, total = [0] * (room + 1), 0
    for x in range(1, room + 1):
        total += x * counts[x] if x < len(counts) else 0
        mass[x] = total
    all_ = sum(1 << x for x in range(1, len(counts)) if counts[x])
    mirror = sum(1 << room - x for x in sizes)
    used: Counter[int] = Counter()
    found: dict[Filling, int] = {}
    seen = exact = 0

    def note(chosen: Filling, waste: int) -> None:
        nonlocal exact
        if waste <= most and chosen not in found:
            free = all_
            for x, n in Counter(chosen).items():
                if counts[x] <= n:
                    free ^= 1 << x
            if not _dominated(chosen, waste, free):
                found[chosen] = waste
                exact += not waste

    def go(rest: int, top: int, chosen: Filling, free: int) -> None:
        """Adds lengths of at most top to what is chosen, in descending order."""
        nonlocal seen
        seen += 1
        fit = free & ((2 << min(rest, top)) - 1)
        if not fit:
            note(chosen, rest)
            return
        if nodes is not None:  # the fullest first: what one or two lengths fill exactly
            if fit >> rest & 1:
                note((*chosen, rest), 0)
            pair = fit & (mirror >> (room - rest))
            x = pair.bit_length() - 1
            if pair and counts[x] > used[x] and counts[rest - x] > used[rest - x] + (2 * x == rest):
                note((*chosen, *sorted((x, rest - x), reverse=True)), 0)
        while fit:
            x = fit.bit_length() - 1
            if rest - mass[x] > most or nodes is not None and seen > nodes or branch is not None and exact >= branch:
                return
            fit ^= 1 << x
            used[x] += 1
            go(rest - x, x, (*chosen, x), free if used[x] < counts[x] else free ^ (1 << x))
            used[x] -= 1

    go(room, room, (), all_)
    if not found and nodes is not None:  # too many short lengths for so few nodes
        rest, filling = room, ()
        for x in reversed(sizes):
            n = min(counts[x], rest // x)
            rest, filling = rest - n * x, filling + (x,) * n
        if rest <= most:
            found[filling] = rest
    return sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))[:branch]


class _Budget:
    """Counts choices; a search without one goes on until it is done."""

    def __init__(self, steps: int | None):
        self.steps = steps

    def spend(self) -> bool:
        if self.steps is None:
            return True
        self.steps -= 1
        return self.steps >= 0


def _complete(hist: dict[int, int], capacity: int, waste: int, branch: int | None, nodes: int | None, budget: _Budget) -> list[tuple[Filling, int]] | None:
    """Fillings that use every piece and waste at most so many tokens, or None if the search finds none.

    With a budget, a filling is used as often as there are pieces for it; without
    one, for one sequence at a time, so that nothing is left untried.
    """
    counts = [0] * (capacity + 1)
    for size, n in hist.items():
        counts[size] = n
    done: list[tuple[Filling, int]] = []
    options: list[list[Filling]] = []  # those not yet tried, of each open choice
    spent = 0
    while True:
        top = next((x for x in range(capacity, 0, -1) if counts[x]), 0)
        if not top:
            return done
        counts[top] -= 1
        # one more filling that wastes all may be the last
        choice = [(top, *f) for f in _fillings(counts, capacity - top, waste - spent, branch, nodes)]
        counts[top] += 1
        options.append(choice)
        while True:
            if not options or not budget.spend():
                return None
            if options[-1]:
                filling = options[-1].pop(0)
                need = Counter(filling)
                loss = capacity - sum(filling)
                times = int(min(counts[x] // n for x, n in need.items())) if budget.steps is not None else 1
                if loss:
                    times = min(times, (waste - spent) // loss)
                if times:
                    for x, n in need.items():
                        counts[x] -= n * times
                    spent += loss * times
                    done.append((filling, times))
                    break
            else:
                options.pop()
                if done:
                    filling, times = done.pop()
                    spent -= (capacity - sum(filling)) * times
                    for x, n in Counter(filling).items():
                        counts[x] += n * times


def solve(hist: dict[int, int], capacity: int, branch: int | None = BRANCH, nodes: int | None = NODES, steps: int | None = STEPS) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, in as few sequences as the search finds.

    With steps None the search is exhaustive whatever branch and nodes are, and
    the number of sequences the least there is; that takes time that grows
    exponentially with the number of sequences, where best fit misses the bound.
    """
    hist = {int(k): int(n) for k, n in hist.items() if n}
    total = sum(k * n for k, n in hist.items())
    incumbent = best_fit(hist, capacity)
    bins = sum(n for _, n in incumbent)
    bound = max(-(-total // capacity), sum(n for k, n in hist.items() if 2 * k > capacity))
    budget = _Budget(None if steps is None else steps + 2 * len(hist))
    if steps is None:
        branch = nodes = None
        sys.setrecursionlimit(max(sys.getrecursionlimit(), capacity + 1000))  # a call for each length of a filling
    # numbers of sequences to seek: each one, from the bound, or with ever longer strides while the budget lasts, and then between
    low, stride = bound, 0
    while low < bins:
        target = min(low + stride, bins - 1)
        better = _complete(hist, capacity, target * capacity - total, branch, nodes, budget)
        if better is not None:
            incumbent, bins, stride = better, sum(n for _, n in better), 0
            continue
        if budget.steps is not None and budget.steps < 0:
            break
        low, stride = target + 1, 0 if steps is None else 2 * stride + 1
    return incumbent


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text; other columns are ignored): doc_id, piece, start, length, ids_crc32, part, rank.

    A null text counts as empty; every document ends with end_id, so none is
    without a piece.  rank numbers the pieces of one length in one part.
    """

    shipped = Shipped(docs.sparkSession, vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = shipped.tokenizer(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            got, n = tok.encode(b.column(1))
            ends = np.cumsum(n + 1)
            ids = np.full(int(ends[-1]), end_id, "<u4")
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = got
            count = -(-(n + 1) // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, (n + 1)[row] - start)
            at = (ends - n - 1)[row] + start
            order = np.argsort(length, kind="stable")
            sizes, first, many = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(first, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            cuts = [ids[x : x + y] for x, y in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                columns.append(pa.array([c.tobytes() for c in cuts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids, tokens=True)


def places(solution: list[tuple[Filling, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each slot of a filling, ordered by length and by the number of its first piece: length, first, sequence, offset."""
    taken = np.zeros(capacity + 1, np.int64)
    slots, sequence = [], 0
    for filling, times in solution:
        offset = 0
        for size in filling:
            slots.append((size, int(taken[size]), sequence, offset))
            taken[size] += times
            offset += size
        sequence += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return tuple(table[:, i].copy() for i in range(4))


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False, branch: int | None = BRANCH, nodes: int | None = NODES, steps: int | None = STEPS) -> DataFrame:
    """The pieces of docs with sequence_id and offset; sequences hold at most capacity tokens, without gaps.

    Rows with equal doc_id are documents of their own.  An empty table has no
    pieces.  branch, nodes and steps: see solve.
    """
    cut = written(pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces")
    by_part = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    hist = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    size, first, sequence, offset = places(solve(hist, capacity, branch, nodes, steps), capacity)
    base = by_part.select("part", "length", F.expr("sum(n) over (partition by length order by part) - n").alias("base"))
    ranked = cut.join(small_or_shuffled(base, by_part.count()), ["part", "length"])
    # the slots of one length are together, ordered by first: keys of one search
    span = int(first.max()) + 2 + sum(hist.values()) if len(first) else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = size.astype(np.float64) * span + first if size.max(initial=0) * span > 1 << 62 else size * span + first
        for b in batches:
            length, n = b.column("length").to_numpy(), b.column("base").to_numpy() + b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + n, "right") - 1
            kept = [c for c in b.schema.names if c not in ("part", "rank", "base")]
            columns = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + n - first[at]), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    order = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "part", "rank", "base"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    return map_arrow(ranked.select(*order), place, schema)


__all__ = ["best_fit", "pack", "pieces", "places", "solve"]
