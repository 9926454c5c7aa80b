"""Best-fit packing by bin completion.

Pieces of equal length are interchangeable, so the search runs over a histogram with at most ``capacity``
entries, whatever the corpus' size: the driver sees counts by length and nothing else.  Each step fills the rest
of a sequence around the longest piece left, from undominated fillings only, and repeats that filling as often as
the counts allow, so the plan has at most one step for each length.  A depth-first search with a bound on total
waste tries other fillings; the best plan so far (at first best-fit decreasing) is the incumbent, and the
search ends when it meets the lower bound, or after ``budget`` fillings and search steps, several descents to a
complete plan (which limits the proof, not the pieces: every piece has its place in any plan).  Spark then ranks the pieces of each length and gives rank r its place
in the plan.

Defined results: a null text is an empty one and holds just the end id; documents longer than the capacity are
cut into pieces of the capacity, the last piece may be shorter; rows with equal doc_id are packed each on its
own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import materialize
from .text import slices
from .tokens import open_tokenizer

Filling = tuple[tuple[int, int], ...]
#: Fillings and search steps: so many for each distinct length, and at least so many.
DESCENTS, LEAST = 12, 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: total length, and Martello and Toth's bound over all thresholds."""
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n, best = counts[sizes], -(-int((sizes * counts[sizes]).sum()) // capacity)
    for k in {0, *sizes[sizes <= capacity // 2].tolist()}:
        large, mid, small = sizes > capacity - k, (sizes <= capacity - k) & (sizes > capacity // 2), (sizes <= capacity // 2) & (sizes >= k)
        room = int(n[mid].sum()) * capacity - int((sizes[mid] * n[mid]).sum())
        best = max(best, int(n[large].sum() + n[mid].sum()) + max(0, -(-(int((sizes[small] * n[small]).sum()) - room) // capacity)))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best fit over whole classes: sequences with equal contents are kept as one entry."""
    by_room: dict[int, dict[Filling, int]] = {}

    def put(room: int, filling: Filling, times: int) -> None:
        if times:
            here = by_room.setdefault(room, {})
            here[filling] = here.get(filling, 0) + times

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left and (fits := [r for r in by_room if r >= size]):
            room = min(fits)
            filling, times = by_room[room].popitem()
            if not by_room[room]:
                del by_room[room]
            k = min(room // size, left)
            use = min(times, left // k)
            put(room, filling, times - use)
            put(room - k * size, (*filling, (size, k)), use)
            left -= use * k
        k = min(capacity // size, left) if left else 1
        put(capacity - k * size, ((size, k),), left // k)
        if left % k:
            put(capacity - left % k * size, ((size, left % k),), 1)
    return [(f, n) for fs in by_room.values() for f, n in fs.items()]


def _fillings(room: int, counts: np.ndarray, waste: int, left: list[int]) -> Iterator[Filling]:
    """Undominated ways to fill ``room`` that leave at most ``waste``, least waste first, found one at a time.

    Larger pieces come first.  One piece that fills the room dominates everything, the longest piece that fits
    dominates whatever is no longer than it, and a filling is dominated if another one has the same number of pieces,
    each at least as long, or if one more piece fits in.  Exact pairs come by looking up complements; other fillings by
    a search that enters no branch whose total can't be met (sums of pieces as bits of one number, as if each length
    had any number of pieces).  ``counts`` must be the same at each step; ``left`` is what remains of the budget.
    """
    if room <= 0 or not counts[1 : room + 1].any():
        if room <= waste:
            yield ()
        return
    if counts[room]:
        yield ((room, 1),)
        return
    a = room
    while True:  # exact pairs, longest first; nothing large is kept between steps
        low = -(-room // 2)
        has = counts[low:a] > 0
        has &= counts[room - a + 1 : room - low + 1][::-1] > 0
        if room % 2 == 0 and a > low and counts[low] < 2:
            has[0] = False
        found = np.flatnonzero(has)
        if not len(found):
            break
        a = low + int(found[-1])
        yield ((a, 1), (room - a, 1)) if a * 2 != room else ((a, 2),)
    single = int(np.flatnonzero(counts[: room + 1])[-1])
    seen: list[list[int]] = []
    sizes: list[int] = []
    reach: list[int] = []

    def prepare() -> None:
        """reach[i]: bit t is set if pieces of sizes[i:] can add up to t."""
        sizes[:] = np.flatnonzero(counts[: room + 1])[::-1].tolist()
        bits, cut = 1, (1 << (room + 1)) - 1
        table = [bits]
        for s in reversed(sizes):
            step = s
            while step <= room:
                bits |= (bits << step) & cut
                step *= 2
            table.append(bits)
        reach[:] = reversed(table)

    prepare()
    for lost in range(min(waste, room - single) + 1):
        if not reach:
            prepare()
        if not reach[0] >> (room - lost) & 1:
            continue
        chosen: list[tuple[int, int]] = []  # place in sizes and number of pieces
        rest, at, most = room - lost, 0, room
        while True:
            if left[0] <= 0:
                return
            if not rest:
                own = {sizes[i]: k for i, k in chosen}
                flat = [s for s, k in own.items() for _ in range(k)]
                fits = any(counts[s] > own.get(s, 0) for s in range(1, lost + 1))
                if not fits and (lost or len(flat) != 2) and not any(len(o) == len(flat) and all(x <= y for x, y in zip(flat, o)) for o in seen):
                    seen.append(flat)
                    sizes.clear()
                    reach.clear()
                    yield tuple(own.items())
                    prepare()
                at = len(sizes)
            else:
                left[0] -= 1
                at = max(at, bisect_left(sizes, -rest, key=lambda s: -s))
            k = 0
            while at < len(sizes):  # as many of the longest as the rest allows, then fewer
                k = min(most, int(counts[sizes[at]]), rest // sizes[at])
                while k and not reach[at + 1] >> (rest - k * sizes[at]) & 1:
                    k -= 1
                if k or not reach[at + 1] >> rest & 1:
                    break
                at, most = at + 1, room
            if k:
                chosen.append((at, k))
                rest -= k * sizes[at]
                at, most = at + 1, room
            elif chosen:
                at, k = chosen.pop()
                rest += k * sizes[at]
                most = k - 1
            else:
                break


def fillings(room: int, counts: np.ndarray, waste: int) -> list[Filling]:
    """All of them at once."""
    return list(_fillings(room, counts, waste, [1 << 62]))


def bin_completion(counts: np.ndarray, capacity: int, budget: int | None = None) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences have each; ``counts`` by length, from 0 to the capacity.

    ``budget`` counts fillings tried and steps of the search for them; by default it is DESCENTS times the number of
    distinct lengths and at least LEAST, as one descent to a complete plan takes little more than a filling for each.
    """
    counts = np.asarray(counts, np.int64).copy()
    bound, total = lower_bound(counts, capacity), int((np.arange(len(counts)) * counts).sum())
    best = best_fit_decreasing(counts, capacity)
    if not total or sum(n for _, n in best) == bound:
        return best
    left = [max(LEAST, DESCENTS * np.count_nonzero(counts)) if budget is None else budget]
    path: list[tuple[Filling, int, int]] = []  # filling, times, waste of each step
    least, lost_so_far = sum(n for _, n in best), 0

    def waste_left() -> int:
        """What may still be lost if the plan is to beat the incumbent."""
        return (least - 1) * capacity - total - lost_so_far

    def choices() -> tuple[int, Iterator[Filling]]:
        large = int(np.flatnonzero(counts)[-1])
        return large, _fillings(capacity - large, counts, max(0, waste_left()), left)

    stack = [choices()]
    while stack and left[0] > 0:
        large, more = stack[-1]
        counts[large] -= 1
        rest = next(more, None)
        counts[large] += 1
        left[0] -= 1
        if rest is None:
            stack.pop()
            if path:
                f, times, lost = path.pop()
                lost_so_far -= lost
                for s, k in f:
                    counts[s] += k * times
            continue
        need = dict(rest)
        need[large] = need.get(large, 0) + 1
        lost = capacity - sum(s * k for s, k in need.items())
        times = min(int(counts[s]) // k for s, k in need.items())
        if lost:
            times = min(times, max(1, waste_left() // lost))
        if times < 1 or lost * times > waste_left():
            continue
        step = tuple(sorted(need.items(), reverse=True))
        for s, k in step:
            counts[s] -= k * times
        path.append((step, times, lost * times))
        lost_so_far += lost * times
        if not counts.any():
            best = [(f, n) for f, n, _ in path]
            least = sum(n for _, n in best)
            if least == bound:
                break
            f, n, lost = path.pop()
            lost_so_far -= lost
            for s, k in f:
                counts[s] += k * n
        else:
            stack.append(choices())
    return best


def cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of all documents, with the checksum of their ids."""
    tokens = open_tokenizer(tokenizer)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, at = tokens.encode(part.column("text"))
            rows: list[tuple] = []
            for d, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for i, s in enumerate(range(0, len(own), capacity)):
                    x = own[s : s + capacity]
                    rows.append((d, i, s, len(x), zlib.crc32(x.tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit_packing(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = 4096, budget: int | None = None) -> DataFrame:
    """Each piece of each document with its sequence and its place there."""
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(lambda it: cut(it, tokenizer, end_id, capacity), PIECES))
    found = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    # Of each length: ranks from .. on go to sequences base, base+1, .., each with k pieces from offset on.
    taken, base, places = np.zeros(capacity + 1, np.int64), 0, []
    for filling, times in bin_completion(counts, capacity, budget):
        offset = 0
        for size, k in filling:
            places.append((size, taken[size], base, k, offset))
            taken[size] += k * times
            offset += size * k
        base += times
    if (taken != counts).any():
        raise RuntimeError("the plan doesn't hold every piece once")
    plan = np.array(sorted(places) or [(0, 0, 0, 1, 0)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, begin, first, k, offset = plan[np.searchsorted(key, (size << 48) + rank, "right") - 1].T
            nth = rank - begin
            own = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*own, pa.array(first + nth // k), pa.array(offset + nth % k * size)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Ranks without gathering a length in one task: count by part, add up the parts before, rank inside each part.
    parts = max(1, -(-int(counts.sum()) // 20_000))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sums = dealt.groupBy("length", "part").count()
    before = sums.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("nth", nth).join(before, ["length", "part"]).withColumn("rank", (F.col("before") + F.col("nth")).cast("long")).drop("before", "nth", "part")
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
