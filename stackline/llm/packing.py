"""Best-fit packing of token sequences by bin completion branch-and-bound on the histogram of lengths.

Lengths are whole numbers up to the sequence length, so however many documents there are,
their histogram has at most that many rows. It alone reaches the driver, where the search
runs on it. Best fit decreasing, and fillings of least waste taken greedily, are the first
incumbents. Where none meets the lower bound, bin completion follows: around the longest open
length, the fillings of the rest that no other filling dominates (Martello and Toth) are
enumerated from the least waste up, each is used as often as its lengths last or less often,
and a branch ends when its waste exceeds what any better packing may waste, when its open
lengths were met before with as few sequences, or when the lower bound of the rest leaves no
gain. The search goes back over all choices until ``NODES`` fillings were looked at or ``VISITS``
lengths visited, and then ends with the best packing so far; ``Packing.proven``
says whether the packing is known to have the fewest sequences. Pieces then find their place by
their rank among equal lengths.

Defined cases: a null or empty text is the end token alone; pieces of equal length are
interchangeable, so repeated rows are packed each; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackline.llm.ranking import ranked
from stackline.llm.staging import staged
from stackline.llm.tokens import KEPT, ChunkTokens

SEQUENCE = 2048
END_ID = 0
#: Branches tried for one filling of a greedy incumbent before the exact subset sum decides.
BRANCHES = 2000
#: Fillings that the search over packings looks at before it ends with the best one so far.
NODES = 20_000
#: Lengths visited by the search, all nodes together: its time on histograms of many lengths.
VISITS = 6_000_000


def pieces(documents: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """Each document's ids and end token, cut only where longer than a sequence; the first piece is the shorter one."""
    kind = documents.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkTokens.of(tokenizer, kept)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.ids(b.column(1))):
                data = ids + end
                n = len(data) // 4
                edges = [0, *range(n % size or size, n + 1, size)]
                for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                    at.append(row), piece.append(k), start.append(i), length.append(j - i), crc.append(zlib.crc32(data[4 * i : 4 * j]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(room: int, left: dict[int, int], lengths: list[int]) -> list[int]:
    """Lengths, longest first, with the greatest sum up to ``room``, of few short ones; exact."""
    whole = (1 << (room + 1)) - 1
    reach = [1]  # bit s: sums s of the lengths so far
    for n in lengths:
        sums, copies, step = reach[-1], min(left[n], room // n), 1
        while copies > 0:
            step = min(step, copies)
            sums |= (sums << (n * step)) & whole
            copies, step = copies - step, 2 * step
        reach.append(sums)
        if sums >> room:
            break
    total, out = reach[-1].bit_length() - 1, []
    for n, before in zip(reversed(lengths[: len(reach) - 1]), reversed(reach[:-1]), strict=True):
        while not before >> total & 1:
            out.append(n)
            total -= n
    return out[::-1]


def filling(room: int, left: dict[int, int], lengths: list[int], branches: int = BRANCHES, exact: bool = True) -> list[int]:
    """Lengths, longest first, that fill ``room``, each at most ``left`` times; with ``exact`` no others waste less."""
    best: list[int] = []
    rest = room
    for n in lengths:  # incumbent: what fits best, again and again
        while n <= rest and left[n] > best.count(n):
            best.append(n)
            rest -= n
    if not rest:
        return best
    waste, tried, shortest = rest, 0, lengths[-1] if lengths else room + 1
    stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
    while stack and tried < branches and waste:
        at, free, chosen = stack.pop()
        tried += 1
        if free < waste:
            waste, best = free, chosen
        # A filling with room for the shortest open length is dominated by the one that holds it too.
        if free < shortest or not waste:
            continue
        nexts = []
        i = at
        while i < len(lengths) and len(nexts) < 12:
            n = lengths[i]
            if n <= free and left[n] > chosen.count(n):
                nexts.append((i, free - n, [*chosen, n]))
            i += 1
        if left.get(free, 0) > chosen.count(free):
            return [*chosen, free]
        stack += reversed(nexts)
    if exact and waste and sum(full := fullest(room, left, lengths)) > room - waste:
        return full
    return best


Plan = list[tuple[list[int], int]]


def greedy(histogram: dict[int, int], size: int = SEQUENCE, branches: int = BRANCHES, exact: bool = True) -> Plan:
    """(lengths in one sequence, number of such sequences): around the longest open length a good filling, as often as it lasts."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        lengths = [n for n in sorted(left, reverse=True) if left[n] and n <= size - longest]
        chosen = [longest, *filling(size - longest, left, lengths, branches, exact)]
        left[longest] += 1
        uses = {n: chosen.count(n) for n in chosen}
        times = min(left[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((chosen, times))
    return out


def best_fit(histogram: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Best fit decreasing on counts: sequences of equal contents are one entry."""
    rooms, by_room = [], {}  # sorted rooms, and per room its (contents, count)

    def put(room: int, chosen: list[int], count: int) -> None:
        if room not in by_room:
            rooms.insert(bisect_left(rooms, room), room)
        by_room.setdefault(room, []).append((chosen, count))

    for n in sorted(histogram, reverse=True):
        c = histogram[n]
        while c > 0:
            at = bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else size
            if at == len(rooms):
                put(size, [], -(-c // (size // n)))
            chosen, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.remove(room)
            # a sequence that took one stays the tightest, so it takes all that fit
            each = min(room // n, c)
            times = min(count, c // each)
            put(room - each * n, [*chosen, *[n] * each], times)
            if count > times:
                put(room, chosen, count - times)
            c -= each * times
    return [(chosen, count) for groups in by_room.values() for chosen, count in groups if chosen]


def lower_bound(histogram: dict[int, int], size: int = SEQUENCE) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    lengths = sorted(n for n, c in histogram.items() if c > 0)
    if not lengths:
        return 0
    count = np.array([histogram[n] for n in lengths], np.int64)
    n = np.array(lengths, np.int64)
    pieces, tokens = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * n)))
    half = np.searchsorted(n, size // 2, "right")
    large, large_tokens = pieces[-1] - pieces[half], tokens[-1] - tokens[half]
    k = np.concatenate(([0], n[:half]))
    alone = np.searchsorted(n, size - k, "right")  # above size - k: no room for k
    low = np.searchsorted(n, k)
    # sequences of a large piece that still have room for k or more; pieces from k to the half fill them first
    room = (pieces[alone] - pieces[half]) * size - (tokens[alone] - tokens[half])
    more = -((room - (tokens[half] - tokens[low])) // size)
    return int(max(-(-tokens[-1] // size), (large + np.maximum(0, more)).max(), -(-large_tokens // size)))


def completions(left: dict[int, int], lengths: list[int], room: int, most_waste: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of ``room``, longest lengths first, from the least waste up; None for each dominated one.

    lengths: the open ones, longest first. A filling is dominated where an open length left out
    could take the place of a shorter one, or of two or more that together are no longer.
    """
    reach = [1]  # bit s: sums s of the shorter lengths
    whole = (1 << (room + 1)) - 1
    for n in reversed(lengths):
        sums, copies, step = reach[-1], min(left[n], room // n), 1
        while copies > 0:
            step = min(step, copies)
            sums |= (sums << (n * step)) & whole
            copies, step = copies - step, 2 * step
        reach.append(sums)
    reach.reverse()

    def with_sum(i: int, target: int) -> Iterator[tuple[int, ...]]:
        if not target:
            yield ()
            return
        while i < len(lengths) and reach[i] >> target & 1:
            n = lengths[i]
            for k in range(min(left[n], target // n), 0, -1):
                if reach[i + 1] >> (target - k * n) & 1:
                    for rest in with_sum(i + 1, target - k * n):
                        yield (*[n] * k, *rest)
            i += 1

    for waste in range(min(most_waste, room) + 1):
        if reach[0] >> (room - waste) & 1:
            for chosen in with_sum(0, room - waste):
                yield None if dominated(chosen, left, lengths, waste) else chosen


def dominated(chosen: tuple[int, ...], left: dict[int, int], lengths: list[int], waste: int) -> bool:
    one, several = 0, 0  # bit s: a length s of the filling; a sum s of two or more
    for n in chosen:
        several |= ((one | several) << n)
        one |= 1 << n
    near = (1 << (waste + 1)) - 1
    for x in lengths:
        if left[x] <= chosen.count(x):
            continue
        # it may be longer than what it replaces by the waste at most
        if x <= waste or (one & ~(1 << x) | several) >> (x - waste) & near:
            return True
    return False


@dataclass(frozen=True)
class Packing:
    """A plan, its number of sequences, the lower bound, and whether the search proved that no plan has fewer."""

    plan: Plan
    sequences: int
    bound: int
    proven: bool


def search(histogram: dict[int, int], incumbent: Plan, size: int = SEQUENCE, nodes: int = NODES, visits: int = VISITS) -> Packing:
    """Depth first over (filling of the longest open length, times), with the waste that a better packing may have as bound."""
    left = {n: c for n, c in histogram.items() if c > 0}
    best, fewest, bound = incumbent, sum(t for _, t in incumbent), lower_bound(left, size)
    total = sum(n * c for n, c in left.items())
    # A state is the sum of a 128-bit digest for each open piece, so two different ones agree with a chance of about 2^-128.
    keys = {n: int.from_bytes(hashlib.blake2b(n.to_bytes(8, "big"), digest_size=16).digest(), "big") for n in left}
    state, met = sum(keys[n] * c for n, c in left.items()), {}

    def fillings(allowed: int) -> Iterator[tuple[list[int], int] | None]:
        """(filling with the longest open length, times), best first; None where nothing came of a look."""
        nonlocal visits
        longest = max(left)
        lengths = [n for n in sorted(left, reverse=True) if n <= size - longest and left[n] > (n == longest)]
        visits -= len(left) + len(lengths)
        left[longest] -= 1
        found = completions(left, lengths, size - longest, allowed)
        left[longest] += 1
        while True:
            left[longest] -= 1  # the generator reads what is open without the longest itself
            chosen = next(found, False)
            left[longest] += 1
            if chosen is False:
                return
            if chosen is None:
                yield None
                continue
            whole = [longest, *chosen]
            waste = size - sum(whole)
            times = min(left[n] // whole.count(n) for n in set(whole))
            if waste:
                times = min(times, allowed // waste)
            for t in range(times, 0, -1):
                yield whole, t

    # (fillings still to try, sequences, waste); ``taken`` holds the choices that led to each but the first
    stack = [(fillings((fewest - 1) * size - total), 0, 0)] if left and fewest > bound else []
    taken: Plan = []
    while stack and nodes > 0 and visits > 0 and fewest > bound:
        tries, used, waste = stack[-1]
        nodes -= 1
        allowed = (fewest - 1) * size - total
        choice = next(tries, ()) if waste <= allowed else ()
        if choice is None:
            continue
        if choice == ():
            stack.pop()
            if taken:
                chosen, times = taken.pop()
                for n in chosen:
                    left[n] = left.get(n, 0) + times
                    state += keys[n] * times
            continue
        chosen, times = choice
        spent = waste + times * (size - sum(chosen))
        if spent > allowed:
            continue
        for n in chosen:
            left[n] -= times
            state -= keys[n] * times
            if not left[n]:
                del left[n]
        taken.append((chosen, times))
        now = used + times
        dead = met.get(state, fewest) <= now
        if not left and now < fewest:
            best, fewest = list(taken), now
        elif left and not dead and len(left) <= 64:
            dead = now + lower_bound(left, size) >= fewest
        met[state] = min(now, met.get(state, now))
        stack.append((iter(()) if dead or not left else fillings((fewest - 1) * size - total - spent), now, spent))
    return Packing(best, fewest, bound, fewest == bound or not stack)


def plan(histogram: dict[int, int], size: int = SEQUENCE, nodes: int = NODES) -> Plan:
    """(lengths in one sequence, number of such sequences) for all pieces of a histogram of lengths."""
    return packing(histogram, size, nodes).plan


def packing(histogram: dict[int, int], size: int = SEQUENCE, nodes: int = NODES) -> Packing:
    """The best incumbent, improved by the search where it doesn't meet the lower bound."""
    count = lambda x: sum(times for _, times in x)
    best, bound = best_fit(histogram, size), lower_bound(histogram, size)
    for branches, exact in ((BRANCHES, True), (BRANCHES, False)):
        if count(best) > bound:
            best = min(best, greedy(histogram, size, branches, exact), key=count)
    return search(histogram, best, size, nodes)


def slots(planned: Plan) -> dict[int, np.ndarray]:
    """Per length the runs of ranks as rows (first rank, first sequence, offset), by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for chosen, times in planned:
        offset = 0
        for n in chosen:
            runs.setdefault(n, []).append((used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        first += times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def pack(pieces_table: DataFrame, size: int = SEQUENCE, nodes: int = NODES) -> DataFrame:
    """Pieces with sequence_id and offset; ``pieces_table`` should be staged, as it is read three times."""
    spark = pieces_table.sparkSession
    # At most ``size`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in pieces_table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    planned = plan(histogram, size, nodes)
    runs = spark.sparkContext.broadcast(slots(planned))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["_rank"].to_numpy()
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n in np.unique(length):
                at, table = np.flatnonzero(length == n), runs.value[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                seq[at], off[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            f = f.drop(columns="_rank")
            f["sequence_id"], f["offset"] = seq, off
            yield f

    schema = T.StructType([*pieces_table.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    with_rank = ranked(pieces_table, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    return with_rank.select(*pieces_table.columns, "_rank").mapInPandas(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, kept: int = KEPT) -> DataFrame:
    """All documents' pieces, each with its place. kept: chunks that a worker keeps the ids of; memory for time, results don't depend on it."""
    return pack(staged(pieces(documents, tokenizer, size, end_id, kept=kept), "pieces"), size)
