"""Best-fit packing by bin completion: branch and bound over fillings of the sequence with the largest document.

Only lengths matter, so the search works on their counts: at most one number per length, whatever the corpus. The
largest length left is completed by the fillings that no single length left dominates (put in the place of items that are
together no longer), best fit first; the rest is packed likewise under a bound on the sequences it needs, with best-fit
packings of all that is left as incumbents. The search is bounded, see ``plan``.

Documents then find their places without being gathered: a document's number within its length, in gapless
numbers, falls into one of the filling runs, which are at most a few thousand rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.byte_bpe import rank_tokenizer
from lariat.llm.common import configure, map_batches, numbered, texts_of

Run = tuple[tuple[int, ...], int]


def _bound(left: list[int], capacity: int) -> int:
    """Sequences that any packing of what is left needs: Martello and Toth's bound, the most over all thresholds.

    Lengths over a half need a sequence each; shorter ones, from a threshold on, go beside those they fit or need more.
    """
    n = np.asarray(left, np.int64)
    items, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    at = np.arange(half + 1)
    many, beside = items[capacity] - items[half], tokens[capacity - at] - tokens[half]
    room = (items[capacity - at] - items[half]) * capacity - beside
    short = tokens[half] - tokens[np.maximum(at - 1, 0)]
    return int((many + np.maximum(0, -((room - short) // capacity))).max())


def _best_fit(left: list[int], capacity: int) -> list[Run]:
    """Best-fit decreasing, over counts: each item goes where the least room that holds it is left."""
    rooms: list[int] = []
    open_: dict[int, list[Run]] = {}

    def put(filling: tuple[int, ...], room: int, uses: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((filling, uses))

    for x in range(capacity, 0, -1):
        n = left[x]
        while n:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                filling, uses = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, filling, uses = capacity, (), n
            k = room // x
            whole = min(uses, n // k)
            if whole:
                put((*filling, *(x,) * k), room - k * x, whole)
                n, uses = n - whole * k, uses - whole
            if uses and n:
                put((*filling, *(x,) * n), room - n * x, 1)
                n, uses = 0, uses - 1
            if uses and filling:
                put(filling, room, uses)
    return [run for room in rooms for run in open_[room]]


def _dominated(filling: tuple[int, ...], waste: int, left: list[int], some: int) -> bool:
    """Whether a length that is left over could take the place of none, one or several items of a filling.

    It must fit in their place and be no shorter than they are together. Sums of items and lengths left are bits.
    """
    for y in set(filling):
        if left[y] == filling.count(y):
            some &= ~(1 << y)
    sums, below = 1, 0
    for y in (*sorted(set(filling)), 0):
        near, have = sums, 0
        while have < waste:
            step = min(have + 1, waste - have)
            near |= near << step
            have += step
        # Lengths up to y take the place of shorter items only.
        longer = some >> below + 1 << below + 1
        if near & (longer & (2 << y) - 1 if y else longer):
            return True
        for _ in range(filling.count(y) if y else 0):
            sums |= sums << y
        below = y
    return False


def _completions(room: int, left: list[int], most: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, fullest first, out of the first ``most`` to which no length left can be added.

    Bits tell which sums the shorter lengths can make, so that only fillings of a wanted sum are walked through: the
    fullest ones first, and of those the ones with most of the longest lengths. At most 20 * most steps are walked.
    """
    lengths = [x for x in range(1, room + 1) if left[x]]
    sums, mask = [1], (2 << room) - 1
    for x in lengths:
        made, n, k = sums[-1], min(left[x], room // x), 1
        while n:
            made |= made << min(k, n) * x
            n, k = n - min(k, n), 2 * k
        sums.append(made & mask)
    found: list[tuple[int, tuple[int, ...]]] = []
    walked = 0
    for waste in range(room + 1):
        if not sums[-1] >> room - waste & 1:
            continue
        stack: list[tuple[int, int, tuple[int, ...]]] = [(len(lengths), room - waste, ())]
        while stack and len(found) < most and walked < 20 * most:
            end, rest, taken = stack.pop()
            walked += 1
            if rest == 0:
                if not any(left[y] > taken.count(y) for y in lengths[: bisect_right(lengths, waste)]):
                    found.append((waste, taken))
                continue
            at = bisect_right(lengths, rest, 0, end) - 1
            x = lengths[at]
            for k in range(min(rest // x, left[x]) + 1):
                if sums[at] >> rest - k * x & 1:
                    stack.append((at, rest - k * x, (*taken, *(x,) * k)))
        if len(found) >= most or walked >= 20 * most:
            break
    found.sort(key=lambda f: (f[0], len(f[1]), tuple(-x for x in f[1])))
    some = sum(1 << x for x in lengths)
    return [f for free, f in found if not _dominated(f, free, left, some)] or ([found[0][1]] if found else [()])


def _branches(left: list[int], capacity: int, most: int) -> Iterator[Run]:
    """What the sequences of the largest length left may hold: each filling as often as the counts allow, then once."""
    largest = max(x for x, n in enumerate(left) if n)
    left[largest] -= 1
    fills = [(largest, *f) for f in _completions(capacity - largest, left, most)]
    left[largest] += 1
    uses = [min(left[x] // f.count(x) for x in set(f)) for f in fills]
    yield from zip(fills, uses)
    yield from ((f, 1) for f, n in zip(fills, uses) if n > 1)


def plan(counts: dict[int, int], capacity: int, nodes: int = 2000, most: int = 200) -> list[Run]:
    """Fillings and how often each is used; together they use every length as often as ``counts`` says.

    The sequences of the largest length left are filled in each way that may be needed, and the rest likewise, to any
    depth. A branch is cut where the sequences so far and the bound on those of the rest aren't fewer than the incumbent's,
    or where the same rest came up before after as few. At each branch, its sequences and a best-fit packing of the rest may
    become the incumbent. The search ends when the incumbent meets the bound of the whole, and else after ``nodes``
    branches beyond its first way down; ``most`` bounds the fillings looked at for one branch. Only where either runs out
    may a packing in fewer sequences be missed. Lengths over ``capacity`` or under 1 are refused.
    """
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    left = [0] * (capacity + 1)
    for x, n in counts.items():
        left[x] = max(int(n), 0)
    need, best = _bound(left, capacity), _best_fit(left, capacity)
    fewest = sum(uses for _, uses in best)
    if fewest == need:
        return best
    path: list[Run] = []
    used, first, seen = 0, True, {}
    stack = [_branches(left, capacity, most)]

    def use(run: Run, sign: int) -> None:
        for x in run[0]:
            left[x] -= sign * run[1]

    while stack and nodes > 0:
        run = next(stack[-1], None)
        if run is None:
            first = False
            stack.pop()
            if path:
                run = path.pop()
                use(run, -1)
                used -= run[1]
            continue
        nodes -= not first
        use(run, 1)
        path.append(run)
        used += run[1]
        rest = hashlib.blake2b(np.asarray(left, np.int64).tobytes(), digest_size=16).digest()
        if used + _bound(left, capacity) < fewest and used < seen.get(rest, used + 1):
            seen[rest] = used
            tail = _best_fit(left, capacity)
            n = used + sum(uses for _, uses in tail)
            if n < fewest:
                best, fewest = [*path, *tail], n
                if fewest == need:
                    break
            # Where the packing of the rest meets its own bound, nothing below is better.
            if used + _bound(left, capacity) < fewest:
                stack.append(_branches(left, capacity, most))
                continue
        first = False
        path.pop()
        use(run, -1)
        used -= run[1]
    return best


def pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text as ids and an end id, long ones cut.

    A document of more than ``capacity`` ids is cut into pieces of that length, of which the first may be shorter.
    Null and empty texts have the end id alone. Every row of docs is packed, repeated rows and null ids too.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        model = rank_tokenizer(tokenizer, ranks, pattern)
        at, rows = [], []
        for i, text in enumerate(texts_of(b.column("_text"))):
            ids = np.append(model.encode(text), np.uint32(end)).astype("<u4")
            first = len(ids) % capacity or min(capacity, len(ids))
            raw = ids.tobytes()
            for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                stop = first if k == 0 else start + capacity
                at.append(i)
                rows.append((k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
        n = np.array(rows, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n[:, 0].astype(np.int32)), pa.array(n[:, 1]), pa.array(n[:, 2]), pa.array(n[:, 3])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(narrow, cut, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to capacity, in as few sequences as the search finds.

    Only the counts by length come to the driver (at most ``capacity`` rows) and only the filling runs go out: each run
    leaves fewer of a length than one filling takes, so there are a few for each length. An empty table gives no rows.
    """
    spark = items.sparkSession
    configure(spark)
    ranked = numbered(items, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    counts = {int(r["length"]): int(r["count"]) for r in ranked.groupBy("length").count().collect()}
    used, places, sequence = dict.fromkeys(counts, 0), [], 0
    for filling, uses in plan(counts, capacity):
        offset = 0
        for x in sorted(set(filling), reverse=True):
            k = filling.count(x)
            places.append((x, used[x], used[x] + k * uses, k, sequence, offset))
            used[x] += k * uses
            offset += k * x
        sequence += uses
    runs = spark.createDataFrame(places or [(0, 0, 0, 1, 0, 0)], "_length long, _from long, _to long, _k long, _sequence long, _offset long")
    inside = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    nth = F.col("rank") - F.col("_from")
    placed = ranked.join(F.broadcast(runs), inside).withColumn("sequence_id", F.col("_sequence") + F.expr("(rank - _from) div _k")).withColumn("offset", F.col("_offset") + nth % F.col("_k") * F.col("length"))
    return placed.drop("rank", *[c for c in placed.columns if c.startswith("_")])
