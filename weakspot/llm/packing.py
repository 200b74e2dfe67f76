"""Best-fit packing by a grouping genetic algorithm.

What has to be packed is known by how many pieces there are of each length, at most `capacity` numbers whatever the corpus's
size. A solution is a list of groups: a bin's contents (lengths and how often) and how many such bins there are, so its size
doesn't grow with the corpus either. Islands evolve solutions as Spark tasks:

* the first solutions come from best fit, with the order of lengths disturbed, and from filling one bin after the other as
  full as any choice of the pieces left allows;
* crossover injects whole well-filled groups of one parent into the other, drops groups whose pieces are gone by then
  (duplicates), and packs the displaced pieces by best fit;
* mutation empties the worst-filled bins and some others and packs their pieces, fullest bin first;
* after each epoch the islands' elites migrate to all islands.

The search ends where a solution meets `lower_bound`, as no packing can have fewer bins.

The best solution is dealt to the pieces by their rank among those of the same length.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, chunks, id_and_text, materialize
from .tokens import CACHE, encoder

CAPACITY, END = 1024, 2
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4, 3, 6, 60
#: Bins that a mutation empties.
EMPTIED = 40


def best_fit(counts: dict[int, int], capacity: int, dice: random.Random | None = None, groups: list | tuple = ()) -> list:
    """Groups (contents, bins) that hold all pieces: longest first, each into the open bin that it fills best, else a new one.

    Equal bins are filled together: bins of space s take s // x pieces of length x each, as they would one by one. `groups`
    are bins to start from; with `dice` the order of lengths is disturbed a little.
    """
    open_bins: dict[int, list] = {}
    spaces: list[int] = []
    full: list = []

    def keep(contents: tuple, n: int, space: int) -> None:
        if not space:
            full.append((contents, n))
        elif space in open_bins:
            open_bins[space].append((contents, n))
        else:
            open_bins[space] = [(contents, n)]
            bisect.insort(spaces, space)

    for contents, n in groups:
        keep(contents, n, capacity - sum(x * k for x, k in contents))
    for x in sorted(counts, key=lambda x: x * (1 + 0.1 * dice.random() if dice else 1), reverse=True):
        left = counts[x]
        while left:
            at = bisect.bisect_left(spaces, x)
            space = spaces[at] if at < len(spaces) else capacity
            k = min(space // x, left)
            m = left // k
            if at < len(spaces):
                contents, n = open_bins[space].pop()
                m = min(m, n)
                if m < n:
                    open_bins[space].append((contents, n - m))
                elif not open_bins[space]:
                    del open_bins[space], spaces[at]
                contents = dict(contents)
                contents[x] = contents.get(x, 0) + k
                contents = tuple(sorted(contents.items(), reverse=True))
            else:
                contents = ((x, k),)
            keep(contents, m, space - k * x)
            left -= m * k
    return full + [g for gs in open_bins.values() for g in gs]


def bins(groups) -> int:
    return sum(n for _, n in groups)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that every packing needs: by the sum, and by the pieces that can't share a bin with one of at least t (Martello
    and Toth), for each t up to half a bin."""
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    for t in range(1, capacity // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > capacity - t)
        large = sum(n for x, n in counts.items() if capacity - t >= x > capacity // 2)
        room = sum((capacity - x) * n for x, n in counts.items() if capacity - t >= x > capacity // 2)
        small = sum(x * n for x, n in counts.items() if capacity // 2 >= x >= t)
        least = max(least, alone + large + max(0, -(-(small - room) // capacity)))
    return least


def fullest(left: dict[int, int], space: int, dice: random.Random | None = None) -> dict[int, int]:
    """Pieces of those left that fill the space as far as any choice does: subset sums as bits, walked back by length."""
    lengths = [x for x in sorted(left, reverse=True) if x <= space and left[x]]
    if dice:
        lengths.sort(key=lambda x: x * (1 + 0.2 * dice.random()), reverse=True)
    reached, steps, mask = 1, [], (1 << space + 1) - 1
    for x in lengths:
        k, most = 1, min(left[x], space // x)
        while most:  # 1, 2, 4, .. pieces and the rest
            k = min(k, most)
            steps.append((reached, x, k))
            reached |= reached << k * x & mask
            most -= k
            k *= 2
        if reached >> space & 1:
            break
    total = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, x, k in reversed(steps):
        if not before >> total & 1:
            chosen[x] = chosen.get(x, 0) + k
            total -= k * x
    return chosen


def fill_bins(counts: dict[int, int], capacity: int, dice: random.Random | None = None) -> list:
    """Groups (contents, bins): the largest piece left with the pieces that fill its bin best, as often as these are there."""
    left, groups = {x: n for x, n in counts.items() if n}, []
    while left:
        x = max(left)
        left[x] -= 1
        chosen = fullest(left, capacity - x, dice)
        left[x] += 1
        chosen[x] = chosen.get(x, 0) + 1
        n = min(left[y] // k for y, k in chosen.items())
        groups.append((tuple(sorted(chosen.items(), reverse=True)), n))
        for y, k in chosen.items():
            left[y] -= n * k
            if not left[y]:
                del left[y]
    return groups


def fitness(groups, capacity: int) -> tuple:
    """Fewer bins first, then bins filled more unevenly, which leaves room to fill."""
    return -bins(groups), sum(n * (sum(x * k for x, k in c) / capacity) ** 2 for c, n in groups)


def mutate(groups, capacity: int, dice: random.Random) -> list:
    """The worst-filled bins and as many others emptied and packed anew."""
    fill = lambda g: sum(x * k for x, k in g[0])
    by, kept, pieces = sorted(groups, key=fill), [], {}
    worst = dice.randint(1, EMPTIED // 2)
    others = {dice.randrange(len(by)) for _ in range(dice.randint(1, EMPTIED // 2))}
    for i, (contents, n) in enumerate(by):
        gone = min(n, worst) + (1 if i in others and n > worst else 0)
        worst -= min(n, worst)
        for x, k in contents:
            pieces[x] = pieces.get(x, 0) + k * gone
        if n > gone:
            kept.append((contents, n - gone))
    return merged(kept + fill_bins(pieces, capacity, dice))


def merged(groups) -> list:
    out: dict = {}
    for contents, n in groups:
        out[contents] = out.get(contents, 0) + n
    return list(out.items())


def crossover(one, two, counts: dict[int, int], capacity: int, dice: random.Random) -> list:
    fill = lambda g: sum(x * k for x, k in g[0])
    left, child = dict(counts), []

    def put(contents, n):
        n = min([n, *(left.get(x, 0) // k for x, k in contents)])
        if n:
            child.append((contents, n))
            for x, k in contents:
                left[x] -= n * k

    full = [g for g in two if fill(g) == capacity] or sorted(two, key=fill)[-max(1, len(two) // 2) :]
    for contents, n in dice.sample(full, max(1, len(full) // 2)):
        put(contents, n)
    rest = [g for g in one if fill(g) >= capacity - 1]
    dice.shuffle(rest)
    for contents, n in rest[: max(1, len(rest) * 3 // 4)]:
        put(contents, n)
    child = best_fit({x: n for x, n in left.items() if n}, capacity, dice if dice.random() < 0.5 else None, child)
    return merged(child)


def evolve(counts: dict[int, int], capacity: int, seed: int, elites: list, population: int = POPULATION, generations: int = GENERATIONS) -> list:
    """One island's best solution."""
    dice = random.Random(seed)
    least = lower_bound(counts, capacity)
    score = lambda g: fitness(g, capacity)
    people = list(elites) or [best_fit(counts, capacity)]
    if not elites and bins(people[0]) > least:
        people.append(fill_bins(counts, capacity, dice if seed else None))
    while len(people) < population and bins(max(people, key=score)) > least:
        people.append(best_fit(counts, capacity, dice))
    for _ in range(generations):
        people.sort(key=score, reverse=True)
        people = people[:population]
        if bins(people[0]) <= least:
            break
        one, two = (max(dice.sample(people, min(2, len(people))), key=score) for _ in range(2))
        people.append(crossover(one, two, counts, capacity, dice))
        people.append(mutate(max(dice.sample(people, min(2, len(people))), key=score), capacity, dice))
    return max(people, key=score)


def plan(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> list:
    """The best solution of all islands; elites, one an island, migrate by way of the driver."""
    least = lower_bound(counts, capacity)
    elites: list = []
    for epoch in range(epochs if counts else 0):

        def run(batches, epoch=epoch, elites=elites):
            for batch in batches:
                for island in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"solution": [json.dumps(evolve(counts, capacity, epoch * islands + island, elites))]})

        found = spark.range(0, islands, 1, islands).mapInArrow(run, "solution string").collect()
        elites = [[(tuple(map(tuple, c)), n) for c, n in json.loads(r["solution"])] for r in found]
        if min(map(bins, elites)) <= least:
            break
    return max(elites, key=lambda g: fitness(g, capacity), default=[])


def _pieces(tokenizer: str, capacity: int, cache: int):
    def run(batches):
        encode, end, pid = encoder(tokenizer, cache).encode, np.array([END], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64).tolist()
        for batch in batches:
            for part, _, _ in chunks(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = memoryview(encode(text or "") + end)
                    n = len(data) // 4
                    cut = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for piece, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b]), pid, seen[b - a]))
                        seen[b - a] += 1
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"])

    return run


def _places(groups: list, capacity: int):
    """By length: ranks from which a group's bins take pieces, the group's first bin, pieces a bin, and where in a bin."""
    by: dict[int, list] = {}
    first, used = 0, {}
    for contents, n in groups:
        offset = 0
        for length, k in contents:
            by.setdefault(length, []).append((used.get(length, 0), first, k, offset))
            used[length] = used.get(length, 0) + n * k
            offset += length * k
        first += n
    table = {x: np.array(rows, dtype=np.int64).T for x, rows in by.items()}

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                from_rank, first_bin, k, place = table[int(x)]
                g = np.searchsorted(from_rank, rank[at], side="right") - 1
                j = rank[at] - from_rank[g]
                sequence[at], offset[at] = first_bin[g] + j // k[g], place[g] + j % k[g] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """Packs whole texts into as few sequences of at most `capacity` ids as the search finds.

    A text (null: empty) gives its ids and the end id 2; only longer ones are cut, into pieces of `capacity` of which the
    first may be shorter. One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces of one
    sequence lie without gaps from offset 0. Each row of docs is packed, also repeated ones and those of null doc_id. Other
    columns are ignored. An empty table gives no rows. `cache` is how many words a worker remembers, which trades memory for
    time.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"
    pieces = materialize(id_and_text(docs).mapInArrow(_pieces(tokenizer, capacity, cache), schema), "pieces")
    tally = materialize(pieces.groupBy("length", "pid").agg(F.count("*").alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    groups = plan(spark, counts, capacity)
    # a row for each length and partition: broadcast up to a bound, else joined by a shuffle
    base = tally.select("length", "pid", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("base"))
    if tally.count() <= BROADCAST_IDS:
        base = F.broadcast(base)
    ranked = pieces.join(base, ["length", "pid"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "pid")
    return ranked.mapInArrow(_places(groups, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
