"""Jaccard join of word n-gram sets by chosen paths.

Texts with the same set are one text from the start. Each set is embedded as `WIDTH` minhash tokens (place, n-gram). A run
splits the sets on sampled tokens: a path picks each place with probability 1 / (threshold * WIDTH), and sets that share the
token there go on together; two sets over the threshold are expected to share one child or more. Buckets of up to `BUCKET` sets
are compared by brute force, larger ones are split again unless most of their sets are alike, and what is still large after
`DEPTH` splits is compared in pairs of blocks. `runs_for` gives the number of runs that reaches the target recall. What the runs join to one candidate group is then
checked exactly: all pairs of its sets, in pairs of blocks.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, U64, Slices, Words, chunks, drop, id_and_text, materialize, mix, without_ids
from .graphs import components, forest, in_blocks, together, whole_groups

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
WIDTH, BUCKET, DEPTH = 128, 64, 4
#: Sets in a block: when sketches are compared, and when whole sets are.
WIDE_BLOCK, BLOCK = 2048, 256
#: A large bucket of which this share is like its pivot is compared instead of split.
ALIKE = 0.3
#: Columns of the exact check's incidence matrix at once, and n-grams that a block of sets holds.
COLUMNS = 1 << 15
#: Standard deviations under the threshold's expectation from which on likeness of sketches isn't compared exactly.
DEVIATIONS = 4.5


def places(path: np.ndarray | int, width: int, threshold: float) -> np.ndarray:
    """Which places a path picks."""
    h = mix(np.arange(width, dtype=U64) ^ mix(np.array([path], dtype=U64), 77), 78)
    return np.flatnonzero(h < U64(int(2**64 / (threshold * width))))


def runs_for(recall: float, threshold: float, levels: int) -> int:
    """Runs after which two sets at the threshold have been compared with the given probability.

    `levels` counts the root bucket and all splits after it: a pair in large buckets is only compared in the last. The number
    of a pair's equal places is binomial; a pair with too few is never compared, and takes its part of the misses.
    """
    equal = np.arange(WIDTH + 1)
    share = np.array([math.comb(WIDTH, k) * threshold**k * (1 - threshold) ** (WIDTH - k) for k in range(WIDTH + 1)])
    parted = np.zeros(WIDTH + 1)  # that a pair which shares a bucket shares none of the last level under it
    for _ in range(levels - 1):
        parted = (1 - (1 - parted) / (threshold * WIDTH)) ** equal
    miss = np.where(equal >= least_likeness(threshold), 1 - equal / WIDTH * (1 - parted), 1.0)
    if share @ (miss == 1) >= 1 - recall:
        raise ValueError(f"sketches of {WIDTH} places can't reach a recall of {recall} at {threshold}")
    runs = roots = 0
    while share @ miss**roots > 1 - recall:
        roots += len(places(runs, WIDTH, threshold))
        runs += 1
    return runs


def shingles(words: Words, n: int):
    """Distinct n-grams of each row: row, name; a shorter text's only n-gram is all its words."""
    count = np.diff(words.first)
    slices = Slices(words.name)
    at = np.arange(max(0, len(words) - n + 1))
    at = at[words.row[at] == words.row[at + n - 1]] if len(at) else at
    short = np.flatnonzero((count > 0) & (count < n))
    row = np.concatenate((words.row[at], short))
    name = np.concatenate((slices(at, at + n), mix(slices(words.first[short], words.first[short] + count[short]), 4)))
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
    return row[keep], name[keep]


def _sums(row, name, rows: int):
    """Two names of each row's set that don't depend on order, and its size."""
    total = lambda v: np.concatenate((np.zeros(1, dtype=U64), np.cumsum(v, dtype=U64)))
    first = np.searchsorted(row, np.arange(rows + 1))
    one, two = total(mix(name, 12)), total(mix(name, 13))
    return mix(one[first[1:]] - one[first[:-1]], 1).view(np.int64), mix(two[first[1:]] - two[first[:-1]], 2).view(np.int64), np.diff(first), first


def _sketch_rows(n: int, runs: int, threshold: float):
    factors = mix(np.arange(WIDTH, dtype=U64), 900) | U64(1)
    shifts = mix(np.arange(WIDTH, dtype=U64), 901)
    roots = [(r, int(i)) for r in range(runs) for i in places(r, WIDTH, threshold)]

    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                rows = part.num_rows
                row, name = shingles(Words(raw, offsets), n)
                one, two, size, first = _sums(row, name, rows)
                have = np.flatnonzero(size)
                least = np.zeros((rows, WIDTH), dtype=U64)
                for i in range(WIDTH if len(have) else 0):
                    least[have, i] = np.minimum.reduceat(name * factors[i] + shifts[i], first[:-1][have])
                least = mix(least, 5)
                keys = np.stack([mix(least[:, i] ^ mix(np.array([r * WIDTH + i], dtype=U64), 79), 80) for r, i in roots], axis=1) if roots else np.zeros((rows, 0), dtype=U64)
                small = (least & U64(0xFFFF)).astype("<u2")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(roots)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(one), pa.array(two), pa.array(size.astype(np.int32)), pa.array([x.tobytes() for x in small], pa.binary()), lists],
                    names=["doc_id", "f1", "f2", "size", "sketch", "roots"],
                )

    return run


def spanning(sketch: np.ndarray, size: np.ndarray, enough: float, threshold: float) -> np.ndarray:
    """For each set the first set that likeness leads to; each set is compared with those that nothing led to before."""
    label = np.arange(len(sketch))
    left = np.arange(len(sketch))
    while len(left):
        root, left, reached = left[0], left[1:], [left[0]]
        while reached and len(left):
            x = reached.pop()
            near = ((sketch[left] == sketch[x]).sum(axis=1) >= enough) & (np.minimum(size[left], size[x]) >= threshold * np.maximum(size[left], size[x]))
            label[left[near]] = root
            reached.extend(left[near].tolist())
            left = left[~near]
    return label


def least_likeness(threshold: float) -> float:
    """Equal places below which two sets aren't compared exactly."""
    return (threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / WIDTH)) * WIDTH


def _alike(threshold: float):
    """bucket, alike, n: of a batch's rows of each bucket, how many sketches may be over the threshold with the pivot."""

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, WIDTH) for c in ("sketch", "pivot"))
            bucket, place = np.unique(batch.column("bucket").to_numpy(), return_inverse=True)
            alike = np.bincount(place, (one == two).sum(axis=1) >= least_likeness(threshold), len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(alike.astype(np.int64)), pa.array(np.bincount(place, minlength=len(bucket)).astype(np.int64))], names=["bucket", "alike", "n"])

    return run


def _compare(threshold: float):
    """Within pairs of blocks: edges of a spanning forest of the sets that may be over the threshold."""
    enough = least_likeness(threshold)

    def run(batches):
        for table, bounds in whole_groups(batches, ["bucket", "bi", "bj"]):
            ids = table.column("id").to_numpy()
            size = table.column("size").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u2").reshape(-1, WIDTH)
            one, two = [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                label = spanning(sketch[a:b], size[a:b], enough, threshold)
                at = np.flatnonzero(label != np.arange(b - a))
                one.append(ids[a + label[at]])
                two.append(ids[a + at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], names=["a", "b"])

    return run


def _split(depth: int, threshold: float):
    def run(batches):
        for batch in batches:
            bucket = batch.column("bucket").to_numpy().view(U64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype="<u2").reshape(-1, WIDTH).astype(U64)
            at, keys = [], []
            for b in np.unique(bucket):
                rows = np.flatnonzero(bucket == b)
                for i in places(int(mix(np.array([b], dtype=U64), 90 + depth)[0]), WIDTH, threshold):
                    at.append(rows)
                    keys.append(mix(sketch[rows, i] ^ mix(np.array([b + U64(i)], dtype=U64), 91), 92 + depth))
            if at:
                held = batch.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(held.column(c) for c in ("id", "size", "sketch"))], names=["bucket", "id", "size", "sketch"])

    return run


def candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: edges that join sets which may be over the threshold into groups. texts: id, size, sketch, roots."""
    slim = texts.select("id", "size", "sketch")
    rows = texts.select("id", F.explode("roots").alias("bucket"))
    counts = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = materialize(rows.join(counts.hint("merge"), "bucket", "left_semi").join(slim.hint("merge"), "id").select("bucket", "id", "size", "sketch"), "paths")
    bucket = "bucket long, id long, size int, sketch binary"
    found = []
    for depth in range(DEPTH + 1):
        large = counts.where(F.col("n") > BUCKET)
        last = depth == DEPTH or not large.limit(1).count()
        spent = [rows, counts]
        if not last:
            # splitting doesn't part sets that are all alike; buckets that mostly hold such are compared at once
            in_large = rows.join(large.select("bucket"), "bucket", "left_semi")
            pivots = in_large.groupBy("bucket").agg(F.min_by("sketch", "id").alias("pivot"))
            alike = in_large.join(pivots, "bucket").select("bucket", "sketch", "pivot").mapInArrow(_alike(threshold), "bucket long, alike long, n long")
            apart = materialize(alike.groupBy("bucket").agg((F.sum("alike") / F.sum("n")).alias("alike")).where(F.col("alike") < ALIKE).select("bucket"), "apart")
            spent.append(apart)
        now = counts if last else counts.join(apart, "bucket", "left_anti")
        blocks = in_blocks(rows, now, "bucket", "id", WIDE_BLOCK)
        found.append(materialize(together(blocks, ["bucket", "bi", "bj"], ["id"]).mapInArrow(_compare(threshold), "a long, b long").distinct(), "pairs"))
        if last:
            drop(*spent)
            break
        # rows of a bucket stay in their partitions: a path's places depend on its name alone
        rows = materialize(rows.join(apart, "bucket", "left_semi").mapInArrow(_split(depth, threshold), bucket), "split", *spent)
        counts = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        rows = materialize(rows.join(counts, "bucket", "left_semi"), "paths", rows)
    return materialize(functools.reduce(DataFrame.union, found).distinct(), "candidates", *found)


def _set_rows(n: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                row, name = shingles(Words(raw, offsets), n)
                one, two, _, first = _sums(row, name, part.num_rows)
                right = np.flatnonzero((one == part.column("f1").to_numpy()) & (two == part.column("f2").to_numpy()))
                sets = pa.array([name[first[i] : first[i + 1]].tobytes() for i in right], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("group").take(pa.array(right)), part.column("id").take(pa.array(right)), sets], names=["group", "id", "grams"])

    return run


def exact_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of the threshold or more."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(n), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        present = np.zeros((n, COLUMNS), dtype=np.float32)
        present[row[a:b], column[a:b] - low] = 1
        common += present @ present.T
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _check(threshold: float):
    def run(batches):
        for table, bounds in whole_groups(batches, ["group", "bi", "bj"], 512):
            ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
            bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
            grams = table.column("grams")
            nodes, links, least = [], [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                linked = exact_links([np.frombuffer(x.as_py(), dtype=U64) for x in grams[a:b]], threshold)
                label = forest(linked)
                if bi[a] != bj[a]:  # a block's own pairs are counted where it meets itself
                    linked &= block[a:b][:, None] != block[a:b][None, :]
                nodes.append(ids[a:b])
                links.append(linked.sum(axis=1))
                least.append(ids[a + label])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, least)], names=["id", "links", "least"])

    return run


def jaccard_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_id, n_copies, class_id and n_links of each row of docs.

    text_id is the smallest doc_id with the same set of n-word shingles and n_copies how many rows have it; n_links counts the
    other text_ids whose set has a Jaccard similarity of `threshold` or more; class_id is the smallest doc_id that links lead
    to. A text of fewer than n words has one shingle, all its words; texts without words (and null ones) are classes of their
    own. Rows of null doc_id get null ids and no links. Repeated rows are copies. Other columns are ignored; an empty
    table gives no rows.
    """
    ids = id_and_text(docs)
    schema = "doc_id long, f1 long, f2 long, size int, sketch binary, roots array<long>"
    rows = materialize(ids.mapInArrow(_sketch_rows(n, runs_for(recall, threshold, DEPTH + 1), threshold), schema), "sketches")
    real = rows.where("size > 0 and doc_id is not null")
    # equal sets have equal sketches and roots, so any will do
    texts = real.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"))
    texts = materialize(texts, "texts")
    rows = materialize(rows.select("doc_id", "f1", "f2", "size"), "named", rows)
    edges = candidates(texts, threshold)
    texts = materialize(texts.select("id", "f1", "f2", "n_copies"), "known", texts)
    groups = components(edges).withColumnRenamed("component", "group")
    members = materialize(groups.join(texts.select(F.col("id").alias("node"), "f1", "f2"), "node").select("group", F.col("node").alias("id"), "f1", "f2"), "members", edges)
    named = ids.where("text is not null")
    if members.count() <= BROADCAST_IDS:
        named = named.join(F.broadcast(members.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    sets = named.join(members, named["doc_id"] == members["id"]).select("group", "id", "f1", "f2", "text")
    sets = materialize(sets.mapInArrow(_set_rows(n), "group long, id long, grams binary").dropDuplicates(["id"]), "sets")
    counts = materialize(members.groupBy("group").agg(F.count("*").alias("n")), "counts")
    met = materialize(together(in_blocks(sets, counts, "group", "id", BLOCK), ["group", "bi", "bj"], ["id"]).mapInArrow(_check(threshold), "id long, links long, least long"), "met", sets, counts, members)
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(met.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    known = texts.join(links, "id", "left").join(classes.select(F.col("node").alias("id"), "component"), "id", "left")
    known = materialize(known.select("f1", "f2", F.col("id").alias("text_id"), "n_copies", F.coalesce("component", "id").alias("class"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), "classes", met, texts)
    lone = F.col("doc_id").isNull() | (F.col("size") == 0)
    out = rows.select("doc_id", "f1", "f2", "size").join(known, ["f1", "f2"], "left")
    return out.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.when(lone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("class")).alias("class_id"),
        F.when(lone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
    )


def one_of_each_class(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, unchanged, of the smallest doc_id of each class of jaccard_join; rows of null doc_id stay."""
    others = jaccard_join(docs, n, threshold).where("doc_id <> class_id").select("doc_id")
    return without_ids(docs, materialize(others, "others"))
