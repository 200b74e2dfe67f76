"""Exact top-k inner-product search by branch and bound over ball trees.

For a query q, no candidate under a node with centre c and radius r scores more than q.c + |q| r, so a query goes to the child
of larger bound first and leaves out nodes whose bound is under its current k-th score.

The same holds for whole shards. The candidates are dealt to shards by the top levels of one tree, which is fitted to a bounded
sample of vectors and then routes every vector; a part that comes out too large (many equal vectors, say) is dealt to several
shards by a hash. Each shard's tree is built once and written. A query first searches the shard of largest bound, then the next
ones, then the rest: in each round it goes only to shards whose bound reaches the k-th score that all rounds before have found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, small_batches
from .graphs import together, whole_groups

K, EVERY, SCALE = 20, 20, 64
LEAF = 128
#: Vectors of a shard: SHARD, or as many as keep the shards' number at SHARDS, up to LARGEST_SHARD.
SHARD, SHARDS, LARGEST_SHARD = 4096, 256, 1 << 16
#: Vectors to which the top tree is fitted, those of smallest hash.
SAMPLE = 8192
#: Queries that are searched at once, and that meet a shard's tree in one task.
TOGETHER, BLOCK = 2048, 1 << 16
#: Shards by rank of their bound that a query visits in each round.
ROUNDS = ((0, 1), (1, 8), (8, None))
NONE = np.iinfo(np.int64).min


def halves(vectors: np.ndarray, rows: np.ndarray):
    """A direction away from the row farthest from the centre, and the rows on either side of its median."""
    own = vectors[rows].astype(float)
    one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    two = own[((own - one) ** 2).sum(axis=1).argmax()]
    side = own @ (one - two)
    by = np.argsort(side, kind="stable")
    middle = len(by) // 2
    return one - two, side[by[middle]], rows[by[:middle]], rows[by[middle:]]


class Router:
    """The top levels of a tree over the sample: which of `parts` parts a vector belongs to."""

    def __init__(self, vectors: np.ndarray, parts: int):
        leaves = [((), np.arange(len(vectors)))]
        self.cuts: dict[tuple, tuple] = {}
        while len(leaves) < parts:
            leaves.sort(key=lambda x: len(x[1]))
            path, rows = leaves.pop()
            if len(rows) < 2:
                leaves.append((path, rows))
                break
            direction, cut, one, two = halves(vectors, rows)
            self.cuts[path] = (direction, cut)
            leaves += [((*path, 0), one), ((*path, 1), two)]
        self.parts = {path: i for i, (path, _) in enumerate(sorted(leaves))}

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), dtype=np.int32)
        todo = [((), np.arange(len(vectors)))]
        while todo:
            path, rows = todo.pop()
            if path in self.cuts:
                direction, cut = self.cuts[path]
                above = vectors[rows] @ direction >= cut
                todo += [((*path, 0), rows[~above]), ((*path, 1), rows[above])]
            else:
                out[rows] = self.parts[path]
        return out


class Tree:
    """A ball tree over a shard's vectors as arrays: nodes of centre, radius, the range of `order` under them, and children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.order = ids, vectors, np.arange(len(ids))
        self.centre, self.radius, self.span, self.child = [], [], [], []
        self._build(0, len(ids))

    def _build(self, a: int, b: int) -> int:
        rows, node = self.order[a:b], len(self.radius)
        own = self.vectors[rows].astype(float)
        centre = own.mean(axis=0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        self.span.append((a, b))
        self.child.append((-1, -1))
        if b - a > LEAF and self.radius[node] > 0:
            _, _, one, two = halves(self.vectors, rows)
            self.order[a:b] = np.concatenate((np.sort(one), np.sort(two)))
            middle = a + len(one)
            self.child[node] = (self._build(a, middle), self._build(middle, b))
        return node

    def row(self, shard: int) -> dict:
        return {
            "shard": shard, "ids": self.ids.astype("<i8").tobytes(), "vectors": self.vectors.astype("<i8").tobytes(), "order": self.order.astype("<i4").tobytes(), "centre": np.array(self.centre, dtype="<f8").tobytes(),
            "radius": np.array(self.radius, dtype="<f8").tobytes(), "span": np.array(self.span, dtype="<i4").tobytes(), "child": np.array(self.child, dtype="<i4").tobytes(),
        }

    @classmethod
    def read(cls, r: dict, width: int) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, tree.order, tree.radius = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["order"], "<i4"), np.frombuffer(r["radius"], "<f8")
        tree.vectors, tree.centre = np.frombuffer(r["vectors"], "<i8").reshape(-1, width), np.frombuffer(r["centre"], "<f8").reshape(-1, width)
        tree.span, tree.child = np.frombuffer(r["span"], "<i4").reshape(-1, 2), np.frombuffer(r["child"], "<i4").reshape(-1, 2)
        return tree


TREE = "shard int, ids binary, vectors binary, order binary, centre binary, radius binary, span binary, child binary"


def bounds(queries: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius) -> np.ndarray:
    """No score under the ball is larger, also in floating point."""
    top = queries @ centre.T + norm * radius
    return top + np.abs(top) * 1e-9 + 1e-6


class Search:
    """Top k of one shard for some queries; the shard's ids ascend."""

    ROWS = 2 * LARGEST_SHARD

    def __init__(self, tree: Tree, query_ids, queries, kth, k: int):
        self.tree, self.ids, self.query_ids, self.k = tree, tree.ids, query_ids, k
        most = max(np.abs(tree.vectors).max(initial=0), 1) * float(max(np.abs(queries).max(initial=0), 1)) * tree.vectors.shape[1]
        # whole numbers under 2**53 are exact as doubles; a score and a row then fit one double, larger first, ties to smaller ids
        self.packed = most * 2 * self.ROWS < 2**53 and len(tree.ids) <= self.ROWS
        self.vectors, self.queries = (tree.vectors.astype(float), queries.astype(float)) if most < 2**52 else (tree.vectors, queries)
        self.as_float, self.norm = queries.astype(float), np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        self.kth = kth.copy()
        self.score, self.found = np.full((len(queries), k), NONE), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.best = np.full((len(queries), k), -np.inf) if self.packed else None

    def bound(self, node: int, at: np.ndarray) -> np.ndarray:
        return bounds(self.as_float[at], self.norm[at], self.tree.centre[node], self.tree.radius[node])

    def visit(self, node: int, at: np.ndarray) -> None:
        at = at[self.bound(node, at) >= self.kth[at]]
        if not len(at):
            return
        left, right = self.tree.child[node]
        if left < 0:
            a, b = self.tree.span[node]
            self.compare(self.tree.order[a:b], at)
            return
        first = self.bound(left, at) >= self.bound(right, at)
        self.visit(left, at[first])
        self.visit(right, at[~first])
        self.visit(right, at[first])
        self.visit(left, at[~first])

    def compare(self, rows: np.ndarray, at: np.ndarray) -> None:
        if not self.packed:
            self.compare_apart(rows, at)
            return
        score = self.queries[at] @ self.vectors[rows].T
        score[self.query_ids[at][:, None] == self.ids[rows][None, :]] = -np.inf
        some = (score >= self.kth[at][:, None]).any(axis=1)
        at = at[some]
        if len(at):
            key = np.concatenate((self.best[at], score[some] * self.ROWS + (self.ROWS - 1 - rows)), axis=1)
            key = np.partition(key, key.shape[1] - self.k, axis=1)[:, -self.k :]
            self.best[at] = key
            least = key.min(axis=1)
            full = np.isfinite(least)
            self.kth[at[full]] = np.maximum(self.kth[at[full]], np.floor(least[full] / self.ROWS).astype(np.int64))

    def finish(self) -> None:
        """Sets score and found, best first."""
        if not self.packed:
            return
        key = -np.sort(-self.best, axis=1)
        have = np.isfinite(key)
        score = np.floor(np.where(have, key, 0) / self.ROWS)
        row = (self.ROWS - 1 - (np.where(have, key, 0) - score * self.ROWS)).astype(np.int64)
        self.score = np.where(have, score.astype(np.int64), NONE)
        self.found = np.where(have, self.ids[np.where(have, row, 0)], np.iinfo(np.int64).max)

    def compare_apart(self, rows: np.ndarray, at: np.ndarray) -> None:
        score = (self.queries[at] @ self.vectors[rows].T).astype(np.int64)
        score[self.query_ids[at][:, None] == self.ids[rows][None, :]] = NONE
        # an equal score may win by its smaller id
        some = (score >= self.kth[at][:, None]).any(axis=1) & (score > NONE).any(axis=1)
        at, score = at[some], score[some]
        if not len(at):
            return
        score = np.concatenate((self.score[at], score), axis=1)
        ids = np.concatenate((self.found[at], np.broadcast_to(self.ids[rows], (len(at), len(rows)))), axis=1)
        by = np.argsort(ids, axis=1, kind="stable")
        score, ids = np.take_along_axis(score, by, 1), np.take_along_axis(ids, by, 1)
        # descending without overflow: ~x turns the order of whole numbers
        by = np.argsort(~score, axis=1, kind="stable")[:, : self.k]
        self.score[at], self.found[at] = np.take_along_axis(score, by, 1), np.take_along_axis(ids, by, 1)
        self.kth[at] = np.maximum(self.kth[at], self.score[at, -1])


def _matrix(column, width: int) -> np.ndarray:
    """Rows of `width` numbers; missing components are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def whole_vectors(table: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each finite vector; of rows that repeat an id, the smallest vector."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(F.lit(scale).cast("double") * c.cast("double")).cast("long"))
    return table.where(fine).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def build_shards(vectors: DataFrame, n: int, width: int) -> DataFrame:
    """A row with the tree of each shard; every vector is in one."""
    size = min(LARGEST_SHARD, max(SHARD, -(-n // SHARDS)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded by its parameter
    router = Router(np.array([r["v"] + [0] * (width - len(r["v"])) for r in sample], dtype=float).reshape(len(sample), width), -(-n // size))

    def route(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(router(_matrix(batch.column("v"), width).astype(float))), batch.column("vec_id"), batch.column("v")], names=["part", "vec_id", "v"])

    routed = materialize(vectors.mapInArrow(route, "part int, vec_id long, v array<long>"), "routed")
    parts = [(r["part"], -(-r["n"] // size)) for r in routed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]  # at most SHARDS, or n / LARGEST_SHARD, rows
    base = np.cumsum([0] + [c for _, c in parts]).tolist()
    places = vectors.sparkSession.createDataFrame([(p, c, b) for (p, c), b in zip(parts, base, strict=False)], "part int, pieces int, base int")
    dealt = routed.join(F.broadcast(places), "part").withColumn("shard", F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))

    def build(batches):
        for table, edges in whole_groups(batches, ["shard"], 1):
            ids, shards = table.column("vec_id").to_numpy(), table.column("shard").to_numpy()
            vectors = _matrix(table.column("v"), width)
            for a, b in zip(edges, edges[1:], strict=False):
                yield pa.RecordBatch.from_pylist([Tree(ids[a:b], vectors[a:b]).row(int(shards[a]))], schema=kinds)

    kinds = pa.schema([("shard", pa.int32()), *((x, pa.binary()) for x in ("ids", "vectors", "order", "centre", "radius", "span", "child"))])
    return materialize(together(dealt.select("shard", "vec_id", "v"), ["shard"], ["vec_id"]).mapInArrow(build, TREE), "trees", routed)


def _search(k: int, width: int):
    """Rows of a (shard, block) come with the shard's tree first, then the queries."""

    def run(batches):
        tree = None
        for batch in batches:
            shard, block, kth, vec_ids = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("shard", "block", "kth", "vec_id"))
            is_tree = ~np.asarray(batch.column("tree").is_null())
            queries = _matrix(batch.column("v"), width)
            edges = np.append(np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (block[1:] != block[:-1]))), len(shard)) if len(shard) else np.zeros(1, int)
            for a, b in zip(edges, edges[1:], strict=False):
                if is_tree[a]:
                    tree = Tree.read(batch.column("tree")[int(a)].as_py(), width)
                    a += 1
                for at in range(a, b, TOGETHER):
                    rows = slice(at, min(at + TOGETHER, b))
                    search = Search(tree, vec_ids[rows], queries[rows], kth[rows], k)
                    search.visit(0, np.arange(len(search.norm)))
                    search.finish()
                    q, r = np.nonzero((search.score > NONE) & (search.score >= kth[rows][:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (vec_ids[rows][q], search.found[q, r], search.score[q, r])], names=["query_id", "vec_id", "score"])

    return run


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k others of highest inner product.

    Vectors are whole numbers floor(scale * x) as doubles; scores are exact; ties go to the smaller id. Vectors that are null
    or hold null or non-finite components take no part; missing components of shorter vectors are 0. Rows that repeat an id are
    one row. Fewer than k candidates give as many ranks; an empty table gives no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    small_batches(spark)
    vectors = materialize(whole_vectors(table, id_column, vector, scale), "vectors")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    result = "query_id long, vec_id long, score long"
    if not n or not width:
        width = 1
    trees = build_shards(vectors, n, width) if n else None
    balls = trees.select("shard", "centre", "radius").orderBy("shard").collect() if n else []  # as many as shards: SHARDS, or n / LARGEST_SHARD
    centre = np.array([np.frombuffer(r["centre"], "<f8", count=width) for r in balls]).reshape(-1, width)
    radius = np.array([np.frombuffer(r["radius"], "<f8", count=1)[0] for r in balls])
    shards = np.array([r["shard"] for r in balls], dtype=np.int32)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = materialize(asked.select("vec_id", "v", F.lit(NONE).alias("kth")), "asked", vectors)
    blocks = max(1, -(-asked.count() // BLOCK))

    def visits(low: int, high: int | None):
        """The shards of each query in one round."""

        def run(batches):
            for batch in batches:
                queries, kth = _matrix(batch.column("v"), width).astype(float), batch.column("kth").to_numpy()
                norm = np.sqrt((queries**2).sum(axis=1))
                bound = bounds(queries, norm[:, None], centre, radius[None, :])
                by = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
                q, r = np.nonzero(np.take_along_axis(bound, by, 1) >= kth[:, None])
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(shards[by[q, r]]), *(batch.column(c).take(at) for c in ("vec_id", "v", "kth"))], names=["shard", "vec_id", "v", "kth"])

        return run

    best = spark.createDataFrame([], result + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    whole = F.struct(*[c for c in trees.columns if c != "shard"]) if n else None
    for low, high in ROUNDS:
        if low >= len(shards):
            break
        goes = asked.mapInArrow(visits(low, high), "shard int, vec_id long, v array<long>, kth long").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        goes = materialize(goes, "visits")
        met = goes.select("shard", "block").distinct().join(trees, "shard").select("shard", "block", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("long").alias("kth"), whole.alias("tree"))
        both = met.unionByName(goes.withColumn("tree", F.lit(None).cast(met.schema["tree"].dataType)))
        found = together(both, ["shard", "block"], ["vec_id"]).mapInArrow(_search(k, width), result)
        ranked = found.unionByName(best.drop("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        spent = [best] if low else []
        best = materialize(ranked, "best", goes, *spent)
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NONE)).alias("new"))
        asked = materialize(asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("new", F.lit(NONE)).alias("kth")), "asked", asked)
    drop(asked, *([trees] if n else []))
    return best.select("query_id", "rank", "vec_id", "score")
