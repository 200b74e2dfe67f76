"""Trees as column expressions: leaf codes, additive scores, leaf geometry, medoids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import first_nearest, mismatch


@dataclass(frozen=True)
class Split:
    """feature <= threshold goes left."""

    feature: str
    threshold: float
    left: Split | Leaf
    right: Split | Leaf


@dataclass(frozen=True)
class Leaf:
    code: int
    value: float


def _walk(node, leaf) -> Column:
    if isinstance(node, Leaf):
        return leaf(node)
    return F.when(F.col(node.feature) <= F.lit(float(node.threshold)), _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def code(tree) -> Column:
    return _walk(tree, lambda x: F.lit(x.code))


def value(tree) -> Column:
    return _walk(tree, lambda x: F.lit(float(x.value)))


def codes(trees: Sequence) -> Column:
    """The leaf of each tree as an array; nested CASE WHEN inside code generation."""
    return F.array(*map(code, trees))


def additive(trees: Sequence, base: float = 0.0) -> Column:
    return sum(map(value, trees), F.lit(float(base)))


def sql(node, leaf: str = "code") -> str:
    """The same tree as SQL text."""
    if isinstance(node, Leaf):
        return f"{node.code}" if leaf == "code" else f"{node.value!r}::DOUBLE"
    return f"CASE WHEN {node.feature} <= {float(node.threshold)!r} THEN {sql(node.left, leaf)} ELSE {sql(node.right, leaf)} END"


def leaf_table(spark, trees: Sequence) -> DataFrame:
    rows = []

    def visit(i, node):
        if isinstance(node, Leaf):
            rows.append((i, node.code, float(node.value)))
        else:
            visit(i, node.left)
            visit(i, node.right)

    for i, t in enumerate(trees):
        visit(i, t)
    return spark.createDataFrame(rows, "tree int, leaf int, value double")


def from_spark(model) -> list:
    """Trees of a fitted pyspark.ml tree ensemble of continuous features, with its weights folded into the leaf values.

    Leaves are numbered from left to right in each tree. Read from the model's public node data.
    """
    names = None
    for stage in model.extractParamMap():
        if stage.name == "featuresCol":
            names = model.getOrDefault(stage)
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        count = 0

        def build(node, weight=weight):
            nonlocal count
            if node.numDescendants() == 0:
                count += 1
                return Leaf(count - 1, weight * node.prediction())
            split = node.split()
            return Split(f"f{split.featureIndex()}", split.threshold(), build(node.leftChild()), build(node.rightChild()))

        trees.append(build(tree._call_java("rootNode")))
    return trees if names else trees


def embedding(rows: DataFrame, key: str, trees: Sequence) -> DataFrame:
    """key, tree, leaf, value: the long form of the weighted leaf embedding."""
    cells = [F.struct(F.lit(i).alias("tree"), code(t).alias("leaf"), value(t).alias("value")) for i, t in enumerate(trees)]
    return rows.select(key, F.inline(F.array(*cells)))


def kernel(embedded: DataFrame, key: str, trees: int) -> DataFrame:
    """a, b, similarity: share of trees in which two rows of a bounded pool meet in one leaf; pairs that never meet are left out."""
    one = embedded.select(F.col(key).alias("a"), "tree", "leaf")
    return one.join(one.withColumnRenamed("a", "b"), ["tree", "leaf"]).groupBy("a", "b").agg((F.count("*") / F.lit(float(trees))).alias("similarity"))


def class_kernel(rows: DataFrame, key: str, codes_column: str) -> DataFrame:
    """The whole kernel by classes of equal leaf codes: a, b (the classes' smallest keys), n_a, n_b, similarity.

    All rows of two classes have one similarity, so no pair of rows is made; there are as many classes as the trees have
    regions at most. Pairs of classes that never meet in a leaf are left out; class_of gives each row's class.
    """
    one = rows.groupBy(codes_column).agg(F.min(key).alias("a"), F.count("*").alias("n_a"))
    two = one.select(F.col(codes_column).alias("_c"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    same = 1 - mismatch(F.col(codes_column), F.col("_c"))
    return one.crossJoin(two).select("a", "b", "n_a", "n_b", same.alias("similarity")).where("similarity > 0")


def class_of(rows: DataFrame, key: str, codes_column: str) -> DataFrame:
    """key, class: the smallest key of the rows with the row's leaf codes."""
    least = rows.groupBy(codes_column).agg(F.min(key).alias("class"))
    return rows.select(key, codes_column).join(least, codes_column).select(key, "class")


def distance_to(codes_column: Column, medoid: Sequence[int], weights: Sequence[float] | None = None) -> Column:
    """Weighted share of trees in which a row's leaf isn't the medoid's."""
    weights = weights or [1.0] * len(medoid)
    total = float(sum(weights))
    return sum((F.when(F.get(codes_column, F.lit(i)) != m, F.lit(float(w))).otherwise(0.0) for i, (m, w) in enumerate(zip(medoid, weights, strict=True))), F.lit(0.0)) / total


def embedded_distance(codes_column: Column, values: Column, medoid: Sequence[int], medoid_values: Sequence[float]) -> Column:
    """Euclidean distance of one-hot leaf embeddings: a tree with different leaves adds both values squared."""
    terms = [F.when(F.get(codes_column, F.lit(i)) != m, F.get(values, F.lit(i)) ** 2 + F.lit(float(v) ** 2)).otherwise(0.0) for i, (m, v) in enumerate(zip(medoid, medoid_values, strict=True))]
    return F.sqrt(sum(terms, F.lit(0.0)))


def assign(rows: DataFrame, key: str, codes_column: str, medoids: Sequence[Sequence[int]], weights: Sequence[float] | None = None) -> DataFrame:
    """key, medoid, distance: the nearest medoid, the lowest place among equals. No shuffle: medoids are literals."""
    all_of = F.array(*[F.round(distance_to(F.col(codes_column), m, weights), 10) for m in medoids])
    return rows.withColumn("_d", all_of).select(key, first_nearest(F.col("_d")).alias("medoid"), F.array_min("_d").alias("distance"))


def leaf_neighbours(rows: DataFrame, key: str, codes_column: str, anchors: dict[int, Sequence[int]], m: int, tie: Column) -> DataFrame:
    """anchor, key, similarity: the m rows most like each anchor; ties by `tie`, then key. A group limit keeps m rows a task."""
    cells = [F.struct(F.lit(a).alias("anchor"), F.round(1 - distance_to(F.col(codes_column), c), 10).alias("similarity")) for a, c in anchors.items()]
    long = rows.select(key, tie.alias("_t"), F.inline(F.array(*cells)))
    order = Window.partitionBy("anchor").orderBy(F.desc("similarity"), "_t", key)
    return long.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= m).select("anchor", key, "similarity")


def router(embedded: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """cluster, tree, leaf, weight: each cluster's mean leaf vector."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("k"))
    return embedded.join(labels, key).groupBy("cluster", "tree", "leaf").agg(F.count("*").alias("c")).join(F.broadcast(sizes), "cluster").select("cluster", "tree", "leaf", (F.col("c") / F.col("k")).alias("weight"))


def route(embedded: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """key, cluster of the largest dot product with a cluster's mean leaf vector; the lowest number among equals."""
    score = embedded.join(F.broadcast(means), ["tree", "leaf"]).groupBy(key, "cluster").agg(F.round(F.sum("weight"), 10).alias("s"))
    return score.groupBy(key).agg(F.max_by("cluster", F.struct("s", -F.col("cluster"))).alias("cluster"))


def code_classes(rows: DataFrame, key: str, codes_column: str, most: int = 3000, seed: int = 0) -> list[tuple[list[int], int, int]]:
    """Distinct leaf codes, the smallest key of each and how many rows have it, by that key: all, or the `most` of least hash.

    Of many trees there are nearly as many classes as rows, so what comes to the driver is bounded by `most`.
    """
    classes = rows.groupBy(codes_column).agg(F.min(key).alias("least"), F.count("*").alias("n"))
    found = classes.orderBy(F.xxhash64(F.lit(seed), codes_column), "least").limit(most).collect()
    return sorted(((list(r[codes_column]), r["least"], r["n"]) for r in found), key=lambda c: c[1])


def dissimilarity(codes_matrix: np.ndarray, block: int = 512) -> np.ndarray:
    """Mismatch shares of a pool's rows; for at most a few thousand rows."""
    n, trees = codes_matrix.shape
    if n > MOST_POOL:
        raise ValueError(f"a pool of {n} rows; give at most {MOST_POOL}")
    out = np.zeros((n, n))
    for a in range(0, n, block):
        for t in range(trees):
            out[a : a + block] += codes_matrix[a : a + block, t, None] != codes_matrix[None, :, t]
    return out / trees


def pam(distance: np.ndarray, k: int, rounds: int = 100, counts: Sequence[int] | None = None) -> tuple[list[int], float]:
    """k medoids of a pool by BUILD and steepest SWAP; earliest row among equals. Returns medoids and total distance.

    With counts, a row stands for so many equal ones.
    """
    n = len(distance)
    weight = np.ones(n) if counts is None else np.asarray(counts, float)
    medoids = [int((weight @ distance).argmin())]
    near = distance[:, medoids[0]].copy()
    while len(medoids) < min(k, n):
        gain = weight @ np.maximum(near[:, None] - distance, 0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
        near = np.minimum(near, distance[:, medoids[-1]])
    for _ in range(rounds):
        held = distance[:, medoids]
        order = np.argsort(held, axis=1, kind="stable")
        first, second = held[np.arange(n), order[:, 0]], held[np.arange(n), order[:, 1]] if len(medoids) > 1 else np.full(n, np.inf)
        best, move = -1e-12, None
        for j in range(len(medoids)):
            without = np.where(order[:, 0] == j, second, first)
            change = weight @ (np.minimum(without[:, None], distance) - first[:, None])
            change[medoids] = np.inf
            c = int(change.argmin())
            if change[c] < best:
                best, move = change[c], (j, c)
        if move is None:
            break
        medoids[move[0]] = move[1]
    return medoids, float(weight @ distance[:, medoids].min(axis=1))


def interactions(spark, trees: Sequence, gains: Sequence[float]) -> DataFrame:
    """f, g, gain: each tree's gain in equal parts to the pairs of features on it, largest first."""
    total: dict = {}
    for t, gain in zip(trees, gains, strict=True):
        names: set = set()

        def visit(node, names=names):
            if isinstance(node, Split):
                names.add(node.feature)
                visit(node.left)
                visit(node.right)

        visit(t)
        pairs = [(a, b) for a in sorted(names) for b in sorted(names) if a < b]
        for p in pairs:
            total[p] = total.get(p, 0.0) + gain / len(pairs)
    rows = [(a, b, g) for (a, b), g in sorted(total.items(), key=lambda x: (-x[1], x[0]))]
    return spark.createDataFrame(rows, "f string, g string, gain double")


#: Rows of a pool whose distances are held at once (200 MB).
MOST_POOL = 5000

NODES = "tree int, path string, feature string, threshold double, code int, value double"


def save(spark, trees: Sequence, path: str) -> None:
    """Writes trees as a table of nodes; a node's path is its turns from the root, 0 left and 1 right."""
    rows: list = []

    def visit(i, at, node):
        if isinstance(node, Leaf):
            rows.append((i, at, None, None, node.code, float(node.value)))
        else:
            rows.append((i, at, node.feature, float(node.threshold), None, None))
            visit(i, at + "0", node.left)
            visit(i, at + "1", node.right)

    for i, t in enumerate(trees):
        visit(i, "", t)
    spark.createDataFrame(rows, NODES).write.mode("errorifexists").parquet(path)


def load(spark, path: str) -> list:
    """The trees that save() wrote; their nodes are a model's, not data."""
    nodes = {(r["tree"], r["path"]): r for r in spark.read.schema(NODES).parquet(path).collect()}

    def build(i, at):
        r = nodes[i, at]
        return Leaf(r["code"], r["value"]) if r["feature"] is None else Split(r["feature"], r["threshold"], build(i, at + "0"), build(i, at + "1"))

    return [build(i, "") for i in range(1 + max((i for i, _ in nodes), default=-1))]
