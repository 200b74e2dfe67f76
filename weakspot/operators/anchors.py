"""Neighbourhoods in leaf space: the contrast of every row taken as an anchor, and search over anchors that are no rows.

Rows of equal leaf codes are one class: they are equally like any anchor, so an anchor's neighbourhood depends on its codes and
on the classes' counts and loss sums alone. For each anchor the classes are added up by level, the (weighted) number of shared
leaves; there are as many levels as trees, so no pair of rows, and of classes none that outlives a task, is ever kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch
from . import trees as T
from .evaluate import ratio

#: Classes in a block; a task compares two blocks.
BLOCK = 1024
#: Anchors that may be given as a list, to be broadcast.
MOST_LISTED = 10_000

LEVELS = "anchor long, level int, n long, s double"


def leaf_classes(rows: DataFrame, key: str, codes: str, loss: str) -> DataFrame:
    """class (the smallest key of its rows), codes, n, s (the sum of losses) of each distinct row of leaf codes; rows of null loss are left out."""
    held = rows.where(F.col(loss).isNotNull())
    return held.groupBy(F.col(codes).alias("codes")).agg(F.min(key).cast("long").alias("class"), F.count("*").alias("n"), F.sum(loss).alias("s")).select("class", "codes", "n", "s")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row a block of (id, codes, n, s): arrays as bytes."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        codes = np.array(part["codes"].tolist(), dtype=np.int32)
        return pd.DataFrame({name: part["block"].iloc[:1].to_numpy(), f"{name}_id": [part["id"].to_numpy(np.int64).tobytes()], f"{name}_codes": [codes.tobytes()], f"{name}_n": [part["n"].to_numpy(np.int64).tobytes()], f"{name}_s": [part["s"].to_numpy(float).tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, f"{name} int, {name}_id binary, {name}_codes binary, {name}_n binary, {name}_s binary")


def _levels_of(weights: np.ndarray):
    top = int(weights.sum()) + 1

    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                a, b = (np.frombuffer(x, np.int32).reshape(-1, len(weights)) for x in (r.a_codes, r.b_codes))
                level = np.zeros((len(a), len(b)), dtype=np.int32)
                for t, w in enumerate(weights):
                    level += w * (a[:, t, None] == b[None, :, t])
                level += top * np.arange(len(a), dtype=np.int32)[:, None]
                n, s = (np.bincount(level.ravel(), np.broadcast_to(np.frombuffer(x, kind), level.shape).ravel(), len(a) * top) for x, kind in ((r.b_n, np.int64), (r.b_s, float)))
                at = np.flatnonzero(n)
                yield pd.DataFrame({"anchor": np.frombuffer(r.a_id, np.int64)[at // top], "level": (at % top).astype(np.int32), "n": n[at].astype(np.int64), "s": s[at]})

    return run


def levels(anchors: DataFrame, classes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """anchor, level, n, s: what the classes that share so many leaves with an anchor hold together.

    Both tables (anchors: anchor, codes; classes: class, codes, n, s; both written out) are dealt to blocks; each pair of
    blocks meets in one task.
    """
    spark = classes.sparkSession
    many_a, many_b = (max(1, -(-df.count() // BLOCK)) for df in (anchors, classes))
    a = _packed(anchors.select(F.col("anchor").alias("id"), "codes", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")), many_a, "a")
    b = _packed(classes.select(F.col("class").alias("id"), "codes", "n", "s"), many_b, "b")
    pairs = spark.range(many_a * many_b).select((F.col("id") % many_a).cast("int").alias("a"), F.floor(F.col("id") / many_a).cast("int").alias("b"))
    met = pairs.join(a, "a").join(b, "b").repartition(min(many_a * many_b, 4 * spark.sparkContext.defaultParallelism), "a", "b")
    found = met.select("a_id", "a_codes", "b_codes", "b_n", "b_s").mapInPandas(_levels_of(np.asarray(weights, dtype=np.int32)), LEVELS)
    return found.groupBy("anchor", "level").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def listed_levels(anchors: Sequence[Sequence[int]], classes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """The same for a short list of anchors, numbered from 0."""
    if len(anchors) > MOST_LISTED:
        raise ValueError(f"at most {MOST_LISTED} anchors can be listed; give a table to levels()")
    few = classes.sparkSession.createDataFrame([(i, list(map(int, c))) for i, c in enumerate(anchors)], "anchor long, _c array<int>")
    shared = sum((F.when(F.get("codes", F.lit(t)) == F.get("_c", F.lit(t)), F.lit(int(w))).otherwise(0) for t, w in enumerate(weights)), F.lit(0))
    return classes.crossJoin(F.broadcast(few)).groupBy("anchor", shared.cast("int").alias("level")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def filled(found: DataFrame, classes: DataFrame, m: int, total_weight: int) -> DataFrame:
    """anchor, contrast, threshold of the m rows nearest each anchor.

    The last level that is needed may have more rows than places left: the places are filled by its mean loss, which is what a
    draw without regard to the losses has on average. threshold is that level's share of shared leaves. contrast is null where
    no row is left outside, and without losses.
    """
    whole = classes.agg(F.sum("n").alias("_rows"), F.sum("s").alias("_total"))
    upto = F.sum("n").over(Window.partitionBy("anchor").orderBy(F.desc("level")))
    taken = found.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(m) - (upto - F.col("n")))))
    inside = taken.groupBy("anchor").agg(F.sum(F.col("s") * F.col("_take") / F.col("n")).alias("_in"), F.min(F.when(F.col("_take") > 0, F.col("level"))).alias("_least"))
    outside = F.when(F.col("_rows") > m, (F.col("_total") - F.col("_in")) / (F.col("_rows") - F.lit(m)))
    # one row of totals
    return inside.crossJoin(F.broadcast(whole)).select("anchor", (ratio(F.col("_in") / F.lit(float(m)), outside) - 1).alias("contrast"), (F.col("_least") / F.lit(float(total_weight))).alias("threshold"))


def exhaustive_contrasts(rows: DataFrame, key: str, codes: str, loss: str, m: int, weights: Sequence[int] | None = None) -> DataFrame:
    """class, n, contrast, threshold of every class of leaf codes taken as anchor; join class_of() for every row's.

    weights: whole numbers by which the trees count, 1 each by default. No rows give no classes.
    """
    classes = _written(leaf_classes(rows, key, codes, loss), "classes")
    first = classes.select(F.size("codes").alias("n")).first()
    weights = list(weights or [1] * (first["n"] if first else 1))
    found = levels(classes.select(F.col("class").alias("anchor"), "codes"), classes, weights)
    return filled(found, classes, m, sum(weights)).join(classes.select(F.col("class").alias("anchor"), "n"), "anchor").select(F.col("anchor").alias("class"), "n", "contrast", "threshold")


def anchor_contrasts(rows: DataFrame, key: str, codes: str, loss: str, anchors: DataFrame, m: int, weights: Sequence[int] | None = None) -> DataFrame:
    """anchor, contrast, threshold for anchors (anchor long, codes) that need not be rows."""
    classes, anchors = _written(leaf_classes(rows, key, codes, loss), "classes"), _written(anchors.select("anchor", "codes"), "anchors")
    first = classes.select(F.size("codes").alias("n")).first()
    weights = list(weights or [1] * (first["n"] if first else 1))
    return filled(levels(anchors, classes, weights), classes, m, sum(weights))


def frozen_leaf_region(codes: Column, anchor: Sequence[int], threshold: float, weights: Sequence[int] | None = None) -> Column:
    """The predicate of a neighbourhood for rows that were not searched: at least the threshold's share of leaves is shared."""
    return F.round(1 - T.distance_to(codes, anchor, weights), 10) >= F.round(F.lit(float(threshold)), 10)


def codes_at(trees: Sequence, point: dict[str, float]) -> list[int]:
    """The leaf codes of one point of input space."""
    out = []
    for node in trees:
        while isinstance(node, T.Split):
            node = node.left if point[node.feature] <= node.threshold else node.right
        out.append(node.code)
    return out


def leaf_search(
    rows: DataFrame, key: str, trees: Sequence, features: Sequence[str], centre: Sequence[float], spread: Sequence[float], loss: str, m: int, start: Sequence[float],
    budget: int, brood: int = 1, sigma: float = 0.6, adapt: float = 0.85, restart_below: float = 0.02, seed: int = 0, weights: Sequence[int] | None = None, fit_reads: int = 0,
) -> tuple[list[tuple], dict]:
    """An evolution strategy over anchors z in standard units (x = centre + spread * z), by measured contrast.

    Each step draws `brood` Gaussian children of the current anchor, measured in one job over the classes; the best replaces it
    if strictly better, and the step grows by 1 / adapt, else shrinks by adapt, and starts anew under restart_below. A child
    reads m losses, fit_reads are charged first, and no step starts once the budget is spent. Returns the history
    (step, reads, contrast, best) and the best anchor: z, codes, contrast, threshold.
    """
    dice = np.random.default_rng(seed)
    weights = list(weights or [1] * len(trees))
    classes = _written(leaf_classes(rows.withColumn("_codes", T.codes(trees)), key, "_codes", loss), "classes").persist()
    known: dict[tuple, tuple[float, float]] = {}
    first, reads, history = sigma, fit_reads, []

    def measured(points):
        at = [tuple(codes_at(trees, {f: c + s * v for f, c, s, v in zip(features, centre, spread, z, strict=True)})) for z in points]
        new = sorted(set(at) - set(known))
        if new:
            for r in filled(listed_levels(new, classes, weights), classes, m, sum(weights)).collect():  # one row an anchor
                known[new[r["anchor"]]] = (-math.inf if r["contrast"] is None else r["contrast"], r["threshold"])
        return [(*known.get(c, (-math.inf, None)), c) for c in at]

    z = np.asarray(start, float)
    value, threshold, codes = measured([z])[0]
    reads += m
    best = {"z": z.tolist(), "codes": list(codes), "contrast": value, "threshold": threshold}
    history.append((0, reads, value, value))
    while reads < budget:
        children = [z + sigma * dice.normal(size=len(z)) for _ in range(brood)]
        found = measured(children)
        top = max(range(brood), key=lambda i: (found[i][0], -i))
        if found[top][0] > value:
            z, (value, threshold, codes), sigma = children[top], found[top], sigma / adapt
        else:
            sigma *= adapt
        if sigma < restart_below:
            sigma = first
        if value > best["contrast"]:
            best = {"z": z.tolist(), "codes": list(codes), "contrast": value, "threshold": threshold}
        for f in found:
            reads += m
            history.append((len(history), reads, f[0], best["contrast"]))
    classes.unpersist()
    return history, best
