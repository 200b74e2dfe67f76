"""Groups of rows in one task, blocks of large groups, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def in_blocks(rows: DataFrame, counts: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Rows of groups (counts: key, n), each under columns bi, bj for every pair of blocks that holds it.

    A group of up to `most` rows is one block; a larger one is dealt to blocks of about that size by a hash of the item, and
    each pair of blocks meets once, so no task holds more than two blocks whatever the group's size.
    """
    held = rows.join(counts, key).withColumn("blocks", F.ceil(F.col("n") / F.lit(most)).cast("int"))
    held = held.withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return held.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "other", "n")


def together(rows: DataFrame, keys: list[str], then: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *then)


def whole_groups(batches, keys: list[str], most_rows: int = 4096):
    """Tables with whole groups of equal keys, and the groups' bounds, from batches sorted by keys; a group is held whole."""
    kept: list[pa.RecordBatch] = []
    held = 0

    def cut(table, last):
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bounds = np.append(np.flatnonzero(change), table.num_rows)
        return (table, bounds, None) if last else (table.slice(0, bounds[-2]), bounds[:-1], table.slice(bounds[-2]))

    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held >= most_rows:
            table, bounds, rest = cut(pa.Table.from_batches(kept).combine_chunks(), False)
            if len(bounds) > 1:
                yield table, bounds
                kept, held = rest.combine_chunks().to_batches(), 0
    if kept and sum(b.num_rows for b in kept):
        table, bounds, _ = cut(pa.Table.from_batches(kept).combine_chunks(), True)
        yield table, bounds


def forest(adjacent: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the smallest node of its component."""
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) from edges a, b. Hash-to-min rounds with shortcuts; each round is written out.

    Empty edges give no rows. Rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = written = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        step = step.join(jump, "new").select("node", "component", F.least("new", "far").alias("new"))
        written = materialize(step, "labels", written)
        changed = written.where("component <> new").limit(1).count()
        labels = written.select("node", F.col("new").alias("component"))
        if not changed:
            drop(both)
            return labels
