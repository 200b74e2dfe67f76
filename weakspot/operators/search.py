"""Search for weak regions. Driver loops only propose; whole neighbourhoods are measured in one job each."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import measure, ratio
from .regions import membership


def within_budget(measured: DataFrame, n: int, budget: int) -> DataFrame:
    """Measured candidates in order of their number while the loss reads, n for the totals and m each, stay in the budget."""
    reads = F.lit(n) + F.sum("m").over(Window.orderBy("cand"))
    return measured.withColumn("reads", reads).where(F.col("reads") <= budget)


def condition_weakness(rows: DataFrame, mask: Column, loss: str, stressed_loss: Column, least: int = 20) -> DataFrame:
    """n, weakness: mean stressed loss in the slice over the mean loss of all rows, minus 1; 0 for a slice of under `least` rows."""
    inside = F.coalesce(mask, F.lit(False))
    one = rows.agg(F.count_if(inside).alias("n"), F.avg(F.when(inside, stressed_loss)).alias("s"), F.avg(loss).alias("b"))
    return one.select("n", F.when(F.col("n") < least, 0.0).otherwise(ratio(F.col("s"), F.col("b")) - 1).alias("weakness"))


class SparkEvaluator:
    """Measures lists of candidates of m rows; keeps a count of the losses read."""

    def __init__(self, rows: DataFrame, features: Sequence[str], key: str, loss: str, m: int):
        self.rows, self.features, self.key, self.loss, self.m = rows.select(key, loss, *features).cache(), list(features), key, loss, m
        self.n = self.rows.count()
        self.reads, self.steps, self.best, self.history = self.n, 0, None, []

    def __call__(self, proposals: list[tuple[list[float], list[float]]]) -> list[float]:
        spark = self.rows.sparkSession
        frame = spark.createDataFrame([(i, [float(x) for x in z], [float(x) for x in w], self.m) for i, (z, w) in enumerate(proposals)], "cand int, z array<double>, w array<double>, m int")
        members = membership(self.rows, frame, self.features, self.key)
        found = {r["cand"]: r["contrast"] for r in measure(members, self.rows, self.key, self.loss, float("inf")).collect()}  # one row a proposal
        out = []
        for i in range(len(proposals)):
            value = found.get(i)
            self.reads += self.m
            if value is not None and (self.best is None or value > self.best):
                self.best = value
            self.history.append((self.steps, self.reads, value, self.best))
            self.steps += 1
            out.append(float("-inf") if value is None else value)
        return out


def hill_climb(evaluate: SparkEvaluator, z: list[float], w: list[float], step: float = 0.5, least: float = 0.02, shrink: float = 0.5, rounds: int = 20, budget: int | None = None) -> list:
    """Best-improvement climbing over single centre and shape moves; the step shrinks where no move improves."""
    at, value = (list(z), list(w)), evaluate([(z, w)])[0]
    for _ in range(rounds):
        if step < least or (budget is not None and evaluate.reads + 4 * len(z) * evaluate.m > budget):
            break
        around = []
        for i in range(len(z)):
            for sign in (1, -1):
                c = list(at[0])
                c[i] += sign * step
                around.append((c, at[1]))
                s = list(at[1])
                s[i] = max(s[i] * (1 + step if sign > 0 else 1 / (1 + step)), 1e-3)
                around.append((at[0], s))
        values = evaluate(around)
        top = max(range(len(values)), key=lambda i: (values[i], -i))
        if values[top] > value:
            at, value = around[top], values[top]
        else:
            step *= shrink
    return evaluate.history


def evolution(evaluate: SparkEvaluator, z: list[float], w: list[float], sigma: float = 0.5, steps: int = 50, seed: int = 0, up: float = 1 / 0.85, down: float = 0.85) -> list:
    """A (1 + 1) strategy: Gaussian centres, log-normal shapes; the step grows on success and shrinks on failure."""
    dice = random.Random(seed)
    at, value = (list(z), list(w)), evaluate([(z, w)])[0]
    import math

    for _ in range(steps - 1):
        child = ([c + dice.gauss(0, sigma) for c in at[0]], [s * math.exp(dice.gauss(0, sigma)) for s in at[1]])
        found = evaluate([child])[0]
        if found > value:
            at, value, sigma = child, found, sigma * up
        else:
            sigma *= down
    return evaluate.history
