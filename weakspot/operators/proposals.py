"""Structural proposals: rows that name a union of cells or a derived feature, checked against what is known, compiled to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: id, the rule it changes, what it does, and the facts it rests on.
PROPOSAL = "id string, parent string, action string, cells array<int>, feature struct<name: string, op: string, left: string, right: string>, evidence array<string>"
OPERATIONS = ("plus", "minus", "times", "over", "least", "greatest")


def admission(proposals: DataFrame, parents: DataFrame, facts: DataFrame, columns: Sequence[str], outcomes: Sequence[str], cells: int, most: int = 2) -> DataFrame:
    """id, admitted, fault: the first rule that a proposal breaks, null where it breaks none.

    In order: no id; repeated id; unknown parent (parents: id); no evidence; unknown evidence (facts: id); unknown action; for
    a union, cells: 1 to `most` different numbers under `cells`; for a feature, its name: new and given, its operation, its
    operands: among `columns`, and outcome: an operand that is known only after the fact. Nothing is evaluated here.
    """
    ids = Window.partitionBy("id")
    held = proposals.withColumn("_same", F.count("*").over(ids))
    known = parents.select(F.col("id").alias("parent")).distinct().withColumn("_parent", F.lit(True))
    named = proposals.select("id", F.explode("evidence").alias("_fact"))
    unknown = named.join(facts.select(F.col("id").alias("_fact")).distinct(), "_fact", "left_anti").select("id").distinct().withColumn("_unknown", F.lit(True))
    held = held.join(known, "parent", "left").join(unknown, "id", "left")
    f = F.col("feature")
    named_in = lambda c, names: F.coalesce(c.isin(*names), F.lit(False)) if names else F.lit(False)
    good_cells = F.col("cells").isNotNull() & F.size("cells").between(1, most) & (F.size("cells") == F.size(F.array_distinct("cells"))) & F.forall("cells", lambda c: F.coalesce(c.between(0, cells - 1), F.lit(False)))
    union, feature = F.col("action") == "union", F.col("action") == "feature"
    new = F.coalesce(f["name"].rlike(r"^[A-Za-z_][A-Za-z_0-9]*$"), F.lit(False)) & ~named_in(F.lower(f["name"]), [c.lower() for c in (*columns, *outcomes)])
    fault = (
        F.when(F.col("id").isNull(), "no id").when(F.col("_same") > 1, "repeated id").when(F.col("_parent").isNull(), "unknown parent")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no evidence").when(F.col("_unknown"), "unknown evidence").when(~F.coalesce(union | feature, F.lit(False)), "unknown action")
        .when(union & ~F.coalesce(good_cells, F.lit(False)), "cells").when(feature & ~new, "name").when(feature & ~named_in(f["op"], OPERATIONS), "operation")
        .when(feature & (named_in(f["left"], outcomes) | named_in(f["right"], outcomes)), "outcome").when(feature & ~(named_in(f["left"], columns) & named_in(f["right"], columns)), "operands")
    )
    return held.select("id", fault.isNull().alias("admitted"), fault.alias("fault"))


def compiled(proposal: Row, cell: str = "cluster") -> Column:
    """An admitted proposal as a column: membership of its cells, or its feature (null where it divides by 0)."""
    if proposal["action"] == "union":
        return F.coalesce(F.col(cell).isin(*proposal["cells"]), F.lit(False))
    f = proposal["feature"]
    a, b = F.col(f["left"]), F.col(f["right"])
    return {"plus": lambda: a + b, "minus": lambda: a - b, "times": lambda: a * b, "over": lambda: F.try_divide(a.cast("double"), b.cast("double")), "least": lambda: F.least(a, b), "greatest": lambda: F.greatest(a, b)}[f["op"]]()


def applied(rows: DataFrame, proposals: DataFrame, verdicts: DataFrame, cell: str = "cluster") -> DataFrame:
    """rows with a column for each admitted proposal, named by its feature or `in_<id>`; the proposals of a study are few."""
    good = proposals.join(verdicts.where("admitted").select("id"), "id").orderBy("id").collect()
    return rows.withColumns({(p["feature"]["name"] if p["action"] == "feature" else f"in_{p['id']}"): compiled(p, cell) for p in good})
