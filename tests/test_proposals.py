"""Structural proposals, strict JSON, instructions and words of all scripts, case by case."""

import pytest
from pyspark.sql import functions as F

from weakspot.operators import evidence as V
from weakspot.operators import proposals as P
from weakspot.sources import files


def proposal(id="a", parent="base", action="union", cells=(0, 1), feature=None, evidence=("e1",)):
    return (id, parent, action, None if cells is None else list(cells), feature, None if evidence is None else list(evidence))


def ratio(name="r", op="over", left="x", right="z"):
    return (name, op, left, right)


CASES = [
    (proposal(), None), (proposal(cells=[3]), None), (proposal(action="feature", feature=ratio()), None), (proposal(action="feature", feature=ratio(op="least")), None),
    (proposal(id=None), "no id"), (proposal(parent="other"), "unknown parent"), (proposal(parent=None), "unknown parent"),
    (proposal(evidence=[]), "no evidence"), (proposal(evidence=None), "no evidence"), (proposal(evidence=["e1", "e9"]), "unknown evidence"),
    (proposal(action="delete"), "unknown action"), (proposal(action=None), "unknown action"),
    (proposal(cells=[0, 0]), "cells"), (proposal(cells=[4]), "cells"), (proposal(cells=[-1]), "cells"), (proposal(cells=[]), "cells"), (proposal(cells=None), "cells"), (proposal(cells=[0, 1, 2]), "cells"), (proposal(cells=[0, None]), "cells"),
    (proposal(action="feature"), "name"), (proposal(action="feature", feature=ratio(name="X")), "name"), (proposal(action="feature", feature=ratio(name="a b")), "name"), (proposal(action="feature", feature=ratio(name=None)), "name"),
    (proposal(action="feature", feature=ratio(op="eval")), "operation"), (proposal(action="feature", feature=ratio(right="loss")), "outcome"), (proposal(action="feature", feature=ratio(left="w")), "operands"), (proposal(action="feature", feature=ratio(right=None)), "operands"),
]


def known(spark):
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    return one("base"), one("e1", "e2", "e1")


def test_each_refusal(spark):
    rows = [(f"p{i}" if p[0] else None, *p[1:]) for i, (p, _) in enumerate(CASES)]
    found = {r["id"]: (r["admitted"], r["fault"]) for r in P.admission(spark.createDataFrame(rows, P.PROPOSAL), *known(spark), ["x", "z"], ["y", "loss"], 4).collect()}
    assert found == {r[0]: (fault is None, fault) for r, (_, fault) in zip(rows, CASES, strict=True)}
    twice = P.admission(spark.createDataFrame([proposal(), proposal(), proposal(id="b")], P.PROPOSAL), *known(spark), ["x"], [], 4).collect()
    assert sorted((r["id"], r["fault"]) for r in twice if r["fault"]) == [("a", "repeated id")] * 2
    assert P.admission(spark.createDataFrame([], P.PROPOSAL), *known(spark), ["x"], [], 4).collect() == []


def test_compiled(spark):
    rows = spark.createDataFrame([(4.0, 2.0, 0), (3.0, 0.0, 2), (None, 1.0, None)], "x double, z double, cluster int")
    made = spark.createDataFrame([proposal("u", cells=[0, 1]), proposal("v", cells=[9])] + [proposal(op, action="feature", feature=ratio(f"f_{op}", op)) for op in P.OPERATIONS], P.PROPOSAL)
    out = P.applied(rows, made, P.admission(made, *known(spark), ["x", "z"], [], 4)).collect()
    assert "in_v" not in out[0].asDict() and [r["in_u"] for r in out] == [True, False, False]
    assert [[r[f"f_{op}"] for op in P.OPERATIONS] for r in out] == [[6, 2, 8, 2, 2, 4], [3, 3, 0, None, 0, 3], [None, None, None, None, 1, 1]]


FAULTY = [
    ('{"a": 1}', None), ("[]", None), ('"x"', None), ("1e308", None), (None, "malformed"), ("", "malformed"), ("{", "malformed"), ("{'a': 1}", "malformed"), ("1 2", "malformed"),
    ('{"a": 1, "a": 1}', "repeated key"), ('[{"b": {"a": 1, "a": 2}}]', "repeated key"), ("NaN", "not finite"), ("[-Infinity]", "not finite"), ("1e309", "not finite"), ("-1e400", "not finite"), ("[" * 200_000, "malformed"),
]


def test_strict_json_column(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FAULTY)], "id int, text string")
    out = V.strict_documents(df, "text").select("id", "fault", F.to_json("value").alias("value")).collect()
    assert {r["id"]: r["fault"] for r in out} == {i: f for i, (_, f) in enumerate(FAULTY)}
    assert all((r["value"] is None) == (r["fault"] is not None) for r in out)
    with pytest.raises(ValueError):
        files.strict_json("1e999")


@pytest.mark.parametrize("text, value, want", [("Anné says", "ann", False), ("Ann says", "ann", True), ("naïve", "na", False), ("x é y", "É", True), ("١٢ units", "١٢", True), ("a٣b", "a", False), ("(a+b)", "a+b", True), ("日本 語", "日本", True), ("日本語", "日本", False)])
def test_words_of_all_scripts(spark, text, value, want):
    assert spark.createDataFrame([(text, value)], "t string, v string").select(V.states(F.col("t"), F.col("v"))).first()[0] is want


def test_instructions(spark):
    factors = spark.createDataFrame([(2, "tone", "plain", True, "Be plain."), (2, "tone", "rich", False, "Be rich."), (0, "gaps", "name", True, "Name gaps."), (0, "gaps", "skip", False, "Skip gaps."), (0, "gaps", "ask", False, "Ask.")], "slot int, factor string, level string, baseline boolean, text string")
    frozen = spark.createDataFrame([(1, "You write reports.")], "slot int, text string")
    arms = V.instruction_arms(factors, frozen, "|").orderBy("arm").collect()
    assert len(arms) == 6 == len({r["instruction"] for r in arms}) and arms[0]["instruction"] == "Name gaps.|You write reports.|Be plain." and arms[0]["levels"] == {"tone": "plain", "gaps": "name"}
    assert all(r["instruction"].split("|") == [{"name": "Name gaps.", "skip": "Skip gaps.", "ask": "Ask."}[r["levels"]["gaps"]], "You write reports.", {"plain": "Be plain.", "rich": "Be rich."}[r["levels"]["tone"]]] for r in arms)
    with pytest.raises(ValueError):
        V.instruction_arms(factors.where("not baseline"), frozen)
    facts = "array<struct<tail: string, span: string>>"
    rows = [(arm, s, t, [("7", "s")], [], ["drift"]) for arm, t in ((0, "7 rows; drift is not reported"), (1, "drift is small"), (2, "8 rows")) for s in ("one", "two")]
    ranked = V.rank_instructions(spark.createDataFrame(rows, f"arm int, section string, text string, values {facts}, qualifiers {facts}, gaps array<string>"), "arm").orderBy("place").collect()
    assert [(r["arm"], r["n"], round(r["overall"], 6)) for r in ranked] == [(0, 2, 1.0), (1, 2, 0.6), (2, 2, 0.6)]


def test_plans_with_qualifiers(spark):
    packet = spark.createDataFrame([(["a", "b", "q"], ["q"])], "facts array<string>, qualifiers array<string>")
    plans = spark.createDataFrame([("all", ["q", "b", "a"]), ("most", ["a", "b"]), ("one", ["q"])], "plan string, facts array<string>")
    found = {r["plan"]: (round(r["coverage"], 3), r["qualifier_coverage"], r["admissible"]) for r in V.evaluate_plans(plans, packet).collect()}
    assert found == {"all": (1.0, 1.0, True), "most": (0.667, 0.0, False), "one": (0.333, 1.0, False)}
    store = spark.createDataFrame([(i, i.upper()) for i in "abq"], "id string, value string")
    assert [tuple(r) for r in V.render(plans, store, packet).collect()] == [("all", "q = Q; b = B; a = A")]
    assert V.render(plans, store).count() == 3
