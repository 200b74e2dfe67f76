"""Queries over evidence: stores, claims, packets, plans, reports. Facts are made of the nations' customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as V
from .registry import registrar
from .scored import table

REGISTRY: dict = {}
query = registrar(REGISTRY)

FACTS = """
WITH n AS (SELECT n_name AS entity, count(*) AS c, CAST(CAST(max(c_acctbal) AS DECIMAL(18, 2)) AS VARCHAR) AS b, min(n_nationkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name),
facts AS (
  SELECT 'bank/' || entity || '/customers' AS id, CAST(c AS VARCHAR) AS value, 'int' AS vtype, '/' || entity || '/customers' AS pointer, k FROM n
  UNION ALL SELECT 'bank/' || entity || '/balance', b, 'float', '/' || entity || '/balance', k FROM n
  UNION ALL SELECT 'bank/' || entity || '/name', entity, 'str', '/' || entity || '/name', k FROM n)"""


def nations(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("entity")).agg(F.count("*").alias("c"), F.max("c_acctbal").cast("decimal(18,2)").cast("string").alias("b"), F.min("n_nationkey").alias("k"))


def store(spark, sf_dir):
    pair = lambda v, t: F.struct(v.cast("string").alias("value"), F.lit(t).alias("vtype"))
    fields = F.create_map(F.lit("customers"), pair(F.col("c"), "int"), F.lit("balance"), pair(F.col("b"), "float"), F.lit("name"), pair(F.col("entity"), "str"))
    docs = nations(spark, sf_dir).select("entity", F.col("entity").alias("source"), F.col("entity").alias("content"), fields.alias("fields"))
    return V.build_store(docs, "bank")


@query("e01_build_store", FACTS + " SELECT id, value, vtype, split_part(pointer, '/', 2) AS source, sha256(split_part(pointer, '/', 2)) AS sha256, pointer FROM facts")
def build_store(spark, sf_dir):
    return store(spark, sf_dir)


@query("e02_audit", FACTS + " SELECT 3 * count(*) AS drifted, 0::BIGINT AS misplaced, 0::BIGINT AS rebound, 0::BIGINT AS repeated FROM n WHERE k % 5 = 0")
def audit(spark, sf_dir):
    now = nations(spark, sf_dir).select(F.col("entity").alias("source"), F.sha2(F.when(F.col("k") % 5 == 0, F.lit("x")).otherwise(F.col("entity")).cast("binary"), 256).alias("sha256"))
    return V.audit(store(spark, sf_dir), now, "bank")


CASES = FACTS + """, cl AS (
  SELECT 'exact|' || id AS claim, 'exact' AS attack, CASE WHEN true THEN 'Supported' END AS expected, value AS stored FROM facts
  UNION ALL SELECT 'altered|' || id, 'altered', 'Contradicted', value FROM facts UNION ALL SELECT 'unknown|' || id || '#', 'unknown', 'Absent', NULL FROM facts
  UNION ALL SELECT 'as_text|' || id, 'as_text', CASE WHEN vtype = 'str' THEN 'Supported' ELSE 'Unscorable' END, value FROM facts
  UNION ALL SELECT 'no_value|' || id, 'no_value', 'Unscorable', value FROM facts)"""


@query("e03_j08_verify", CASES + " SELECT claim, expected AS verdict, stored FROM cl")
def verify(spark, sf_dir):
    s = store(spark, sf_dir)
    return V.verify(V.mutations(s), s)


@query("e04_verify_loose", CASES + " SELECT claim, CASE WHEN attack = 'as_text' AND expected = 'Unscorable' THEN 'Contradicted' ELSE expected END AS verdict FROM cl")
def verify_loose(spark, sf_dir):
    s = store(spark, sf_dir)
    return V.verify(V.mutations(s), s, strict_types=False).drop("stored")


@query("e06_verdict_counts", CASES + " SELECT expected AS verdict, count(*) AS n FROM cl GROUP BY expected")
def verdict_counts(spark, sf_dir):
    s = store(spark, sf_dir)
    return V.verify(V.mutations(s), s).groupBy("verdict").agg(F.count("*").alias("n"))


@query("e07_mutation_grid", CASES + " SELECT attack, count(*) AS cases, count(*) FILTER (expected <> expected) AS false_accepts FROM cl GROUP BY attack")
def mutation_grid(spark, sf_dir):
    s = store(spark, sf_dir)
    m = V.mutations(s)
    judged = m.join(V.verify(m, s), "claim")
    return judged.groupBy("attack").agg(F.count("*").alias("cases"), F.count_if((F.col("verdict") == "Supported") & (F.col("expected") != "Supported")).alias("false_accepts"))


TRIPLES = FACTS + ", tr AS (SELECT entity AS head, 'region' AS relation, r_name AS tail, k AS pos FROM n JOIN nation ON n_name = entity JOIN region ON r_regionkey = n_regionkey)"


def triples(spark, sf_dir):
    t = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations(spark, sf_dir).join(t, F.col("entity") == F.col("n_name")).select(F.col("entity").alias("head"), F.lit("region").alias("relation"), F.col("r_name").alias("tail"), F.col("k").alias("pos"))


@query(
    "e05_triples",
    TRIPLES
    + """ SELECT 'r' || head AS claim, 'Supported' AS verdict, 'text' AS rule FROM tr UNION ALL SELECT 'w' || head, 'Contradicted', 'text' FROM tr
UNION ALL SELECT 'n' || head, 'Supported', 'number' FROM tr UNION ALL SELECT 'm' || head, 'Contradicted', 'number' FROM tr UNION ALL SELECT 'a' || head, 'Absent', NULL FROM tr UNION ALL SELECT 'u' || head, 'Unscorable', 'text' FROM tr""",
)
def verify_triples(spark, sf_dir):
    t = triples(spark, sf_dir)
    n = nations(spark, sf_dir).select(F.col("entity").alias("head"), F.lit("customers").alias("relation"), F.col("c").cast("double").alias("number"))
    one = lambda tag, df, relation, value: df.select(F.concat(F.lit(tag), "head").alias("claim"), "head", F.lit(relation).alias("relation"), value.cast("string").alias("value"))
    claims = one("r", t, "region", F.concat(F.lit(" "), F.lower("tail"))).union(one("w", t, "region", F.lit("nowhere"))).union(one("n", n, "customers", F.format_number("number", 1))).union(one("m", n, "customers", F.col("number") + 1))
    claims = claims.union(one("a", t, "ruler", F.lit("x"))).union(one("u", t, "region", F.lit(None)))
    return V.verify_triples(claims, t, n)


@query("e11_j09_first_span", TRIPLES + " SELECT head AS claim, head || ':' || tail AS span FROM tr")
def first_span(spark, sf_dir):
    t = triples(spark, sf_dir).withColumn("span", F.concat_ws(":", "head", "tail"))
    other = t.withColumns({"tail": F.lit("elsewhere"), "span": F.lit("other"), "pos": F.col("pos") - 100})
    claims = t.select(F.col("head").alias("claim"), "head", "relation", F.col("tail").alias("value"))
    return V.first_span(t.union(other), claims)


def needs(spark, sf_dir):
    n = nations(spark, sf_dir)
    fields = F.explode(F.array(F.lit("customers"), F.lit("balance"), F.lit("ruler"))).alias("f")
    return n.select("entity", fields).select(F.col("entity").alias("section"), F.concat(F.lit("bank/"), "entity", F.lit("/"), "f").alias("id"))


@query("e08_j10_packets", FACTS + " SELECT entity AS section, string_agg(id || '=' || value, ',' ORDER BY id) AS facts, 'bank/' || entity || '/ruler' AS gaps FROM n JOIN facts USING (k) WHERE id NOT LIKE '%/name' GROUP BY entity")
def packets(spark, sf_dir):
    p = V.packets(needs(spark, sf_dir), store(spark, sf_dir))
    return p.select("section", F.concat_ws(",", F.transform("facts", lambda x: F.concat(x["id"], F.lit("="), x["value"]))).alias("facts"), F.concat_ws(",", "gaps").alias("gaps"))


@query("e18_required_facts", FACTS + " SELECT count(*) AS missing FROM n")
def required(spark, sf_dir):
    return needs(spark, sf_dir).join(store(spark, sf_dir), "id", "left_anti").agg(F.count("*").alias("missing"))


@query(
    "e09_f05_section_scores",
    FACTS + """ SELECT entity AS section, CASE WHEN k % 2 = 0 THEN 1e0 ELSE 0e0 END AS faithfulness, 0.5e0 AS completeness, 1e0 AS qualification, 0.5e0 AS numerical_fidelity, 0.5e0 AS provenance,
    round((CASE WHEN k % 2 = 0 THEN 1e0 ELSE 0e0 END + 2.5e0) / 5, 6) AS overall FROM n""",
)
def section_scores(spark, sf_dir):
    fact = lambda tail, span: F.struct(tail.alias("tail"), F.lit(span).cast("string").alias("span"))
    count = F.col("c").cast("string")
    s = nations(spark, sf_dir).select(
        F.col("entity").alias("section"),
        F.concat(F.lit("In all "), count, F.lit(" customers, about 0.12345 of them. Only A SAMPLE. The ruler"), F.when(F.col("k") % 2 == 0, " is not reported.").otherwise(" is well known.")).alias("text"),
        F.array(fact(count, "a span"), fact(F.concat(count, F.lit(".5")), "another")).alias("values"), F.array(fact(F.lit("a sample"), None)).alias("qualifiers"), F.array(F.lit("Ruler")).alias("gaps"),
    )
    return V.section_scores(s).withColumn("overall", F.round("overall", 6))


@query("f06_missing_phrases", "SELECT item_id, " + " OR ".join(f"contains(lower(text), '{phrase}')" for phrase in V.MISSING) + " AS missing FROM benchmark")
def missing(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", V.says_missing(F.col("text")).alias("missing"))


@query("f04_numbers", "SELECT c_custkey, CAST(replace(trim(' ' || CAST(c_custkey * 1000 AS VARCHAR) || ' '), ',', '') AS DOUBLE) AS x FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 7 = 0")
def numbers(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("nan")).otherwise(F.concat(F.lit(" "), F.format_number(F.col("c_custkey") * 1000, 0), F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", V.number_of(text).alias("x"))


@query("e10_u03_plans", FACTS + " SELECT 'all' AS plan, true AS valid, 1e0 AS coverage, 1e0 AS qualifier_coverage, true AS admissible, count(*)::INT AS cost FROM facts UNION ALL SELECT 'half', true, round(count(*) FILTER (vtype = 'int') / count(*)::DOUBLE, 6), 0e0, false, count(*) FILTER (vtype = 'int')::INT FROM facts UNION ALL SELECT 'odd', false, 0e0, 0e0, false, 2::INT")
def plans(spark, sf_dir):
    s = store(spark, sf_dir)
    packet = s.agg(F.collect_list("id").alias("facts"), F.collect_list(F.when(F.col("vtype") == "str", F.col("id"))).alias("qualifiers"))
    every = s.agg(F.lit("all").alias("plan"), F.collect_list("id").alias("facts")).union(s.where("vtype = 'int'").agg(F.lit("half").alias("plan"), F.collect_list("id").alias("facts")))
    every = every.union(spark.createDataFrame([("odd", ["x", "x"])], "plan string, facts array<string>"))
    return V.evaluate_plans(every, packet).withColumn("coverage", F.round("coverage", 6))


@query("e10_render", FACTS + " SELECT entity AS plan, 'bank/' || entity || '/name = ' || entity || '; bank/' || entity || '/customers = ' || c AS text FROM n")
def render(spark, sf_dir):
    p = nations(spark, sf_dir).select(F.col("entity").alias("plan"), F.array(F.concat(F.lit("bank/"), "entity", F.lit("/name")), F.concat(F.lit("bank/"), "entity", F.lit("/customers"))).alias("facts"))
    return V.render(p, store(spark, sf_dir))


@query(
    "e12_answers",
    FACTS + " SELECT 'c' || entity AS answer, 'correct' AS verdict, true AS provenance FROM n UNION ALL SELECT 'w' || entity, 'wrong', false FROM n UNION ALL SELECT 'a' || entity, 'abstained', false FROM n UNION ALL SELECT 'b' || entity, 'malformed', true FROM n UNION ALL SELECT 'x' || entity, 'malformed', false FROM n",
)
def answers(spark, sf_dir):
    n = nations(spark, sf_dir)
    one = lambda tag, raw: n.select(F.concat(F.lit(tag), "entity").alias("answer"), raw.alias("raw"), F.col("c").cast("double").alias("expected"), F.array(F.lit("s")).alias("sources"))
    rows = one("c", F.concat(F.lit('{"answer": '), F.col("c").cast("string"), F.lit(', "sources": ["s"]}'))).union(one("w", F.lit('{"answer": -1, "sources": ["t"]}'))).union(one("a", F.lit('{"answer": null, "sources": []}'))).union(one("b", F.lit('{"answer": true, "sources": ["s"]}'))).union(one("x", F.lit("{oops")))
    return V.score_answers(rows)


@query("u10_distinct_facts", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL")
def distinct_facts(spark, sf_dir):
    return V.distinct_facts(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], "turn")


@query("e14_context", TRIPLES + " SELECT tail AS query, string_agg(head || ' region ' || tail, chr(10) ORDER BY pos) AS context FROM tr GROUP BY tail UNION ALL SELECT 'NOBODY', 'no facts'")
def context(spark, sf_dir):
    t = triples(spark, sf_dir)
    heads = t.select(F.col("tail").alias("query"), "head").union(spark.createDataFrame([("NOBODY", "none")], "query string, head string"))
    return V.context(heads.union(heads), t)


@query("e16_drafts", FACTS + " SELECT 'g' || entity AS draft, true AS valid FROM n UNION ALL SELECT 'b' || entity, false FROM n")
def drafts(spark, sf_dir):
    n = nations(spark, sf_dir)
    good, bad = '{"title": "t", "text": "x", "facts": ["f2", "f1"], "qualifiers": ["q"]}', '{"title": "t", "text": "x", "facts": ["f1", "f1"], "qualifiers": ["q"]}'
    rows = n.select(F.concat(F.lit("g"), "entity").alias("draft"), F.lit(good).alias("raw")).union(n.select(F.concat(F.lit("b"), "entity"), F.lit(bad)))
    return V.draft_check(rows, ["f1", "f2"], ["q"])


@query("e17_tasks", FACTS + ", nu AS (SELECT id, CAST(value AS DOUBLE) AS v FROM facts WHERE vtype <> 'str'), ne AS (SELECT id, v, lead(id) OVER (ORDER BY id) AS i2, lead(v) OVER (ORDER BY id) AS v2 FROM nu) SELECT 'recall ' || id AS task, round(v, 6) AS expected FROM nu UNION ALL SELECT 'minus ' || id || ' ' || i2, round(v - v2, 6) FROM ne WHERE i2 IS NOT NULL")
def tasks(spark, sf_dir):
    return V.tasks(store(spark, sf_dir)).withColumn("expected", F.round("expected", 6))


@query("e19_f07_pointers", "SELECT event_id AS source, '/k' AS pointer, json_extract_string(props, '$.k') AS value FROM events")
def pointers(spark, sf_dir):
    return V.pointers(table(spark, sf_dir, "events").select(F.col("event_id").alias("source"), F.col("props").alias("content")), ["/k"])


ARMS = [(0, "facts", "stated", True, "State each fact."), (0, "facts", "left out", False, "Leave the facts out."), (1, "gaps", "named", True, "Say what isn't known."), (1, "gaps", "passed over", False, "Speak of everything.")]


@query(
    "e13_t07_ranked_instructions",
    FACTS + """, arms AS (SELECT a AS arm, a < 2 AS said, a % 2 = 0 AS named FROM range(4) AS t(a)),
sc AS (SELECT arm, count(*) AS n, CASE WHEN named THEN 1e0 ELSE 0e0 END AS faithfulness, CASE WHEN said THEN 1e0 ELSE 0e0 END AS completeness, 1e0 AS qualification, 1e0 AS numerical_fidelity, 1e0 AS provenance FROM arms, n GROUP BY ALL)
SELECT CAST(arm AS INT) AS arm, n, faithfulness, completeness, qualification, numerical_fidelity, provenance, round((faithfulness + completeness + 3) / 5, 6) AS overall,
  CAST(row_number() OVER (ORDER BY faithfulness + completeness DESC, arm) AS INT) AS place FROM sc""",
)
def ranked(spark, sf_dir):
    """Four instructions, and for each a section on every nation as it would be written under it, ranked by the mean scores."""
    frozen = spark.createDataFrame([(9, "Write plainly.")], "slot int, text string")
    arms = V.instruction_arms(spark.createDataFrame(ARMS, "slot int, factor string, level string, baseline boolean, text string"), frozen)
    count = F.col("c").cast("string")
    facts = F.array(F.struct(count.alias("tail"), F.lit("a span").alias("span")))
    packets = nations(spark, sf_dir).select(F.col("entity").alias("section"), facts.alias("values"), F.filter(facts, lambda _: F.lit(False)).alias("qualifiers"), F.array(F.lit("Ruler")).alias("gaps"))

    def writer(arm, packet):
        has = lambda factor, level: F.element_at(arm["levels"], factor) == level
        said = F.when(has("facts", "stated"), F.concat(F.lit("There are "), F.get(packet["values"], F.lit(0))["tail"], F.lit(" customers. "))).otherwise("")
        return F.concat(said, F.when(has("gaps", "named"), "The ruler is not reported.").otherwise("The ruler is well known."))

    written = V.write_sections(arms, packets, writer)
    return V.rank_instructions(written, "arm").withColumn("overall", F.round("overall", 6))


FAULTS = ["NULL", "'unknown parent'", "'no evidence'", "'unknown evidence'", "'unknown action'", "'cells'", "'outcome'", "NULL"]


@query("s13_proposals", FACTS + ", f AS (SELECT entity AS id, CASE k % 8 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(FAULTS)) + " END AS fault FROM n) SELECT id, fault IS NULL AS admitted, fault FROM f")
def proposals(spark, sf_dir):
    """A proposal a nation, by its number: unions and features, each with one fault or none."""
    from ..operators.proposals import admission

    case = lambda *places: (F.col("k") % 8).isin(*places)
    feature = F.struct(F.lit("ratio").alias("name"), F.lit("over").alias("op"), F.when(case(6), "loss").otherwise("x1").alias("left"), F.lit("x2").alias("right"))
    rows = nations(spark, sf_dir).select(
        F.col("entity").alias("id"), F.when(case(1), "nothing").otherwise("base").alias("parent"), F.when(case(4), "guess").when(case(6, 7), "feature").otherwise("union").alias("action"),
        F.when(case(5), F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(3))).alias("cells"), F.when(case(6, 7), feature).alias("feature"),
        F.when(case(2), F.array().cast("array<string>")).when(case(3), F.array(F.lit("bank/none"))).otherwise(F.array(F.concat(F.lit("bank/"), "entity", F.lit("/name")))).alias("evidence"),
    )
    return admission(rows, spark.createDataFrame([("base",)], "id string"), store(spark, sf_dir), ["x1", "x2", "x3"], ["y", "p", "loss"], 4)


@query("s13_applied", "WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_linenumber % 4 AS cluster FROM lineitem) SELECT l_orderkey, l_linenumber, round(a / nullif(b, 0), 6) AS ratio, cluster IN (0, 3) AS in_u FROM q")
def applied(spark, sf_dir):
    """An admitted feature and an admitted union over the order lines."""
    from ..operators.proposals import PROPOSAL, admission, applied

    made = spark.createDataFrame([("f", "base", "feature", None, ("ratio", "over", "a", "b"), ["e"]), ("u", "base", "union", [0, 3], None, ["e"]), ("x", "base", "union", [0, 1, 2], None, ["e"])], PROPOSAL)
    found = admission(made, spark.createDataFrame([("base",)], "id string"), spark.createDataFrame([("e",)], "id string"), ["a", "b"], ["y"], 4)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"), (F.col("l_linenumber") % 4).alias("cluster"))
    return applied(lines, made, found).select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"), "in_u")


@query(
    "f08_strict_json",
    "SELECT event_id AS id, CASE event_id % 5 WHEN 1 THEN 'repeated key' WHEN 2 THEN 'not finite' WHEN 3 THEN 'malformed' WHEN 4 THEN 'not finite' END AS fault, CASE WHEN event_id % 5 = 0 THEN json_extract_string(props, '$.k') END AS k FROM events",
)
def strict_json(spark, sf_dir):
    """The events' properties, four in five of them broken in one of four ways."""
    case = lambda i: F.col("event_id") % 5 == i
    inner = F.substring("props", F.lit(2), F.length("props") - 2)
    broken = F.when(case(1), F.concat(F.lit("{"), inner, F.lit(","), inner, F.lit("}"))).when(case(2), F.concat(F.lit('{"n": NaN, '), inner, F.lit("}"))).when(case(3), F.concat(F.lit("{"), inner)).when(case(4), F.concat(F.lit('{"n": 1e999, '), inner, F.lit("}"))).otherwise(F.col("props"))
    found = V.strict_documents(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), broken.alias("text")), "text")
    return found.select("id", "fault", F.try_variant_get("value", "$.k", "string").alias("k"))
