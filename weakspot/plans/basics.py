"""Queries over scans, scoring, group aggregates and ordered windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.arrays import edges_at_most, edges_under, hash_number, snap_down, snap_up
from ..operators import evaluate as E
from ..operators import regions as R
from .registry import r, registrar, rounded
from .scored import FEATURES, SCORED, STANDARD, scored, table

REGISTRY: dict = {}
query = registrar(REGISTRY)


@query("a01_csv_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def csv_scan(spark, sf_dir):
    from ..sources.files import csv_round_trip

    return csv_round_trip(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")).where("c_acctbal > 0")


@query("a03_json_documents", "SELECT conv_id, turn, role FROM conversations")
def json_documents(spark, sf_dir):
    from ..sources.files import json_round_trip

    c = json_round_trip(table(spark, sf_dir, "conversations"), "text")
    return c.select(*[F.try_variant_get("document", f"$.{n}", t).alias(n) for n, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"))])


@query("a05_a12_result_files", SCORED + " SELECT grp, count(*) AS n, round(sum(loss), 6) AS total FROM scored GROUP BY grp")
def result_files(spark, sf_dir):
    from ..sources.files import scratch, write_new

    path = scratch(spark, "result")
    write_new(rounded(scored(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.sum("loss").alias("total"))), path)
    return spark.read.parquet(path)


@query("a04_column_scan", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def column_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id")


@query("a09_digest", "SELECT page_id, sha256(html) AS digest FROM pages")
def digest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


@query("a10_manifest", "SELECT count(*) AS files, count(*) FILTER (page_id % 10 = 0) AS changed, 0::BIGINT AS missing FROM pages")
def manifest(spark, sf_dir):
    from ..sources.files import manifest_report

    found = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    listed = found.withColumn("digest", F.when(F.col("name").cast("long") % 10 == 0, F.lit("x")).otherwise(F.col("digest")))
    return manifest_report(listed, found)


@query("a11_provenance", "SELECT CAST(conv_id AS VARCHAR) AS head, role AS relation, CAST(turn AS VARCHAR) AS tail, CASE WHEN turn % 5 <> 4 THEN md5(text) END AS span FROM conversations")
def provenance(spark, sf_dir):
    """A provenance document for each conversation: a triple for each turn with the spans that say it (none for some turns)."""
    from ..operators.evidence import load_provenance

    spans = F.when(F.col("turn") % 5 != 4, F.array(F.struct(F.md5(F.col("text").cast("binary")).alias("span")), F.struct(F.lit("a later span").alias("span")))).otherwise(F.array())
    said = F.struct(F.array(F.col("conv_id").cast("string"), "role", F.col("turn").cast("string")).alias("triple"), spans.alias("evidence"))
    documents = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(said)).alias("triples"))).alias("content"))
    missing = spark.createDataFrame([("no such file", None), ("empty", "{}")], "source string, content string")
    return load_provenance(documents.union(missing)).select("head", "relation", "tail", "span")


@query("b01_slice", SCORED + " SELECT id FROM scored WHERE (x1 > 60 AND x2 >= 8) OR NOT (x3 = 1 OR x2 < 20)")
def slice_rows(spark, sf_dir):
    return scored(spark, sf_dir).where(S.slice_predicate("(x1 > 60 & x2 >= 8) | ~(x3 == 1 or x2 < 20)")).select("id")


@query("b02_stress", SCORED + " SELECT id, round(x1 * 1.1e0, 6) AS x1 FROM scored WHERE x2 < 6")
def stress(spark, sf_dir):
    return rounded(S.stress(scored(spark, sf_dir).where("x2 < 6"), "x1*1.1").select("id", "x1"))


@query("b03_standardize", STANDARD + f" SELECT id, {r('z_x1', 'z_x2')} FROM std")
def standardize(spark, sf_dir):
    return rounded(R.standardize(scored(spark, sf_dir), ["x1", "x2"]).select("id", "z_x1", "z_x2"))


@query("b03_standardize_sample", SCORED + ", mo AS (SELECT avg(x1) AS m, stddev_samp(x1) AS s FROM scored) SELECT id, round((x1 - m) / s, 6) + 0e0 AS z_x1 FROM scored, mo")
def standardize_sample(spark, sf_dir):
    return rounded(R.standardize(scored(spark, sf_dir), ["x1"], ddof=1).select("id", "z_x1"))


@query(
    "b04_b08_losses",
    SCORED
    + """ SELECT id, round(p, 6) AS p, round(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) + 0e0 AS log_loss,
round(-(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))), 6) + 0e0 AS log_score,
round((y - p) * (y - p), 6) + 0e0 AS brier, round(abs(y - p), 6) + 0e0 AS abs_error FROM scored""",
)
def losses(spark, sf_dir):
    d = scored(spark, sf_dir)
    return rounded(d.select("id", "p", S.log_loss("y", "p").alias("log_loss"), S.log_score("y", "p").alias("log_score"), S.brier("y", "p").alias("brier"), S.absolute_error("y", "p").alias("abs_error")))


@query("b09_box", SCORED + " SELECT count(*) AS n, round(avg(loss), 6) AS mean FROM scored WHERE x1 >= 40e0 AND x1 <= 120e0 AND x2 >= 6e0")
def box(spark, sf_dir):
    return rounded(scored(spark, sf_dir).where(R.Box({"x1": (40, 120), "x2": (6, None)}).predicate()).agg(F.count("*").alias("n"), F.avg("loss").alias("mean")))


BALL = R.Ball({"x1": 0.5, "x2": 0.2}, 1.1, {"x1": 50, "x2": 11.5}, {"x1": 48, "x2": 7})
DISTANCE = "round(sqrt(((x1 - 50e0) / 48e0 - 0.5e0) * ((x1 - 50e0) / 48e0 - 0.5e0) + ((x2 - 11.5e0) / 7e0 - 0.2e0) * ((x2 - 11.5e0) / 7e0 - 0.2e0)), 10)"


@query("b10_ball", SCORED + f" SELECT id FROM scored WHERE {DISTANCE} <= 1.1e0")
def ball(spark, sf_dir):
    return scored(spark, sf_dir).where(BALL.predicate()).select("id")


@query("b11_radius_router", SCORED + f", d AS (SELECT id, {DISTANCE} AS d FROM scored), k AS (SELECT d AS radius FROM d ORDER BY d LIMIT 1 OFFSET 150) SELECT id FROM d, k WHERE d < radius")
def radius_router(spark, sf_dir):
    d = scored(spark, sf_dir)
    radius = R.radius_for(d, BALL.distance(), 150)
    return d.where(R.Ball(BALL.centre, radius, BALL.mean, BALL.deviation, strict=True).predicate()).select("id")


CENTRES = [(20.0, 4.0), (60.0, 12.0), (110.0, 18.0)]
NEAREST = "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
TO_CENTRES = ", ".join(f"round((x1 - {a}e0) * (x1 - {a}e0) + (x2 - {b}e0) * (x2 - {b}e0), 10) AS d{i}" for i, (a, b) in enumerate(CENTRES))


@query("b12_centroid_router", SCORED + f", d AS (SELECT id, {TO_CENTRES} FROM scored) SELECT id, {NEAREST} AS cell FROM d")
def centroid_router(spark, sf_dir):
    return scored(spark, sf_dir).select("id", R.nearest_centre(["x1", "x2"], CENTRES).alias("cell"))


@query("b13_segments", SCORED + " SELECT id, round(CASE WHEN x1 > 80 THEN least(p * 1.2e0, 1e0) ELSE p END, 6) AS p FROM scored")
def segments(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("id", R.routed(F.col("x1") > 80, F.least(F.col("p") * 1.2, F.lit(1.0)), F.col("p")).alias("p")))


@query(
    "b14_monotone",
    SCORED
    + """, s AS (SELECT stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM scored)
SELECT 'x1' AS feature, round(avg(CASE WHEN sin((x1 + 0.25e0 * s1) / 30) - sin(x1 / 30) < -1e-9 THEN 1e0 ELSE 0e0 END), 6) AS rate FROM scored, s
UNION ALL SELECT 'x2', round(avg(CASE WHEN -1 * (cos((x2 + 0.25e0 * s2) / 5) - cos(x2 / 5)) < -1e-9 THEN 1e0 ELSE 0e0 END), 6) FROM scored, s""",
)
def monotone(spark, sf_dir):
    return rounded(S.monotone_violations(scored(spark, sf_dir), lambda c: F.sin(c["x1"] / 30) + F.cos(c["x2"] / 5), {"x1": 1, "x2": -1}))


@query("b15_guards", SCORED + " SELECT count(*) AS n, 0::BIGINT AS bad_loss, 0::BIGINT AS bad_flag, count(*) FILTER (x1 < 1 OR x1 > 200) AS range_x1 FROM scored")
def guards(spark, sf_dir):
    return S.check_losses(scored(spark, sf_dir).withColumn("flag", F.col("y") == 1), ["loss"], ["flag"], {"x1": (1, 200)})


@query("c01_totals", SCORED + " SELECT count(*) AS n, round(sum(loss), 6) AS total FROM scored")
def totals(spark, sf_dir):
    return rounded(E.totals(scored(spark, sf_dir), "loss"))


@query("c02_fold_totals", SCORED + " SELECT fold, count(*) AS n, round(sum(loss), 6) AS total FROM scored GROUP BY fold")
def fold_totals(spark, sf_dir):
    return rounded(E.fold_totals(scored(spark, sf_dir), "fold", "loss"))


SUMMARY = (
    SCORED
    + """, part AS (SELECT grp, count(*) AS n, sum(loss) AS s, sum(loss * loss) AS q, avg(y) AS prevalence FROM scored GROUP BY grp),
al AS (SELECT count(*) AS nn, sum(loss) AS ss, sum(loss * loss) AS qq FROM scored),
b AS (SELECT *, s / n AS brier, (ss - s) / (nn - n) AS rest_brier FROM part, al),
v AS (SELECT *, sqrt((q - n * brier * brier) / (n - 1) / n + (qq - q - (nn - n) * rest_brier * rest_brier) / (nn - n - 1) / (nn - n)) AS se FROM b),
summary AS (SELECT grp, n, n / nn::DOUBLE AS share, brier, rest_brier, brier - ss / nn AS excess, brier - rest_brier AS gap, se, brier - rest_brier - 1.96e0 * se AS low, brier - rest_brier + 1.96e0 * se AS high, brier / rest_brier - 1 AS inflation, prevalence FROM v)"""
)
SUMMARY_COLUMNS = ("share", "brier", "rest_brier", "excess", "gap", "se", "low", "high", "inflation", "prevalence")


@query("c06_cluster_summary", SUMMARY + f" SELECT grp, n, {r(*SUMMARY_COLUMNS)} FROM summary")
def cluster_summary(spark, sf_dir):
    return rounded(E.cluster_summary(scored(spark, sf_dir), "grp", "y", "loss"))


AUC_BY = """, rk AS (SELECT {by} p, y, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({part2} p) - 1) / 2e0 AS rk FROM scored),
auc AS (SELECT {by} (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) AS auc FROM rk {group})"""
AUC_GRP = AUC_BY.format(by="grp,", part="PARTITION BY grp", part2="PARTITION BY grp,", group="GROUP BY grp")
AUC_ALL = AUC_BY.format(by="", part="", part2="PARTITION BY", group="")


@query("c07_cluster_metrics", SUMMARY + AUC_GRP + f", o AS (SELECT avg(y) AS overall_prevalence FROM scored) SELECT grp, n, {r(*SUMMARY_COLUMNS, 'auc', 'overall_prevalence')} FROM summary JOIN auc USING (grp), o")
def cluster_metrics(spark, sf_dir):
    return rounded(E.cluster_metrics(scored(spark, sf_dir), "grp", "y", "p", "loss"))


LS = "-(y * ln(least(greatest({0}, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest({0}, 1e-12), 1 - 1e-12)))"
H = "-(least(greatest(rate, 1e-12), 1 - 1e-12) * ln(least(greatest(rate, 1e-12), 1 - 1e-12)) + (1 - least(greatest(rate, 1e-12), 1 - 1e-12)) * ln(1 - least(greatest(rate, 1e-12), 1 - 1e-12)))"


@query(
    "c08_cluster_weakness",
    SCORED
    + f""", l AS (SELECT grp, y, p, {LS.format('p')} AS ls, {LS.format('0.2e0')} AS lb FROM scored),
part AS (SELECT grp, count(*) AS n, avg(y) AS rate, avg(p) AS mean_pred, avg(ls) AS score, avg(lb) AS base_score, sum(ls) AS s FROM l GROUP BY grp),
al AS (SELECT avg(ls) AS mean, sum(ls) AS total FROM l), k AS (SELECT CAST(range AS INT) AS grp FROM range(10)),
j AS (SELECT grp, coalesce(n, 0) AS n, rate, mean_pred, {H} AS entropy, score, base_score, score - {H} AS excess, base_score - score AS improvement, score / mean AS lift, coalesce(s / total, 0) AS coverage FROM k LEFT JOIN part USING (grp), al)
SELECT grp, n, {r('rate', 'mean_pred', 'entropy', 'score', 'base_score', 'excess', 'improvement', 'lift', 'coverage')} FROM j""",
)
def cluster_weakness(spark, sf_dir):
    return rounded(E.cluster_weakness(scored(spark, sf_dir).withColumn("base", F.lit(0.2)), "grp", "y", "p", "base", 10))


@query(
    "c09_error_report",
    SCORED
    + f""", l AS (SELECT grp, y, p, {LS.format('p')} AS ls FROM scored), al AS (SELECT count(*) AS nn, avg(ls) AS mean FROM l)
SELECT grp, count(*) AS n, round(count(*) / any_value(nn)::DOUBLE, 6) AS share, round(avg(y), 6) AS event_rate, round(avg(p), 6) AS mean_pred, round(avg(ls), 6) AS logloss, round(avg(ls) / any_value(mean), 6) AS logloss_ratio FROM l, al GROUP BY grp""",
)
def error_report(spark, sf_dir):
    return rounded(E.cluster_error_report(scored(spark, sf_dir), "grp", "y", "p"))


MASK_SQL = {"late": "x2 >= 18", "large": "x1 > 90", "both": "x2 >= 12 AND x1 > 60", "buyers": "y = 1", "few": "id < 20", "none": "false"}


def masks() -> dict:
    return {name: F.expr(text) for name, text in MASK_SQL.items()}


LIFTS = (
    SCORED
    + ", b AS (SELECT avg(loss) AS base FROM scored), t AS (SELECT sum(greatest(loss - base, 0)) AS total FROM scored, b), lifts AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS region, count(*) FILTER ({m}) AS support, avg(loss) FILTER ({m}) / any_value(base) AS lift, coalesce(sum(greatest(loss - base, 0)) FILTER ({m}), 0) / any_value(total) AS coverage FROM scored, b, t" for n, m in MASK_SQL.items()
    )
    + ")"
)


@query("c10_lift_coverage", LIFTS + f" SELECT region, support, {r('lift', 'coverage')} FROM lifts")
def lift_coverage(spark, sf_dir):
    return rounded(E.lift_and_coverage(scored(spark, sf_dir), "loss", masks()))


@query("c11_auc", SCORED + AUC_ALL + " SELECT round(auc, 6) AS auc FROM auc")
def auc(spark, sf_dir):
    return rounded(E.auc(scored(spark, sf_dir), "y", "p"))


@query("c12_fit", SCORED + " SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0e0 AS r2 FROM scored")
def fit(spark, sf_dir):
    return rounded(E.r_squared(scored(spark, sf_dir), "y", "p"))


@query("c13_quantiles", SCORED + " SELECT round(quantile_cont(loss, 0.9), 6) AS q90, round(quantile_cont(loss, 0.5), 6) AS median FROM scored")
def quantiles(spark, sf_dir):
    return rounded(scored(spark, sf_dir).agg(F.percentile("loss", 0.9).alias("q90"), F.percentile("loss", 0.5).alias("median")))


RANKS = ", rk AS (SELECT id, x1, x2, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2e0 AS ra, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2e0 AS rb FROM scored)"


@query("c14_correlations", SCORED + RANKS + " SELECT round(corr(x1, x2), 6) + 0e0 AS pearson, round(corr(ra, rb), 6) + 0e0 AS spearman FROM rk")
def correlations(spark, sf_dir):
    d = scored(spark, sf_dir)
    return rounded(d.agg(F.corr("x1", "x2").alias("pearson")).crossJoin(E.spearman(d, "x1", "x2")))


@query("c15_distinct", SCORED + " SELECT count(DISTINCT x1) AS values, count(DISTINCT (x2, x3)) AS pairs FROM scored")
def distinct(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count_distinct("x1").alias("values"), F.count_distinct("x2", "x3").alias("pairs"))


@query("c16_histogram", SCORED + ", b AS (SELECT CAST(range AS INT) AS bin FROM range(6)), c AS (SELECT (x1 >= 10)::INT + (x1 >= 30)::INT + (x1 >= 80)::INT + (x1 >= 150)::INT + (x1 >= 9999)::INT AS bin, count(*) AS n FROM scored GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)")
def histogram(spark, sf_dir):
    return E.histogram(scored(spark, sf_dir), "x1", [10, 30, 80, 150, 9999])


JS = (
    SCORED
    + """, lng AS (SELECT x1 > 60 AS inside, 'x1' AS feature, x1 AS x FROM scored UNION ALL SELECT x1 > 60, 'x2', x2 FROM scored UNION ALL SELECT x1 > 60, 'x3', x3 FROM scored),
cuts AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS cuts FROM lng GROUP BY feature),
bn AS (SELECT feature, inside, CAST(len(list_filter(cuts, lambda c: c <= x)) AS INT) AS bin FROM lng JOIN cuts USING (feature)),
cell AS (SELECT feature, bin, count(*) FILTER (inside) AS a, count(*) FILTER (NOT inside) AS b FROM bn GROUP BY ALL),
pq AS (SELECT feature, bin, a / sum(a) OVER (PARTITION BY feature)::DOUBLE AS p, b / sum(b) OVER (PARTITION BY feature)::DOUBLE AS q FROM cell),
js AS (SELECT feature, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js FROM pq GROUP BY feature),
top AS (SELECT feature, bin AS top_bin, p AS region_share, q AS rest_share, en AS enrichment FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY coalesce(en, -1e0) DESC, bin) AS k FROM (SELECT feature, bin, p, q, round(p / nullif(q, 0), 10) AS en FROM pq)) WHERE k = 1),
md AS (SELECT feature, avg(x) FILTER (inside) AS region_mean, avg(x) FILTER (NOT inside) AS rest_mean, quantile_cont(x, 0.5) FILTER (inside) AS region_median, quantile_cont(x, 0.5) FILTER (NOT inside) AS rest_median FROM lng GROUP BY feature)"""
)


@query("c17_js_profile", JS + f" SELECT feature, top_bin, {r('js', 'region_share', 'rest_share', 'enrichment', 'region_mean', 'rest_mean', 'region_median', 'rest_median')} FROM js JOIN top USING (feature) JOIN md USING (feature)")
def js_profile(spark, sf_dir):
    return rounded(E.js_profile(scored(spark, sf_dir), F.col("x1") > 60, FEATURES))


@query(
    "c18_adjusted_rand",
    SCORED
    + """, c AS (SELECT grp, fold, count(*) AS c FROM scored GROUP BY ALL), j AS (SELECT sum(c * (c - 1) / 2e0) AS j, sum(c) AS n FROM c),
a AS (SELECT sum(c * (c - 1) / 2e0) AS a FROM (SELECT sum(c) AS c FROM c GROUP BY grp)), b AS (SELECT sum(c * (c - 1) / 2e0) AS b FROM (SELECT sum(c) AS c FROM c GROUP BY fold))
SELECT round((j - a * b / (n * (n - 1) / 2e0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2e0)), 6) + 0e0 AS ari FROM j, a, b""",
)
def adjusted_rand(spark, sf_dir):
    return rounded(E.adjusted_rand(scored(spark, sf_dir), "grp", "fold"))


@query("c19_jaccard", SCORED + " SELECT round(count(*) FILTER (x1 > 60 AND x2 > 12) / count(*) FILTER (x1 > 60 OR x2 > 12)::DOUBLE, 6) AS jaccard FROM scored")
def jaccard(spark, sf_dir):
    return rounded(E.jaccard(scored(spark, sf_dir), F.col("x1") > 60, F.col("x2") > 12))


DIST = "sqrt(list_sum(list_transform(list_zip(u.v, w.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(
    "c20_energy",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), a AS (SELECT * FROM v WHERE vec_id % 2 = 0), b AS (SELECT * FROM v WHERE vec_id % 2 = 1)
SELECT round(2 * (SELECT avg({DIST}) FROM a AS u, b AS w) - (SELECT avg({DIST}) FROM a AS u, a AS w) - (SELECT avg({DIST}) FROM b AS u, b AS w), 6) AS energy""",
)
def energy(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(E.energy_distance(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "v"))


@query("c21_crosstab", SCORED + " SELECT grp, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'discovery') AS discovery, count(*) FILTER (split = 'confirm') AS confirm FROM scored GROUP BY grp")
def crosstab(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("grp").pivot("split", ["train", "discovery", "confirm"]).agg(F.count("id"))


@query("c22_named_aggregates", SCORED + " SELECT split, count(*) AS cases, sum(y)::BIGINT AS events, round(max(loss), 6) AS worst FROM scored GROUP BY split")
def named_aggregates(spark, sf_dir):
    return rounded(scored(spark, sf_dir).groupBy("split").agg(F.count("*").alias("cases"), F.sum("y").alias("events"), F.max("loss").alias("worst")))


@query("c24_effective_sample", SCORED + " SELECT grp, round(sum(loss) * sum(loss) / sum(loss * loss), 6) AS ess FROM scored GROUP BY grp")
def effective_sample(spark, sf_dir):
    return rounded(E.effective_sample(scored(spark, sf_dir), "grp", "loss"))


@query("c27_interval_coverage", SCORED + " SELECT round(avg(CASE WHEN abs(y - p) <= 1.645e0 * 0.3e0 THEN 1e0 ELSE 0e0 END), 6) AS covered, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM scored")
def interval_coverage(spark, sf_dir):
    return rounded(E.interval_coverage(scored(spark, sf_dir).withColumn("sd", F.lit(0.3)), "y", "p", "sd", 1.645))


@query("c28_cube", SCORED + " SELECT split, grp, count(*) AS n FROM scored GROUP BY CUBE (split, grp)")
def cube(spark, sf_dir):
    return scored(spark, sf_dir).cube("split", "grp").agg(F.count("*").alias("n"))


@query("w09_round_robin", "SELECT event_id, CAST((row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1) % 7 AS INT) AS fold FROM events WHERE event_type = 'purchase'")
def round_robin(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("h"))
    return R.round_robin(e, ["h", "event_id"], 7).select("event_id", "fold")


@query("w10_average_ranks", SCORED + RANKS + " SELECT id, rb FROM rk")
def average_ranks(spark, sf_dir):
    return E.average_ranks(scored(spark, sf_dir), "x2", "rb").select("id", "rb")


@query("j07_range_lookup", SCORED + " SELECT id, (x1 >= 10)::INT + (x1 >= 30)::INT + (x1 >= 80)::INT AS high, (x1 > 10)::INT + (x1 > 30)::INT + (x1 > 80)::INT AS low FROM scored")
def range_lookup(spark, sf_dir):
    cuts = F.array(F.lit(10.0), F.lit(30.0), F.lit(80.0))
    return scored(spark, sf_dir).select("id", edges_at_most(cuts, F.col("x1")).alias("high"), edges_under(cuts, F.col("x1")).alias("low"))


@query("f03_entropy", SCORED + f", g AS (SELECT grp, avg(y) AS rate FROM scored GROUP BY grp) SELECT grp, round({H}, 6) AS h FROM g")
def entropy(spark, sf_dir):
    return rounded(scored(spark, sf_dir).groupBy("grp").agg(F.avg("y").alias("rate")).select("grp", S.entropy("rate").alias("h")))


@query("f12_snapping", SCORED + " SELECT id, list_max(list_filter([10e0, 30e0, 80e0], lambda e: e <= x1)) AS lo, list_min(list_filter([10e0, 30e0, 80e0], lambda e: e >= x1)) AS hi FROM scored")
def snapping(spark, sf_dir):
    cuts = F.array(F.lit(10.0), F.lit(30.0), F.lit(80.0))
    return scored(spark, sf_dir).select("id", snap_down(cuts, F.col("x1")).alias("lo"), snap_up(cuts, F.col("x1")).alias("hi"))


@query("f11_map_profile", SCORED + ", a AS (SELECT grp, round(avg(x1), 4) AS v1, round(avg(x2), 4) AS v2 FROM scored GROUP BY grp) SELECT grp, 'x1' AS feature, v1 AS value FROM a UNION ALL SELECT grp, 'x2', v2 FROM a")
def map_profile(spark, sf_dir):
    m = scored(spark, sf_dir).groupBy("grp").agg(F.map_from_arrays(F.array(F.lit("x1"), F.lit("x2")), F.array(F.round(F.avg("x1"), 4), F.round(F.avg("x2"), 4))).alias("profile"))
    return m.select("grp", F.explode("profile").alias("feature", "value"))


@query("f13_clamped_profile", SCORED + " SELECT id, round(least(greatest(x1, 5e0), 120e0), 4) AS x1 FROM scored")
def clamped_profile(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round(S.clip("x1", 5.0, 120.0), 4).alias("x1"))


@query("f09_hash_number", "SELECT event_id, ('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|s'), 1, 8))::BIGINT AS h FROM events")
def hash_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hash_number(F.col("event_id").cast("string"), F.lit("s")).alias("h"))


@query("g01_bin_grid", SCORED + " SELECT round(unnest(list_distinct(quantile_cont(x1, [0.2, 0.4, 0.6, 0.8]))), 6) AS edge FROM scored")
def bin_grid(spark, sf_dir):
    return R.bin_grid(scored(spark, sf_dir), "x1", 5).select(F.explode("edges").alias("edge")).select(F.round("edge", 6).alias("edge"))


@query("g01_bin_grid_few", SCORED + ", v AS (SELECT DISTINCT x2 AS v FROM scored), m AS (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM v) SELECT (v + w) / 2 AS edge FROM m WHERE w IS NOT NULL")
def bin_grid_few(spark, sf_dir):
    return R.bin_grid(scored(spark, sf_dir), "x2", 24).select(F.explode("edges").alias("edge"))


@query("g02_freeze_box", SCORED + " SELECT count(*) AS support, round(avg(loss), 6) AS mean FROM scored WHERE x1 >= 20e0 AND x1 <= 160e0 AND x2 <= 20e0")
def freeze_box(spark, sf_dir):
    rule = R.freeze_box({"x1": 0.5, "x2": 0.0}, {"x1": 1.0, "x2": 2.0}, 1.0, {"x1": (50.0, 48.0), "x2": (11.5, 3.5)}, {"x1": [20.0, 60.0, 100.0, 160.0], "x2": [6.0, 12.0, 20.0]})
    return rounded(scored(spark, sf_dir).where(rule.predicate()).agg(F.count("*").alias("support"), F.avg("loss").alias("mean")))


@query(
    "g05_stratified_split",
    SCORED
    + """, h AS (SELECT id, y, ('0x' || substr(md5(CAST(id AS VARCHAR) || '|7'), 1, 8))::UBIGINT AS h FROM scored),
q AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY h, id) - 1) / count(*) OVER (PARTITION BY y)::DOUBLE AS q FROM h)
SELECT id, CASE WHEN q < 0.5 - 1e-12 THEN 'train' WHEN q < 0.75 - 1e-12 THEN 'discovery' ELSE 'confirm' END AS split FROM q""",
)
def stratified_split(spark, sf_dir):
    return R.stratified_split(scored(spark, sf_dir).drop("split"), "id", "y", {"train": 0.5, "discovery": 0.25, "confirm": 0.25}, "7").select("id", "split")


@query("g08_constant_features", SCORED + " SELECT 'c' AS feature")
def constant_features(spark, sf_dir):
    found = R.constant_features(scored(spark, sf_dir).withColumn("c", F.lit(1.0)), ["x1", "x2", "c"])
    return spark.createDataFrame([(f,) for f in found], "feature string")


@query("u01_union", SCORED + " SELECT split, count(*) AS n FROM scored WHERE split IN ('train', 'discovery') GROUP BY split")
def union(spark, sf_dir):
    d = scored(spark, sf_dir)
    return d.where("split = 'train'").unionByName(d.where("split = 'discovery'")).groupBy("split").agg(F.count("*").alias("n"))


@query("t01_ranked_features", JS + " SELECT feature, round(js, 6) AS js FROM js ORDER BY js DESC LIMIT 2")
def ranked_features(spark, sf_dir):
    return rounded(E.js_profile(scored(spark, sf_dir), F.col("x1") > 60, FEATURES).orderBy(F.desc("js")).limit(2).select("feature", "js"))


@query("w08_running_best", SCORED + " SELECT id, grp, round(max(loss) OVER (PARTITION BY grp ORDER BY id), 6) AS best FROM scored")
def running_best(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("id", "grp", F.max("loss").over(Window.partitionBy("grp").orderBy("id")).alias("best")))
