"""Queries over frozen trees: leaf codes, kernels, medoids, routers, region scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as T
from .registry import r, registrar, rounded
from .scored import SCORED, members_sql, scored
from .search import members

REGISTRY: dict = {}
query = registrar(REGISTRY)

TREES = [
    T.Split("x1", 40, T.Split("x2", 8, T.Leaf(0, 0.02), T.Leaf(1, -0.01)), T.Split("x1", 100, T.Leaf(2, 0.05), T.Leaf(3, 0.12))),
    T.Split("x2", 12, T.Split("x3", 3, T.Leaf(0, -0.03), T.Leaf(1, 0.01)), T.Split("x1", 60, T.Leaf(2, 0.02), T.Leaf(3, 0.07))),
    T.Split("x3", 5, T.Split("x1", 25, T.Leaf(0, 0.0), T.Leaf(1, 0.04)), T.Split("x2", 18, T.Leaf(2, -0.02), T.Leaf(3, 0.03))),
]
WEIGHTS = [0.5, 0.3, 0.2]
MEDOIDS = [[0, 0, 0], [2, 2, 1], [3, 3, 3], [1, 2, 2]]
MEDOID_VALUES = [[0.02, -0.03, 0.0], [0.05, 0.02, 0.04], [0.12, 0.07, 0.03], [-0.01, 0.02, -0.02]]

CODED = SCORED + ", coded AS (SELECT id, y, x1, x2, x3, loss, " + ", ".join(f"{T.sql(t)} AS c{i}, {T.sql(t, 'value')} AS v{i}" for i, t in enumerate(TREES)) + " FROM scored)"
LONG = CODED + ", emb AS (" + " UNION ALL ".join(f"SELECT id, {i} AS tree, c{i} AS leaf, v{i} AS value FROM coded" for i in range(len(TREES))) + ")"


def coded(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("codes", T.codes(TREES)).withColumn("vals", F.array(*map(T.value, TREES)))


@query("l02_leaf_codes", CODED + " SELECT id, c0, c1, c2 FROM coded")
def leaf_codes(spark, sf_dir):
    return coded(spark, sf_dir).select("id", *[F.get("codes", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query("l03_additive_score", CODED + " SELECT id, round(0.1e0 + v0 + v1 + v2, 6) + 0e0 AS score FROM coded")
def additive(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("id", T.additive(TREES, 0.1).alias("score")))


@query("l03_leaf_table", LONG + " SELECT tree, leaf, round(value, 6) + 0e0 AS value, count(*) AS n FROM emb GROUP BY ALL")
def leaf_table(spark, sf_dir):
    n = T.embedding(scored(spark, sf_dir), "id", TREES).groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    return rounded(T.leaf_table(spark, TREES).join(n, ["tree", "leaf"]))


@query("l04_embedding", LONG + " SELECT id, tree, leaf, round(value, 6) + 0e0 AS value FROM emb")
def embedding(spark, sf_dir):
    return rounded(T.embedding(scored(spark, sf_dir), "id", TREES))


CLASSES = CODED + ", cl AS (SELECT c0, c1, c2, min(id) AS least, count(*) AS n FROM coded GROUP BY ALL)"


@query(
    "j03_leaf_kernel",
    CLASSES + ", k AS (SELECT a.least AS a, b.least AS b, a.n AS n_a, b.n AS n_b, CAST(a.c0 = b.c0 AS INT) + CAST(a.c1 = b.c1 AS INT) + CAST(a.c2 = b.c2 AS INT) AS met FROM cl AS a CROSS JOIN cl AS b) SELECT a, b, n_a, n_b, round(met / 3e0, 6) AS similarity FROM k WHERE met > 0",
)
def leaf_kernel(spark, sf_dir):
    return rounded(T.class_kernel(coded(spark, sf_dir), "id", "codes"))


@query("j03_leaf_classes", CLASSES + " SELECT id, least AS class FROM coded JOIN cl USING (c0, c1, c2)")
def leaf_classes(spark, sf_dir):
    return T.class_of(coded(spark, sf_dir), "id", "codes")


def nearest_sql(distances: list[str]) -> str:
    names = [f"d{i}" for i in range(len(distances))]
    pick = " ".join(f"WHEN {n} = least({', '.join(names)}) THEN {i}" for i, n in enumerate(names))
    return ", dd AS (SELECT id, loss, " + ", ".join(f"round({d}, 10) AS d{i}" for i, d in enumerate(distances)) + f" FROM coded), near AS (SELECT id, loss, CAST(CASE {pick} END AS INT) AS medoid, least({', '.join(names)}) AS distance FROM dd)"


def mismatch_sql(medoid, weights):
    return "(" + " + ".join(f"CASE WHEN c{i} <> {m} THEN {w}e0 ELSE 0e0 END" for i, (m, w) in enumerate(zip(medoid, weights, strict=True))) + f") / {sum(weights)}e0"


@query("j04_medoid_assignment", CODED + nearest_sql([mismatch_sql(m, [1, 1, 1]) for m in MEDOIDS]) + " SELECT id, medoid, round(distance, 6) AS distance FROM near")
def medoids(spark, sf_dir):
    return rounded(T.assign(coded(spark, sf_dir), "id", "codes", MEDOIDS))


@query("l05_gain_weighted", CODED + nearest_sql([mismatch_sql(m, WEIGHTS) for m in MEDOIDS]) + " SELECT medoid, count(*) AS n, round(avg(distance), 6) AS distance FROM near GROUP BY medoid")
def gain_weighted(spark, sf_dir):
    a = T.assign(coded(spark, sf_dir), "id", "codes", MEDOIDS, WEIGHTS)
    return rounded(a.groupBy("medoid").agg(F.count("*").alias("n"), F.avg("distance").alias("distance")))


@query("l05_embedded_distance", CODED + " SELECT id, round(sqrt(" + " + ".join(f"CASE WHEN c{i} <> {m} THEN v{i} * v{i} + {v * v!r} ELSE 0e0 END" for i, (m, v) in enumerate(zip(MEDOIDS[1], MEDOID_VALUES[1], strict=True))) + "), 6) AS distance FROM coded")
def embedded_distance(spark, sf_dir):
    return rounded(coded(spark, sf_dir).select("id", T.embedded_distance(F.col("codes"), F.col("vals"), MEDOIDS[1], MEDOID_VALUES[1]).alias("distance")))


@query(
    "w04_b16_leaf_neighbours",
    CODED
    + f""", sm AS (SELECT 0 AS anchor, id, x1, round(1 - {mismatch_sql(MEDOIDS[1], [1, 1, 1])}, 10) AS similarity FROM coded UNION ALL SELECT 1, id, x1, round(1 - {mismatch_sql(MEDOIDS[2], [1, 1, 1])}, 10) FROM coded)
SELECT anchor, id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY similarity DESC, round(abs(x1 - 50e0), 10), id) AS k FROM sm) WHERE k <= 120""",
)
def leaf_neighbours(spark, sf_dir):
    return rounded(T.leaf_neighbours(coded(spark, sf_dir), "id", "codes", {0: MEDOIDS[1], 1: MEDOIDS[2]}, 120, F.round(F.abs(F.col("x1") - 50.0), 10)))


@query("b16_leaf_region", CODED + f" SELECT id FROM coded WHERE round(1 - {mismatch_sql(MEDOIDS[2], [1, 1, 1])}, 10) >= 0.6")
def leaf_region(spark, sf_dir):
    return coded(spark, sf_dir).where(F.round(1 - T.distance_to(F.col("codes"), MEDOIDS[2]), 10) >= 0.6).select("id")


@query(
    "l06_leaf_router",
    LONG
    + """, lb AS (SELECT id, CAST(grp AS INT) AS cluster FROM scored WHERE split = 'train'), sz AS (SELECT cluster, count(*) AS k FROM lb GROUP BY cluster),
me AS (SELECT cluster, tree, leaf, count(*) / any_value(k)::DOUBLE AS w FROM emb JOIN lb USING (id) JOIN sz USING (cluster) GROUP BY ALL),
sc AS (SELECT id, cluster, round(sum(w), 10) AS s FROM emb JOIN me USING (tree, leaf) GROUP BY ALL)
SELECT id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cluster) AS k FROM sc) WHERE k = 1""",
)
def leaf_router(spark, sf_dir):
    d = scored(spark, sf_dir)
    e = T.embedding(d, "id", TREES)
    return T.route(e, T.router(e, d.where("split = 'train'").select("id", F.col("grp").alias("cluster")), "id"), "id")


@query("l08_region_score", members_sql() + ", p AS (SELECT id, 0.1e0 + " + " + ".join(T.sql(t, "value") for t in TREES) + " AS s FROM scored) SELECT cand, round(avg(s), 6) AS score FROM members JOIN p USING (id) GROUP BY cand")
def region_score(spark, sf_dir):
    s = scored(spark, sf_dir).select("id", T.additive(TREES, 0.1).alias("s"))
    return rounded(members(spark, sf_dir).join(s, "id").groupBy("cand").agg(F.avg("s").alias("score")))


@query(
    "t02_interactions",
    CODED + ", g AS (SELECT count(*) * var_pop(v0) AS g0, count(*) * var_pop(v1) AS g1, count(*) * var_pop(v2) AS g2 FROM coded) SELECT t.f, t.g, round(CASE WHEN t.f = 'x1' AND t.g = 'x2' THEN g0 ELSE 0 END + (g1 + g2) / 3, 6) AS gain FROM g, (VALUES ('x1', 'x2'), ('x1', 'x3'), ('x2', 'x3')) AS t(f, g)",
)
def interactions(spark, sf_dir):
    """A tree's gain: what its values add to the variance of the score over all rows."""
    one = scored(spark, sf_dir).agg(*[(F.count("*") * F.var_pop(T.value(t))).alias(f"g{i}") for i, t in enumerate(TREES)]).first()
    return T.interactions(spark, TREES, list(map(float, one))).withColumn("gain", F.round("gain", 6))


@query("l10_medoids")
def pam(spark, sf_dir):
    import numpy as np

    pool = T.code_classes(coded(spark, sf_dir), "id", "codes")
    found, total = T.pam(T.dissimilarity(np.array([c for c, _, _ in pool])), 4, counts=[n for _, _, n in pool])
    return spark.createDataFrame([(i, pool[m][1], total) for i, m in enumerate(found)], "place int, row long, inertia double")


@query("c06_medoid_clusters", CODED + nearest_sql([mismatch_sql(m, [1, 1, 1]) for m in MEDOIDS]) + f" SELECT medoid, count(*) AS n, {r('brier')} FROM (SELECT medoid, loss, avg(loss) OVER (PARTITION BY medoid) AS brier FROM near) GROUP BY medoid, brier")
def medoid_clusters(spark, sf_dir):
    d = coded(spark, sf_dir)
    return rounded(T.assign(d, "id", "codes", MEDOIDS).join(d.select("id", "loss"), "id").groupBy("medoid").agg(F.count("*").alias("n"), F.avg("loss").alias("brier")))


@query("l01_error_model")
def error_model(spark, sf_dir):
    from ..operators.models import fit_error_model

    d = scored(spark, sf_dir)
    model = fit_error_model(d.where("split = 'train'"), ["x1", "x2", "x3"], "loss", trees=8)
    return model.score(d.where("split = 'confirm'")).select("id", "score")


@query("l20_logistic")
def logistic(spark, sf_dir):
    from ..operators.models import fit_logistic

    d = scored(spark, sf_dir)
    return fit_logistic(d.where("split = 'train'"), ["x1", "x2", "x3"], "y").score(d.where("split = 'confirm'")).select("id", "score")


@query("l14_monotone_mixture")
def monotone_mixture(spark, sf_dir):
    """Fitted on the train split; score, gate and part of the confirm split."""
    from ..operators.estimators import MonotoneMixture

    d = scored(spark, sf_dir)
    model = MonotoneMixture(features=["x1", "x2"], signs=[1, 0], clusters=2, folds=3, gateTrees=8, gateRate=0.3, trees=4, rate=0.2).fit(d.where("split = 'train'"))
    return model.transform(d.where("split = 'confirm'")).select("id", "score", "score_gate", "score_cluster")


@query("g06_twin_folds")
def twin_folds(spark, sf_dir):
    from ..operators.twinning import twin_folds

    return twin_folds(scored(spark, sf_dir), "id", ["x1", "x2"], 5).select("id", "fold")


@query("l11_kmeans")
def kmeans(spark, sf_dir):
    from ..operators.models import kmeans

    return kmeans(scored(spark, sf_dir), ["x1", "x2"], 4, starts=2).select("id", "cluster")


@query("a06_model_files", CODED + " SELECT id, round(0.1e0 + v0 + v1 + v2, 6) + 0e0 AS score FROM coded")
def model_files(spark, sf_dir):
    from ..sources.files import scratch

    path = scratch(spark, "trees")
    T.save(spark, TREES, path)
    return rounded(scored(spark, sf_dir).select("id", T.additive(T.load(spark, path), 0.1).alias("score")))


@query("g07_twin_split")
def twin_split(spark, sf_dir):
    from ..operators.twinning import twin_split

    return twin_split(scored(spark, sf_dir), "id", ["x1", "x2"], 4).select("id", "twin")


@query("g07_multiplets")
def multiplets(spark, sf_dir):
    """All three strategies over all events."""
    from ..operators.twinning import every_multiplets

    found = every_multiplets(scored(spark, sf_dir).select("id", "x1", "x2"), "id", ["x1", "x2"], 4)
    return found.select("id", F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"part_{s}").alias("part")) for s in (1, 2, 3)])))


def halved_sql(features: list[str], levels: int) -> str:
    """Each block halved at the median rank of its widest feature, unrolled."""
    out = ", k0 AS (SELECT *, 0 AS block FROM scored)"
    for i in range(levels):
        wide = ", ".join(f"max({f}) - min({f}) AS w{j}" for j, f in enumerate(features))
        pick = " ".join(f"WHEN w{j} = greatest({', '.join(f'w{x}' for x in range(len(features)))}) THEN {f}" for j, f in enumerate(features))
        out += f""", s{i} AS (SELECT block, count(*) AS n, {wide} FROM k{i} GROUP BY block),
k{i + 1} AS (SELECT scored.*, 2 * block + CASE WHEN 2 * (row_number() OVER (PARTITION BY block ORDER BY v, id) - 1) >= n THEN 1 ELSE 0 END AS block FROM (SELECT id, block, n, CASE {pick} END AS v FROM k{i} JOIN s{i} USING (block)) JOIN scored USING (id))"""
    return out


@query("w12_blocks", SCORED + halved_sql(["x2", "x3", "x1"], 4) + " SELECT id, block::BIGINT AS block FROM k4")
def kd_blocks(spark, sf_dir):
    """Sixteen blocks; two of the features have few values, so that most cuts go through ties."""
    from ..operators.twinning import blocks

    return blocks(scored(spark, sf_dir).select("id", "x1", "x2", "x3"), "id", ["x2", "x3", "x1"], 4).select("id", "block")
