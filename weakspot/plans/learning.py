"""Queries over searches and models whose results SQL can't express; tests hold them against their invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import anchors as A
from ..operators import discovery as D
from ..operators import error_tree as B
from ..operators import leaf_mixture as K
from ..operators import mixtures as X
from ..operators import models as M
from ..operators import surrogate as U
from ..operators import trees as T
from ..operators import twinning as W
from .leaves import CLASSES, CODED, MEDOIDS, TREES, coded
from .registry import registrar, rounded
from .scored import MEASURED, SCORED, candidates, scored
from .search import standard

REGISTRY: dict = {}
query = registrar(REGISTRY)


@query("g03_sample_candidates")
def sample(spark, sf_dir):
    found = D.sample_candidates(standard(spark, sf_dir), ["z_x1", "z_x2"], "id", 12)
    return spark.createDataFrame([(i, z, w) for i, (z, w) in enumerate(found)], "cand int, z array<double>, w array<double>")


@query("g04_fold_archive")
def archive(spark, sf_dir):
    """Centres drawn from ten twin folds in turn."""
    found = W.fold_archive(standard(spark, sf_dir), "id", ["z_x1", "z_x2"], 10, 12)
    return found.select(F.col("place").alias("cand"), "fold", F.array("z_x1", "z_x2").alias("z"))


@query("g10_required_support")
def required_support(spark, sf_dir):
    return spark.createDataFrame([(D.required_support_of(scored(spark, sf_dir).where("fold = 0"), "loss", [25, 50, 100, 200, 400], 0.05),)], "m int")


def space(spark, sf_dir, split: str = "discovery", m: int = 60) -> U.RegionSpace:
    """Regions of a split, with the leaves of an error model fitted to the train split."""
    d = standard(spark, sf_dir)
    model = M.fit_error_model(d.where("split = 'train'"), ["z_x1", "z_x2"], "loss", trees=8)
    return U.RegionSpace(d.where(F.col("split") == split), ["z_x1", "z_x2"], "id", "loss", model.trees, m)


BASE = ([0.9, 0.5], [0.5, 0.5])


@query("s07_bayes_search")
def bayes(spark, sf_dir):
    s = space(spark, sf_dir)
    start = D.sample_candidates(s.rows, s.features, "id", 4)
    found = U.bayes_search(s, start, s.n + 9 * s.m, pool=256, refit_every=2)
    return spark.createDataFrame([(*h, None if np.isnan(o) else o) for h, o in zip(found.history, found.overlaps, strict=True)], "step int, reads long, contrast double, best double, overlap double")


@query("s08_leaf_contrasts")
def leaf_contrasts(spark, sf_dir):
    return D.leaf_contrasts(coded(spark, sf_dir), "id", "codes", "loss", dict(enumerate(MEDOIDS)), 120, F.round(F.abs(F.col("x1") - 50.0), 10))


def filled_sql(anchors: str, m: int, weights) -> str:
    """Contrasts of anchors (a table of anchor, a0, a1, a2) over the classes of leaf codes."""
    level = " + ".join(f"CASE WHEN c{i} = a{i} THEN {w} ELSE 0 END" for i, w in enumerate(weights))
    return f""", cs AS (SELECT c0, c1, c2, count(*) AS n, sum(loss) AS s FROM coded GROUP BY ALL),
tot AS (SELECT sum(n)::BIGINT AS nn, sum(s) AS ss FROM cs),
lv AS (SELECT anchor, {level} AS level, sum(n)::BIGINT AS n, sum(s) AS s FROM {anchors} CROSS JOIN cs GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY anchor ORDER BY level DESC) - n AS before FROM lv),
tk AS (SELECT *, greatest(0, least(n, {m} - before)) AS take FROM cu),
hd AS (SELECT anchor, sum(s * take / n) AS inside, min(level) FILTER (take > 0) AS least FROM tk GROUP BY anchor),
filled AS (SELECT anchor, inside / {m} / nullif((ss - inside) / nullif(nn - {m}, 0), 0e0) - 1 AS contrast, least / {sum(weights)}e0 AS threshold FROM hd, tot)"""


@query(
    "s08_exhaustive_contrasts",
    CLASSES + ", ac AS (SELECT least AS anchor, c0 AS a0, c1 AS a1, c2 AS a2, n AS n_anchor FROM cl)" + filled_sql("ac", 120, [3, 2, 1])
    + " SELECT anchor AS class, n_anchor AS n, round(contrast, 6) + 0e0 AS contrast, round(threshold, 6) + 0e0 AS threshold FROM filled JOIN ac USING (anchor)",
)
def exhaustive_contrasts(spark, sf_dir):
    return rounded(A.exhaustive_contrasts(coded(spark, sf_dir), "id", "codes", "loss", 120, [3, 2, 1]))


@query(
    "s08_anchor_contrasts",
    CODED + ", me AS (SELECT grp::BIGINT AS anchor, round(avg(x1), 6) AS x1, round(avg(x2), 6) AS x2, round(avg(x3), 6) AS x3 FROM scored GROUP BY grp), ac AS (SELECT anchor, " + ", ".join(f"{T.sql(t)} AS a{i}" for i, t in enumerate(TREES)) + " FROM me)"
    + filled_sql("ac", 120, [1, 1, 1]) + " SELECT anchor, round(contrast, 6) + 0e0 AS contrast, round(threshold, 6) + 0e0 AS threshold FROM filled",
)
def anchor_contrasts(spark, sf_dir):
    """The groups' mean points as anchors; none of them is a row."""
    d = coded(spark, sf_dir)
    means = d.groupBy(F.col("grp").cast("long").alias("anchor")).agg(*[F.round(F.avg(x), 6).alias(x) for x in ("x1", "x2", "x3")])
    return rounded(A.anchor_contrasts(d, "id", "codes", "loss", means.withColumn("codes", T.codes(TREES)), 120))


@query("s08_leaf_search")
def leaf_search(spark, sf_dir):
    """Anchors under the trees of an error model fitted to the train split, searched on the discovery split."""
    d = scored(spark, sf_dir)
    features = ["x1", "x2", "x3"]
    model = M.fit_error_model(d.where("split = 'train'"), features, "loss", trees=8)
    found = d.where("split = 'discovery'")
    one = found.agg(*[f(x) for x in features for f in (F.avg, F.stddev_pop)]).first()
    history, _ = A.leaf_search(found, "id", model.trees, features, one[::2], one[1::2], "loss", 120, [0.0, 0.0, 0.0], budget=120 * 24, brood=6)
    return spark.createDataFrame(history, "step int, reads long, contrast double, best double")


@query("s09_discover")
def discover(spark, sf_dir):
    return D.discover(standard(spark, sf_dir), ["z_x1", "z_x2"], "id", "loss", 3, 100, generations=3)


@query("s10_climb")
def climb(spark, sf_dir):
    return D.climb(standard(spark, sf_dir), ["z_x1", "z_x2"], "id", "loss", 3, 100, rounds=5)


@query("s11_condition_scores")
def condition_scores(spark, sf_dir):
    return D.condition_scores(standard(spark, sf_dir), candidates(spark), ["z_x1", "z_x2"], "id", "loss", 5)


@query("s12_medoid_loop")
def medoid_loop(spark, sf_dir):
    d = coded(spark, sf_dir)
    pool = sorted(T.code_classes(d, "id", "codes"))
    found = D.medoid_loop(d, "id", "loss", "codes", [c for c, _, _ in pool], [n for _, _, n in pool], budget=160, brood=8)
    return spark.createDataFrame([tuple(r.values()) for r in found], "id int, parent_id int, operation string, medoids array<int>, counts array<long>, valid boolean, contrast double, share double")


@query("s18_calibration")
def calibration(spark, sf_dir):
    rows, summary = U.calibration_report(space(spark, sf_dir), BASE, n=80)
    return spark.createDataFrame([(*r, *summary.values()) for r in rows], "treatment string, coverage90 double, rmse double, variance double, noise double, n int, y_sd double, mean_overlap double, repeated double, distinct int, kernel_overlap double")


@query("s19_twice_the_same", MEASURED + " SELECT cand, round(contrast, 6) + 0e0 AS contrast, true AS same FROM measured")
def twice(spark, sf_dir):
    return rounded(D.twice_the_same(standard(spark, sf_dir), candidates(spark), ["z_x1", "z_x2"], "id", "loss"))


@query("s20_compare")
def compare(spark, sf_dir):
    s = space(spark, sf_dir)
    budget = s.n + 7 * s.m
    start = lambda seed: D.sample_candidates(s.rows, s.features, "id", 3, seed)
    methods = {
        "random": lambda seed: U.listed_search(s, D.sample_candidates(s.rows, s.features, "id", 7, seed + 100), budget),
        "surrogate": lambda seed: U.bayes_search(s, start(seed), budget, pool=128, refit_every=5, seed=seed),
        "surrogate, overlap allowed": lambda seed: U.bayes_search(s, start(seed), budget, pool=128, most_overlap=1.0, refit_every=5, seed=seed),
    }
    found = U.compare_methods(s, methods, [0], [s.n + 2 * s.m, s.n + 4 * s.m, budget])
    return spark.createDataFrame(found, "method string, seed int, reads long, wall_s double, best double, evals int, distinct int, within array<double>")


@query("l21_lambda_sweep")
def lambda_sweep(spark, sf_dir):
    dice = np.random.default_rng(11)
    s = space(spark, sf_dir)
    archives = {"near": U.around(dice, BASE, 0.18, 60), "wide": U.around(dice, BASE, 0.6, 60), "global": D.sample_candidates(s.rows, s.features, "id", 60), "global, cubes": D.sample_candidates(s.rows, s.features, "id", 60, 1, "cube")}
    return spark.createDataFrame(U.lambda_sweep(s, archives, folds=3), "archive string, lam double, rmse double, coverage90 double, y_sd double")


@query("a14_comparison_table", "WITH e AS (SELECT event_type, user_id % 3 AS seed, count(*)::DOUBLE AS v FROM events GROUP BY ALL) SELECT event_type, count(*) AS runs, min(v) AS least, quantile_cont(v, 0.5) AS middle, max(v) AS most FROM e GROUP BY event_type")
def comparison_table(spark, sf_dir):
    from .scored import table

    runs = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("seed")).agg(F.count("*").cast("double").alias("v"))
    return D.comparison_table(runs, ["event_type"], "v")


@query("l07_spectral_cells")
def spectral(spark, sf_dir):
    return X.spectral_cells(scored(spark, sf_dir), "id", TREES, 100, 3)


@query("l09_best_leaf", None)
def best_leaf(spark, sf_dir):
    return X.best_leaf(scored(spark, sf_dir), "loss", T.code(TREES[0]), 50)


STUMP = (
    SCORED
    + """, vs AS (SELECT 0 AS f, x2 AS x, loss FROM scored UNION ALL SELECT 1, x3, loss FROM scored),
bins AS (SELECT f, x, count(*)::DOUBLE AS n, sum(loss) AS s FROM vs GROUP BY f, x),
cum AS (SELECT f, x, sum(n) OVER w AS n, sum(s) OVER w AS s, (x + lead(x) OVER (PARTITION BY f ORDER BY x)) / 2 AS cut FROM bins WINDOW w AS (PARTITION BY f ORDER BY x)),
tot AS (SELECT count(*)::DOUBLE AS nn, sum(loss) AS ss FROM scored),
gain AS (SELECT f, cut, round(s * s / n + (ss - s) * (ss - s) / (nn - n) - ss * ss / nn, 9) AS gain FROM cum, tot WHERE cut IS NOT NULL AND n >= 400 AND nn - n >= 400),
best AS (SELECT f, cut FROM gain WHERE gain > 0 ORDER BY gain DESC, f, cut LIMIT 1),
cells AS (SELECT CASE WHEN CASE WHEN f = 0 THEN x2 ELSE x3 END <= cut THEN 0 ELSE 1 END AS cell, count(*) AS n, avg(loss) AS mean FROM scored, best GROUP BY ALL)
SELECT cell, n, round(mean, 6) + 0e0 AS mean, round(mean, 12) = max(round(mean, 12)) OVER () AS best FROM cells"""
)


@query("l09_error_stump", STUMP)
def error_stump(spark, sf_dir):
    """The tree of two leaves, whose fit SQL can express."""
    d = scored(spark, sf_dir)
    return rounded(B.leaf_cells(d, B.fit_error_tree(d, ["x2", "x3"], "loss", 400, max_leaves=2, bins=128), "loss", 400))


@query("l09_error_tree")
def error_tree(spark, sf_dir):
    """Fitted and chosen on the discovery split, shown on the confirm split."""
    d = scored(spark, sf_dir)
    fitted = B.fit_error_tree(d.where("split = 'discovery'"), ["x1", "x2", "x3"], "loss", 50, alpha=1e-5)
    return B.leaf_cells(d.where("split = 'confirm'"), fitted, "loss", 50)


@query("l09_loss_kernel_parts")
def loss_kernel_parts(spark, sf_dir):
    return B.loss_kernel_parts(scored(spark, sf_dir).where("split = 'discovery'"), "id", ["x1", "x2", "x3"], "loss", 50, k=6, landmarks=200, trees=12)


@query("l12_fanova")
def fanova(spark, sf_dir):
    d = scored(spark, sf_dir)
    return M.fit_fanova(d.where("split = 'train'"), ["x1", "x2"], "y", {"x1": 1}, pairs=1, trees=4).score(d.where("split = 'confirm'")).select("id", "score")


@query("l13_purified_effects")
def purified(spark, sf_dir):
    found = X.effect_tables(scored(spark, sf_dir), [TREES[0]], {"x1": [40.0, 100.0], "x2": [8.0]}, ("x1", "x2"))
    return spark.createDataFrame([(k, v) for k, v in found["importance"].items()], "effect string, variance double")


@query(
    "l16_moment_gates",
    SCORED
    + """, mo AS (SELECT grp % 2 AS h, count(*)::DOUBLE AS n, avg(x1) AS a1, avg(x2) AS a2, sqrt((var_pop(x1) + var_pop(x2)) / 2) AS s FROM scored GROUP BY 1),
lg AS (SELECT id, h, ln(n / sum(n) OVER (PARTITION BY id)) - 2 * ln(s) - ((x1 - a1) * (x1 - a1) + (x2 - a2) * (x2 - a2)) / (2 * s * s) AS l FROM scored, mo),
ex AS (SELECT id, h, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM lg)
SELECT id, round(max(e) FILTER (h = 0) / sum(e), 6) + 0e0 AS r0, round(max(e) FILTER (h = 1) / sum(e), 6) + 0e0 AS r1 FROM ex GROUP BY id""",
)
def moment_gates(spark, sf_dir):
    """Gates from the moments of two halves of the groups, by way of the search's vector."""
    d = scored(spark, sf_dir)
    x = M.pack_gates(*M.moment_gates(d.withColumn("h", F.col("grp") % 2), ["x1", "x2"], "h"))
    return rounded(d.select("id", *[g.alias(f"r{i}") for i, g in enumerate(M.soft_gates(["x1", "x2"], *M.unpack_gates(x, 2)))]))


def base_logit():
    return F.ln(F.col("p") / (1 - F.col("p")))


@query("l15_leaf_kernel_expert")
def leaf_kernel_expert(spark, sf_dir):
    """Two corrections of the frozen model's margin, in the leaves of an error model, mixed by a soft gate."""
    d = scored(spark, sf_dir)
    train = d.where("split = 'train'")
    trees = M.fit_error_model(train, ["x1", "x2", "x3"], "loss", trees=8).trees
    gates = M.gaussian_gate(["x1", "x2"], [[30.0, 6.0], [90.0, 18.0]], 25.0)
    fitted = K.fit_corrections(train, trees, "y", base_logit(), gates)
    return d.where("split = 'confirm'").select("id", K.pooled(fitted, base_logit(), gates).alias("score"))


@query("l16_gates")
def gates(spark, sf_dir):
    g = M.gaussian_gate(["x1", "x2"], [[30.0, 6.0], [90.0, 18.0]], 25.0)
    return scored(spark, sf_dir).select("id", *[c.alias(f"r{i}") for i, c in enumerate(g)])


def centre_gates(x):
    """Soft gates around centres whose coordinates are one vector."""
    return M.gaussian_gate(["x1", "x2"], np.reshape(x, (-1, 2)).tolist(), 25.0)


def folded(spark, sf_dir):
    """What the mixtures in folds read of each row, cached."""
    return scored(spark, sf_dir).select("y", "x1", "x2", "x3", "p", (F.col("fold") % 3).alias("fold")).persist()


@query("l17_l23_gate_search")
def gate_search(spark, sf_dir):
    """Centres of two gates moved to raise the mean AUC over three folds of the refitted mixture."""
    d = folded(spark, sf_dir)
    score = K.fold_objective(d, TREES, "y", base_logit(), centre_gates, "fold", 3, rounds=2)
    _, history = K.es_search(score, [30.0, 6.0, 90.0, 18.0], [40.0, 8.0, 40.0, 8.0], 4)
    d.unpersist()
    return spark.createDataFrame(history, "step int, tried double, best double, sigma double")


@query("l23_partition_comparison")
def partition_comparison(spark, sf_dir):
    """The mixture's AUC in each fold with gates around k-means centres, and around centres searched from them."""
    d = folded(spark, sf_dir)
    start = np.ravel(M.kmeans_centres(d, ["x1", "x2"], 2, 2))
    score = K.fold_objective(d, TREES, "y", base_logit(), centre_gates, "fold", 3, rounds=2)
    found, _ = K.es_search(score, start, [40.0, 8.0] * 2, 3, seed=1)
    rows = [(name, k, v) for name, x in (("k-means", start), ("searched", found)) for k, v in enumerate(K.fold_aucs(d, TREES, "y", base_logit(), centre_gates(x), "fold", 3, rounds=2) or [])]
    d.unpersist()
    return spark.createDataFrame(rows, "partition string, fold int, auc double")


@query("l18_softmax_mixture")
def softmax_mixture(spark, sf_dir):
    d = scored(spark, sf_dir)
    scaled = d.withColumns({"x1": F.col("x1") / 100, "x2": F.col("x2") / 24})
    fitted, _ = X.softmax_mixture(scaled.where("split = 'train'"), ["x1", "x2"], "y", "grp", steps=100)
    return scaled.select("id", X.mixture_expression(fitted, ["x1", "x2"]).alias("score"))


@query("l19_gaussian_process")
def gaussian_process(spark, sf_dir):
    """A process fitted to 40 regions predicts the contrasts of 20 others."""
    s = space(spark, sf_dir)
    found = s.pool(D.sample_candidates(s.rows, s.features, "id", 60))
    known = np.arange(60) < 40
    gp = U.BlendedProcess(0.5, [0, 0, 1, 1]).fit(found.coordinates[known], found.vectors[known], found.contrasts[known])
    mean, sd = gp.predict(found.coordinates[~known], found.vectors[~known], measured=True)
    ei, ucb = U.expected_improvement(mean, sd, float(found.contrasts[known].max())), U.upper_bound(mean, sd)
    return spark.createDataFrame([(40 + i, float(found.contrasts[40 + i]), *map(float, v)) for i, v in enumerate(zip(mean, sd, ei, ucb, strict=True))], "cand int, contrast double, mean double, sd double, improvement double, bound double")


@query("l22_partition_frontier")
def partition_frontier(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("g", F.col("grp") % 3)
    return X.partition_frontier(d, "g", [0, 1, 2], ["x1", "x2"], "y", 2)
