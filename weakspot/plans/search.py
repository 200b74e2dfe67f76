"""Queries over candidate regions: memberships, measures, overlap, frontiers, ownership, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import frontier as P
from ..operators import regions as R
from .basics import LIFTS, SUMMARY, masks
from .registry import r, registrar, rounded
from .scored import MEASURED, SCORED, STANDARD, candidates, members_sql, scored, table

REGISTRY: dict = {}
query = registrar(REGISTRY)


def standard(spark, sf_dir):
    return R.standardize(scored(spark, sf_dir), ["x1", "x2"])


def members(spark, sf_dir, metric="box"):
    return R.membership(standard(spark, sf_dir), candidates(spark), ["z_x1", "z_x2"], "id", metric)


def measured(spark, sf_dir):
    return E.measure(members(spark, sf_dir), scored(spark, sf_dir), "id", "loss", 0.5)


@query("w01_j01_membership", members_sql() + " SELECT cand, id, round(u, 6) AS u FROM members")
def membership(spark, sf_dir):
    return rounded(members(spark, sf_dir))


@query("w01_ball_membership", members_sql("ball") + " SELECT cand, id, round(u, 6) AS u FROM members")
def ball_membership(spark, sf_dir):
    return rounded(members(spark, sf_dir, "ball"))


@query("w02_radius", members_sql() + " SELECT cand, count(*) AS m, round(max(u), 6) AS gamma FROM members GROUP BY cand")
def radius(spark, sf_dir):
    return rounded(members(spark, sf_dir).groupBy("cand").agg(F.count("*").alias("m"), F.max("u").alias("gamma")))


@query("w03_nearest_mean", members_sql("ball") + " SELECT cand, count(*) AS n, round(avg(loss), 6) AS mean FROM members JOIN scored USING (id) GROUP BY cand")
def nearest_mean(spark, sf_dir):
    return rounded(R.nearest_mean(standard(spark, sf_dir), candidates(spark), ["z_x1", "z_x2"], "id", "loss"))


@query("c03_measure", MEASURED + f" SELECT cand, m, {r('contrast', 'mean_in', 'mean_out', 'sd_in', 'tail_rate', 'var_in')} FROM measured")
def measure(spark, sf_dir):
    return rounded(measured(spark, sf_dir))


REPLICATES = (
    members_sql()
    + """, ins AS (SELECT cand, fold, count(*) AS m, sum(loss) AS s FROM members JOIN scored USING (id) GROUP BY ALL),
fo AS (SELECT fold, count(*) AS n, sum(loss) AS t FROM scored GROUP BY fold),
ce AS (SELECT c.cand, fold, coalesce(m, 0) AS m, coalesce(s, 0) AS s, n, t FROM (SELECT DISTINCT cand FROM ins) AS c CROSS JOIN fo LEFT JOIN ins USING (cand, fold)),
le AS (SELECT cand, sum(m) OVER w - m AS m, sum(s) OVER w - s AS s, sum(n) OVER w - n AS n, sum(t) OVER w - t AS t FROM ce WINDOW w AS (PARTITION BY cand)),
v AS (SELECT cand, (s / m) / ((t - s) / (n - m)) - 1 AS v FROM le)"""
)


@query("c04_replicates", REPLICATES + " SELECT cand, count(v) AS folds, round(sqrt((count(v) - 1) * var_pop(v)), 6) AS se, round(min(v), 6) + 0e0 AS floor FROM v GROUP BY cand")
def replicates(spark, sf_dir):
    return rounded(E.replicates(members(spark, sf_dir), scored(spark, sf_dir), "id", "loss", "fold"))


@query("c05_pooled_variance", MEASURED + " SELECT round(avg(var_in), 6) AS pooled FROM measured")
def pooled(spark, sf_dir):
    return rounded(E.pooled_variance(measured(spark, sf_dir)))


OVER = ", sz AS (SELECT cand, count(*) AS m FROM members GROUP BY cand), ov AS (SELECT a.cand AS a, b.cand AS b, count(*) AS shared FROM members AS a JOIN members AS b USING (id) GROUP BY ALL), ovl AS (SELECT a, b, shared, shared / m::DOUBLE AS overlap FROM ov JOIN sz ON a = cand)"


@query("j02_overlap", members_sql() + OVER + " SELECT a, b, shared, round(overlap, 6) AS overlap FROM ovl")
def overlap(spark, sf_dir):
    return rounded(P.overlaps(members(spark, sf_dir), "id"))


@query("i07_covariance", MEASURED + OVER + " SELECT a, b, round(0.04e0 * overlap / (x.m * x.mean_out * y.mean_out), 8) AS covariance FROM ovl JOIN measured AS x ON a = x.cand JOIN measured AS y ON b = y.cand")
def covariance(spark, sf_dir):
    m = members(spark, sf_dir)
    return rounded(P.resampling_covariance(P.overlaps(m, "id"), measured(spark, sf_dir), 0.04), 8)


@query("t08_archive_overlap", members_sql() + OVER + " SELECT cand, round(coalesce(max(shared) / any_value(m)::DOUBLE, 0), 6) AS overlap FROM (SELECT cand, m FROM sz WHERE cand >= 4) LEFT JOIN (SELECT a AS cand, shared FROM ov WHERE b < 4) USING (cand) GROUP BY cand")
def archive(spark, sf_dir):
    m = members(spark, sf_dir)
    return rounded(P.archive_overlap(m.where("cand >= 4"), m.where("cand < 4"), "id"))


@query("t05_distinct_regions")
def distinct_regions(spark, sf_dir):
    over = P.overlaps(members(spark, sf_dir), "id").collect()  # pairs of a search's few regions
    ranked = [x["cand"] for x in measured(spark, sf_dir).orderBy(F.desc(F.round("contrast", 10)), "cand").collect()]
    kept = P.distinct_regions(ranked, {(x["a"], x["b"]): x["overlap"] for x in over if x["a"] != x["b"]}, 0.5)
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "rank int, cand int")


@query("t06_best_candidate", MEASURED + " SELECT cand, round(contrast, 6) AS contrast FROM measured ORDER BY round(contrast, 10) DESC, cand LIMIT 1")
def best_candidate(spark, sf_dir):
    return rounded(measured(spark, sf_dir).orderBy(F.desc(F.round("contrast", 10)), "cand").limit(1).select("cand", "contrast"))


@query("i08_confirm_frozen", SCORED + " SELECT count(*) AS n, round(avg(loss) FILTER (x1 > 60 AND x2 >= 6) / avg(loss) FILTER (NOT (x1 > 60 AND x2 >= 6)) - 1, 6) + 0e0 AS contrast FROM scored WHERE split = 'confirm'")
def confirm_frozen(spark, sf_dir):
    from ..operators.confirm import confirm_frozen

    rule = R.Box({"x1": (60.000001, None), "x2": (6, None)})
    found = confirm_frozen(rule, scored(spark, sf_dir).where("split = 'confirm'"), "id", "loss")
    return rounded(spark.createDataFrame([(found["n"], found["theta"])], "n long, contrast double"))


@query("i08_confirm_interval")
def confirm_interval(spark, sf_dir):
    from ..operators.confirm import confirm_frozen

    rule = R.Box({"x1": (60.000001, None), "x2": (6, None)})
    found = confirm_frozen(rule, scored(spark, sf_dir).where("split = 'confirm'"), "id", "loss")
    return spark.createDataFrame([tuple(found.values())], "theta double, low double, high double, p double, support long, n long")


@query("s01_weakness_frontier", LIFTS + f", ok AS (SELECT * FROM lifts WHERE support >= 40) SELECT region, support, {r('lift', 'coverage')} FROM ok AS a WHERE NOT EXISTS (SELECT 1 FROM ok AS b WHERE b.lift >= a.lift AND b.coverage >= a.coverage AND (b.lift > a.lift OR b.coverage > a.coverage))")
def weakness_frontier(spark, sf_dir):
    return rounded(P.weakness_frontier(scored(spark, sf_dir), "loss", masks()))


POINTS = SCORED + ", pts AS (SELECT CAST(id % 50 AS INT) AS id, round(avg(loss), 8) AS contrast, round(count(*) / (SELECT count(*) FROM scored)::DOUBLE + (id % 50) / 1000e0 - avg(loss), 8) AS share FROM scored GROUP BY id % 50)"


def points(spark, sf_dir):
    d = scored(spark, sf_dir)
    n = d.agg(F.count("*").alias("all_n"))
    cell = d.groupBy((F.col("id") % 50).cast("int").alias("id")).agg(F.avg("loss").alias("l"), F.count("*").alias("n"))
    return cell.crossJoin(F.broadcast(n)).select("id", F.round("l", 8).alias("contrast"), F.round(F.col("n") / F.col("all_n") + F.col("id") / 1000.0 - F.col("l"), 8).alias("share"))


@query("j05_pareto", POINTS + " SELECT id FROM pts AS a WHERE NOT EXISTS (SELECT 1 FROM pts AS b WHERE b.contrast >= a.contrast AND b.share >= a.share AND (b.contrast > a.contrast OR b.share > a.share))")
def pareto(spark, sf_dir):
    return P.pareto(points(spark, sf_dir), ["contrast", "share"], "id").select("id")


SKY = POINTS + ", bb AS (SELECT *, max(share) OVER (ORDER BY contrast DESC, share DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pts), sky AS (SELECT id, contrast, share FROM bb WHERE best IS NULL OR share > best)"


@query("w07_skyline", SKY + " SELECT id, contrast, share FROM sky")
def skyline(spark, sf_dir):
    return P.skyline(points(spark, sf_dir), "contrast", "share", "id")


@query("c26_nondominated_share", SKY + " SELECT round(count(*) / 50e0, 6) AS share FROM sky")
def nondominated(spark, sf_dir):
    return rounded(P.nondominated_share(points(spark, sf_dir), "contrast", "share", "id"))


@query("c25_hypervolume", SKY + ", st AS (SELECT greatest(contrast, 0) * (share - coalesce(lag(share) OVER (ORDER BY share), 0)) AS a FROM sky) SELECT round(sum(a), 6) + 0e0 AS area FROM st")
def hypervolume(spark, sf_dir):
    return rounded(E.hypervolume(P.skyline(points(spark, sf_dir), "contrast", "share", "id"), "share", "contrast"))


@query("t04_primary_region", SKY + " SELECT id, contrast, share FROM sky WHERE share >= -0.1 ORDER BY contrast DESC, share DESC, id LIMIT 1")
def primary(spark, sf_dir):
    return P.primary(points(spark, sf_dir), -0.1)


@query("t03_worst_cluster", SUMMARY + " SELECT grp, n, round(brier, 6) AS brier FROM summary WHERE n >= 50 AND share >= 0.01 ORDER BY round(brier, 10) DESC, grp LIMIT 1")
def worst_cluster(spark, sf_dir):
    return rounded(P.worst_cluster(E.cluster_summary(scored(spark, sf_dir), "grp", "y", "loss"), "grp").select("grp", "n", "brier"))


SCORES = SCORED + ", w AS (SELECT grp AS cand, fold AS cond, round(avg(loss), 8) AS score FROM scored GROUP BY ALL), ow AS (SELECT cond, cand FROM (SELECT *, max(score) OVER (PARTITION BY cond) AS top FROM w) WHERE score >= top - 0.002e0), sh AS (SELECT cand, sum(1e0 / k / n) AS share FROM (SELECT *, count(*) OVER (PARTITION BY cond) AS k FROM ow), (SELECT count(DISTINCT cond) AS n FROM w) GROUP BY cand), shares AS (SELECT cand, coalesce(share, 0) AS share FROM (SELECT DISTINCT cand FROM w) LEFT JOIN sh USING (cand))"


def scores(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.col("grp").alias("cand"), F.col("fold").alias("cond")).agg(F.round(F.avg("loss"), 8).alias("score"))


@query("w11_owners", SCORES + " SELECT cond, cand FROM ow")
def owners(spark, sf_dir):
    return P.owners(scores(spark, sf_dir), 0.002)


@query("c23_s02_coverage_shares", SCORES + " SELECT cand, round(share, 6) AS share FROM shares")
def shares(spark, sf_dir):
    return rounded(P.coverage_shares(scores(spark, sf_dir), delta=0.002))


@query("u05_reduced_cover")
def reduced(spark, sf_dir):
    s = scores(spark, sf_dir)
    owned: dict = {x["cand"]: set() for x in s.select("cand").distinct().collect()}
    for x in P.owners(s, 0.002).collect():  # a search's conditions and candidates
        owned[x["cand"]].add(x["cond"])
    kept = P.reduce_cover(owned, {x["cand"]: x["share"] for x in P.coverage_shares(s, delta=0.002).collect()})
    return spark.createDataFrame([(c,) for c in sorted(kept)], "cand int")


@query("s03_selection", SCORES + " SELECT cand, round(0.95e0 * share / (SELECT sum(share) FROM shares) + 0.05e0 / (SELECT count(*) FROM shares), 6) AS probability FROM shares")
def selection(spark, sf_dir):
    return rounded(P.selection_probabilities(P.coverage_shares(scores(spark, sf_dir), delta=0.002), 0.05))


HISTORY = SCORED + ", hi AS (SELECT grp, id AS step, id * 13 AS reads, round(loss, 8) AS value FROM scored)"


def history(spark, sf_dir):
    return scored(spark, sf_dir).select("grp", F.col("id").alias("step"), (F.col("id") * 13).alias("reads"), F.round("loss", 8).alias("value"))


@query("w08_best_so_far", HISTORY + " SELECT grp, step, max(value) OVER (PARTITION BY grp ORDER BY step) AS best FROM hi")
def best_so_far(spark, sf_dir):
    return P.best_so_far(history(spark, sf_dir), ["grp"], "step", "value").select("grp", "step", "best")


@query("j06_best_within_budget", HISTORY + " SELECT grp, budget, max(value) FILTER (reads <= budget) AS best FROM hi, (VALUES (5), (1000), (5342), (10000)) AS b(budget) GROUP BY ALL")
def best_within(spark, sf_dir):
    return P.best_within(history(spark, sf_dir), ["grp"], [5, 1000, 5342, 10000])


@query("u02_complement", members_sql() + " SELECT id FROM scored WHERE id NOT IN (SELECT id FROM members)")
def complement(spark, sf_dir):
    return scored(spark, sf_dir).select("id").join(members(spark, sf_dir).select("id"), "id", "left_anti")


@query("u06_cell_unions", SCORED + ", c AS (SELECT grp % 4 AS cell, sum(loss) AS s, count(*) AS n FROM scored GROUP BY 1) SELECT a.cell AS a, b.cell AS b, CASE WHEN a.cell = b.cell THEN a.n ELSE a.n + b.n END AS n, round(CASE WHEN a.cell = b.cell THEN a.s / a.n ELSE (a.s + b.s) / (a.n + b.n) END, 6) AS loss FROM c AS a JOIN c AS b ON a.cell <= b.cell")
def cell_unions(spark, sf_dir):
    c = scored(spark, sf_dir).groupBy((F.col("grp") % 4).alias("cell")).agg(F.sum("loss").alias("s"), F.count("*").alias("n"))
    pairs = spark.createDataFrame([(u[0], u[-1]) for u in P.cell_unions(4)], "a int, b int")
    held = pairs.join(c, (F.col("cell") == F.col("a")) | (F.col("cell") == F.col("b"))).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return rounded(held.select("a", "b", "n", (F.col("s") / F.col("n")).alias("loss")))


@query(
    "u08_simplex",
    SCORED + ", m AS (SELECT avg(loss) FILTER (split = 'train') AS m1, avg(loss) FILTER (split = 'discovery') AS m2, avg(loss) FILTER (split = 'confirm') AS m3 FROM scored) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(6 - a - b AS INT) AS c, round((a * m1 + b * m2 + (6 - a - b) * m3) / 6, 6) AS blend FROM range(7) AS t(a), range(7) AS u(b), m WHERE a + b <= 6",
)
def simplex(spark, sf_dir):
    """The splits' mean losses blended by each point of the lattice."""
    means = scored(spark, sf_dir).agg(*[F.avg(F.when(F.col("split") == s, F.col("loss"))).alias(f"m{i}") for i, s in enumerate(("train", "discovery", "confirm"))])
    blend = (F.col("a") * F.col("m0") + F.col("b") * F.col("m1") + F.col("c") * F.col("m2")) / 6
    return rounded(P.simplex(spark, 6).crossJoin(F.broadcast(means)).select("a", "b", "c", blend.alias("blend")))


@query("u09_crossed_design", "SELECT r_name AS task, rule FROM region, (VALUES ('a'), ('b'), ('c')) AS v(rule)")
def crossed(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("task")).crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "rule string"))


@query("s04_random_search", MEASURED + " SELECT cand, reads, round(contrast, 6) AS contrast FROM (SELECT cand, contrast, (SELECT count(*) FROM scored) + sum(m) OVER (ORDER BY cand) AS reads FROM measured) WHERE reads <= (SELECT count(*) FROM scored) + 700")
def random_search(spark, sf_dir):
    from ..operators.search import within_budget

    d = scored(spark, sf_dir)
    n = d.count()
    return rounded(within_budget(measured(spark, sf_dir), n, n + 700).select("cand", "reads", "contrast"))


@query("s05_hill_climb")
def hill_climb(spark, sf_dir):
    from ..operators.search import SparkEvaluator, hill_climb

    found = hill_climb(SparkEvaluator(standard(spark, sf_dir), ["z_x1", "z_x2"], "id", "loss", 100), [0.5, 0.5], [1.0, 1.0], rounds=3)
    return spark.createDataFrame(found, "step int, reads long, contrast double, best double")


@query("s06_evolution")
def evolution(spark, sf_dir):
    from ..operators.search import SparkEvaluator, evolution

    found = evolution(SparkEvaluator(standard(spark, sf_dir), ["z_x1", "z_x2"], "id", "loss", 100), [0.5, 0.5], [1.0, 1.0], steps=8, seed=1)
    return spark.createDataFrame(found, "step int, reads long, contrast double, best double")


@query("s15_score_condition", SCORED + ", b AS (SELECT avg(loss) AS base FROM scored WHERE fold <> 3), s AS (SELECT count(*) AS n, avg((y - least(p * 1.2e0, 1e0)) ** 2) AS m FROM scored WHERE fold <> 3 AND x1 > 60) SELECT n, round(m / base - 1, 6) + 0e0 AS weakness FROM b, s")
def score_condition(spark, sf_dir):
    from ..operators.search import condition_weakness

    d = scored(spark, sf_dir).where("fold <> 3")
    return rounded(condition_weakness(d, F.col("x1") > 60, "loss", (F.col("y") - F.least(F.col("p") * 1.2, F.lit(1.0))) ** 2))


@query("s17_rank_gap", MEASURED + " SELECT round(corr(mean_in, contrast), 6) + 0e0 AS pearson, arg_max(cand, round(mean_in, 10)) AS best FROM measured")
def rank_gap(spark, sf_dir):
    return rounded(measured(spark, sf_dir).agg(F.corr("mean_in", "contrast").alias("pearson"), F.max_by("cand", F.round("mean_in", 10)).alias("best")))


@query(
    "s16_nearest_admissible",
    STANDARD + """, ce AS (SELECT avg(z_x1) AS c1, avg(z_x2) AS c2 FROM std WHERE loss > 0.5e0),
nr AS (SELECT id, loss, round(greatest(abs(z_x1 - c1), abs(z_x2 - c2)), 10) AS u, round(sqrt((z_x1 - c1) * (z_x1 - c1) + (z_x2 - c2) * (z_x2 - c2)), 10) AS d FROM std, ce),
inside AS (SELECT id, u, row_number() OVER (ORDER BY u, d, id) <= 120 AS member, loss FROM nr)
SELECT id, round(u, 6) + 0e0 AS u, loss > 0.5e0 AS given FROM inside WHERE member""",
)
def nearest_admissible(spark, sf_dir):
    """The cube of 120 rows around the centroid of the rows of high loss."""
    d = standard(spark, sf_dir)
    found = R.nearest_admissible(d, F.col("loss") > 0.5, ["z_x1", "z_x2"], "id", 120)
    return rounded(found.join(d.select("id", (F.col("loss") > 0.5).alias("given")), "id").select("id", "u", "given"))
