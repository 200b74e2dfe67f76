"""Queries over confirmation: intervals, bootstrap, corrections for many claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import normal_cdf, normal_cdf_sql, normal_pdf
from ..operators import confirm as C
from ..operators.evaluate import cluster_summary
from .registry import r, registrar, rounded
from .scored import SCORED, scored

REGISTRY: dict = {}
query = registrar(REGISTRY)

Z19 = C.critical_value(19)


def mask():
    return F.col("x1") > 60



def influence_sql(mask: str, z: float) -> str:
    return (
        SCORED
        + f""", o AS (SELECT avg(CASE WHEN {mask} THEN 1e0 ELSE 0e0 END) AS pi, avg(loss) FILTER ({mask}) AS mi, avg(loss) FILTER (NOT ({mask})) AS mo FROM scored),
ps AS (SELECT CASE WHEN {mask} THEN (loss - mi) / pi ELSE -(loss - mo) / (1 - pi) END AS psi, pi, mi, mo FROM scored, o),
ci AS (SELECT count(*) AS n, any_value(pi) AS share, any_value(mi) AS mean_in, any_value(mo) AS mean_out, any_value(mi) - any_value(mo) AS gap, stddev_samp(psi) / sqrt(count(*)) AS se FROM ps)
SELECT n, {r('share', 'mean_in', 'mean_out', 'gap', 'se')}, round(gap - {z!r} * se, 6) AS low, round(gap + {z!r} * se, 6) AS high FROM ci"""
    )


@query("i01_influence_interval", influence_sql("x1 > 60", Z19))
def influence(spark, sf_dir):
    return rounded(C.influence_interval(scored(spark, sf_dir), mask(), "loss", Z19))


@query(
    "i02_paired_interval",
    SCORED
    + f""", m AS (SELECT loss, (x1 > 60)::INT AS a, (x2 > 12)::INT AS b FROM scored),
o AS (SELECT avg(a) AS pa, avg(loss) FILTER (a = 1) AS ia, avg(loss) FILTER (a = 0) AS oa, avg(b) AS pb, avg(loss) FILTER (b = 1) AS ib, avg(loss) FILTER (b = 0) AS ob FROM m),
ps AS (SELECT a * (loss - ia) / pa - (1 - a) * (loss - oa) / (1 - pa) - (b * (loss - ib) / pb - (1 - b) * (loss - ob) / (1 - pb)) AS psi, (ia - oa) - (ib - ob) AS d FROM m, o),
ci AS (SELECT any_value(d) AS difference, stddev_samp(psi) / sqrt(count(*)) AS se FROM ps)
SELECT {r('difference', 'se')}, round(difference - {Z19!r} * se, 6) AS low, round(difference + {Z19!r} * se, 6) AS high FROM ci""",
)
def paired(spark, sf_dir):
    return rounded(C.paired_interval(scored(spark, sf_dir), mask(), F.col("x2") > 12, "loss", Z19))


BOOTS = 100
STEPS = C._poisson_steps()
WEIGHT = " + ".join(f"(u >= {s!r})::INT" for s in STEPS)
BOOT = (
    SCORED
    + f""", bt AS (SELECT range AS boot FROM range({BOOTS})),
w AS (SELECT boot, loss, x1 > 60 AS i, ('0x' || substr(md5('boot|' || id || '|' || boot), 1, 8))::UBIGINT / 4294967296e0 AS u FROM scored, bt),
ww AS (SELECT boot, loss, i, {WEIGHT} AS w FROM w),
ra AS (SELECT boot, (sum(w * loss) FILTER (i) / sum(w) FILTER (i)) / (sum(w * loss) / sum(w)) - 1 AS theta FROM ww GROUP BY boot)"""
)


@query("g09_bootstrap_conditions", BOOT + " SELECT CAST(boot AS INT) AS boot, round(theta, 6) + 0e0 AS theta FROM ra")
def bootstrap(spark, sf_dir):
    return rounded(C.bootstrap_ratios(scored(spark, sf_dir), "id", mask(), "loss", BOOTS))


@query("i03_percentile_bootstrap", BOOT + " SELECT count(*) AS boots, count(*) FILTER (theta IS NULL) AS undefined, round(quantile_cont(theta, 0.025), 6) AS low, round(quantile_cont(theta, 0.975), 6) AS high, quantile_cont(theta, 0.025) > 0 AS passed FROM ra")
def percentile(spark, sf_dir):
    return rounded(C.confirm_inflation(scored(spark, sf_dir), "id", mask(), "loss", 0.0, BOOTS))


JACK = (
    SCORED
    + """, o AS (SELECT count(*) FILTER (x1 > 60) AS m, sum(loss) FILTER (x1 > 60) AS s, count(*) AS n, sum(loss) AS t FROM scored),
v AS (SELECT CASE WHEN x1 > 60 THEN ((s - loss) / (m - 1)) / ((t - s) / (n - m)) ELSE (s / m) / ((t - s - loss) / (n - m - 1)) END AS v, (s / m) / ((t - s) / (n - m)) AS theta, m FROM scored, o),
a AS (SELECT avg(v) AS mv FROM v), q AS (SELECT any_value(theta) AS theta, any_value(m) AS support, sum((mv - v) ** 3) AS c, sum((mv - v) ** 2) AS q FROM v, a)"""
)


@query("i04_i05_jackknife", JACK + " SELECT round(theta - 1, 6) + 0e0 AS theta, support, round(c / (6 * q ** 1.5e0), 6) + 0e0 AS acceleration FROM q")
def jackknife(spark, sf_dir):
    return rounded(C.jackknife(scored(spark, sf_dir), mask(), "loss"))


@query("i04_bca")
def bca(spark, sf_dir):
    found = C.bca(scored(spark, sf_dir), "id", mask(), "loss", 0.0, 200)
    return spark.createDataFrame([tuple(found[k] for k in ("theta", "low", "high", "p", "support"))], "theta double, low double, high double, p double, support long")


@query("f02_normal", SCORED + f" SELECT id, round({normal_cdf_sql('(x1 - 50) / 25')}, 6) + 0e0 AS below, round(exp(-((x1 - 50) / 25) * ((x1 - 50) / 25) / 2) / sqrt(2 * pi()), 6) + 0e0 AS density FROM scored")
def normal(spark, sf_dir):
    z = (F.col("x1") - 50) / 25
    return rounded(scored(spark, sf_dir).select("id", normal_cdf(z).alias("below"), normal_pdf(z).alias("density")))


@query("i06_critical_value", SCORED + ", c AS (SELECT 'grp' AS name, count(DISTINCT grp) AS claims FROM scored UNION ALL SELECT 'fold', count(DISTINCT fold) FROM scored UNION ALL SELECT 'x2', count(DISTINCT x2) FROM scored) SELECT name, claims, round(1 - 0.05e0 / (2 * claims), 6) AS below FROM c")
def critical(spark, sf_dir):
    """As many claims as a column has values; below is what the critical value leaves below it."""
    counts = scored(spark, sf_dir).agg(*[F.count_distinct(c).alias(c) for c in ("grp", "fold", "x2")]).first().asDict()
    found = spark.createDataFrame([(c, k, C.critical_value(k)) for c, k in counts.items()], "name string, claims long, z double")
    return rounded(found.select("name", "claims", normal_cdf("z").alias("below")))


#: One claim a group and split: the group's mean loss is over the split's others', by the normal tail of gap over standard error.
CLAIMS = (
    SCORED
    + """, part AS (SELECT split, grp, count(*)::DOUBLE AS n, sum(loss) AS s, sum(loss * loss) AS q FROM scored GROUP BY ALL),
whole AS (SELECT split, sum(n) AS nn, sum(s) AS ss, sum(q) AS qq FROM part GROUP BY split),
gaps AS (
  SELECT split || '/' || grp AS claim, s / n - (ss - s) / (nn - n) AS gap,
    sqrt((q - s * s / n) / (n - 1) / n + (qq - q - (ss - s) * (ss - s) / (nn - n)) / (nn - n - 1) / (nn - n)) AS se FROM part JOIN whole USING (split)),
cl AS (SELECT claim, round(1 - """
    + normal_cdf_sql("gap / se")
    + """, 9) + 0e0 AS p FROM gaps), kn AS (SELECT *, row_number() OVER (ORDER BY p, claim) AS rn, count(*) OVER () AS g FROM cl WHERE p IS NOT NULL)"""
)


def claims(spark, sf_dir):
    d = scored(spark, sf_dir)
    cells = [cluster_summary(d.where(F.col("split") == s), "grp", "y", "loss").select(F.concat_ws("/", F.lit(s), "grp").alias("claim"), "gap", "se") for s in ("train", "discovery", "confirm")]
    every = cells[0].union(cells[1]).union(cells[2])
    return every.select("claim", (F.round(1 - normal_cdf(F.col("gap") / F.col("se")), 9) + 0.0).alias("p"))


@query(
    "w05_benjamini_hochberg",
    CLAIMS + ", a AS (SELECT claim, least(1e0, min(p * g / rn) OVER (ORDER BY p, claim ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted, rn <= max(CASE WHEN p * g / rn <= 0.5e0 THEN rn END) OVER () AS rejected FROM kn) SELECT claim, round(p, 6) AS p, round(adjusted, 6) AS adjusted, coalesce(rejected, false) AS rejected FROM cl LEFT JOIN a USING (claim)",
)
def bh(spark, sf_dir):
    return rounded(C.benjamini_hochberg(claims(spark, sf_dir), "claim", "p", 0.5))


@query(
    "w06_holm",
    CLAIMS + ", a AS (SELECT claim, least(1e0, max(p * (g - rn + 1)) OVER (ORDER BY p, claim ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM kn) SELECT claim, round(p, 6) AS p, round(adjusted, 6) AS adjusted, coalesce(adjusted <= 0.5e0, false) AS rejected FROM cl LEFT JOIN a USING (claim)",
)
def holm(spark, sf_dir):
    return rounded(C.holm(claims(spark, sf_dir), "claim", "p", 0.5))


@query("i09_optimism", SCORED + ", g AS (SELECT grp, split, avg(loss) AS v FROM scored GROUP BY ALL) SELECT d.grp, round(d.v, 6) AS discovery, round(c.v, 6) AS confirmation, round(d.v - c.v, 6) + 0e0 AS optimism FROM g AS d JOIN g AS c USING (grp) WHERE d.split = 'discovery' AND c.split = 'confirm'")
def optimism(spark, sf_dir):
    g = scored(spark, sf_dir).where("split <> 'train'").groupBy("split", "grp").agg(F.avg("loss").alias("value"))
    return rounded(C.optimism(g.where("split = 'discovery'"), g.where("split = 'confirm'"), "grp"))


@query("g11_prevalence_floor", SCORED + ", n AS (SELECT split, count(*) AS n FROM scored GROUP BY split) SELECT split, n, coalesce(min(k / 20000e0), 1e0) AS floor FROM n LEFT JOIN range(1, 20001) AS t(k) ON n * (k / 20000e0) - 1.96e0 * sqrt(n * (k / 20000e0) * (1 - k / 20000e0)) >= 30 GROUP BY split, n")
def floor(spark, sf_dir):
    """Of as many rows as each split has."""
    counts = scored(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n")).collect()  # a row a split
    return spark.createDataFrame([(x["split"], x["n"], C.prevalence_floor(x["n"], 30, 1.96)) for x in counts], "split string, n long, floor double")
