"""The scored observations on which the registered queries run: events under a fixed logistic model, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import hash_number
from ..functions.scoring import brier, sigmoid

FEATURES = ["x1", "x2", "x3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, x1..x3, grp, p, loss, fold, split. Scores are rounded, so ranks over them agree between engines."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        F.col("value").alias("x1"),
        F.hour("ts").cast("double").alias("x2"),
        F.get_json_object("props", "$.k").cast("double").alias("x3"),
        (F.col("user_id") % 8).cast("int").alias("grp"),
    )
    e = e.withColumn("p", F.round(sigmoid(-1.4 + 4e-3 * (F.col("x1") - 50.0) + 1e-2 * F.col("x2")), 10))
    h = hash_number(F.col("id").cast("string"))
    return e.withColumns({"loss": brier("y", "p"), "fold": (h % 10).cast("int"), "split": F.when(h % 4 < 2, "train").when(h % 4 < 3, "discovery").otherwise("confirm")})


#: The same as common table expressions; a query appends its own.
SCORED = """
WITH e AS (
  SELECT event_id AS id, CAST(event_type = 'purchase' AS INT) AS y, value AS x1, CAST(hour(ts) AS DOUBLE) AS x2,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x3, CAST(user_id % 8 AS INT) AS grp,
    ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::UBIGINT AS h FROM events),
e2 AS (SELECT *, round(1e0 / (1e0 + exp(-least(greatest(-1.4e0 + 4e-3 * (x1 - 50e0) + 1e-2 * x2, -30e0), 30e0))), 10) AS p FROM e),
scored AS (
  SELECT id, y, x1, x2, x3, grp, p, (y - p) * (y - p) AS loss, CAST(h % 10 AS INT) AS fold,
    CASE WHEN h % 4 < 2 THEN 'train' WHEN h % 4 < 3 THEN 'discovery' ELSE 'confirm' END AS split FROM e2)"""

#: Standard units of x1 and x2 by population moments.
STANDARD = (
    SCORED
    + """,
mo AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM scored),
std AS (SELECT scored.*, (x1 - m1) / s1 AS z_x1, (x2 - m2) / s2 AS z_x2 FROM scored, mo)"""
)

#: Frozen candidates of the registered searches: number, centre, shape, support.
CANDIDATES = [
    (0, 1.2, 0.5, 1.0, 1.0, 100), (1, -0.8, 0.0, 0.7, 1.3, 171), (2, 2.0, -1.0, 1.5, 0.5, 60), (3, 0.0, 1.4, 1.0, 1.0, 250),
    (4, 3.0, 0.2, 1.0, 2.0, 80), (5, -0.5, -1.5, 0.5, 0.5, 300), (6, 0.9, 1.1, 1.2, 0.8, 120), (7, 1.5, -0.4, 0.6, 1.4, 400),
]


def candidates(spark: SparkSession) -> DataFrame:
    rows = [(c, [z1, z2], [w1, w2], m) for c, z1, z2, w1, w2, m in CANDIDATES]
    return spark.createDataFrame(rows, "cand int, z array<double>, w array<double>, m int")


CANDIDATE_VALUES = ", ".join(f"({c}, {z1}e0, {z2}e0, {w1}e0, {w2}e0, {m})" for c, z1, z2, w1, w2, m in CANDIDATES)


def members_sql(metric: str = "box") -> str:
    box = "greatest(abs(z_x1 - c1) / greatest(w1, 1e-9), abs(z_x2 - c2) / greatest(w2, 1e-9))"
    euclid = "sqrt((z_x1 - c1) * (z_x1 - c1) + (z_x2 - c2) * (z_x2 - c2))"
    u = euclid if metric == "ball" else box
    return (
        STANDARD
        + f""",
cands(cand, c1, c2, w1, w2, m) AS (VALUES {CANDIDATE_VALUES}),
members AS (
  SELECT cand, id, u FROM (
    SELECT cand, id, u, m, row_number() OVER (PARTITION BY cand ORDER BY u, d, id) AS r
    FROM (SELECT cand, m, id, round({u}, 10) AS u, round({euclid}, 10) AS d FROM std, cands)) WHERE r <= m)"""
    )


MEASURED = (
    members_sql()
    + """,
tot AS (SELECT count(*) AS n, sum(loss) AS total FROM scored),
ins AS (SELECT cand, count(*) AS m, sum(loss) AS s, stddev_samp(loss) AS sd_in, var_samp(loss) AS var_in, avg(CASE WHEN loss > 0.5e0 THEN 1e0 ELSE 0e0 END) AS tail_rate FROM members JOIN scored USING (id) GROUP BY cand),
measured AS (SELECT cand, m, s / m / ((total - s) / (n - m)) - 1 AS contrast, s / m AS mean_in, (total - s) / (n - m) AS mean_out, sd_in, tail_rate, var_in FROM ins, tot)"""
)
