"""Reading and writing files: CSV with a fixed schema, JSON documents, Parquet results, digests and manifests."""

from __future__ import annotations

import json
import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or local where that is unset."""
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="weakspot-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A headed CSV under a given schema; a row that doesn't fit it fails the read instead of turning null."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return read_csv(df.sparkSession, path, df.schema)


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a result folder and refuses one that is there."""
    df.write.mode("errorifexists").format(kind).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """source, document: each JSON file whole, as a variant."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.parse_json("value").alias("document"))


def json_round_trip(df: DataFrame, *without: str) -> DataFrame:
    """document: df's rows written as JSON lines and parsed again, without the named columns. Non-finite numbers are refused."""
    checks = [F.isnan(c) | (F.abs(c) == float("inf")) for c, t in df.dtypes if t in ("double", "float")]
    for bad in checks:
        df = df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a number isn't finite")).cast("boolean")).otherwise(True))
    path = scratch(df.sparkSession, "json")
    df.drop(*without).write.json(path)
    return df.sparkSession.read.text(path).select(F.parse_json("value").alias("document"))


def _refuse(name):
    raise ValueError(f"{name} is no JSON number")


def _finite(name):
    return x if math.isfinite(x := float(name)) else _refuse(name)


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key stands twice")
    return out


def strict_json(text: str):
    """The value of a JSON text; repeated keys and non-finite numbers, also those too large for a float, are refused."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse, parse_float=_finite)


def strict_dump(value) -> str:
    """JSON with indent 2, without NaN or infinities."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not finite")
    return json.dumps(value, allow_nan=False, indent=2, sort_keys=True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, digest (SHA-256) of each file under path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))


def manifest_report(listed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files listed, changed, missing."""
    both = listed.select("name", F.col("digest").alias("_want")).join(found.select("name", F.col("digest").alias("_have")), "name", "left")
    return both.agg(F.count("*").alias("files"), F.count_if(F.col("_have") != F.col("_want")).alias("changed"), F.count_if(F.col("_have").isNull()).alias("missing"))


def verify_manifest(listed: DataFrame, found: DataFrame) -> None:
    row = manifest_report(listed, found).first()
    if row["changed"] or row["missing"]:
        raise ValueError(f"manifest doesn't hold: {row['changed']} changed, {row['missing']} missing")
