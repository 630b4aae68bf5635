"""Answer keys: what a case should yield, one JSON file per case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """One row per key file, with its version and a digest of its text."""
    raw = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    parsed = raw.withColumn("k", F.from_json("value", schemas.GOLD))
    return parsed.select(
        F.element_at(F.split("path", "/"), -2).alias("gold"),
        F.coalesce("k.gold_version", F.lit("1")).alias("version"),
        F.substring(F.sha2("value", 256), 1, 16).alias("digest"),
        "k.bundles", "k.units", "k.printed_labels", "k.proposed", "k.unresolved")


def key_units(keys: DataFrame) -> DataFrame:
    """(case_id, gold_id, gold_ord, ...): the units a key expects, in its order."""
    each = keys.select("gold", F.posexplode("units").alias("gold_ord", "u"))
    return each.select(
        F.col("gold").alias("case_id"),
        F.concat_ws("#", "gold", F.col("gold_ord").cast("string")).alias("gold_id"), "gold_ord",
        "u.pages", F.col("u.class").alias("doc_class"),
        F.try_to_date("u.row_date", "yyyy-MM-dd").alias("row_date"),
        F.col("u.status").alias("status"), F.col("u.excluded_by").alias("excluded_by"),
        F.col("u.regime").alias("regime"), F.col("u.cue_fields").alias("cue_fields"))


def key_pages(units: DataFrame) -> DataFrame:
    return units.select("case_id", "gold_id", F.explode("pages").alias("pdf_index"))


def key_fields(units: DataFrame) -> DataFrame:
    return units.select(
        "case_id", "gold_id", F.explode("cue_fields").alias("field", "expected"))
