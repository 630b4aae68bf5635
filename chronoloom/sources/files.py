"""Bundles as files: registered by what they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content) of the files under ``path``."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    )


def register(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One bundle per file: id and hash from the content, folder label from the directory.

    ``files``: case_id, path, content and, where the firm gives one, folder_label.  ``pages``
    (bundle_id, pdf_index) supplies the page count.
    """
    parts = F.split("path", "/")
    label = F.element_at(parts, -2)
    if "folder_label" in files.columns:
        label = F.coalesce("folder_label", label)
    out = files.select(
        "case_id", F.element_at(parts, -1).alias("filename"), label.alias("folder_label"),
        F.sha2("content", 256).alias("content_hash"), "path",
    ).withColumn("bundle_id", tx.digest(
        F.col("case_id"), F.col("content_hash"), F.col("folder_label"), size=20, prefix="bundle_"))
    if pages is None:
        return out.withColumn("page_count", F.lit(None).cast("long"))
    counts = pages.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("page_count"))
    return out.join(counts, "bundle_id", "left").fillna(0, ["page_count"])


def new_content(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not stored yet; equal content is stored once.

    ``files`` and ``known`` have ``content_hash``.
    """
    return files.dropDuplicates(["content_hash"]).join(
        known.select("content_hash"), "content_hash", "left_anti")


def missing_content(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Hashes that are referred to but not stored; a job that reads them must stop."""
    return wanted.select("content_hash").distinct().join(
        known.select("content_hash"), "content_hash", "left_anti")
