"""Writing the stored tables.

Plain files know no update, so a change writes the next version of a table: what stays plus
what is new.  A job that fails leaves the version it read untouched, and one that runs twice
writes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import running


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the groups that ``new`` brings, plus ``new``."""
    groups = new.select(*keys).distinct()
    return old.join(groups, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_bundles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks or pages after bundles were read again."""
    return replaced(old, new, ["bundle_id"])


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return replaced(old, new, [key])


def replaced_records(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """Records after (unit, stage) steps ran; a step that read nothing clears its records.

    ``done``: unit_id, stage of the steps that ran.
    """
    return old.join(done.select("unit_id", "stage"), ["unit_id", "stage"], "left_anti").unionByName(new)


def without_units(child: DataFrame, gone: DataFrame) -> DataFrame:
    """A child table after units were deleted."""
    return child.join(gone.select("unit_id"), "unit_id", "left_anti")


def marked_excluded(units: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Units with newly excluded ones marked; nothing is deleted."""
    new = exclusions.select("unit_id", F.col("excluded_by").alias("_new"))
    return units.join(new, "unit_id", "left").withColumn(
        "excluded_by", F.coalesce("_new", "excluded_by")).drop("_new")


def write_version(df: DataFrame, root: str, table: str, version: str,
                  partition_by: list[str] | None = None) -> str:
    """Write a table version; the caller points readers at it when the job is done."""
    path = f"{root}/{table}/v={version}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


READING_ORDER = ("bundle_id", "pdf_index", "ord")


def clustered(rows: DataFrame, order: Sequence[str | Column] = READING_ORDER) -> DataFrame:
    """Rows dealt out in ranges of an order and sorted.  Projections behind it keep both, so what
    is wide (typed blocks) can be worked out from what is slim (pages) after the shuffle."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_blocks(blocks: DataFrame, root: str, version: str, group_bytes: int = 16 << 20, *,
                 ordered: bool = False) -> str:
    """The block store: clustered by reading order, with a filter on the block id in each group.

    Files hold ranges of (bundle, page, order), so a scan of a bundle opens the few row groups
    whose bounds hold it.  Ids are digests and lie anywhere; a Bloom filter per row group tells
    which groups can hold one, so that a lookup skips all others.  ``ordered``: the blocks come
    from rows that were clustered before.
    """
    path = f"{root}/blocks/v={version}"
    ((blocks if ordered else clustered(blocks)).write.mode("overwrite")
     .option("parquet.block.size", group_bytes).option("parquet.bloom.filter.enabled#block_id", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))
    return path


def run_snapshot(rows: DataFrame, run_id: str, order: list[str]) -> DataFrame:
    """Rows of a run with their place in the chronology of their case.

    The place comes from a range partitioning of the rows, so a case of any size is numbered
    side by side.  ``order``: columns that give a total order.
    """
    placed = running(rows, ["case_id"], order, sums={"ord": F.lit(1)})
    return placed.withColumns({"ord": F.col("ord") - 1, "run_id": F.lit(run_id)})


def write_run(df: DataFrame, root: str, table: str) -> None:
    """Write the partition of a run; writing it again replaces it and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id").parquet(f"{root}/{table}")


def audit_entries(subjects: DataFrame, subject_type: str, subject: Column, action: str,
                  detail: Column, *, run_id: str, rule: Column, ts: Column,
                  actor: str = "engine", tag: str | None = None) -> DataFrame:
    """Log entries of one stage.  Ids come from content, so a retry writes the same entries."""
    return subjects.select(
        tx.digest(F.lit(run_id), F.lit(subject_type), subject, F.lit(action), size=20,
                  prefix="aud_").alias("audit_id"),
        ts.alias("ts"), F.lit(actor).alias("actor"), F.lit(run_id).alias("run_id"),
        F.lit(subject_type).alias("subject_type"), subject.alias("subject_id"),
        F.lit(action).alias("action"), rule.alias("rule"),
        F.lit(tag).cast("string").alias("epistemic_tag"), F.to_json(detail).alias("detail"))


def append_corrections(log: DataFrame, root: str) -> None:
    """Add corrections to the log; the log is never rewritten."""
    log.write.mode("append").parquet(f"{root}/corrections")
