"""Page-level facts: printed labels, tier choice, page rows, parse figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import first_by
from .blocks import is_body

# --- Fixed values ---------------------------------------------------------------------------
TRUSTED_LABELS = ("page_x_of_y", "page_x_of_truncated", "page_n")
YEARS = (1900, 2100)
RECURRING_ABOVE = 20
READABLE = 0.35
BANNER_PAGE = r"\bp(?:age)?\.?\s*:?\s*(\d{1,3})\s*/\s*(\d{1,3})\b"
BANNER_SENT = r"\b(\d{1,2}/\d{1,2}/\d{2,4})[,\s]+(\d{1,2}:\d{2}(?::\d{2})?)\s*(AM|PM)?"
# -------------------------------------------------------------------------------------------

PAGE = ["bundle_id", "pdf_index"]


def label_candidates(blocks: DataFrame) -> DataFrame:
    """One (rule, label) per page: the last label block, as footers come below headers."""
    return (
        blocks.filter(F.col("type") == "page_label")
        .groupBy(*PAGE)
        .agg(F.max_by(F.struct(
            F.coalesce("label_rule", F.lit("bare_number")).alias("rule"),
            F.coalesce("label", F.lit("")).alias("label")), F.col("ord")).alias("_w"))
        .select(*PAGE, "_w.rule", "_w.label")
    )


def confirm_labels(candidates: DataFrame) -> DataFrame:
    """Candidates that are page numbers for sure: (page, printed_label).

    A bare number is dropped when it is a year, or when it is large and printed on several
    pages of the bundle.  Counts are aggregated per value first, so a bundle or value of any
    size costs one row per partition in the shuffle.
    """
    bare = (F.col("rule") == "bare_number") & F.col("label").rlike("^[0-9]+$")
    numbered = candidates.withColumn("value", F.when(bare, F.expr("try_cast(label as int)")))
    repeats = (
        numbered.filter(F.col("value") > RECURRING_ABOVE)
        .groupBy("bundle_id", "value").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).select("bundle_id", "value", F.lit(True).alias("recurs"))
    )
    trusted = F.col("rule").isin(*TRUSTED_LABELS)
    kept = F.col("value").isNotNull() & ~F.col("value").between(*YEARS) & F.col("recurs").isNull()
    return (
        numbered.join(repeats, ["bundle_id", "value"], "left")
        .filter(trusted | kept)
        .select(*PAGE, F.col("label").alias("printed_label"))
    )


def banner(text: Column) -> Column:
    """struct(sent, position, total) of a fax banner; null where it is none."""
    position = tx.group(text, BANNER_PAGE, 1).cast("int")
    total = tx.group(text, BANNER_PAGE, 2).cast("int")
    sent = F.concat_ws(" ", *[tx.group(text, BANNER_SENT, i) for i in (1, 2, 3)])
    return F.when(
        tx.hits(text, BANNER_PAGE) & (total > 0) & (position <= total),
        F.struct(sent.alias("sent"), position.alias("position"), total.alias("total")),
    )


def transmissions(blocks: DataFrame) -> DataFrame:
    """The first stamp of each page that reads as a fax banner."""
    read = blocks.filter(F.col("type") == "stamp").select(*PAGE, "ord", banner(F.col("text")).alias("b"))
    return (
        read.filter(F.col("b").isNotNull())
        .groupBy(*PAGE).agg(first_by(F.col("b"), F.col("ord")).alias("b"))
        .select(*PAGE, "b.*")
    )


def page_quality(blocks: DataFrame) -> DataFrame:
    """Word-likeness of each page over all its blocks."""
    counts = tx.counted_words(blocks.columns)
    return (
        blocks.select(*PAGE, counts.alias("w"))
        .groupBy(*PAGE).agg(F.sum("w.good").alias("good"), F.sum("w.alpha").alias("alpha"))
        .select(*PAGE, tx.share(F.col("good"), F.col("alpha")).alias("quality"))
    )


def choose_tier(attempts: DataFrame, readable: float = READABLE) -> DataFrame:
    """Blocks of the tier that gets each page.

    ``attempts`` holds the blocks of every tier with ``tier_rank`` (0 is cheapest).  The
    cheapest tier whose body text reads as words wins; if none does, the one with most
    blocks, the cheaper of two equals.  Blocks are summed per (page, tier) before a page picks.
    """
    body = F.when(is_body(F.col("type")), tx.counted_words(attempts.columns))
    scored = (
        attempts.select(*PAGE, "tier_rank", body.alias("w"))
        .groupBy(*PAGE, "tier_rank")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("w.good").alias("good"),
             F.sum("w.alpha").alias("alpha"))
    )
    good = F.coalesce(tx.share(F.col("good"), F.col("alpha")), F.lit(0.0)) >= readable
    # Smaller is better in every place of this key.
    rank = F.struct(
        F.when(good, 0).otherwise(1), F.when(good, F.col("tier_rank")).otherwise(F.lit(0)),
        F.when(good, F.lit(0)).otherwise(-F.col("n")), F.col("tier_rank"),
    )
    chosen = scored.groupBy(*PAGE).agg(F.min_by("tier_rank", rank).alias("tier_rank"))
    return attempts.join(chosen, [*PAGE, "tier_rank"], "left_semi")


def page_rows(pages: DataFrame, blocks: DataFrame, labels: DataFrame,
              attempted: DataFrame | None = None) -> DataFrame:
    """One row per page of the bundle, read or not.

    A page without blocks is ``unclaimed``; it is ``empty`` where ``attempted`` says a tier
    took it and found nothing.
    """
    seen = blocks.groupBy(*PAGE).agg(
        F.sum(F.length("text")).alias("char_count"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.min_by("source", F.struct("ord")).alias("source"),
    )
    rows = pages.join(seen, PAGE, "left").join(labels, PAGE, "left")
    nothing = F.lit("unclaimed")
    if attempted is not None:
        rows = rows.join(attempted.select(*PAGE, F.lit(True).alias("_tried")).distinct(), PAGE, "left")
        nothing = F.when(F.col("_tried"), "empty").otherwise("unclaimed")
    return rows.select(
        *pages.columns, "printed_label",
        F.coalesce("char_count", F.lit(0)).alias("char_count"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce("source", nothing).alias("parse_source"),
    )


def parse_metrics(rows: DataFrame) -> DataFrame:
    """Per bundle: pages, blocks, unread and labelled pages, pages by tier."""
    by_tier = rows.groupBy("bundle_id", "parse_source").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n_blocks").alias("blocks"),
        F.count_if(F.col("n_blocks") == 0).alias("unread"),
        F.count_if(F.coalesce(F.col("printed_label"), F.lit("")) != "").alias("labelled"),
    )
    return by_tier.groupBy("bundle_id").agg(
        F.sum("pages").alias("pages"), F.sum("blocks").alias("blocks"),
        F.sum("unread").alias("unread_pages"), F.sum("labelled").alias("labelled_pages"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("parse_source", "pages"))))
        .alias("pages_by_tier"),
    ).withColumn("unread_ratio", F.col("unread_pages") / F.col("pages"))
