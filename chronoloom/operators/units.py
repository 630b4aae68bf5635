"""Report units: a document is a set of pages of one bundle, not a page range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import first_by
from .rejoin import rejoin

__all__ = ["page_groups", "rejoin", "unit_spans", "unit_pages", "unit_blocks", "headline",
           "unlabelled_pages", "build", "tally", "listing"]

def page_groups(grouped: DataFrame) -> DataFrame:
    """One row per run of pages, with what its first and last page say."""
    edge = F.struct("label_of", "serial", "author")
    runs = grouped.groupBy("case_id", "bundle_id", "group_start").agg(
        F.max("pdf_index").alias("last_page"), F.count(F.lit(1)).alias("n_pages"),
        F.min_by(edge, "pdf_index").alias("a"), F.max_by(edge, "pdf_index").alias("z"),
    )
    return runs.select(
        "case_id", "bundle_id", "group_start", "last_page", "n_pages",
        F.col("a.label_of.k").alias("first_k"), F.col("a.label_of.n").alias("first_n"),
        F.col("a.serial").alias("first_serial"), F.col("a.author").alias("first_author"),
        F.col("z.label_of.k").alias("last_k"), F.col("z.label_of.n").alias("last_n"),
        F.col("z.serial").alias("last_serial"), F.col("z.author").alias("last_author"),
    )


def unit_spans(groups: DataFrame) -> DataFrame:
    """One row per unit: id, page runs, first page, page count.

    A unit holds one run plus one per re-joined part, so the list of runs stays short however
    many pages the runs have.
    """
    if "host_start" not in groups.columns:
        groups = groups.withColumn("host_start", F.col("group_start"))
    run = F.struct(F.col("group_start").alias("first"), F.col("last_page").alias("last"),
                   F.col("n_pages").alias("n"))
    spans = groups.groupBy("case_id", "bundle_id", "host_start").agg(
        F.array_sort(F.collect_list(run)).alias("spans"), F.sum("n_pages").alias("n_pages"),
    )
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        "-", s["first"].cast("string"), s["last"].cast("string"), s["n"].cast("string"))), ",")
    last = F.element_at("spans", -1)["last"]
    return spans.select(
        "case_id", "bundle_id", "host_start",
        tx.digest(F.col("bundle_id"), written, size=20, prefix="unit_", sep=":").alias("unit_id"),
        "spans", F.col("host_start").alias("first_page"), "n_pages",
        (F.col("n_pages") == last - F.col("host_start") + 1).alias("contiguous"),
    )


def unit_pages(grouped: DataFrame, groups: DataFrame, spans: DataFrame) -> DataFrame:
    """(unit_id, page) for every page: the relation all block-to-unit joins go through."""
    if "host_start" in groups.columns:
        hosts = groups.select("bundle_id", "group_start", "host_start")
        grouped = grouped.join(hosts, ["bundle_id", "group_start"])
    else:
        grouped = grouped.withColumn("host_start", F.col("group_start"))
    named = spans.select("bundle_id", "host_start", "unit_id")
    return grouped.join(named, ["bundle_id", "host_start"]).select(
        "case_id", "bundle_id", "pdf_index", "unit_id",
        (F.col("pdf_index") == F.col("host_start")).alias("is_first"),
        "serial", "revision", "author",
    )


def unit_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with their unit; one equi join on the page for the whole corpus."""
    return blocks.join(
        pages.select("bundle_id", "pdf_index", "unit_id", "is_first"), ["bundle_id", "pdf_index"]
    )


def headline(pages: DataFrame) -> DataFrame:
    """Serial, revision and author of a unit: each the first one any of its pages names."""
    page = F.col("pdf_index")
    return pages.groupBy("unit_id").agg(
        first_by(F.col("serial"), page).alias("form_serial"),
        first_by(F.col("revision"), page).alias("form_revision"),
        first_by(F.col("author"), page).alias("author"),
    )


def unlabelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages of a unit that carry no confirmed printed label."""
    return pages.join(
        labels.filter(F.coalesce("printed_label", F.lit("")) != ""), ["bundle_id", "pdf_index"],
        "left_anti",
    ).select("unit_id", "bundle_id", "pdf_index")


def build(
    spans: DataFrame, heads: DataFrame, classes: DataFrame, legibility: DataFrame,
    row_dates: DataFrame, verdicts: DataFrame, regimes: DataFrame | None, default_regime: str,
) -> DataFrame:
    """The unit table: every part joined on ``unit_id``, one row per unit on each side."""
    out = (
        spans.join(heads, "unit_id", "left").join(classes, "unit_id", "left")
        .join(legibility, "unit_id", "left").join(row_dates, "unit_id", "left")
        .join(verdicts, "unit_id", "left")
    )
    if regimes is None:
        return out.withColumns({
            "regime": F.lit(default_regime), "regime_source": F.lit("case_default"),
            "kind": F.lit("primary"),
        })
    return out.join(regimes, "unit_id", "left").withColumns({
        "regime": F.coalesce("regime", F.lit(default_regime)),
        "regime_source": F.coalesce("regime_source", F.lit("case_default")),
        "kind": F.lit("primary"),
    })


def tally(units: DataFrame, unknown_class: str = "unknown") -> DataFrame:
    """Per bundle: how many units, and how many need a look and why."""
    return units.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(~F.col("contiguous")).alias("non_contiguous"),
        F.count_if(F.size("spans") > 1).alias("rejoined_units"),
        F.count_if(F.col("date_status") == "undated").alias("undated"),
        F.count_if(F.col("date_status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("legibility") == "illegible").alias("illegible"),
        F.count_if(F.col("doc_class") == unknown_class).alias("unclassified"),
        F.count_if("needs_fallback").alias("needs_fallback"),
        F.count_if(F.col("excluded_by").isNotNull()).alias("excluded"),
        F.count_if(F.col("regime_source") == "screened").alias("off_regime"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("filters_unavailable"))))
        .alias("filters_unavailable"),
    )


def listing(units: DataFrame) -> DataFrame:
    """Flat view of the units of a case."""
    return units.select(
        "case_id", "bundle_id", "unit_id", "first_page", "n_pages", "contiguous", "doc_class",
        "class_confidence", "class_source", "regime", "legibility", "author", "form_serial",
        "form_revision", "row_date", "date_status", "date_role", "date_explanation",
        "excluded_by",
    )
