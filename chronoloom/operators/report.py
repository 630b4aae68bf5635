"""Release gate, display columns, plan and state reports, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Pack
from .dates import render_date

# --- Fixed values ---------------------------------------------------------------------------
SECONDS_PER_UNIT = 0.4
PDF_MARK = " [pdf]"
FLAGGED_STATUSES = ("undated", "ambiguous", "illegible", "inferred")
# -------------------------------------------------------------------------------------------


def release_gate(rows: DataFrame, locators: DataFrame, bullets: DataFrame,
                 unit_pages: DataFrame, bundles: DataFrame) -> DataFrame:
    """Per case: the counts that must be zero, page coverage, and whether all hold.

    ``unit_pages`` has each page of each unit; ``bundles`` has ``page_count``.
    """
    located = locators.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("flagged").alias("flagged"))
    by_row = rows.select("case_id", "row_id").join(located, "row_id", "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n").isNull()).alias("unlocated_rows"),
        F.count_if(F.coalesce("flagged", F.lit(False))).alias("rows_without_printed_label"))
    uncited = bullets.filter(F.col("block_id").isNull()).groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"))
    bad = uncited.join(rows.select("row_id", "case_id"), "row_id").groupBy("case_id").agg(
        F.sum("n").alias("uncited"))
    covered = unit_pages.select("case_id", "bundle_id", "pdf_index").distinct().groupBy(
        "case_id").agg(F.count(F.lit(1)).alias("pages_covered"))
    total = bundles.groupBy("case_id").agg(F.sum("page_count").alias("pages_total"))
    out = (
        total.join(by_row, "case_id", "left").join(bad, "case_id", "left")
        .join(covered, "case_id", "left").fillna(0, [
            "rows", "unlocated_rows", "rows_without_printed_label", "uncited", "pages_covered"])
    )
    coverage = F.coalesce(
        F.col("pages_covered") / F.nullif("pages_total", F.lit(0)), F.lit(1.0))
    return out.select(
        "case_id", "rows", "uncited", "unlocated_rows", F.round(coverage, 6).alias("coverage"),
        "pages_total", "pages_covered", "rows_without_printed_label",
        ((F.col("uncited") == 0) & (F.col("unlocated_rows") == 0) & (coverage == 1.0))
        .alias("passes"))


def locator_text(folder: Column, page: Column, flagged: Column, pack: Pack) -> Column:
    spec = pack.output.get("locator", {})
    joiner = "\n" if spec.get("line_break_before_page", True) else spec.get("separator", " / ")
    text = F.concat(folder, F.lit(joiner + spec.get("page_prefix", "p. ")), page)
    return F.when(flagged, F.concat(text, F.lit(PDF_MARK))).otherwise(text)


def display_locators(locators: DataFrame, bundles: DataFrame, pack: Pack) -> DataFrame:
    """Locators with the folder name printed for them."""
    named = locators.join(bundles.select("bundle_id", "folder_label"), "bundle_id", "left")
    folder = F.coalesce("folder_label", "bundle_id")
    return named.withColumn("locator", locator_text(
        folder, F.col("display_page"), F.col("flagged"), pack))


def display_rows(rows: DataFrame, pack: Pack, show_code: bool = False) -> DataFrame:
    """Rows with their printed date, title and warnings; needs ``confidence`` and ``warns``."""
    words = pack.output.get("rows", {})
    title = F.col("title")
    if show_code and pack.class_codes:
        codes = F.create_map(*[F.lit(x) for kv in pack.class_codes.items() for x in kv])
        code = F.try_element_at(codes, F.col("doc_class"))
        title = F.when(code.isNotNull(), F.concat(F.lit("["), code, F.lit("] "), title)).otherwise(title)
    return rows.withColumns({
        "date_cell": render_date(F.col("row_date"), F.col("date_status")),
        "title_cell": title,
        "illegible_cell": F.when(F.col("illegible_reason").isNotNull(), F.concat(
            F.lit(words.get("illegible_label", "Illisible") + " — "), F.col("illegible_reason"))),
        "warning_cell": F.when(F.col("warns"), F.format_string("⚠ confiance %.2f", "confidence")),
    })


def review_rank() -> Column:
    return (
        F.when(F.col("date_status").isin("undated", "illegible"), 0)
        .when(F.col("date_status") == "ambiguous", 1)
        .when(F.col("warns") | F.col("flagged"), 2).otherwise(3)
    )


def review_queue(rows: DataFrame, locators: DataFrame) -> DataFrame:
    """Rows with ``rank``: what needs a date first, then the unsure, then the rest.

    Order by rank, confidence and the row order to print it.
    """
    marks = locators.groupBy("row_id").agg(F.bool_or("flagged").alias("flagged"))
    joined = rows.join(marks, "row_id", "left").withColumn(
        "flagged", F.coalesce("flagged", F.lit(False)))
    return joined.withColumn("rank", review_rank())


#: What a plan counts of units.
PLAN_COUNTS = ("units", "undated", "ambiguous", "illegible", "unclassified", "non_contiguous",
               "excluded_by_rule", "off_by_toggle", "units_in_other_regime")


def plan_tally(units: DataFrame, bundles: DataFrame, pack: Pack) -> DataFrame:
    """(case_id, bundle_id): the plan's counts of one bundle; they add up over bundles.

    ``bundles``: case_id, bundle_id, page_count.
    """
    off = pack.switched_off
    toggled = F.col("doc_class").isin(*off) if off else F.lit(False)
    counts = units.groupBy("case_id", "bundle_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("date_status") == "undated").alias("undated"),
        F.count_if(F.col("date_status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("legibility") == "illegible").alias("illegible"),
        F.count_if(F.col("doc_class") == pack.unknown_class).alias("unclassified"),
        F.count_if(~F.col("contiguous")).alias("non_contiguous"),
        F.count_if(F.col("excluded_by").isNotNull()).alias("excluded_by_rule"),
        F.count_if(toggled).alias("off_by_toggle"),
        F.count_if(F.col("regime") != pack.id).alias("units_in_other_regime"))
    return bundles.select("case_id", "bundle_id", "page_count").join(
        counts, ["case_id", "bundle_id"], "left").fillna(0)


def plan_summary(units: DataFrame, bundles: DataFrame, pack: Pack) -> DataFrame:
    """Per case: what a run would cover, and what in it needs a look."""
    return plan_from(plan_tally(units, bundles, pack), pack)


def plan_from(tallies: DataFrame, pack: Pack) -> DataFrame:
    """The plan of every case from the tallies of its bundles."""
    out = tallies.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("bundles"), F.sum("page_count").alias("pages"),
        *[F.sum(n).alias(n) for n in PLAN_COUNTS])
    flags = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(n) > 0, F.concat_ws(" ", F.col(n).cast("string"), F.lit(n)))
        for n in ("undated", "ambiguous", "illegible", "unclassified", "non_contiguous")])), ", ")
    held = F.col("excluded_by_rule") + F.col("off_by_toggle")
    summary = F.concat_ws(
        " · ",
        F.concat(F.col("units").cast("string"), F.lit(" report units across "),
                 F.col("bundles").cast("string"),
                 F.when(F.col("bundles") == 1, " bundle").otherwise(" bundles")),
        F.lit(f"regime {pack.id.upper()}"), F.nullif(flags, F.lit("")),
        F.when(held > 0, F.concat(held.cast("string"), F.lit(" excluded by rule or toggle"))),
        F.concat(F.lit("est. "), F.bround(F.col("units") * SECONDS_PER_UNIT).cast("int")
                 .cast("string"), F.lit(" s")))
    return out.withColumns({
        "estimate_seconds": F.bround(F.col("units") * SECONDS_PER_UNIT, 1), "summary": summary,
        "pack_gaps": F.to_json(F.create_map(*[
            F.lit(x) for kv in sorted(pack.known_gaps.items()) for x in kv]))
        if pack.known_gaps else F.lit("{}"),
    })


def units_by_class(units: DataFrame, pack: Pack) -> DataFrame:
    """(case_id, label, n): class histogram; print it by n descending, then label."""
    labels = F.create_map(*[F.lit(x) for kv in pack.class_labels.items() for x in kv])
    label = F.coalesce(F.try_element_at(labels, F.col("doc_class")), F.col("doc_class"))
    return units.groupBy("case_id", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def explain_units(units: DataFrame, facts: DataFrame, records: DataFrame, fixes: DataFrame,
                  audit: DataFrame, bundles: DataFrame) -> DataFrame:
    """Everything known about each unit, nested.  Filter ``units`` first: this is a close look."""
    wanted = units.select("unit_id")

    def nested(df: DataFrame, key: str, name: str, *cols) -> DataFrame:
        mine = df.withColumnRenamed(key, "unit_id") if key != "unit_id" else df
        return mine.join(wanted, "unit_id", "left_semi").groupBy("unit_id").agg(
            F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    dates = nested(facts, "unit_id", "dates_found", "pdf_index", "start", "ord", "kind", "end",
                   "role", "raw", "readings", "century_inferred", "block_id")
    read = nested(records, "unit_id", "records", "stage", "field", "value", "confidence",
                  "derived", "rule", "epistemic_tag", "block_id", "span_start", "span_end")
    fixed = nested(fixes.filter(F.col("subject_type") == "unit"), "subject_id", "corrections",
                   "created_at", "correction_id", "field", "old_value", "new_value", "actor")
    told = nested(audit.filter(F.col("subject_type") == "unit"), "subject_id", "audit",
                  "ts", "audit_id", "action", "rule", "detail")
    return (
        units.join(bundles.select("bundle_id", "folder_label"), "bundle_id", "left")
        .join(dates, "unit_id", "left").join(read, "unit_id", "left")
        .join(fixed, "unit_id", "left").join(told, "unit_id", "left")
    )


def case_state(cases: DataFrame, bundles: DataFrame, blocks: DataFrame, units: DataFrame,
               fixes: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of everything held for each case."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    out = cases.select("case_id", "name", "primary_pack").join(
        bundles.groupBy("case_id").agg(
            F.count(F.lit(1)).alias("bundles"), F.sum("page_count").alias("pages")),
        "case_id", "left")
    for df, name in ((blocks, "blocks"), (units, "units"), (fixes, "corrections"),
                     (runs, "runs"), (rows, "rows")):
        out = out.join(count(df, name), "case_id", "left")
    return out.fillna(0)


def stage_progress(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Per (run, stage): how many steps stand at each status."""
    return jobs.groupBy("run_id", "stage").agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in statuses])
