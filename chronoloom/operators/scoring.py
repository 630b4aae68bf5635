"""Scoring a run against an answer key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..functions.ordered import running
from ..functions.similarity import reaches
from ..session import cut
from .worklist import COMPLETE_STOPS

# --- Fixed values ---------------------------------------------------------------------------
SIMILAR = 0.82
NEAR_DAYS = 3
# -------------------------------------------------------------------------------------------


def date_accuracy(got: Column, want: Column) -> Column:
    """exact, near (three days), wrong, missing, spurious or both_undated."""
    off = F.abs(F.datediff(got, want))
    return (
        F.when(want.isNull() & got.isNull(), "both_undated").when(want.isNull(), "spurious")
        .when(got.isNull(), "missing").when(off == 0, "exact")
        .when(off <= NEAR_DAYS, "near").otherwise("wrong")
    )


def ratio_of(hits: Column, total: Column) -> Column:
    """A score; nothing to score is a full score."""
    return F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(1.0))


def score_table(counts: DataFrame, scores: dict[str, tuple[str, str, float | None]],
                keys: list[str]) -> DataFrame:
    """Wide counts to one row per score: name, hits, total, value, must_hold, holds."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.col(h).cast("long").alias("hits"),
            F.col(t).cast("long").alias("total"), F.lit(must).cast("double").alias("must_hold"))
        for name, (h, t, must) in scores.items()])
    out = counts.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")
    value = ratio_of(F.col("hits"), F.col("total"))
    return out.withColumn("value", value).withColumn(
        "holds", F.col("must_hold").isNull() | (F.col("value") >= F.col("must_hold")))


def _placed(pages: DataFrame, name: str, nowhere: int) -> DataFrame:
    """The pages of one side, each once, dealt out by page.

    One shuffle serves the distinct rows, the join on the page and the counts.  A page without a
    number meets no page of the other side, so each side has its own number for it.
    """
    page = F.coalesce(F.col("pdf_index"), F.lit(nowhere)).alias("pdf_index")
    return pages.where(F.col("case_id").isNotNull() & F.col(name).isNotNull()).select(
        "case_id", name, page).repartition("case_id", "pdf_index").distinct()


def overlaps(unit_pages: DataFrame, gold_pages: DataFrame) -> DataFrame:
    """(case_id, gold_id, unit_id, overlap) for every pair that shares a page.

    ``unit_pages``: case_id, unit_id, pdf_index; ``gold_pages``: case_id, gold_id, pdf_index; a
    page that comes twice counts once.
    """
    unit_pages = _placed(unit_pages, "unit_id", -(1 << 31))
    gold_pages = _placed(gold_pages, "gold_id", 1 - (1 << 31))
    shared = unit_pages.join(gold_pages, ["case_id", "pdf_index"]).groupBy(
        "case_id", "gold_id", "unit_id").agg(F.count(F.lit(1)).alias("both"))
    of_unit = unit_pages.groupBy("case_id", "unit_id").agg(F.count(F.lit(1)).alias("n_unit"))
    of_gold = gold_pages.groupBy("case_id", "gold_id").agg(F.count(F.lit(1)).alias("n_gold"))
    out = shared.join(of_gold, ["case_id", "gold_id"]).join(of_unit, ["case_id", "unit_id"])
    return out.select("case_id", "gold_id", "unit_id", (
        F.col("both") / (F.col("n_unit") + F.col("n_gold") - F.col("both"))).alias("overlap"))


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gold units in order, each with its best unit that is still free.

    Rows come case by case, in the order in which they are tried; one pass serves all cases of a
    task, since most have a pair or two.
    """
    case = gold = None
    used: set[str] = set()
    for batch in batches:
        own = batch.column("case_id").to_pylist()
        golds, names = batch.column("gold_ord").to_pylist(), batch.column("unit_id").to_pylist()
        rows = []
        for i, (a, g, unit) in enumerate(zip(own, golds, names, strict=True)):
            if a != case:
                case, gold = a, None
                used.clear()
            if g != gold and unit not in used:
                gold = g
                used.add(unit)
                rows.append(i)
        if rows:
            yield batch.take(pa.array(rows))


def _chunked(open_: DataFrame, chunk_pairs: int) -> DataFrame:
    """The pairs with the ``chunk`` of their gold unit: 0 but for cases of more than a chunk."""
    case = open_.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut(case.where(F.col("n") > chunk_pairs).select("case_id"))
    if large.isEmpty():
        return open_.withColumn("chunk", F.lit(0).cast("long"))
    sizes = open_.join(large, "case_id", "left_semi").groupBy("case_id", "gold_ord").agg(
        F.count(F.lit(1)).alias("n"))
    placed = running(cut(sizes), ["case_id"], ["gold_ord"], sums={"upto": F.col("n")}).select(
        "case_id", "gold_ord", F.floor((F.col("upto") - F.col("n")) / chunk_pairs).alias("chunk"))
    return cut(open_.join(placed, ["case_id", "gold_ord"], "left").fillna(0, "chunk"))


def match_units(pairs: DataFrame, gold: DataFrame, units: DataFrame, chunk_pairs: int = 1 << 16) -> DataFrame:
    """Pair gold units with engine units: in gold order, each takes its best free unit.

    ``pairs``: see ``overlaps``; ``gold``: case_id, gold_id, gold_ord; ``units``: case_id,
    unit_id, unit_ord (ties go to the lower).  A choice depends on all earlier ones of its case
    that want the same units, in chains of any length, so a case is gone through in order: in
    chunks of gold units with about ``chunk_pairs`` pairs, one round for each, all cases side by
    side.  A chunk sees the pairs whose unit no earlier chunk took.  Runs jobs.  Gold units
    without a match are not in the result.
    """
    # ``overlaps`` ends with the units' join, so theirs comes first and needs no shuffle of the pairs.
    open_ = cut(pairs.join(units, ["case_id", "unit_id"]).join(gold, ["case_id", "gold_id"]).where(
        F.col("gold_ord").isNotNull()))
    open_ = _chunked(open_, chunk_pairs)
    kept = ("case_id", "gold_id", "gold_ord", "unit_id", "overlap")
    schema = StructType([open_.schema[c] for c in kept])
    order = ("case_id", "gold_ord", F.desc("overlap"), F.asc_nulls_last("unit_ord"), "unit_id", "gold_id")
    taken = None
    for turn in range((open_.agg(F.max("chunk")).head()[0] or 0) + 1):
        rows = open_.where(F.col("chunk") == turn)
        if taken is not None:
            rows = rows.join(taken, ["case_id", "unit_id"], "left_anti")
        tried = rows.repartition("case_id").sortWithinPartitions(*order).select(*kept)
        got = cut(tried.mapInArrow(_choose, schema))
        taken = got if taken is None else taken.unionByName(got)
    return taken


def spurious_units(units: DataFrame, matched: DataFrame) -> DataFrame:
    return units.join(matched, ["case_id", "unit_id"], "left_anti")


def manifest_score(gold: DataFrame, matched: DataFrame, units: DataFrame) -> DataFrame:
    """Boundary, class, date, regime and exclusion scores of each case.

    ``gold``: case_id, gold_id and what the key states, null where it states nothing.
    """
    got = units.select("case_id", "unit_id", *[
        F.col(c).alias(f"got_{c}") for c in ("doc_class", "row_date", "regime", "excluded_by")])
    joined = gold.join(matched.select("case_id", "gold_id", "unit_id", "overlap"),
                       ["case_id", "gold_id"], "left").join(got, ["case_id", "unit_id"], "left")
    has = F.col("unit_id").isNotNull()

    def stated(name: str) -> Column:
        return has & (F.coalesce(F.col(name).cast("string"), F.lit("")) != "")

    verdict = date_accuracy(F.col("got_row_date"), F.col("row_date"))
    counts = joined.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("gold"), F.count_if(F.col("overlap") == 1.0).alias("boundary"),
        F.count_if(stated("doc_class")).alias("n_class"),
        F.count_if(stated("doc_class") & (F.col("got_doc_class") == F.col("doc_class"))).alias("class_ok"),
        F.count_if(has & F.col("row_date").isNotNull()).alias("n_date"),
        F.count_if(has & F.col("row_date").isNotNull() & (verdict == "exact")).alias("date_ok"),
        F.count_if(has & F.col("row_date").isNotNull() & verdict.isin("exact", "near")).alias("date_near"),
        F.count_if(stated("regime")).alias("n_regime"),
        F.count_if(stated("regime") & (F.col("got_regime") == F.col("regime"))).alias("regime_ok"),
        F.count_if(stated("excluded_by")).alias("n_out"),
        F.count_if(stated("excluded_by") & (F.col("got_excluded_by") == F.col("excluded_by"))).alias("out_ok"))
    return score_table(counts, {
        "boundary_exact": ("boundary", "gold", None), "class_agreement": ("class_ok", "n_class", None),
        "date_exact": ("date_ok", "n_date", None), "date_within_3d": ("date_near", "n_date", None),
        "regime_agreement": ("regime_ok", "n_regime", None),
        "exclusion_agreement": ("out_ok", "n_out", None)}, ["case_id"])


def fuzzy_match(a: Column, b: Column) -> Column:
    """Two strings that say the same, typing and accents apart; two nulls agree."""
    x, y = tx.score_form(a), tx.score_form(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(
        x == y, F.lit(True)).otherwise(reaches(x, y, SIMILAR))


def field_recall(gold_fields: DataFrame, matched: DataFrame, records: DataFrame) -> DataFrame:
    """Share of the fields a key states that the run found.

    ``gold_fields``: case_id, gold_id, field, expected.
    """
    got = records.groupBy("unit_id", "field").agg(F.max("value").alias("actual"))
    joined = gold_fields.join(
        matched.select("case_id", "gold_id", "unit_id"), ["case_id", "gold_id"]
    ).join(got, ["unit_id", "field"], "left")
    present = (F.col("expected") == "present") & (F.col("actual") != "absent")
    ok = F.col("actual").isNotNull() & (present | fuzzy_match(F.col("actual"), F.col("expected")))
    counts = joined.withColumn("ok", ok).groupBy("case_id").agg(
        F.count_if("ok").alias("hits"), F.count(F.lit(1)).alias("total"))
    return score_table(counts, {"field_recall": ("hits", "total", None)}, ["case_id"])


def render_score(gate: DataFrame, bullets: DataFrame, rows: DataFrame) -> DataFrame:
    """Cited share and page coverage; both must be full."""
    cited = bullets.join(rows.select("row_id", "case_id"), "row_id").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("bullets"),
        F.count_if(F.col("block_id").isNotNull()).alias("cited"))
    counts = gate.select("case_id", "pages_covered", "pages_total").join(
        cited, "case_id", "left").fillna(0)
    return score_table(counts, {
        "cited": ("cited", "bullets", 1.0), "page_coverage": ("pages_covered", "pages_total", 1.0),
    }, ["case_id"])


def run_score(audit: DataFrame, units: DataFrame) -> DataFrame:
    """Answers that were not cut off, and spans that hold, from the extraction log."""
    detail = F.from_json("detail", "stop_reason string, selected long, kept long, skipped string")
    calls = audit.filter((F.col("action") == "extract") & (F.col("subject_type") == "unit")).select(
        F.col("subject_id").alias("unit_id"), detail.alias("d")).filter(F.col("d.skipped").isNull())
    stop = F.col("d.stop_reason")
    counts = calls.join(units.select("unit_id", "case_id"), "unit_id").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(stop.isNull() | stop.isin(*COMPLETE_STOPS)).alias("whole"),
        F.sum(F.coalesce("d.selected", F.lit(0))).alias("selected"),
        F.sum(F.coalesce("d.kept", F.lit(0))).alias("kept"))
    return score_table(counts, {
        "not_truncated": ("whole", "calls", 1.0), "groundedness": ("kept", "selected", 1.0),
    }, ["case_id"])


def one_setting(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """The settings (key, value) that differ between two runs; a fair test has exactly one."""
    a = base.select("key", F.col("value").alias("baseline"))
    b = candidate.select("key", F.col("value").alias("candidate"))
    return a.join(b, "key", "full_outer").filter(
        ~F.col("baseline").eqNullSafe(F.col("candidate")))


class NotOneSetting(ValueError):
    """Two runs that differ in several settings, or in none, cannot be compared."""


def require_one_setting(base: DataFrame, candidate: DataFrame) -> str:
    moved = [r["key"] for r in one_setting(base, candidate).orderBy("key").limit(3).collect()]
    if len(moved) != 1:
        raise NotOneSetting(f"settings that moved: {', '.join(moved) or 'none'}")
    return moved[0]


def score_deltas(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Scores both runs have, with their difference.  Columns case_id, name, value."""
    a = base.select("case_id", "name", F.col("value").alias("baseline"))
    b = candidate.select("case_id", "name", F.col("value").alias("candidate"))
    out = a.join(b, ["case_id", "name"]).withColumn("delta", F.col("candidate") - F.col("baseline"))
    return out.withColumn("moved", F.abs("delta") > 1e-9)


def shadow_rows(rows_a: DataFrame, bullets_a: DataFrame, rows_b: DataFrame,
                bullets_b: DataFrame) -> DataFrame:
    """Per case: rows that differ between two runs, matched by date and title.

    Of rows with one date and title the last in row order counts.  Lines meet at their place.
    """
    def face(rows: DataFrame, bullets: DataFrame) -> tuple[DataFrame, DataFrame]:
        order = F.struct(F.coalesce("author", F.lit("")), "doc_class", "min_page", "row_id")
        last = rows.groupBy("case_id", "row_date", "title").agg(
            F.max_by("row_id", order).alias("row_id"))
        key = F.sha2(F.to_json(F.struct("row_date", "title")), 256)
        named = last.select("case_id", key.alias("key"), "row_id")
        return named, named.join(bullets.select("row_id", "pos", "text"), "row_id")

    keys_a, lines_a = face(rows_a, bullets_a)
    keys_b, lines_b = face(rows_b, bullets_b)
    on = ["case_id", "key", "pos"]
    moved = lines_a.select(*on, F.col("text").alias("a")).join(
        lines_b.select(*on, F.col("text").alias("b")), on, "full_outer"
    ).filter(~F.col("a").eqNullSafe(F.col("b"))).select("case_id", "key").distinct()
    both = keys_a.select("case_id", "key", F.lit(1).alias("in_a")).join(
        keys_b.select("case_id", "key", F.lit(1).alias("in_b")), ["case_id", "key"], "full_outer"
    ).join(moved.withColumn("moved", F.lit(True)), ["case_id", "key"], "left")
    differs = F.col("in_a").isNull() | F.col("in_b").isNull() | F.col("moved").isNotNull()
    return both.groupBy("case_id").agg(
        F.count_if(differs).alias("rows_changed"),
        F.greatest(F.count("in_a"), F.count("in_b")).alias("rows_total"))


def product_metrics(rows: DataFrame, row_units: DataFrame, fixes: DataFrame,
                    runs: DataFrame | None = None) -> DataFrame:
    """Per case: how many flags were worth reading, and how many rows stood unedited.

    ``rows`` need date_status and warns.  A rate over nothing is unknown, not full.
    """
    fixed = fixes.filter(F.col("subject_type") == "unit").select(
        F.col("subject_id").alias("unit_id")).distinct()
    touched = row_units.join(fixed, "unit_id", "left_semi").select("row_id").distinct().withColumn(
        "touched", F.lit(True))
    flagged = F.col("date_status").isin("undated", "ambiguous", "illegible", "inferred") | F.col("warns")
    marked = rows.join(touched, "row_id", "left").select(
        "case_id", F.coalesce("touched", F.lit(False)).alias("touched"), flagged.alias("flagged"))
    out = marked.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("touched")).alias("accepted_unedited"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(F.col("flagged") & F.col("touched")).alias("corrected"),
        F.count_if(~F.col("flagged") & F.col("touched")).alias("missed"))
    any_fix = fixes.filter(F.col("subject_type") == "unit").select("case_id").distinct().withColumn(
        "has_fix", F.lit(True))
    out = out.join(any_fix, "case_id", "left")
    if runs is not None:
        timed = runs.select(
            "case_id", "approved",
            (F.unix_timestamp("finished_at") - F.unix_timestamp("created_at")).alias("seconds_to_draft"))
        out = out.join(timed, "case_id", "left")
    else:
        out = out.withColumns({
            "approved": F.lit(False), "seconds_to_draft": F.lit(None).cast("long")})
    zero = F.lit(0)
    return out.select(
        "case_id", "rows", "accepted_unedited", "flagged", "corrected", "missed",
        (F.col("corrected") / F.nullif("flagged", zero)).alias("precision"),
        (F.col("corrected") / F.nullif(F.col("corrected") + F.col("missed"), zero)).alias("recall"),
        (F.col("accepted_unedited") / F.nullif("rows", zero)).alias("accept_rate"),
        "seconds_to_draft",
        (F.coalesce("has_fix", F.lit(False)) | F.coalesce("approved", F.lit(False))).alias("reviewed"))
