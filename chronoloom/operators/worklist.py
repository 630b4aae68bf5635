"""What a batch of span selection is given, and what of its answers is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import joined_text, running
from ..session import cut
from .blocks import is_body
from .dates import render_date
from .templates import position

# --- Fixed values ---------------------------------------------------------------------------
LONG_UNIT = 40_000
MIN_SECTION = 200
MIN_SPAN = 3
END_TOLERANCE = 2
COMPLETE_STOPS = ("end_turn", "stop", "stop_sequence")
# -------------------------------------------------------------------------------------------
CHUNK_PAGES = 64


def subdivide(unit_blocks: DataFrame, long_unit: int = LONG_UNIT,
              min_section: int = MIN_SECTION) -> DataFrame:
    """Blocks with ``part`` and ``reason``: a long unit is cut at its own headings.

    Small sections go to the part before them.  Short units and units without headings stay
    whole.
    """
    blocks = unit_blocks.select("*", F.length("text").alias("_len"))
    facts = blocks.groupBy("unit_id").agg(
        F.sum("_len").alias("unit_chars"), F.bool_or(F.col("type") == "heading").alias("headed"))
    order, chunk = ["pdf_index", "ord"], F.floor(F.col("pdf_index") / CHUNK_PAGES)
    long_ones = facts.filter((F.col("unit_chars") > long_unit) & F.col("headed")).select("unit_id")
    numbered = running(
        blocks.join(long_ones, "unit_id", "left_semi").select("unit_id", *order, "type", "_len"),
        ["unit_id"], order, chunk=chunk,
        sums={"section": F.when(F.col("type") == "heading", 1).otherwise(0)})
    sizes = numbered.groupBy("unit_id", "section").agg(
        F.sum("_len").alias("size"), F.min(position()).alias("pos"))
    first = sizes.groupBy("unit_id").agg(F.min("section").alias("first"))
    opened = running(
        sizes.join(first, "unit_id").withColumn(
            "opens", (F.col("section") == F.col("first")) | (F.col("size") >= min_section)),
        ["unit_id"], ["section"], chunk=F.floor(F.col("section") / 4096),
        sums={"nth": F.when(F.col("opens"), 1).otherwise(0)})
    parts = opened.groupBy("unit_id").agg(F.max("nth").alias("n_parts"))
    placed = numbered.join(opened.select("unit_id", "section", "nth"), ["unit_id", "section"]).select(
        "unit_id", *order, (F.col("nth") - 1).cast("int").alias("part"))
    reason = (
        F.when(F.col("unit_chars") <= long_unit, F.lit("short_enough"))
        .when(~F.col("headed"), F.lit("no_internal_structure"))
        .when(F.col("n_parts") == 1, F.lit("structure_too_shallow"))
        .otherwise(F.lit("split_on_headings"))
    )
    # What the lines are told is put together on slim rows, so that their texts are shuffled once.
    told = blocks.select("unit_id", *order).distinct().join(
        facts.join(parts, "unit_id", "left"), "unit_id").join(
        placed, ["unit_id", *order], "left").select(
        "unit_id", *order, F.coalesce("part", F.lit(0)).alias("part"), reason.alias("reason"))
    # A line without a place stays too.
    same = [F.col("l.unit_id") == F.col("t.unit_id"), *[F.col(f"l.{c}").eqNullSafe(F.col(f"t.{c}")) for c in order]]
    return blocks.drop("_len").alias("l").join(told.alias("t"), same).select("l.*", "part", "reason")


def part_table(parted: DataFrame) -> DataFrame:
    """One row per part: its heading, size and reason."""
    return parted.groupBy("unit_id", "part").agg(
        F.min_by(F.when(F.col("type") == "heading", F.col("text")), position()).alias("heading"),
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("chars"),
        F.min("reason").alias("reason"))


def work_list(parted: DataFrame, units: DataFrame, resolved: DataFrame, labels: dict[str, str],
              ) -> DataFrame:
    """One request per part of a readable unit, and one skipped row per other unit.

    ``listing`` names each body line as ``id | length | text``.  ``resolved``: fields a form
    already answered.
    """
    lines = parted.filter(is_body(F.col("type"))).select(
        "unit_id", "part", "pdf_index", "ord",
        F.concat_ws(" | ", "block_id", F.length("text").cast("string"), "text").alias("line"))
    listed = lines.groupBy("unit_id", "part").agg(
        joined_text("line", ["pdf_index", "ord"], "\n").alias("listing"))
    known = resolved.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set(
        F.substring_index("field", ".", 1))), ", ").alias("already"))
    parts = part_table(parted).select("unit_id", "part", "reason")
    title = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    out = (
        units.select("case_id", "unit_id", "doc_class", "legibility", "row_date", "date_status")
        .join(parts, "unit_id", "left").join(listed, ["unit_id", "part"], "left")
        .join(known, "unit_id", "left")
    )
    skipped = F.when(F.col("legibility") == "illegible", "illegible").when(
        F.col("part").isNull(), "no_blocks")
    open_ = skipped.isNull()
    out = out.withColumn("skipped", skipped).filter(open_ | (F.coalesce("part", F.lit(0)) == 0))
    return out.select(
        "case_id", "unit_id", F.when(open_, F.col("part")).alias("part"), "skipped",
        F.when(open_, F.col("reason")).alias("reason"),
        F.coalesce(F.try_element_at(title, F.col("doc_class")), F.col("doc_class")).alias("class_label"),
        render_date(F.col("row_date"), F.col("date_status")).alias("row_date"),
        F.coalesce("already", F.lit("—")).alias("already_resolved"),
        F.when(open_, F.coalesce("listing", F.lit(""))).alias("listing"))


def verify_spans(selections: DataFrame, parted: DataFrame,
                 truncated: DataFrame | None = None) -> DataFrame:
    """Every selection with ``reason`` (null = kept), its clamped end and its own text.

    The text comes from the block, never from the answer.  An end just past the block means
    the end of the block.  ``truncated``: (unit_id, part) whose answer was cut off; all of it
    is rejected.
    """
    blocks = parted.select(
        "unit_id", "part", "block_id", F.col("text").alias("source"), "confidence")
    joined = selections.join(blocks, ["unit_id", "part", "block_id"], "left")
    if truncated is not None:
        joined = joined.join(
            truncated.select("unit_id", "part", F.lit(True).alias("cut_off")), ["unit_id", "part"], "left")
    else:
        joined = joined.withColumn("cut_off", F.lit(None).cast("boolean"))
    start, end, size = F.col("start"), F.col("end"), F.length("source")
    clamped = F.when((end > size) & (end - size <= END_TOLERANCE), size).otherwise(end)
    fits = (start >= 0) & (start < F.col("end_at")) & (F.col("end_at") <= size)
    taken = tx.strip(tx.cut_out(F.col("source"), start, F.col("end_at")))
    checked = joined.withColumn("end_at", clamped).withColumn(
        "value", F.when(F.col("source").isNotNull() & fits, taken))
    reason = (
        F.when(F.col("cut_off"), "response_truncated")
        .when(F.col("source").isNull(), "not_a_block_of_this_part")
        .when(start.isNull() | end.isNull(), "offsets_missing")
        .when(~fits, "outside_block").when(F.length("value") < MIN_SPAN, "too_short")
    )
    # Of equal spans the first is kept.  They are answers on one block, which stand together since
    # the join, so neither texts nor answers are shuffled again.
    same = Window.partitionBy("unit_id", "part", "block_id", "start", "end_at")
    out = checked.withColumn("reason", reason).withColumn(
        "first_seq", F.min(F.when(F.col("reason").isNull(), F.col("seq"))).over(same))
    repeated = F.col("reason").isNull() & (F.col("seq") > F.col("first_seq"))
    return out.withColumn("reason", F.when(repeated, "repeated").otherwise(F.col("reason"))).select(
        "unit_id", "part", "seq", "block_id", "start", F.col("end_at").alias("end"), "field",
        F.when(F.col("reason").isNull(), F.col("value")).alias("value"), "confidence", "reason")


def span_records(verified: DataFrame, units: DataFrame, rule: str) -> DataFrame:
    """Kept spans as records of stage 4b, in the order they were selected."""
    # Written once: the numbering reads its input twice, and verifying reads every text.
    kept = cut(verified.filter(F.col("reason").isNull()).select(
        "unit_id", "part", "seq", "value", "confidence", "block_id", "start", "end"))
    numbered = running(
        kept, ["unit_id"], ["part", "seq"], chunk=F.col("part"), sums={"nth": F.lit(1)})
    return numbered.join(units.select("unit_id", "case_id"), "unit_id").select(
        "case_id", "unit_id", F.lit("4b").alias("stage"),
        F.concat(F.lit("line."), F.col("nth").cast("string")).alias("field"), "value", "confidence",
        "block_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.lit(False).alias("derived"), F.lit(rule).alias("rule"),
        F.lit("INF-H").alias("epistemic_tag"))


def groundedness(verified: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Spans kept out of spans selected; repeats of a kept span count as kept by nobody."""
    keys = keys or ["unit_id"]
    return verified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("reason").isNull()).alias("kept"),
    ).withColumn("groundedness", share_or_one(F.col("kept"), F.col("selected")))


def share_or_one(hits: Column, total: Column) -> Column:
    return F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(1.0))


