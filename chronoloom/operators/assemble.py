"""From units to chronology rows.

A row is kept as three tables: ``rows`` (one line per row), ``locators`` (one per unit) and
``bullets`` (one per printed line).  An encounter may gather any number of units; nothing of
unbounded length is ever collected into one value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import first_by, running
from ..rules import Pack
from ..schemas import STATUS_FACTOR, WARN_AT

# --- Fixed values ---------------------------------------------------------------------------
NOT_PRINTED = ("page_label", "stamp", "handwriting", "empty", "heading", "signature")
TRANSCRIBED = "assemble.transcribe_line"
# -------------------------------------------------------------------------------------------

#: What a line must carry to be chosen and printed.
LINE_COLUMNS = ("unit_id", "pdf_index", "ord", "block_id", "type", "text", "confidence")
BULLET_ORDER = ["bundle_id", "first_page", "kind", "field_key", "pdf_index", "ord", "block_id"]


def _constant_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def bucket(units: DataFrame, pack: Pack) -> DataFrame:
    """Units with ``held_by``, ``bucket`` (what they merge on) and ``row_id``.

    Held, undated and illegible units stand alone; a diagnostic study keeps its class apart
    from the encounter it was ordered in.
    """
    off, studies = pack.switched_off, pack.studies
    cls = F.col("doc_class")
    toggled = F.when(cls.isin(*off), F.concat(F.lit("toggle."), cls)) if off else F.lit(None)
    held = F.coalesce("excluded_by", toggled.cast("string"))
    alone = F.col("row_date").isNull() | F.col("date_status").isin("undated", "illegible")
    study = cls.isin(*studies) if studies else F.lit(False)
    day, author = F.col("row_date").cast("string"), F.coalesce("author", F.lit(""))

    def key(kind: str, *parts: Column) -> Column:
        return F.to_json(F.array(F.lit(kind), *parts))

    keyed = (
        F.when(held.isNotNull(), key("held", F.col("unit_id")))
        .when(alone, key("solo", F.col("unit_id")))
        .when(study, key("study", day, author, cls)).otherwise(key("encounter", day, author))
    )
    return units.withColumns({"held_by": held, "bucket": keyed, "is_study": study}).withColumn(
        "row_id", tx.digest(F.col("case_id"), F.col("bucket"), size=20, prefix="row_"))


def locators(bucketed: DataFrame, labels: DataFrame) -> DataFrame:
    """One locator per unit: its first page and the label printed on it."""
    printed = labels.select("bundle_id", F.col("pdf_index").alias("first_page"), "printed_label")
    out = bucketed.select("row_id", "case_id", "unit_id", "bundle_id", "first_page").join(
        printed, ["bundle_id", "first_page"], "left")
    bare = F.coalesce("printed_label", F.lit("")) == ""
    return out.withColumns({
        "display_page": F.when(bare, F.col("first_page").cast("string")).otherwise(
            F.col("printed_label")),
        "flagged": bare,
    })


def build_rows(bucketed: DataFrame, pack: Pack, attributions: DataFrame | None = None) -> DataFrame:
    """Merge units into rows in one aggregation; the first unit by (bundle, page) leads."""
    labels = _constant_map(pack.class_labels)
    named = bucketed.withColumn(
        "class_label", F.coalesce(F.try_element_at(labels, F.col("doc_class")), F.col("doc_class")))
    if attributions is None:
        named = named.withColumns({
            "claim_event": F.lit(None).cast("date"), "claim_rule": F.lit(None).cast("string")})
    else:
        named = named.join(
            attributions.select("unit_id", "claim_event", "claim_rule"), "unit_id", "left")
    order = F.struct("bundle_id", "first_page")
    lead = F.struct(
        "row_date", "date_status", "date_role", "date_explanation", "date_alternatives",
        "doc_class", "regime", "legibility_reason", "held_by", "is_study")
    event = F.col("claim_event")
    rows = named.groupBy("row_id", "case_id").agg(
        F.min_by(lead, order).alias("lead"),
        F.array_join(F.array_sort(F.collect_set("class_label")), " + ").alias("classes"),
        first_by(F.nullif("author", F.lit("")), order).alias("author"),
        F.bool_or(F.col("legibility") == "illegible").alias("illegible"),
        F.bool_and(F.col("kind") == "referenced").alias("second_hand"),
        F.count(F.lit(1)).alias("n_units"), F.count_distinct("bundle_id").alias("n_bundles"),
        F.min("first_page").alias("min_page"),
        F.min(event).alias("e0"), F.max(event).alias("e1"),
        first_by(F.when(event.isNotNull(), F.col("claim_rule")), order).alias("r_event"),
        first_by(F.col("claim_rule"), order).alias("r_any"))
    suffix = pack.output.get("title_line", {}).get("author_suffix", " — {author}")
    head, tail = suffix.split("{author}")
    title = F.when(F.col("author").isNotNull(), F.concat(
        F.col("classes"), F.lit(head), F.col("author"), F.lit(tail))).otherwise(F.col("classes"))
    agreed = F.col("e0") == F.col("e1")
    return rows.select(
        "row_id", "case_id", "lead.row_date", "lead.date_status", "lead.date_role",
        "lead.date_explanation", "lead.date_alternatives", title.alias("title"), "author",
        "lead.doc_class", "lead.regime", "illegible",
        F.when(F.col("illegible"), F.col("lead.legibility_reason")).alias("illegible_reason"),
        "second_hand", "n_units", "n_bundles", "min_page",
        F.when(agreed, F.col("e0")).alias("claim_event"),
        F.when(agreed, F.col("r_event"))
        .when(F.col("e0").isNotNull(), F.lit("claim_event.units_disagree"))
        .otherwise(F.col("r_any")).alias("claim_rule"),
        F.col("lead.held_by").alias("excluded_by"), "lead.is_study",
    )


def _filled(template: str, raw: Column) -> Column:
    """A wording with its places filled from the value or from the parts of a JSON value."""
    pieces = []
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if text:
            pieces.append(F.lit(text))
        if name:
            pieces.append(raw if name == "value" else F.get_json_object(raw, f"$.{name}"))
    return F.concat(*pieces)


def record_line(field: Column, value: Column, pack: Pack) -> Column:
    """A record as one printed line, in the wording of the pack."""
    out = pack.output
    base = F.substring_index(field, ".", 1)
    states = [
        F.when((base == name) & value.isin(*table), F.element_at(_constant_map(table), value))
        for name, table in out.get("state_labels", {}).items() if table
    ]
    raw = F.coalesce(*states, value)
    is_json = F.startswith(raw, F.lit("{"))
    prior = F.get_json_object(raw, "$.prior_pct")
    lines = out.get("field_lines", {})
    cases = [F.when(field.rlike(r"\.cont[0-9]+$"), _filled(out.get("continuation_line", "{value}"), raw))]
    for name, template in lines.items():
        wording = _filled(template, raw)
        if f"{name}_with_prior" in lines:
            wording = F.when(
                is_json & prior.isNotNull(), _filled(lines[f"{name}_with_prior"], raw)
            ).otherwise(wording)
        cases.append(F.when(base == name, wording))
    pairs = F.map_entries(F.from_json(raw, "map<string,string>"))
    listed = F.array_join(F.transform(pairs, lambda e: F.concat_ws(" ", e["key"], e["value"])), ", ")
    plain = F.concat(F.replace(field, F.lit("_"), F.lit(" ")), F.lit(" : "), raw)
    return F.coalesce(*cases, F.when(is_json, listed), plain)


def candidate_bullets(bucketed: DataFrame, rows: DataFrame, records: DataFrame,
                      unit_blocks: DataFrame, selected: DataFrame, pack: Pack) -> DataFrame:
    """Printed lines of every row before repeats are folded: fields read, then lines kept.

    A line a field already cites is not printed again.  Illegible rows print nothing.
    """
    index_fields = pack.output.get("index_fields", [])
    open_rows = rows.filter(~F.col("illegible")).select("row_id")
    home = bucketed.select("row_id", "unit_id", "bundle_id", "first_page").join(
        open_rows, "row_id", "left_semi")
    cited = records.filter(
        ~F.col("derived") & (F.coalesce("value", F.lit("")) != "") & F.col("block_id").isNotNull())
    if index_fields:
        cited = cited.filter(~F.col("field").isin(*index_fields))
    place = unit_blocks.select(
        "unit_id", "block_id", "pdf_index", "ord", F.length("text").alias("size"))
    from_records = cited.join(place, ["unit_id", "block_id"]).select(
        "unit_id", F.lit(0).alias("kind"),
        F.concat_ws("|", "stage", "field").alias("field_key"), "pdf_index", "ord", "block_id",
        record_line(F.col("field"), F.col("value"), pack).alias("text"), "confidence", "rule",
        F.coalesce("span_start", F.lit(0)).alias("span_start"),
        F.coalesce(F.nullif("span_end", F.lit(0)), F.col("size")).alias("span_end"))
    lines = selected.filter(F.col("kept") & ~F.col("type").isin(*NOT_PRINTED))
    from_lines = lines.join(
        cited.select("unit_id", "block_id"), ["unit_id", "block_id"], "left_anti"
    ).select(
        "unit_id", F.lit(1).alias("kind"), F.lit("").alias("field_key"), "pdf_index", "ord",
        "block_id", "text", "confidence", F.lit(TRANSCRIBED).alias("rule"),
        F.lit(0).alias("span_start"), F.length("text").alias("span_end"))
    return from_records.unionByName(from_lines).join(home, "unit_id")


def union_bullets(candidates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Equal lines of a row become one: the first citation, the lowest confidence."""
    order = order or BULLET_ORDER
    rest = [c for c in candidates.columns if c not in ("row_id", "confidence")]
    return candidates.groupBy("row_id", tx.fold(F.col("text")).alias("line")).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("b"),
        F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("copies"),
    ).select("row_id", "b.*", "confidence", "copies")


def number_bullets(bullets: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Bullets with their place in the row; range-partitioned, so a row may have any length."""
    order = order or BULLET_ORDER
    placed = running(bullets, ["row_id"], order, sums={"pos": F.lit(1)})
    return placed.withColumn("pos", F.col("pos") - 1)


def with_confidence(rows: DataFrame, bullets: DataFrame) -> DataFrame:
    """Row confidence: its least certain line, weakened by the status of its date."""
    least = bullets.groupBy("row_id").agg(
        F.min("confidence").alias("least"), F.count(F.lit(1)).alias("n_bullets"))
    factor = F.coalesce(
        F.try_element_at(_constant_map(STATUS_FACTOR), F.col("date_status")), F.lit(1.0))
    out = rows.join(least, "row_id", "left").withColumn(
        "confidence", F.coalesce("least", F.lit(1.0)) * factor)
    return out.withColumns({
        "n_bullets": F.coalesce("n_bullets", F.lit(0)), "warns": F.col("confidence") <= WARN_AT,
    }).drop("least")


def row_order() -> list[Column]:
    """Undated rows first, then by date; total, so two runs never differ by order."""
    return [
        F.col("row_date").isNotNull().asc(), F.col("row_date").asc(),
        F.coalesce("author", F.lit("")).asc(), F.col("doc_class").asc(),
        F.col("min_page").asc(), F.col("row_id").asc(),
    ]


def metrics(rows: DataFrame) -> DataFrame:
    """Per case: what merging did."""
    live = F.col("excluded_by").isNull()
    return rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(live & (F.col("n_units") > 1)).alias("merged_encounters"),
        F.count_if(live & F.col("is_study")).alias("split_studies"),
        F.count_if(live & (F.col("n_bundles") > 1)).alias("cross_bundle_unions"),
        F.sum(F.when(~live, F.col("n_units")).otherwise(0)).alias("excluded_units"),
        F.count_if(F.col("row_date").isNull()).alias("undated"))
