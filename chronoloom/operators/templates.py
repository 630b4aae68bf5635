"""Fields of known forms: ticked boxes, table rows and sections, read where the form has them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import running
from ..rules import Pack
from .blocks import is_body

STAGE = "4a"
PAGE_STEP = 1 << 31
CHUNK_PAGES = 64
BOX_STATE_BLANK, BOX_STATE_ABSENT = "trop_tot", "absent"


def position() -> Column:
    """Reading position of a block in its document as one number."""
    return F.col("pdf_index").cast("long") * F.lit(PAGE_STEP) + F.col("ord")


def lookup(units: DataFrame, pack: Pack) -> DataFrame:
    """(unit_id, template, status): exact, unknown_revision, or none.

    A known form in an unknown revision never falls back to another revision's fields.
    """
    form, revision = F.col("form_serial"), F.col("form_revision")
    keys = [(str(t["form"]), str(t["revision"])) for t in pack.templates]
    exact = F.coalesce(F.lit(None).cast("string"), *[
        F.when((form == f) & (revision == r), F.lit(f"{f}@{r}")) for f, r in keys])
    known = form.isin(*sorted({f for f, _ in keys})) if keys else F.lit(False)
    return units.select(
        "unit_id", "case_id", exact.alias("template"),
        F.when(exact.isNotNull(), "exact").when(known, "unknown_revision").otherwise("none")
        .alias("status"),
    )


def _named(pattern: str, name: str) -> int:
    return re.compile(pattern).groupindex[name]


def _record(field: Column, value: Column, block_id, start, end, confidence, derived: bool,
            rule: str, tag: str) -> Column:
    return F.struct(
        field.alias("field"), value.alias("value"), confidence.cast("double").alias("confidence"),
        block_id.cast("string").alias("block_id"), start.cast("int").alias("span_start"),
        end.cast("int").alias("span_end"), F.lit(derived).alias("derived"),
        F.lit(rule).alias("rule"), F.lit(tag).alias("epistemic_tag"))


def _rule(template: dict, spec: dict) -> tuple[str, str]:
    key = f"{template['form']}@{template['revision']}"
    return f"template.{key}.{spec['id']}", spec.get("tag", template.get("tag", "INF-H"))


def _specs(pack: Pack, kind: str) -> list[tuple[str, dict, dict]]:
    return [
        (f"{t['form']}@{t['revision']}", t, f)
        for t in pack.templates for f in t.get("fields", []) if f.get("kind") == kind
    ]


def _checkboxes(blocks: DataFrame, found: DataFrame, pack: Pack) -> DataFrame | None:
    """All checkbox fields of all templates in one pass over the blocks."""
    specs = _specs(pack, "checkbox")
    if not specs:
        return None
    text, kind = F.col("text"), F.col("type")
    above = Window.partitionBy("unit_id", "pdf_index").orderBy("ord").rowsBetween(
        Window.unboundedPreceding, -1)
    anchors = list(dict.fromkeys(spec["anchor"] for _, _, spec in specs))
    seen = blocks
    for i, anchor in enumerate(anchors):
        at = tx.hits(text, anchor)
        seen = seen.withColumns({
            f"a{i}": at, f"up{i}": F.last(F.when(at, F.col("ord")), True).over(above),
            f"cut{i}": F.last(F.when((kind == "heading") & ~at, F.col("ord")), True).over(above)})
    boxes = seen.filter(kind == "checkbox")
    picks = []
    for i, (key, template, spec) in enumerate(specs):
        a = anchors.index(spec["anchor"])
        owned = F.col(f"a{a}") | F.coalesce(
            F.col(f"up{a}") > F.coalesce(F.col(f"cut{a}"), F.lit(-1)), F.lit(False))
        state = F.coalesce(*[
            F.when(tx.hits(text, p, case=True), F.struct(
                F.lit(name).alias("value"), F.regexp_extract(text, tx.rx(p, case=True), 0).alias("m"),
                F.length(F.element_at(F.split(text, tx.rx(p, case=True), 2), 1)).alias("at")))
            for name, p in spec.get("states", {}).items()
        ], F.struct(F.lit(spec.get("blank_state", BOX_STATE_BLANK)).alias("value"),
                    text.alias("m"), F.lit(0).alias("at")))
        rule, tag = _rule(template, spec)
        record = _record(F.lit(spec["id"]), state["value"], F.col("block_id"), state["at"],
                         state["at"] + F.length(state["m"]), F.col("confidence"), False, rule, tag)
        mine = (F.col("template") == key) & owned
        picks.append(F.min_by(record, F.when(mine, position())).alias(f"r{i}"))
    read = boxes.groupBy("unit_id").agg(*picks)
    joined = found.join(read, "unit_id", "left")
    rows = []
    for i, (key, template, spec) in enumerate(specs):
        rule, tag = _rule(template, spec)
        none = _record(F.lit(spec["id"]), F.lit(spec.get("absent_state", BOX_STATE_ABSENT)),
                       F.lit(None), F.lit(None), F.lit(None), F.lit(1.0), True, rule, tag)
        rows.append(F.when(F.col("template") == key, F.coalesce(F.col(f"r{i}"), none)))
    return joined.select(
        "unit_id", "case_id", F.explode(F.array_compact(F.array(*rows))).alias("r"))


def sections(blocks: DataFrame, pattern: str) -> DataFrame:
    """Blocks under the first heading that matches, up to a heading of its level or above.

    A deeper heading that matches narrows the section to its own level.  Only headings take
    part in the ordered pass.
    """
    named = tx.hits(F.col("text"), pattern)
    heads = blocks.filter(F.col("type") == "heading").select(
        "unit_id", "pdf_index", "ord", position().alias("pos"),
        F.coalesce("level", F.lit(2)).alias("level"), named.alias("named"))
    levelled = running(
        heads, ["unit_id"], ["pdf_index", "ord"],
        chunk=F.floor(F.col("pdf_index") / CHUNK_PAGES),
        befores={"inside": F.when(F.col("named"), F.col("level"))})
    bounds = levelled.groupBy("unit_id").agg(
        F.min(F.when(F.col("named"), F.col("pos"))).alias("opens"),
        F.min(F.when(F.col("level") <= F.col("inside"), F.col("pos"))).alias("closes"),
    ).filter(F.col("opens").isNotNull())
    pos = position()
    return blocks.join(bounds, "unit_id").filter(
        (pos > F.col("opens")) & (F.col("closes").isNull() | (pos < F.col("closes")))
        & ~((F.col("type") == "heading") & named)
    ).drop("opens", "closes")


def _table_rows(blocks: DataFrame, found: DataFrame, key: str, template: dict,
                spec: dict) -> DataFrame:
    text, row = F.col("text"), spec["row"]
    rule, tag = _rule(template, spec)
    rows = sections(blocks.filter(F.col("template") == key), spec["under_heading"]).filter(
        tx.hits(text, row))
    nth = F.row_number().over(Window.partitionBy("unit_id").orderBy("pdf_index", "ord"))
    code = tx.squeeze(F.regexp_extract(text, tx.rx(row), _named(row, "code")))
    pct = F.regexp_extract(text, tx.rx(row), _named(row, "pct"))
    prior = F.lit("")
    if spec.get("prior_pct"):
        before = F.regexp_extract(
            text, tx.rx(spec["prior_pct"]), _named(spec["prior_pct"], "prior"))
        prior = F.when(before != "", F.concat(
            F.lit(', "prior_pct": "'), before, F.lit('"'))).otherwise("")
    value = F.concat(F.lit('{"code": "'), code, F.lit('", "pct": "'), pct, F.lit('"'), prior, F.lit("}"))
    at = tx.first_match(text, row)
    numbered = rows.withColumn("nth", nth)
    out = numbered.select(
        "unit_id", "case_id", _record(
            F.concat(F.lit(f"{spec['id']}."), F.col("nth").cast("string")), value,
            F.col("block_id"), at["start"], at["end"], F.col("confidence"), False, rule, tag
        ).alias("r"))
    if spec.get("emit_expected_count"):
        counts = rows.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
        expected = found.filter(F.col("template") == key).join(counts, "unit_id", "left")
        out = out.unionByName(expected.select(
            "unit_id", "case_id", _record(
                F.lit(f"{spec['id']}.expected_count"),
                F.coalesce("n", F.lit(0)).cast("string"), F.lit(None), F.lit(None), F.lit(None),
                F.lit(1.0), True, rule, tag).alias("r")))
    return out


def _section(blocks: DataFrame, key: str, template: dict, spec: dict) -> DataFrame:
    rule, tag = _rule(template, spec)
    inside = sections(blocks.filter(F.col("template") == key), spec["under_heading"])
    nth = F.row_number().over(Window.partitionBy("unit_id").orderBy("pdf_index", "ord"))
    kept = inside.withColumn("nth", nth).filter(F.col("nth") <= spec.get("max_lines", 4))
    lines = F.array_sort(F.collect_list(F.struct("nth", "text", "block_id", "confidence")))
    first = F.element_at("lines", 1)
    return kept.filter(is_body(F.col("type"))).groupBy("unit_id", "case_id").agg(
        lines.alias("lines")
    ).select("unit_id", "case_id", _record(
        F.lit(spec["id"]), F.array_join(F.transform("lines", lambda x: x["text"]), " "),
        first["block_id"], F.lit(0), F.length(first["text"]),
        F.array_min(F.transform("lines", lambda x: x["confidence"])), False, rule, tag).alias("r"))


def read_forms(unit_blocks: DataFrame, units: DataFrame, pack: Pack) -> DataFrame:
    """Records of stage 4a for every unit with a registered form and revision."""
    found = lookup(units, pack).filter(F.col("template").isNotNull())
    blocks = unit_blocks.drop("case_id").join(found.drop("status"), "unit_id")
    parts = [p for p in [_checkboxes(blocks, found, pack)] if p is not None]
    parts += [_table_rows(blocks, found, *s) for s in _specs(pack, "table_rows")]
    parts += [_section(blocks, *s) for s in _specs(pack, "section")]
    if not parts:
        parts = [found.select("unit_id", "case_id", _record(
            F.lit(""), F.lit(""), F.lit(None), F.lit(None), F.lit(None), F.lit(1.0), True, "", ""
        ).alias("r")).filter(F.lit(False))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("case_id", "unit_id", F.lit(STAGE).alias("stage"), "r.*")


def rating_totals(records: DataFrame, field: str = "bareme") -> DataFrame:
    """Per unit: rated rows, rows expected, and the sum of the readable percentages.

    A row the form counts but no record holds is a silent loss, so both counts are kept.
    """
    rows = records.filter(F.col("field").rlike(rf"^{field}\.([0-9]+|expected_count)$"))
    counted = F.col("field") == f"{field}.expected_count"
    pct = F.regexp_replace(F.get_json_object("value", "$.pct"), ",", ".")
    return rows.groupBy("unit_id").agg(
        F.count_if(~counted).alias("rated_rows"),
        F.max(F.when(counted, F.col("value").try_cast("int"))).alias("expected_rows"),
        F.sum(F.when(~counted, pct.try_cast("decimal(12,4)"))).alias("total_pct"),
    ).withColumn("complete", F.col("rated_rows").eqNullSafe(F.col("expected_rows")))
