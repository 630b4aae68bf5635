"""Document class, legibility, exclusion and regime of a unit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import joined_text
from ..rules import Pack
from .blocks import is_body
from .matching import document_hits

# --- Fixed values: strengths, thresholds and result wordings --------------------------------
HEADING_AND_BODY, HEADING_ONLY, BODY_ONLY = 1.0, 0.9, 0.5
SERIAL_SCORE, STRONG_SCORE, WEAK_SCORE = 1.0, 0.45, 0.12
REGIME_MIN = 0.5
MIN_CHARS_PER_PAGE = 40
ILLEGIBLE_BELOW = 0.35
DEGRADED_BELOW = 0.60
DEGRADED_CONFIDENCE = 0.8
DEGRADED_NUMBER_SHARE = 0.15
CLINICAL_CHARS = 40
OPENING_BLOCKS = 6
REASON_NO_TEXT = "No text layer on any page of the unit; nothing was extracted."
REASON_FEW_CHARS = "Only %d characters across %d page(s); below the readable floor."
REASON_NOISE = (
    "Text layer present but only %s%% of it reads as words; the scan's own OCR pass failed.")
REASON_WEAK = "%s%% of the text reads as words; legible enough to review, not to trust unread."
REASON_UNSURE = "Mean block confidence %.2f is below 0.8."
REASON_NUMBERS = (
    "%d block(s) contain a malformed number; a wrong barème percentage is a legal error,"
    " not a typo.")
REASON_SOME_NUMBERS = "%d block(s) flagged for a malformed number; review those values."
REASON_CLEAN = "Text layer read cleanly."
# -------------------------------------------------------------------------------------------


def _opening(unit_blocks: DataFrame) -> DataFrame:
    """Text of the first page, whole and headings only; a group is one sheet."""
    first = unit_blocks.filter("is_first")
    return first.groupBy("unit_id").agg(
        joined_text("text", ["ord"], "\n").alias("page_text"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("type") == "heading", F.struct("ord", "text")))),
            lambda r: r["text"]), "\n").alias("heading_text"),
    )


def body_of(unit_blocks: DataFrame) -> DataFrame:
    return unit_blocks.filter(is_body(F.col("type"))).select("unit_id", "pdf_index", "ord", "text")


def classify(unit_blocks: DataFrame, heads: DataFrame, pack: Pack,
             body_hits: DataFrame | None = None) -> DataFrame:
    """Class of each unit: printed form number, then self-naming, then headings and body.

    ``heads``: unit_id, form_serial for every unit.  ``body_hits`` may be shared with other
    operators that look for patterns in whole documents.
    """
    if body_hits is None:
        patterns = [p for c in pack.classes for p in c.get("body", [])]
        body_hits = document_hits(body_of(unit_blocks), patterns)
    found = body_hits.groupBy("unit_id").agg(F.collect_set("pattern").alias("hits"))
    base = (
        heads.select("unit_id", "form_serial")
        .join(_opening(unit_blocks), "unit_id", "left").join(found, "unit_id", "left")
    )
    none = F.array().cast("array<string>")
    serial, page, head = F.col("form_serial"), F.col("page_text"), F.col("heading_text")
    body = F.coalesce(F.col("hits"), none)

    def verdict(name: str, confidence: Column, source: str, matched: Column) -> Column:
        return F.struct(
            F.lit(name).alias("doc_class"), confidence.cast("double").alias("class_confidence"),
            F.lit(source).alias("class_source"), matched.alias("class_matched"))

    by_serial = F.coalesce(F.lit(None), *[
        F.when(serial.isin(*[str(s) for s in c["serials"]]), verdict(
            c["id"], F.lit(c.get("confidence", 0.95)), "serial",
            F.array(F.concat(F.lit("serial:"), serial))))
        for c in pack.classes if c.get("serials")
    ])
    by_name = F.coalesce(F.lit(None), *[
        F.when(tx.hits_any(page, c["declares"]), verdict(
            c["id"], F.lit(c.get("declared_confidence", c.get("confidence", 0.95))), "declared",
            tx.matched_patterns(page, c["declares"])))
        for c in pack.classes if c.get("declares")
    ])

    def zone(place: int, spec: dict) -> Column:
        in_head = tx.matched_patterns(head, spec.get("headings", []))
        in_body = F.filter(
            F.array(*[F.lit(p) for p in spec.get("body", [])]).cast("array<string>"),
            lambda p: F.array_contains(body, p))
        strength = (
            F.when((F.size(in_head) > 0) & (F.size(in_body) > 0), HEADING_AND_BODY)
            .when(F.size(in_head) > 0, HEADING_ONLY).when(F.size(in_body) > 0, BODY_ONLY)
        )
        score = F.bround(F.lit(spec.get("confidence", 0.8)) * strength, 4)
        return F.when(strength.isNotNull(), F.struct(
            score.alias("score"), F.lit(-place).alias("place"), F.lit(spec["id"]).alias("id"),
            F.concat(in_head, in_body).alias("matched")))

    best = F.array_max(F.array(*[zone(i, c) for i, c in enumerate(pack.classes)]))
    scored = base.select(
        "unit_id", page.isNotNull().alias("has_text"),
        F.coalesce(by_serial, by_name).alias("stated"), best.alias("best"),
    )
    sure = F.col("best.score") >= pack.min_confidence
    unknown = F.lit(pack.unknown_class)
    by_zone = F.struct(
        F.when(F.col("has_text") & sure, F.col("best.id")).otherwise(unknown).alias("doc_class"),
        F.when(F.col("has_text"), F.coalesce("best.score", F.lit(0.0))).otherwise(0.0)
        .alias("class_confidence"),
        F.lit("zones").alias("class_source"),
        F.coalesce("best.matched", none).alias("class_matched"),
    )
    chosen = F.when(F.col("has_text") & F.col("stated").isNotNull(), F.col("stated")).otherwise(by_zone)
    return scored.select(
        "unit_id", chosen.alias("c"),
        (F.col("has_text") & F.col("stated").isNull() & ~F.coalesce(sure, F.lit(False)))
        .alias("needs_fallback"),
    ).select("unit_id", "c.*", "needs_fallback")


def legibility(unit_blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Can the unit be read at all; one aggregation over its blocks."""
    words = tx.counted_words(unit_blocks.columns)
    sums = (
        unit_blocks.select("unit_id", F.length("text").alias("chars"), words.alias("w"),
                           "confidence", "degenerate")
        .groupBy("unit_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"),
            F.sum("w.good").alias("good"), F.sum("w.alpha").alias("alpha"),
            # Confidences have four places; whole numbers add up the same in any order.
            F.sum(F.round(F.col("confidence") * 10000).cast("long")).alias("conf"),
            F.count_if("degenerate").alias("broken"))
    )
    every = spans.select("unit_id", "n_pages").join(sums, "unit_id", "left")
    quality = tx.share(F.col("good"), F.col("alpha"))
    percent = F.bround(quality * 100, 0).cast("int").cast("string")
    mean = F.col("conf") / F.col("n") / 10000
    broken = F.col("broken")

    def level(name: str, reason: Column) -> Column:
        return F.struct(F.lit(name).alias("legibility"), reason.alias("legibility_reason"))

    read = (
        F.when(F.col("n").isNull(), level("illegible", F.lit(REASON_NO_TEXT)))
        .when(F.col("chars") / F.col("n_pages") < MIN_CHARS_PER_PAGE,
              level("illegible", F.format_string(REASON_FEW_CHARS, "chars", "n_pages")))
        .when(quality < ILLEGIBLE_BELOW, level("illegible", F.format_string(REASON_NOISE, percent)))
        .when(quality < DEGRADED_BELOW, level("degraded", F.format_string(REASON_WEAK, percent)))
        .when(mean < DEGRADED_CONFIDENCE, level("degraded", F.format_string(REASON_UNSURE, mean)))
        .when((broken > 0) & (broken / F.col("n") >= DEGRADED_NUMBER_SHARE),
              level("degraded", F.format_string(REASON_NUMBERS, broken)))
        .when(broken > 0, level("legible", F.format_string(REASON_SOME_NUMBERS, broken)))
        .otherwise(level("legible", F.lit(REASON_CLEAN)))
    )
    return every.select("unit_id", read.alias("r")).select("unit_id", "r.*")


def clinical_content(unit_blocks: DataFrame) -> DataFrame:
    """Units with at least one body line long enough to say something."""
    long_line = is_body(F.col("type")) & (F.length(tx.strip(F.col("text"))) >= CLINICAL_CHARS)
    return unit_blocks.groupBy("unit_id").agg(F.bool_or(long_line).alias("has_clinical"))


#: Conditions a pack may name.  Each gets the unit facts as columns.  A name that is not here
#: is reported with the unit, never taken for false.
PREDICATES: dict[str, Callable[[], Column]] = {
    "unit_has_no_clinical_content_and_class_is_admin":
        lambda: F.col("is_admin") & ~F.col("has_clinical"),
}

#: Conditions over the whole case; usable once their facts are in the unit table.
CASE_PREDICATES: dict[str, Callable[[], Column]] = {
    "unit_has_identical_duplicate_already_included": lambda: F.col("duplicate_of").isNotNull(),
    "unit_date_precedes_earliest_claim_event_and_no_rra_reference":
        lambda: (F.col("row_date") < F.col("first_event")) & ~F.col("has_relapse_cue"),
}


def naming_blocks(unit_blocks: DataFrame) -> DataFrame:
    """Blocks where a document may name itself: its first six, and all its headings."""
    nth = F.row_number().over(Window.partitionBy("unit_id").orderBy("pdf_index", "ord"))
    cols = ["unit_id", "pdf_index", "ord", "text", "type"]
    opening = unit_blocks.select(*cols).withColumn("nth", nth).filter(F.col("nth") <= OPENING_BLOCKS)
    headings = unit_blocks.select(*cols).filter(F.col("type") == "heading")
    return opening.select(*cols).unionByName(headings)


def exclusions(
    unit_blocks: DataFrame, unit_facts: DataFrame, pack: Pack,
    predicates: dict[str, Callable[[], Column]] | None = None,
) -> DataFrame:
    """The first filter rule that fires on a unit, with the text that set it off.

    ``unit_facts``: unit_id, doc_class, has_clinical and whatever ``predicates`` read.  A rule
    is a status; no unit is dropped.
    """
    predicates = PREDICATES if predicates is None else predicates
    text = F.col("text")
    fired = []
    for place, rule in enumerate(pack.text_filters):
        for nth, pattern in enumerate(rule["matches"]):
            fired.append(F.when(tx.hits(text, pattern), F.struct(
                F.lit(place).alias("place"), F.lit(nth).alias("nth"),
                F.regexp_extract(text, tx.rx(pattern), 0).alias("evidence"))))
    every = [p for r in pack.text_filters for p in r["matches"]]
    facts = unit_facts.withColumns({
        "is_admin": F.col("doc_class").isin(*pack.admin_classes) if pack.admin_classes
        else F.lit(False),
        "has_clinical": F.coalesce("has_clinical", F.lit(False)),
    })
    if every:
        spots = naming_blocks(unit_blocks).filter(tx.hits_any(text, every))
        hits = spots.select(
            "unit_id", "pdf_index", "ord", F.explode(F.array_compact(F.array(*fired))).alias("f")
        ).groupBy("unit_id", F.col("f.place").alias("place")).agg(
            F.min(F.struct("f.nth", "pdf_index", "ord", "f.evidence")).alias("first"))
        scope = [
            F.when(F.col("place") == i, F.col("doc_class").isin(*r["classes"]))
            for i, r in enumerate(pack.text_filters) if r.get("classes")
        ]
        in_scope = F.coalesce(*scope, F.lit(True))
        open_to_rules = ~(F.col("has_clinical") & ~F.col("is_admin"))
        allowed = hits.join(facts.select("unit_id", "doc_class", "is_admin", "has_clinical"), "unit_id")
        first = allowed.filter(in_scope & open_to_rules).groupBy("unit_id").agg(
            F.min(F.struct("place", F.col("first.evidence").alias("evidence"))).alias("text_rule"))
        facts = facts.join(first, "unit_id", "left")
    else:
        facts = facts.withColumn(
            "text_rule", F.lit(None).cast("struct<place:int,evidence:string>"))

    place = F.col("text_rule.place")
    ids = F.array(*[F.lit(r["id"]) for r in pack.text_filters]).cast("array<string>")
    reasons = F.array(*[F.lit(r.get("reason")) for r in pack.text_filters]).cast("array<string>")
    by_text = F.when(place.isNotNull(), F.struct(
        F.get(ids, place).alias("id"), F.get(reasons, place).alias("reason"),
        F.lit(len(pack.fact_filters)).alias("at")))
    by_fact = F.coalesce(F.lit(None), *[
        F.when(predicates[r["when"]](), F.struct(
            F.lit(r["id"]).alias("id"), F.lit(r.get("reason")).alias("reason"),
            F.lit(i).alias("at")))
        for i, r in enumerate(pack.fact_filters) if r["when"] in predicates
    ])
    rule = F.coalesce(by_text, by_fact)
    met = F.when(by_text.isNotNull(), 0).otherwise(
        F.coalesce(by_fact["at"], F.lit(len(pack.fact_filters))))
    unjudged = F.array_compact(F.array(*[
        F.when(F.lit(i) < met, F.lit(r["id"]))
        for i, r in enumerate(pack.fact_filters) if r["when"] not in predicates
    ]).cast("array<string>"))
    return facts.select(
        "unit_id", rule["id"].alias("excluded_by"), rule["reason"].alias("excluded_reason"),
        F.col("text_rule.evidence").alias("excluded_evidence"),
        unjudged.alias("filters_unavailable"),
    )


def screen_regimes(unit_blocks: DataFrame, heads: DataFrame, packs: list[Pack], default: str,
                   hits: DataFrame | None = None) -> DataFrame:
    """The regime a unit's own words claim; the case's regime unless another clearly wins.

    ``packs`` in id order: ties go to the earlier one, and to the default above all.
    """
    patterns = [
        p for k in packs for strength in ("strong", "weak") for p in k.identity.get(strength, [])
    ]
    if hits is None:
        hits = document_hits(body_of(unit_blocks), patterns)
    found = hits.groupBy("unit_id").agg(F.collect_set("pattern").alias("hits"))
    base = heads.select("unit_id", "form_serial").join(found, "unit_id", "left")
    words = F.coalesce(F.col("hits"), F.array().cast("array<string>"))

    def claim(place: int, pack: Pack) -> Column:
        serials = pack.identity.get("serials", [])
        by_serial = F.col("form_serial").isin(*serials) if serials else F.lit(False)
        parts = [F.when(by_serial, F.struct(
            F.lit(SERIAL_SCORE).alias("points"),
            F.concat(F.lit("serial:"), F.col("form_serial")).alias("name")))]
        for strength, points in (("strong", STRONG_SCORE), ("weak", WEAK_SCORE)):
            parts += [
                F.when(F.array_contains(words, p), F.struct(
                    F.lit(points).alias("points"), F.lit(p).alias("name")))
                for p in pack.identity.get(strength, [])
            ]
        said = F.array_compact(F.array(*parts))
        total = F.aggregate(said, F.lit(0.0), lambda a, s: a + s["points"])
        return F.struct(
            F.least(total, F.lit(1.0)).alias("score"), F.lit(-place).alias("place"),
            F.lit(pack.id).alias("id"), F.transform(said, lambda s: s["name"]).alias("matched"))

    claims = F.array(*[claim(i, k) for i, k in enumerate(packs)])
    scored = base.select("unit_id", claims.alias("claims")).select(
        "unit_id", F.array_max("claims").alias("best"),
        F.get(F.filter("claims", lambda c: c["id"] == default), F.lit(0)).alias("own"),
    )
    moves = (
        (F.col("best.id") != default) & (F.col("best.score") >= REGIME_MIN)
        & (F.col("best.score") > F.coalesce("own.score", F.lit(0.0)))
    )
    return scored.select(
        "unit_id", F.when(moves, F.col("best.id")).otherwise(default).alias("regime"),
        F.when(moves, F.lit("screened")).otherwise("case_default").alias("regime_source"),
        F.when(moves, F.col("best.score")).otherwise(F.coalesce("own.score", F.lit(0.0)))
        .alias("regime_confidence"),
        F.when(moves, F.col("best.matched")).otherwise(F.col("own.matched")).alias("regime_matched"),
    )
