"""From page lines to typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import BODY_TYPES

# --- Fixed values: line patterns and thresholds ---------------------------------------------
EMPTY_FIELD = r"^\s*([^:\n]{1,60}?)\s*:\s*$"
CHECKBOX = r"\[\s*[xX✓]?\s*\]"
STAMP = r"(^|\s)(de\s*:|from\s*:|à\s*:|to\s*:|fax|t[ée]l[ée]copie|p\.\s*\d{3}\b|re[çc]u\s+le)"
SIGNATURE = r"^\s*(sign[ée]|signature|dr[e]?\.?\s|<signature>)"
TABLE_ROW = r"^\s*\S.*?(?:\s\d[\d\s.,%°/-]*){2,}\s*$"
HEADING_RATIO = 1.05
OCR_HEADING_RATIO = 1.35
TOP_HEADING_RATIO = 1.25
HEADING_MAX_CHARS = 90
UPPER_DENSE = 0.8
OCR_UPPER_MAX_CHARS = 40
BROKEN_NUMBER_CONFIDENCE = 0.55
#: Share of the page height that counts as header or footer.
LABEL_BAND = 0.12
_GAP = r"[\s ]*"
_PAGE_WORD = r"(?:p?age|p)\.?"
LABEL_PATTERNS = (
    ("page_x_of_y",
     rf"^{_GAP}(?:{_PAGE_WORD}{_GAP})?(?<label>\d{{1,4}}){_GAP}(?:de|of|/|sur){_GAP}\d{{1,4}}{_GAP}$"),
    ("page_x_of_truncated",
     rf"^{_GAP}{_PAGE_WORD}{_GAP}(?<label>\d{{1,4}}){_GAP}(?:de|of|sur){_GAP}$"),
    ("page_n", rf"^{_GAP}{_PAGE_WORD}{_GAP}(?<label>\d{{1,4}}){_GAP}$"),
    ("bare_number", rf"^{_GAP}(?<label>\d{{1,4}}){_GAP}$"),
)
# -------------------------------------------------------------------------------------------


def is_body(kind: Column) -> Column:
    return kind.isin(*BODY_TYPES)


def page_label(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    """struct(rule, label) for a line that reads as a page label where labels are printed."""
    in_band = (y1 <= height * LABEL_BAND) | (y0 >= height - height * LABEL_BAND)
    read = F.coalesce(*[
        F.when(tx.hits(text, p), F.struct(
            F.lit(rule).alias("rule"), F.regexp_extract(text, tx.rx(p), 1).alias("label")))
        for rule, p in LABEL_PATTERNS
    ])
    # A label holds a number, a cheap test that spares most lines the patterns.
    return F.when(in_band & tx.has_digit(text), read)


def block_type(
    text: Column, font_size: Column, body_size: Column, upper_dense: Column,
    heading_ratio: float = HEADING_RATIO,
) -> Column:
    """struct(type, level, field) of one line; the order of the cases is the rule."""
    larger = (body_size > 0) & (font_size >= body_size * heading_ratio)
    top = (body_size > 0) & (font_size >= body_size * TOP_HEADING_RATIO)

    def kind(name: str, level: Column | None = None, field: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("type"),
            (F.lit(None) if level is None else level).cast("int").alias("level"),
            (F.lit(None) if field is None else field).cast("string").alias("field"),
        )

    def read(bare: Column) -> Column:
        heading = (F.length(bare) <= HEADING_MAX_CHARS) & (larger | upper_dense)
        # Each pattern runs only on lines that hold what it cannot match without.
        stamped = tx.once(F.lower(bare), lambda low: (
            F.contains(low, F.lit(":")) | F.contains(low, F.lit("fax")) | F.contains(low, F.lit("copie"))
            | F.contains(low, F.lit("p.")) | bare.rlike("(?iu)re[çc]u")))
        ends_in_number = F.right(bare, F.lit(1)).rlike(r"[\p{Nd}.,%°/-]")
        return (
            F.when(bare == "", kind("empty"))
            .when(F.endswith(bare, F.lit(":")) & tx.hits(bare, EMPTY_FIELD, case=True),
                  kind("empty", field=F.regexp_extract(bare, tx.rx(EMPTY_FIELD, case=True), 1)))
            .when(F.contains(bare, F.lit("[")) & tx.hits(bare, CHECKBOX, case=True), kind("checkbox"))
            .when(stamped & tx.hits(bare, STAMP), kind("stamp"))
            .when(tx.hits(bare, SIGNATURE), kind("signature"))
            .when(heading, kind("heading", level=F.when(top, 1).when(larger, 2).otherwise(3)))
            .when(ends_in_number & tx.hits(bare, TABLE_ROW, case=True), kind("table"))
            .otherwise(kind("paragraph"))
        )

    return tx.once(tx.strip(text), read)


def block_id(*parts: Column) -> Column:
    return tx.digest(*[p.cast("string") for p in parts], size=20, prefix="blk_")


def from_lines(
    lines: DataFrame,
    *,
    source: str = "text_layer",
    heading_ratio: float = HEADING_RATIO,
    upper_max_chars: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Type every line of the text-layer or OCR tier.  No shuffle: one narrow projection.

    ``lines`` may carry ``confidence`` (default 1.0); ``keep`` names columns to pass through.
    """
    text = F.col("text")
    dense = tx.upper_share(text) > UPPER_DENSE
    if upper_max_chars is not None:
        dense = dense & (F.length(text) <= upper_max_chars)
    label = page_label(text, F.col("y0"), F.col("y1"), F.col("page_height"))
    typed = lines.select(
        "*",
        label.alias("_label"),
        block_type(text, F.col("font_size"), F.col("body_size"), dense, heading_ratio)
        .alias("_kind"),
        tx.broken_number(text).alias("degenerate"), tx.word_counts(text).alias("_words"),
    )
    stated = F.col("confidence") if "confidence" in lines.columns else F.lit(1.0)
    confidence = F.when(
        F.col("degenerate"), F.least(stated, F.lit(BROKEN_NUMBER_CONFIDENCE))
    ).otherwise(stated)
    id_parts = ["bundle_id", "pdf_index", "ord", "text"]
    id_cols = [F.col(c) for c in id_parts]
    if source != "text_layer":
        id_cols.insert(2, F.lit(source))
    on_label = F.col("_label").isNotNull()
    return typed.select(
        "case_id", "bundle_id", "pdf_index", "ord",
        block_id(*id_cols).alias("block_id"),
        F.when(on_label, "page_label").otherwise(F.col("_kind.type")).alias("type"),
        tx.strip(text).alias("text"),
        "x0", "y0", "x1", "y1", "page_height",
        F.lit(source).alias("source"),
        F.round(confidence, 4).alias("confidence"),
        F.when(~on_label, F.col("_kind.level")).alias("level"),
        F.when(~on_label, F.col("_kind.field")).alias("field"),
        F.col("_label.rule").alias("label_rule"),
        F.col("_label.label").alias("label"),
        "degenerate", "font_size", F.col("_words.alpha").alias("alpha"),
        F.col("_words.good").alias("good"),
        *keep,
    )


def label_lines(lines: DataFrame) -> DataFrame:
    """Only the blocks of ``from_lines`` that are page labels, as far as labels need them.

    No other line is typed, so this costs a small part of it.
    """
    read = lines.select("bundle_id", "pdf_index", "ord", page_label(
        F.col("text"), F.col("y0"), F.col("y1"), F.col("page_height")).alias("_label"))
    return read.filter(F.col("_label").isNotNull()).select(
        "bundle_id", "pdf_index", "ord", F.lit("page_label").alias("type"),
        F.col("_label.rule").alias("label_rule"), F.col("_label.label").alias("label"))


def attributes(blocks: DataFrame) -> DataFrame:
    """Blocks with the open ``attrs`` map of the exchange format."""
    pairs = F.array(
        F.struct(F.lit("level").alias("k"), F.col("level").cast("string").alias("v")),
        F.struct(F.lit("field").alias("k"), F.col("field").alias("v")),
        F.struct(F.lit("raw").alias("k"),
                 F.when(F.col("type") == "checkbox", F.col("text")).alias("v")),
        F.struct(F.lit("structure").alias("k"),
                 F.when(F.col("type") == "table", F.lit("row_only")).alias("v")),
        F.struct(F.lit("label").alias("k"), F.col("label").alias("v")),
        F.struct(F.lit("rule").alias("k"), F.col("label_rule").alias("v")),
        F.struct(F.lit("font_size").alias("k"),
                 F.regexp_replace(F.col("font_size").cast("string"), r"\.0$", "").alias("v")),
        F.struct(F.lit("degenerate_number").alias("k"),
                 F.when(F.col("degenerate"), F.lit("true")).alias("v")),
    )
    present = F.filter(pairs, lambda p: p["v"].isNotNull())
    return blocks.withColumn("attrs", F.map_from_entries(present))


def modal_size(chars: DataFrame, keys: list[str]) -> DataFrame:
    """The size most characters are set in; ties go to the size seen first.

    ``chars`` has the keys, ``pos`` (reading position) and ``size``.
    """
    counted = chars.groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")
    )
    rank = F.struct("n", -F.col("first"))
    return counted.groupBy(*keys).agg(F.max_by("size", rank).alias("body_size"))


def size_in_boxes(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """Font size of each line: the modal size of the characters inside its box.

    ``chars``: bundle_id, pdf_index, pos, cx, cy, size; ``boxes``: bundle_id, pdf_index, ord,
    x0, y0, x1, y1 in the same coordinates.  Both are keyed by page, so the join is an equi
    join whose groups are one sheet.
    """
    page = ["bundle_id", "pdf_index"]
    inside = boxes.join(chars, page).filter(
        F.col("cx").between(F.col("x0"), F.col("x1"))
        & F.col("cy").between(F.col("y0"), F.col("y1"))
    )
    sizes = modal_size(inside, [*page, "ord"]).withColumnRenamed("body_size", "font_size")
    return boxes.join(sizes, [*page, "ord"], "left").fillna(0.0, ["font_size"])


def flip_origin(lines: DataFrame) -> DataFrame:
    """Boxes measured from the bottom edge become boxes measured from the top edge."""
    return lines.withColumns({
        "y0": F.col("page_height") - F.col("y1"), "y1": F.col("page_height") - F.col("y0"),
    })


def page_text_needs_ocr(text: Column, threshold: float = 0.35) -> Column:
    """No text at all, or text that does not read as words."""
    return (tx.strip(text) == "") | (tx.word_likeness(text) < threshold)


def derived_key(*parts: Column) -> Column:
    """Key of a derived artifact: equal inputs and producers give an equal key."""
    return tx.digest(*parts, size=32)


def only_changed(candidates: DataFrame, done: DataFrame, key: str = "derived_key") -> DataFrame:
    """Work whose key has not been produced before."""
    return candidates.join(done.select(key), key, "left_anti")
