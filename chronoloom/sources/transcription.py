"""Page transcriptions made elsewhere, as blocks of the most expensive tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

# --- Fixed values ---------------------------------------------------------------------------
CONFIDENCE = 0.70
KINDS = ("heading", "paragraph", "table", "checkbox", "signature", "handwriting", "stamp")
# -------------------------------------------------------------------------------------------


def to_blocks(payloads: DataFrame) -> DataFrame:
    """One block per transcribed line, spread evenly down the page.

    ``payloads``: case_id, bundle_id, pdf_index, width, height, payload (JSON).  A line that
    could not be read stays, as handwriting of half the confidence.
    """
    read = payloads.withColumn("p", F.from_json("payload", schemas.TRANSCRIPT))
    lines = read.select(
        "case_id", "bundle_id", "pdf_index", "width", "height",
        F.size("p.lines").alias("n"), F.posexplode("p.lines").alias("ord", "line"))
    text = tx.strip(F.coalesce("line.text", F.lit("")))
    legible = F.coalesce("line.legible", F.lit(True))
    step = F.col("height") / F.greatest("n", F.lit(1))
    top = F.col("ord") * step
    words = tx.word_counts(text)
    kind = F.coalesce("line.kind", F.lit("paragraph"))
    return lines.filter(text != "").select(
        "case_id", "bundle_id", "pdf_index", "ord",
        tx.digest(F.col("bundle_id"), F.col("pdf_index").cast("string"), F.lit("vision"),
                  F.col("ord").cast("string"), size=20, prefix="blk_", sep=":").alias("block_id"),
        F.when(~legible, "handwriting").when(kind.isin(*KINDS), kind).otherwise("paragraph")
        .alias("type"),
        text.alias("text"), F.lit(0.0).alias("x0"), top.alias("y0"), F.col("width").alias("x1"),
        F.least(top + step, F.col("height")).alias("y1"), F.col("height").alias("page_height"),
        F.lit("vision").alias("source"),
        F.when(legible, CONFIDENCE).otherwise(CONFIDENCE / 2).alias("confidence"),
        F.when(legible & (kind == "heading"), 2).cast("int").alias("level"),
        F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("label_rule"),
        F.lit(None).cast("string").alias("label"), F.lit(False).alias("degenerate"),
        F.lit(None).cast("double").alias("font_size"), words["alpha"].alias("alpha"),
        words["good"].alias("good"))
