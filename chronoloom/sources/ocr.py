"""Word tables of an OCR engine, read and joined to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import blocks as blk

# --- Fixed values ---------------------------------------------------------------------------
WORD_LEVEL = 5
MIN_WORD_CONFIDENCE = 30.0
DEFAULT_SCALE = 3.0
# -------------------------------------------------------------------------------------------

PAGE = ["bundle_id", "pdf_index"]


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word rows; quotes are text."""
    return spark.read.csv(path, sep="\t", header=True, quote="", schema=schemas.OCR_WORDS,
                          mode="PERMISSIVE")


def usable_words(words: DataFrame) -> DataFrame:
    text = F.trim("text")
    return words.filter(
        (F.col("level") == WORD_LEVEL) & (F.col("conf") >= MIN_WORD_CONFIDENCE) & (text != "")
    ).withColumn("text", text)


def words_to_lines(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Words of one (block, paragraph, line) of a page become a line, read left to right.

    Lines are numbered from the top; groups are one printed line and one page.
    """
    keys = keys or PAGE
    line = [*keys, "block_num", "par_num", "line_num"]
    grouped = usable_words(words).groupBy(*line).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("left", "word_num", "text"))),
            lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("left"), F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        (F.sum(F.col("conf").cast("decimal(20,6)")) / F.count(F.lit(1)) / 100)
        .cast("double").alias("confidence"))
    order = Window.partitionBy(*keys).orderBy("top", "left", "block_num", "par_num", "line_num")
    return grouped.withColumn("ord", F.row_number().over(order) - 1)


def scaled(lines: DataFrame, scale: float = DEFAULT_SCALE) -> DataFrame:
    """Pixel boxes in points, line heights as font sizes, and the page's upper-median height."""
    boxes = lines.withColumns({
        "x0": F.col("left") / scale, "y0": F.col("top") / scale,
        "x1": F.col("right") / scale, "y1": F.col("bottom") / scale,
    }).withColumn("font_size", F.col("y1") - F.col("y0"))
    height = F.greatest(F.lit(1.0), F.col("font_size"))
    heights = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(height)).alias("h"))
    body = heights.select(*PAGE, F.get("h", (F.size("h") / 2).cast("int")).alias("body_size"))
    return boxes.join(body, PAGE)


def to_blocks(words: DataFrame, pages: DataFrame, scale: float = DEFAULT_SCALE) -> DataFrame:
    """Typed blocks of the OCR tier.  ``pages``: case_id, bundle_id, pdf_index, height."""
    lines = scaled(words_to_lines(words), scale).join(
        pages.select("case_id", *PAGE, F.col("height").alias("page_height")), PAGE)
    return blk.from_lines(
        lines, source="ocr", heading_ratio=blk.OCR_HEADING_RATIO,
        upper_max_chars=blk.OCR_UPPER_MAX_CHARS)
