"""The chronology as JSON and as Markdown.

A row is one object and one table line, however many lines and locators it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import Pack

# --- Fixed values: headings of the printed tables -------------------------------------------
REMOVED_HEAD = ("| Date | Document | Règle |", "|---|---|---|")
UNDATED_HEADING = "SANS DATE — {n} documents à dater"
REMOVED_HEADING = "RETIRÉ PAR RÈGLE — {n} document(s), conservés au dossier"
# -------------------------------------------------------------------------------------------


def _nested(df: DataFrame, place: str, name: str, *cols) -> DataFrame:
    item = F.struct(F.col(place).alias("_at"), F.struct(*cols).alias("v"))
    return df.groupBy("row_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))


def row_object() -> list:
    """The fields of a row's object, but for its lists."""
    return [
        F.col("row_id").alias("id"), F.col("case_id"), F.col("row_date").cast("string").alias("date"),
        *map(F.col, ("date_status", "date_explanation", "date_alternatives", "title", "author",
                     "doc_class", "regime")),
        F.round("confidence", 4).alias("confidence"),
        *map(F.col, ("warns", "illegible_reason", "second_hand", "n_units", "excluded_by"))]


def locator_object() -> list:
    return [*map(F.col, ("folder_label", "bundle_id")), F.col("first_page").alias("pdf_index"),
            *map(F.col, ("printed_label", "display_page", "flagged", "unit_id"))]


def bullet_object() -> list:
    citation = F.struct(
        "bundle_id", "pdf_index", "unit_id", "block_id",
        F.col("span_start").alias("start"), F.col("span_end").alias("end")).alias("citation")
    return [*map(F.col, ("text", "confidence", "rule")), citation]


def json_rows(rows: DataFrame, locators: DataFrame, bullets: DataFrame) -> DataFrame:
    """One object per row.  ``locators`` and ``bullets`` carry ``pos``."""
    places = _nested(locators, "pos", "locators", *locator_object())
    lines = _nested(bullets, "pos", "bullets", *bullet_object())
    out = rows.join(places, "row_id", "left").join(lines, "row_id", "left")
    return out.select(*row_object(), "locators", "bullets")


def removal_manifest(rows: DataFrame) -> DataFrame:
    """Every row held back, with its date, title and the rule that held it."""
    return rows.filter(F.col("excluded_by").isNotNull()).select(
        "case_id", "row_id",
        F.coalesce(F.col("row_date").cast("string"), F.lit("—")).alias("date"), "title", "excluded_by")


def row_sort():
    """Where a row stands in the printed table."""
    return F.struct(
        F.col("row_date").isNotNull().alias("dated"), "row_date",
        F.coalesce("author", F.lit("")).alias("author"), "doc_class", "min_page", "row_id")


def markdown_lines(rows: DataFrame, locators: DataFrame, bullets: DataFrame, pack: Pack) -> DataFrame:
    """(case_id, section, row_sort, part, line): the printed document, one line per record; part
    counts the lines of a heading.

    Sort by the first columns to print.  ``rows`` need the cells of ``display_rows``,
    ``locators`` the ``locator`` text; both they and ``bullets`` carry ``pos``.
    """
    places = _nested(locators, "pos", "places", F.regexp_replace("locator", "\n", "<br>").alias("l"))
    lines = _nested(bullets, "pos", "lines", F.concat(F.lit("• "), F.col("text")).alias("l"))
    body = rows.filter(F.col("excluded_by").isNull()).join(places, "row_id", "left").join(lines, "row_id", "left")
    opening = F.concat(F.lit("**"), F.col("title_cell"), F.lit("**"))

    def joined(name: str, sep: str):
        return F.nullif(F.array_join(F.transform(name, lambda x: x["l"]), sep), F.lit(""))

    content = F.concat_ws("<br>", opening, "illegible_cell", joined("lines", "<br>"), "warning_cell")
    table = body.select(
        "case_id", F.lit(2).alias("section"), row_sort().alias("row_sort"), F.lit(0).alias("part"), F.concat(
            F.lit("| "), F.col("date_cell"), F.lit(" | "),
            F.coalesce(joined("places", " ; "), F.lit("")), F.lit(" | "), content,
            F.lit(" |")).alias("line"))
    return table.unionByName(markdown_frame(rows, pack))


def markdown_frame(rows: DataFrame, pack: Pack) -> DataFrame:
    """The lines around the table: headings, and the rows that are held back."""
    words = pack.output.get("rows", {})
    heads = [c["header"] for c in pack.output.get("columns", [])] or ["Date", "Document", "Contenu"]
    shown = F.col("excluded_by").isNull()
    held = rows.filter(~shown).select(
        "case_id", F.lit(4).alias("section"), row_sort().alias("row_sort"), F.lit(0).alias("part"),
        F.concat(F.lit("| "), F.coalesce(F.col("row_date").cast("string"), F.lit("—")),
                 F.lit(" | "), F.col("title"), F.lit(" | `"), F.col("excluded_by"),
                 F.lit("` |")).alias("line"))
    nothing = F.lit(None).cast(held.schema["row_sort"].dataType)

    counts = rows.groupBy("case_id").agg(
        F.count_if(shown & F.col("row_date").isNull()).alias("undated"),
        F.count_if(~shown).alias("held"))

    def fixed(df: DataFrame, section: int, *texts) -> DataFrame:
        return df.select("case_id", F.lit(section).alias("section"), nothing.alias("row_sort"),
                         F.posexplode(F.array(*texts)).alias("part", "line"))

    def heading(name: str, default: str, count: str):
        before, after = words.get(name, default).split("{n}")
        return F.concat(F.lit("**" + before), F.col(count).cast("string"), F.lit(after + "**"))

    first = fixed(counts.filter("undated > 0"), 0,
                  heading("undated_heading", UNDATED_HEADING, "undated"), F.lit(""))
    head = fixed(counts, 1, F.lit("| " + " | ".join(heads) + " |"),
                 F.lit("|" + "|".join(["---"] * len(heads)) + "|"))
    gone = fixed(counts.filter("held > 0"), 3, F.lit(""),
                 heading("removed_heading", REMOVED_HEADING, "held"), F.lit(""),
                 *[F.lit(x) for x in REMOVED_HEAD])
    out = held
    for part in (first, head, gone):
        out = out.unionByName(part)
    return out


def write_json(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").partitionBy("case_id").json(path)


def write_markdown(lines: DataFrame, path: str) -> None:
    """Text files per case, in printed order; a long case is split over files by range."""
    order = ["case_id", "section", "row_sort", "part"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "case_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("case_id").text(path)


