"""The reference tables (orders, line items, documents, ...) seen as case files.

Used by the registered queries: every one of them runs over whole tables, so its work grows
with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread

PAGE_LINES = 4
PAGE_HEIGHT = 792.0
CLASS_OF_STATUS = {"F": "rapport_medical", "O": "note_consultation", "P": "rapport_imagerie"}
ROLE_OF_FLAG = {"R": "event", "A": "exam", "N": "report"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: dict, column):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


# --- documents as bundles of four-line pages ------------------------------------------------


def document_lines(spark: SparkSession, folder: str, pieces: int = 4) -> DataFrame:
    """Every line of every document: case = source, bundle = document, four lines to a page.

    A line takes long to type: what is read as one piece would be minutes of one task, so it is
    dealt out in ``pieces``.
    """
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"), pieces=pieces)
    each = docs.select(
        F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("bundle_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("nth", "text"))
    slot = F.col("nth") % PAGE_LINES
    top = F.lit(20.0) + slot * 240
    return each.select(
        "case_id", "bundle_id",
        (F.floor(F.col("nth") / PAGE_LINES) + 1).cast("int").alias("pdf_index"),
        F.col("nth").alias("ord"), "text",
        F.when((slot == 0) & (F.length("text") <= 60), 13.0).otherwise(10.0).alias("font_size"),
        F.lit(10.0).alias("body_size"), F.lit(62.0).alias("x0"), top.alias("y0"),
        F.lit(550.0).alias("x1"), (top + 12).alias("y1"), F.lit(PAGE_HEIGHT).alias("page_height"))


def printed(lines: DataFrame) -> DataFrame:
    """Lines with ink on them; blank ones draw nothing, but their page exists."""
    return lines.filter(F.trim("text") != "")


def document_pages(lines: DataFrame) -> DataFrame:
    return lines.select(
        "case_id", "bundle_id", "pdf_index", F.lit(612.0).alias("width"),
        F.lit(PAGE_HEIGHT).alias("height")).distinct()


# --- orders as units, line items as date facts and printed lines ----------------------------


def order_units(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("o"), key.cast("string")).alias("unit_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("case_id"),
        F.concat(F.lit("b"), (key % 4).cast("string")).alias("bundle_id"),
        (key + 1).cast("int").alias("first_page"), F.lit(1).cast("long").alias("n_pages"),
        F.lit(True).alias("contiguous"),
        _pick(CLASS_OF_STATUS, F.col("o_orderstatus")).alias("doc_class"),
        F.lit("cnesst").alias("regime"),
        F.when(key % 50 == 0, "illegible").otherwise("legible").alias("legibility"),
        F.when(key % 50 == 0, F.lit("no text")).alias("legibility_reason"),
        F.col("o_orderpriority").alias("author"), F.lit(None).cast("string").alias("form_serial"),
        F.when(key % 97 == 0, F.lit("rule.seven")).alias("excluded_by"),
        F.lit("primary").alias("kind"), F.lit("zones").alias("class_source"),
        F.lit(0.9).alias("class_confidence"), F.to_date("o_orderdate").alias("o_date"))


def item_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Date facts: one per line item; line 7 has two readings, line 5 an inferred century."""
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    day = F.to_date("l_shipdate")
    readings = F.when(F.col("l_linenumber") == 7, F.array(day, F.date_add(day, 1))).otherwise(
        F.array(day))
    return items.join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    ).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("case_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("block_id"),
        F.col("l_linenumber").alias("pdf_index"), (F.col("l_suppkey") * 64 + F.col("l_quantity")).cast("int").alias("ord"),
        F.col("l_partkey").cast("int").alias("start"), (F.col("l_partkey") + 10).cast("int").alias("end"),
        F.lit(1).alias("kind"),
        F.when(F.col("l_linenumber") == 6, F.lit("unknown")).otherwise(
            _pick(ROLE_OF_FLAG, F.col("l_returnflag"))).alias("role"),
        readings.alias("readings"), day.cast("string").alias("raw"), F.lit(1.0).alias("confidence"),
        (F.col("l_linenumber") == 5).alias("century_inferred"))


def item_bullets(spark: SparkSession, folder: str, units: DataFrame) -> DataFrame:
    """Printed lines before folding.  ``units``: row_id, unit_id, bundle_id, first_page."""
    items = table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit_id"),
        F.lit(1).alias("kind"), F.lit("").alias("field_key"),
        F.col("l_linenumber").alias("pdf_index"), (F.col("l_suppkey") * 64 + F.col("l_quantity")).cast("int").alias("ord"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("block_id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus",
                    F.col("l_quantity").cast("int").cast("string")).alias("text"),
        F.round(1 - F.col("l_discount") * 4, 2).alias("confidence"),
        F.lit("assemble.transcribe_line").alias("rule"), F.lit(0).alias("span_start"),
        F.lit(5).alias("span_end"))
    return items.join(units.select("row_id", "unit_id", "bundle_id", "first_page"), "unit_id")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections: events of a user correct the unit of that number."""
    value = F.col("value")
    field = (
        F.when(F.col("event_type") == "click", "doc_class").when(F.col("event_type") == "view", "regime")
        .when(F.col("event_type") == "purchase", "row_date").otherwise(F.col("event_type"))
    )
    new = (
        F.when(F.col("event_type") == "click", F.concat(
            F.lit("class_"), F.floor(value).cast("string")))
        .when(F.col("event_type") == "view", F.when(value > 20, "saaq").otherwise("ivac"))
        .when((F.col("event_type") == "purchase") & (value <= 40), F.date_format(
            F.date_add(F.lit("2020-01-01").cast("date"), F.floor(value).cast("int")), "yyyy-MM-dd"))
    )
    return table(spark, folder, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("correction_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("case_id"),
        F.lit("unit").alias("subject_type"),
        F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("subject_id"),
        field.alias("field"), F.lit(None).cast("string").alias("old_value"), new.alias("new_value"),
        F.lit("review").alias("rule"),
        F.concat(F.lit("user"), (F.col("event_id") % 7).cast("string")).alias("actor"),
        F.col("ts").alias("created_at"))


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log entries; purchases are extraction calls with their figures."""
    n = F.floor("value").cast("int")
    detail = F.to_json(F.struct(
        F.when(n % 10 == 3, "max_tokens").otherwise("end_turn").alias("stop_reason"),
        n.alias("selected"), (n - n % 2).alias("kept"),
        F.when(n % 11 == 0, F.lit("no_model")).alias("skipped")))
    return table(spark, folder, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("audit_id"), F.col("ts"),
        F.lit("engine").alias("actor"),
        F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("run_id"),
        F.lit("unit").alias("subject_type"),
        F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("subject_id"),
        F.when(F.col("event_type") == "purchase", "extract").otherwise(F.col("event_type")).alias("action"),
        F.lit("stage").alias("rule"), F.lit(None).cast("string").alias("epistemic_tag"),
        detail.alias("detail"))


# --- orders and line items as written case files --------------------------------------------

HEADING_OF_FLAG = {"R": "RAPPORT MÉDICAL", "A": "RAPPORT D'IMAGERIE", "N": "NOTE DE CONSULTATION"}
MONTH_NAMES = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
               "septembre", "octobre", "novembre", "décembre")
STATEMENTS = (
    "Le patient note une amélioration de la douleur lombaire.",
    "Tableau clinique stationnaire depuis la dernière évaluation médicale.",
    "Une rechute est survenue pendant le retour progressif au",
    "Douleur lombaire à l'effort et sommeil correct.",
)


def written_pages(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One page per line item, in the order of line number, part and quantity: what it says."""
    # An order has some lines, so its window is small.
    within = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_shipdate")
    page = items.select(
        "l_orderkey", F.row_number().over(within).alias("l_linenumber"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_suppkey").alias("supp"))
    return page.join(orders.select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
        F.to_date("o_orderdate").alias("o_day")), "l_orderkey")


def written_lines(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Case files in the words the rules look for, one bundle per order."""
    return lines_of_pages(written_pages(items, orders))


def lines_of_pages(p: DataFrame) -> DataFrame:
    """The lines of ``written_pages``, page by page in their order."""
    day, qty = F.col("day"), F.col("qty")
    opens = F.col("status") == "F"
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day))
    dated = (
        F.when(F.col("flag") == "R", F.concat(
            F.lit("Vu le "), F.day(day).cast("string"), F.lit(" "), month, F.lit(" "),
            F.year(day).cast("string"), F.lit(" en clinique")))
        .when(F.col("flag") == "A", F.concat(F.lit("Date de l'examen: "), day.cast("string")))
        .otherwise(F.concat(F.lit("Date de la visite: "), F.date_format(day, "dd/MM/yyyy")))
    )
    statement = F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), qty % 4 + 1)
    slots = [
        (0, F.when(opens, _pick(HEADING_OF_FLAG, F.col("flag"))), 13.0, 60.0),
        (1, F.when(opens & (F.col("flag") == "R"), F.lit("Formulaire 1918 (2011-11)")), 10.0, 100.0),
        (2, dated, 10.0, 130.0),
        (3, F.when(qty % 5 == 0, F.concat(
            F.lit("Date de l'événement: "), F.col("o_day").cast("string"))), 10.0, 150.0),
        (4, F.when(opens, F.lit("SUBJECTIF")), 11.0, 180.0),
        (5, statement, 10.0, 210.0),
        (6, F.when(qty % 4 == 2, F.lit("travail cette semaine.")), 10.0, 230.0),
        (7, F.concat(F.lit("Constat numéro "), qty.cast("string"), F.lit(" noté au dossier.")), 10.0, 250.0),
        (8, F.when(F.col("flag") == "R", F.when(qty % 3 == 0, F.lit("CONSOLIDATION [x] Oui [ ] Non")).when(
            qty % 3 == 1, F.lit("CONSOLIDATION [ ] Oui [x] Non")).otherwise(
            F.lit("CONSOLIDATION [ ] Oui [ ] Non"))), 10.0, 300.0),
        (9, F.when(qty % 2 == 0, F.concat(F.lit("Signé: Dr Martin "), F.col("supp").cast("string"))), 10.0, 330.0),
        (10, F.concat(F.lit("p. "), F.col("l_linenumber").cast("string")), 8.0, 750.0),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), text.alias("text"), F.lit(size).alias("font_size"),
                 F.lit(y).alias("y0")) for i, text, size, y in slots])
    return p.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("case_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("bundle_id"),
        F.col("l_linenumber").alias("pdf_index"), F.explode(rows).alias("r"),
    ).filter(F.col("r.text").isNotNull()).select(
        "case_id", "bundle_id", "pdf_index", "r.ord", "r.text", "r.font_size",
        F.lit(10.0).alias("body_size"), F.lit(62.0).alias("x0"), F.col("r.y0").alias("y0"),
        F.lit(550.0).alias("x1"), (F.col("r.y0") + 12).alias("y1"),
        F.lit(PAGE_HEIGHT).alias("page_height"))


def pages_of(lines: DataFrame) -> DataFrame:
    return lines.select(
        "case_id", "bundle_id", "pdf_index", F.lit(612.0).alias("width"),
        F.lit(PAGE_HEIGHT).alias("height")).distinct()
