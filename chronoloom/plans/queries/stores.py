"""Queries over readers, writers and form fields."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ... import rules
from ...operators import blocks, dates, templates
from ...session import shared_folder, spread
from ...sinks import store as sink
from ...sources import files, gold, ocr, store, tables, transcription
from . import casefiles, facts
from .registry import TODAY, query, shared, text_date

PACK = rules.load("cnesst")


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- files and blobs ------------------------------------------------------------------------


@query("register_bundles", """
WITH p AS (SELECT page_id, url, html, 'site' || (page_id % 3) AS case_id FROM pages)
SELECT case_id, 'p' || page_id || '.pdf' AS filename, 'd' || (page_id % 7) AS folder_label,
  sha256(html) AS content_hash,
  'bundle_' || substr(sha256(case_id || '|' || sha256(html) || '|' || 'd' || (page_id % 7)), 1, 20) AS bundle_id
FROM p""")
def register_bundles(spark, folder):
    """Web pages as files: hashed by content, labelled by directory."""
    key = F.col("page_id")
    raw = tables.table(spark, folder, "pages").select(
        F.concat(F.lit("site"), (key % 3).cast("string")).alias("case_id"),
        F.concat(F.lit("/in/d"), (key % 7).cast("string"), F.lit("/p"), key.cast("string"),
                 F.lit(".pdf")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.register(raw).select("case_id", "filename", "folder_label", "content_hash", "bundle_id")


@query("new_content", """
SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN
  (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def new_content(spark, folder):
    """Documents not stored yet, each content once; labelled ones are stored."""
    docs = tables.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    known = docs.join(tables.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return files.new_content(docs, known).select("content_hash")


# --- table versions -------------------------------------------------------------------------


@query("unit_upsert", facts._with(facts.UNITS, facts.FACTS, facts.ROW_DATES) + """
SELECT u.unit_id, CASE WHEN n.unit_id IS NULL THEN u.doc_class ELSE 'again' END AS doc_class
FROM u LEFT JOIN (SELECT DISTINCT 'o' || user_id AS unit_id FROM events) n USING (unit_id)""")
def unit_upsert(spark, folder):
    """Units of users with events are described again; the rest stay."""
    old = tables.order_units(spark, folder).select("unit_id", "doc_class")
    new = tables.event_log(spark, folder).select(F.col("subject_id").alias("unit_id")).distinct().join(
        old, "unit_id", "left_semi").withColumn("doc_class", F.lit("again"))
    return sink.upserted(old, new, "unit_id")


@query("bundle_replace", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, 2 AS gen FROM lineitem JOIN orders
  ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND l_linestatus = 'F')
SELECT l_orderkey, l_linenumber, l_partkey, 1 AS gen FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n""")
def bundle_replace(spark, folder):
    """Bundles of open studies are read again and now hold only their closed lines."""
    items = tables.table(spark, folder, "lineitem")
    old = items.select(F.col("l_orderkey").alias("bundle_id"), "l_linenumber", "l_partkey",
                       F.lit(1).alias("gen"))
    studies = tables.table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    new = items.filter("l_linestatus = 'F'").join(studies, "l_orderkey", "left_semi").select(
        F.col("l_orderkey").alias("bundle_id"), "l_linenumber", "l_partkey", F.lit(2).alias("gen"))
    return sink.replaced_bundles(old, new).withColumnRenamed("bundle_id", "l_orderkey")


@query("record_replace", """
WITH r AS (SELECT 'o' || l_orderkey AS unit_id, CASE l_linestatus WHEN 'F' THEN '4a' ELSE '4c' END AS stage,
    l_returnflag AS field FROM lineitem)
SELECT unit_id, stage, field, count(*) AS n FROM (
  SELECT * FROM r WHERE NOT (stage = '4a' AND field = 'x') AND NOT (stage = '4a' AND unit_id IN
    (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F'))
  UNION ALL SELECT 'o' || o_orderkey, '4a', 'again' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) GROUP BY 1, 2, 3""")
def record_replace(spark, folder):
    """Forms of closed orders were read again: half of them yield a record, half none."""
    items = tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit_id"),
        F.when(F.col("l_linestatus") == "F", "4a").otherwise("4c").alias("stage"),
        F.col("l_returnflag").alias("field"))
    closed = tables.table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("unit_id"), "o_orderkey",
        F.lit("4a").alias("stage"))
    new = closed.filter("o_orderkey % 2 = 0").select("unit_id", "stage", F.lit("again").alias("field"))
    return sink.replaced_records(items, new, closed).groupBy("unit_id", "stage", "field").agg(
        F.count(F.lit(1)).alias("n"))


@query("cascade_delete", """
SELECT 'o' || l_orderkey AS unit_id, count(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def cascade_delete(spark, folder):
    child = tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit_id"))
    gone = tables.table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("unit_id"))
    return sink.without_units(child, gone).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


@query("mark_excluded", facts._with(facts.UNITS) + """
SELECT unit_id, CASE WHEN unit_id IN (SELECT 'o' || user_id FROM events) THEN 'late.rule'
  ELSE excluded_by END AS excluded_by FROM u""")
def mark_excluded(spark, folder):
    new = tables.event_log(spark, folder).select(F.col("subject_id").alias("unit_id")).distinct().withColumn(
        "excluded_by", F.lit("late.rule"))
    return sink.marked_excluded(tables.order_units(spark, folder), new).select("unit_id", "excluded_by")


@query("run_snapshot", facts._with(facts.UNITS, facts.ENCOUNTERS, facts.MERGED) + """
SELECT 'run1' AS run_id, case_id, row_id, row_number() OVER (PARTITION BY case_id ORDER BY
  row_date IS NOT NULL, row_date, author, doc_class, min_page, row_id) - 1 AS ord FROM rws""")
def run_snapshot(spark, folder):
    """Rows of a run with their stored place, written by run and read back."""
    rows = facts.encounter_rows(spark, folder).select(
        "case_id", "row_id", F.col("row_date").isNotNull().alias("dated"),
        F.coalesce("row_date", F.lit("1900-01-01").cast("date")).alias("day"),
        F.coalesce("author", F.lit("")).alias("author"), "doc_class", "min_page")
    placed = sink.run_snapshot(rows, "run1", ["dated", "day", "author", "doc_class", "min_page", "row_id"])
    root = _scratch(spark, "runs")
    sink.write_run(placed, root, "rows")
    back = spark.read.parquet(f"{root}/rows")
    return store.rows_of_run(back, "run1").select("run_id", "case_id", "row_id", "ord")


@query("audit_entries", """
SELECT 'aud_' || substr(sha256('run1|unit|o' || o_orderkey || '|manifest_unit'), 1, 20) AS audit_id,
  'o' || o_orderkey AS subject_id, '{"status":"' || o_orderstatus || '"}' AS detail FROM orders""")
def audit_entries(spark, folder):
    orders = tables.table(spark, folder, "orders")
    return sink.audit_entries(
        orders, "unit", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), "manifest_unit",
        F.struct(F.col("o_orderstatus").alias("status")), run_id="run1", rule=F.lit("stage.manifest"),
        ts=F.col("o_orderdate")).select("audit_id", "subject_id", "detail")


@query("blocks_of_units", """
SELECT 'o' || l_orderkey || CASE WHEN l_linenumber % 3 = 0 THEN ':rest' ELSE '' END AS unit_id,
  l_linenumber AS pdf_index, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def blocks_of_units(spark, folder):
    """Blocks of page sets with gaps: every third page of an order is one unit, the others another."""
    items = tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("bundle_id"),
        F.col("l_linenumber").alias("pdf_index"))
    last = items.groupBy("bundle_id").agg(F.max("pdf_index").alias("z"))
    thirds = F.sequence(F.lit(0), F.floor(F.col("z") / 3))

    def runs(first: int, end: int):
        return F.transform(thirds, lambda i: F.struct(
            (3 * i + first).cast("int").alias("first"), (3 * i + end).cast("int").alias("last")))

    units = last.select("bundle_id", F.explode(F.array(
        F.struct(F.col("bundle_id").alias("unit_id"), runs(1, 2).alias("spans")),
        F.struct(F.concat("bundle_id", F.lit(":rest")).alias("unit_id"), runs(3, 3).alias("spans")),
    )).alias("u")).select("bundle_id", "u.*")
    return store.blocks_of_units(items, units).groupBy("unit_id", "pdf_index").agg(
        F.count(F.lit(1)).alias("n"))


@query("bundle_scan", facts._with(casefiles.WRITTEN, casefiles.PRINTED) + """
SELECT 'o' || l_orderkey AS bundle_id, CAST(page AS INTEGER) AS pdf_index, CAST(ord AS INTEGER) AS ord,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY page, ord) AS place FROM pl""")
def bundle_scan(spark, folder):
    """Every bundle read back from the clustered store in reading order."""
    return store.bundles_in_order(casefiles.typed_blocks(spark, folder)).select("bundle_id", "pdf_index", "ord", "place")


@query("block_lookup", facts._with(casefiles.WRITTEN, casefiles.ROWS, casefiles.BULLETS) + """
SELECT DISTINCT block_id, 'o' || l_orderkey AS bundle_id, CAST(page AS INTEGER) AS pdf_index, 62.0::DOUBLE AS x0,
  CASE ord WHEN 2 THEN 130.0 WHEN 3 THEN 150.0 WHEN 5 THEN 210.0 WHEN 6 THEN 230.0 WHEN 7 THEN 250.0 ELSE 300.0 END::DOUBLE AS y0,
  page::VARCHAR AS printed_label FROM bu""")
def block_lookup(spark, folder):
    """The block that each printed line cites, looked up by its id: where to crop the page."""
    labels = casefiles.casefile_labels(spark, folder)
    cited = casefiles.casefile_bullets(spark, folder).select("block_id").distinct()
    return store.look_up(casefiles.typed_blocks(spark, folder), labels, cited).select(
        "block_id", "bundle_id", "pdf_index", "x0", "y0", "printed_label")


@query("units_with_dates", facts._with(facts.UNITS, facts.FACTS) + """
SELECT u.unit_id, coalesce((SELECT string_agg(f.d::VARCHAR, ',' ORDER BY pdf_index, start_at, ord) FROM f
  WHERE f.unit_id = u.unit_id), '') AS days FROM u""")
def units_with_dates(spark, folder):
    nested = store.units_with_dates(tables.order_units(spark, folder), tables.item_facts(spark, folder))
    days = F.transform("dates", lambda d: d["readings"][0].cast("string"))
    return nested.select("unit_id", F.coalesce(F.array_join(days, ","), F.lit("")).alias("days"))


@query("correction_append", facts._with(facts.LOG) + """
SELECT subject_id, field, count(*) AS n, max(created_at)::VARCHAR AS last_at FROM lg GROUP BY 1, 2""")
def correction_append(spark, folder):
    """Corrections appended to the log day by day, then read back."""
    root = _scratch(spark, "log")
    log = tables.event_log(spark, folder)
    sink.append_corrections(log.filter("created_at < '2024-01-15'"), root)
    sink.append_corrections(log.filter("created_at >= '2024-01-15'"), root)
    return spark.read.parquet(f"{root}/corrections").groupBy("subject_id", "field").agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").cast("string").alias("last_at"))


@query("unit_explanations", facts._with(facts.UNITS, facts.FACTS, facts.LOG) + """
SELECT u.unit_id, coalesce(d.n, 0) AS n_dates, coalesce(d.n, 0) AS n_records, coalesce(c.n, 0) AS n_corrections,
  coalesce(c.n, 0) AS n_audit, 'Dossier ' || u.bundle_id AS folder_label
FROM u LEFT JOIN (SELECT unit_id, count(*) AS n FROM f GROUP BY 1) d USING (unit_id)
LEFT JOIN (SELECT subject_id AS unit_id, count(*) AS n FROM lg GROUP BY 1) c USING (unit_id)""")
def unit_explanations(spark, folder):
    """Everything known of every unit, nested, and summed up."""
    from ...operators import report

    units, found = tables.order_units(spark, folder), tables.item_facts(spark, folder)
    records = found.select(
        "unit_id", F.lit("4a").alias("stage"), F.col("role").alias("field"), F.col("raw").alias("value"),
        "confidence", F.lit(False).alias("derived"), F.lit("r").alias("rule"), F.lit("KEY").alias("epistemic_tag"),
        "block_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    folders = units.select("bundle_id").distinct().withColumn(
        "folder_label", F.concat(F.lit("Dossier "), F.col("bundle_id")))
    told = report.explain_units(units, found, records, tables.event_log(spark, folder),
                                tables.audit_log(spark, folder), folders)
    return told.select("unit_id", *[
        F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for c, n in (
            ("dates_found", "n_dates"), ("records", "n_records"), ("corrections", "n_corrections"),
            ("audit", "n_audit"))], "folder_label")


@query("rejoined_units", """
WITH RECURSIVE pg AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS page,
    CAST(l_quantity AS INTEGER) AS q, l_suppkey AS s FROM lineitem),
run AS (SELECT l_orderkey, page, CASE WHEN q % 4 <> 3 THEN q % 3 + 1 END AS k,
    CASE WHEN s % 3 = 0 THEN s % 5 END AS a FROM pg),
st AS (
  SELECT l_orderkey, list({'k': k, 'lk': k, 'a': a, 'la': a, 'z': page, 'pages': [page]} ORDER BY page) AS runs,
    CAST(count(*) AS BIGINT) AS i FROM run GROUP BY 1
  UNION ALL
  SELECT l_orderkey, CASE WHEN h IS NULL THEN runs ELSE list_transform(
      list_filter(range(1, len(runs) + 1), lambda j: j <> i), lambda j: CASE WHEN j <> h THEN runs[j] ELSE {
        'k': runs[j].k, 'lk': CASE WHEN runs[i].z > runs[j].z THEN runs[i].lk ELSE runs[j].lk END, 'a': runs[j].a,
        'la': CASE WHEN runs[i].z > runs[j].z THEN runs[i].la ELSE runs[j].la END, 'z': greatest(runs[i].z, runs[j].z),
        'pages': list_sort(runs[j].pages || runs[i].pages)} END) END, i - 1
  FROM (SELECT *, CASE WHEN runs[i].k > 1 THEN list_max(list_filter(range(1, i), lambda j:
      coalesce(runs[j].lk + 1 = runs[i].k, FALSE) OR coalesce(runs[j].la = runs[i].a, FALSE))) END AS h FROM st WHERE i > 1)),
un AS (SELECT 'o' || l_orderkey AS bundle_id, unnest(list_transform(runs, lambda r: r.pages)) AS pages FROM st WHERE i = 1)
SELECT 'unit_' || substr(sha256(bundle_id || ':' || list_aggregate(list_transform(pages, lambda x: x || '-' || x || '-1'),
    'string_agg', ',')), 1, 20) AS unit_id, bundle_id, CAST(pages[1] AS INTEGER) AS first_page, CAST(len(pages) AS BIGINT) AS n_pages,
  len(pages) = pages[len(pages)] - pages[1] + 1 AS contiguous FROM un""")
def rejoined_units(spark, folder):
    """Pages of an order as interrupted documents, joined again.

    Every line item is a page, in the order of line number, part and quantity.
    """
    from ...operators import units

    # An order has some lines, so its window is small.
    within = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    page = tables.table(spark, folder, "lineitem").select(
        "l_orderkey", F.row_number().over(within).alias("l_linenumber"),
        F.col("l_quantity").cast("int").alias("q"), F.col("l_suppkey").cast("int").alias("s"))
    label = F.when(F.col("q") % 4 != 3, F.struct((F.col("q") % 3 + 1).alias("k"), F.lit(3).alias("n")))
    single = page.select(
        F.lit("c").alias("case_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("bundle_id"),
        F.col("l_linenumber").alias("pdf_index"), F.col("l_linenumber").alias("group_start"),
        label.alias("label_of"), F.lit(None).cast("string").alias("serial"),
        F.when(F.col("s") % 3 == 0, (F.col("s") % 5).cast("string")).alias("author"))
    return units.unit_spans(units.rejoin(units.page_groups(single))).select(
        "unit_id", "bundle_id", "first_page", "n_pages", "contiguous")


# --- page geometry, OCR words and transcriptions --------------------------------------------


def _reading_place():
    return (F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 64 + F.col("l_quantity")


@query("body_size", """
WITH c AS (SELECT l_orderkey, l_quantity AS size, count(*) AS n, min((l_linenumber * 100000 + l_partkey) * 64 + l_quantity) AS first
  FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1""")
def body_size(spark, folder):
    """Line items as characters of a page: the size most of them have, the first seen on a tie."""
    chars = tables.table(spark, folder, "lineitem").select(
        "l_orderkey", _reading_place().alias("pos"), F.col("l_quantity").alias("size"))
    return blocks.modal_size(chars, ["l_orderkey"])


@query("line_sizes", """
WITH b AS (SELECT o_orderkey, 0.0 AS x0, 25.5 AS x1 FROM orders),
c AS (SELECT o_orderkey, l_tax AS size, count(*) AS n, min((l_linenumber * 100000 + l_partkey) * 64 + l_quantity) AS first
  FROM b JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity BETWEEN x0 AND x1 GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1)
SELECT 'o' || o_orderkey AS bundle_id, coalesce(size, 0.0) AS font_size FROM b LEFT JOIN r USING (o_orderkey)""")
def line_sizes(spark, folder):
    """Font size of a box: the modal size of the characters whose centre lies in it."""
    chars = tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("bundle_id"), F.lit(1).alias("pdf_index"),
        _reading_place().alias("pos"), F.col("l_quantity").alias("cx"),
        F.lit(5.0).alias("cy"), F.col("l_tax").alias("size"))
    boxes = tables.table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("bundle_id"), F.lit(1).alias("pdf_index"),
        F.lit(0).alias("ord"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(25.5).alias("x1"),
        F.lit(10.0).alias("y1"))
    return blocks.size_in_boxes(chars, boxes).select("bundle_id", "font_size")


WORD_ROWS = """
w0 AS (SELECT conv_id, turn, unnest(regexp_split_to_array(trim(text), '[ \\n]+')) AS word,
    generate_subscripts(regexp_split_to_array(trim(text), '[ \\n]+'), 1) - 1 AS i FROM conversations),
w AS (SELECT *, i // 5 AS line, 20 + 60 * (4 - i % 5) AS "left", 12 * (i // 5) + (i * 7) % 3 AS top,
    50 AS width, 9 + (i * 5) % 4 AS height, ((i * 37) % 101)::DOUBLE AS conf FROM w0 WHERE word <> ''),
g AS (SELECT conv_id, turn, line, string_agg(word, ' ' ORDER BY "left", i) AS text, min("left") AS "left",
    min(top) AS top, max("left" + width) AS "right", max(top + height) AS bottom, round(avg(conf) / 100, 6) AS confidence
  FROM w WHERE conf >= 30 GROUP BY 1, 2, 3)"""


def _word_rows(spark, folder):
    """Words of conversations with computed boxes, five to a printed line, set right to left."""
    text = F.trim("text")
    each = tables.table(spark, folder, "conversations").select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("bundle_id"),
        (F.col("turn") + 1).cast("int").alias("pdf_index"),
        F.posexplode(F.split(text, r"[ \n]+")).alias("i", "text")).filter("text <> ''")
    i = F.col("i")
    return each.select(
        "bundle_id", "pdf_index", F.lit(5).alias("level"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"),
        F.floor(i / 5).cast("int").alias("line_num"), i.alias("word_num"),
        (20 + 60 * (4 - i % 5)).alias("left"), (12 * F.floor(i / 5) + (i * 7) % 3).cast("int").alias("top"),
        F.lit(50).alias("width"), (9 + (i * 5) % 4).alias("height"),
        ((i * 37) % 101).cast("double").alias("conf"), "text")


@query("words_to_lines", "WITH " + WORD_ROWS + """
SELECT 'v' || conv_id AS bundle_id, CAST(turn + 1 AS INTEGER) AS pdf_index, text, "left", top, "right", bottom,
  confidence, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY top, "left", line) - 1 AS INTEGER) AS ord FROM g""")
def words_to_lines(spark, folder):
    return ocr.words_to_lines(_word_rows(spark, folder)).select(
        "bundle_id", "pdf_index", "text", "left", "top", "right", "bottom",
        F.round("confidence", 6).alias("confidence"), "ord")


@query("ocr_scaled_lines", "WITH " + WORD_ROWS + """,
h AS (SELECT conv_id, turn, list_sort(list(greatest(1.0, (bottom - top) / 3.0))) AS hs FROM g GROUP BY 1, 2)
SELECT 'v' || conv_id AS bundle_id, CAST(turn + 1 AS INTEGER) AS pdf_index, round(top / 3.0, 6) AS y0,
  round((bottom - top) / 3.0, 6) AS font_size, round(hs[len(hs) // 2 + 1], 6) AS body_size
FROM g JOIN h USING (conv_id, turn)""")
def ocr_scaled_lines(spark, folder):
    return ocr.scaled(ocr.words_to_lines(_word_rows(spark, folder))).select(
        "bundle_id", "pdf_index", F.round("y0", 6).alias("y0"), F.round("font_size", 6).alias("font_size"),
        F.round("body_size", 6).alias("body_size"))


@query("ocr_word_scan", "WITH " + WORD_ROWS + """
SELECT conv_id, turn, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS chars FROM w WHERE conf >= 30 GROUP BY 1, 2""")
def ocr_word_scan(spark, folder):
    """Word tables written as tab-separated files and read back."""
    path = _scratch(spark, "ocr")
    rows = _word_rows(spark, folder)
    page = F.substring("bundle_id", 2, 20).cast("int") * 1000 + F.col("pdf_index") - 1
    rows.select(
        "level", page.alias("page_num"), "block_num", "par_num", "line_num", "word_num", "left",
        "top", "width", "height", "conf", "text"
    ).write.csv(path, sep="\t", quote="", header=True)
    read = ocr.usable_words(ocr.read_words(spark, path))
    return read.groupBy(
        F.floor(F.col("page_num") / 1000).alias("conv_id"), (F.col("page_num") % 1000).cast("long").alias("turn")
    ).agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("text")).alias("chars"))


@query("ocr_blocks")
def ocr_blocks(spark, folder):
    """Typed blocks of the OCR tier."""
    words = _word_rows(spark, folder)
    sheets = words.select(F.lit("v").alias("case_id"), "bundle_id", "pdf_index", F.lit(792.0).alias("height")).distinct()
    return ocr.to_blocks(words, sheets).select(
        "bundle_id", "pdf_index", "ord", "block_id", "type", "text", "confidence")


@query("transcription_blocks", r"""
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations),
e AS (SELECT conv_id, turn, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ord FROM l)
SELECT 'v' || conv_id AS bundle_id, CAST(turn + 1 AS INTEGER) AS pdf_index, CAST(ord AS INTEGER) AS ord,
  'blk_' || substr(sha256('v' || conv_id || ':' || (turn + 1) || ':vision:' || ord), 1, 20) AS block_id,
  CASE WHEN ord % 4 = 3 THEN 'handwriting' WHEN ord % 4 = 0 THEN 'heading' WHEN ord % 4 = 1 THEN 'stamp' ELSE 'paragraph' END AS type,
  trim(line) AS text, round(ord * (792.0 / n), 4) AS y0, CASE WHEN ord % 4 = 3 THEN 0.35 ELSE 0.7 END::DOUBLE AS confidence
FROM e WHERE trim(line) <> ''""")
def transcription_blocks(spark, folder):
    """Turns as transcribed pages, sent as JSON; every fourth line could not be read."""
    lines = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(
        t.alias("text"), F.when(i % 4 == 0, "heading").when(i % 4 == 1, "stamp").when(i % 4 == 3, "table")
        .otherwise("scribble").alias("kind"), (i % 4 != 3).alias("legible")))
    payloads = tables.table(spark, folder, "conversations").select(
        F.lit("v").alias("case_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("bundle_id"),
        (F.col("turn") + 1).cast("int").alias("pdf_index"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
        F.to_json(F.struct(lines.alias("lines"))).alias("payload"))
    return transcription.to_blocks(payloads).select(
        "bundle_id", "pdf_index", "ord", "block_id", "type", "text", F.round("y0", 4).alias("y0"), "confidence")


@query("flipped_boxes", """
SELECT o_orderkey, CAST(692 - o_orderkey % 500 AS DOUBLE) AS y0, CAST(792 - o_orderkey % 500 AS DOUBLE) AS y1 FROM orders""")
def flipped_boxes(spark, folder):
    low = (F.col("o_orderkey") % 500).cast("double")
    return blocks.flip_origin(tables.table(spark, folder, "orders").select(
        "o_orderkey", low.alias("y0"), (low + 100).alias("y1"), F.lit(792.0).alias("page_height"))
    ).select("o_orderkey", "y0", "y1")


# --- answer keys ----------------------------------------------------------------------------


@query("answer_keys", """
SELECT l_orderkey::VARCHAR AS case_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS INTEGER) AS gold_ord,
  l_returnflag AS doc_class, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS pages,
  CAST(min(l_shipdate) AS DATE)::VARCHAR AS row_date FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def answer_keys(spark, folder):
    """Keys of all orders in the exchange format, one JSON text each, parsed and exploded."""
    from ... import schemas

    unit = tables.table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(
        F.array_sort(F.collect_set("l_linenumber")).alias("pages"),
        F.to_date(F.min("l_shipdate")).cast("string").alias("row_date"))
    key = unit.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_returnflag").alias("class"), "pages", "row_date"))).alias("units"))
    text = key.select(F.col("l_orderkey").cast("string").alias("gold"),
                      F.to_json(F.struct("units")).alias("value"))
    parsed = text.select("gold", F.from_json("value", schemas.GOLD).alias("k")).select("gold", "k.units")
    return gold.key_units(parsed).select(
        "case_id", "gold_ord", "doc_class",
        F.array_join(F.array_sort(F.transform("pages", lambda p: p.cast("string"))), ",").alias("pages"),
        text_date("row_date"))


# --- dates and form fields in written lines -------------------------------------------------

DATE_LINES = """
d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS form FROM orders),
y AS (SELECT d.*, year(day) AS yy, month(day) AS mm, day(day) AS dd FROM d)"""


@query("date_find", "WITH " + DATE_LINES + r""",
c AS (SELECT o_orderkey, form, day, dd, mm, yy % 100 AS y2, CASE WHEN dd > 31 THEN NULL ELSE dd END AS x FROM y),
r AS (
  SELECT o_orderkey, [day] AS rs FROM c WHERE form < 3
  UNION ALL
  SELECT o_orderkey, list_filter([TRY_CAST('19' || lpad(y2::VARCHAR, 2, '0') || '-' || mm || '-' || dd AS DATE),
    TRY_CAST('20' || lpad(y2::VARCHAR, 2, '0') || '-' || mm || '-' || dd AS DATE),
    TRY_CAST('19' || lpad(dd::VARCHAR, 2, '0') || '-' || mm || '-' || y2 AS DATE),
    TRY_CAST('20' || lpad(dd::VARCHAR, 2, '0') || '-' || mm || '-' || y2 AS DATE)],
    lambda v: v IS NOT NULL AND v <= DATE '2025-06-01') FROM c WHERE form = 3)
SELECT o_orderkey, CASE form WHEN 2 THEN 0 ELSE 1 END AS kind, form = 3 AS century_inferred,
  CASE WHEN form = 3 AND dd = y2 THEN len(list_distinct(rs)) ELSE len(list_distinct(rs)) END AS n_readings,
  rs[1]::VARCHAR AS first_reading FROM c JOIN r USING (o_orderkey)""")
def date_find(spark, folder):
    """Order dates written in four ways, found and read back; the last has a two-digit year."""
    day, form = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    month = F.element_at(F.array(*[F.lit(m) for m in tables.MONTH_NAMES]), F.month(day))
    text = (
        F.when(form == 0, F.concat(F.lit("Rapport du "), day.cast("string"), F.lit(" reçu")))
        .when(form == 1, F.concat(F.lit("Vu le "), F.date_format(day, "dd.MM.yyyy")))
        .when(form == 2, F.concat(F.lit("Le "), F.day(day).cast("string"), F.lit(" "), F.upper(month), F.lit(" "),
                                  F.year(day).cast("string")))
        .otherwise(F.concat(F.lit("Date d'examen: "), F.date_format(day, "yy-MM-dd")))
    )
    lines = tables.table(spark, folder, "orders").select(
        F.lit("c").alias("case_id"), F.col("o_orderkey").cast("string").alias("bundle_id"), "o_orderkey",
        F.col("o_orderkey").cast("string").alias("unit_id"),
        F.lit("b").alias("block_id"), F.lit(1).alias("pdf_index"), F.lit(0).alias("ord"), text.alias("text"),
        F.lit(1.0).alias("confidence"))
    found = dates.find_dates(lines, dates.year_anchors(lines), PACK, TODAY)
    return found.select(
        F.col("unit_id").cast("long").alias("o_orderkey"), "kind", "century_inferred",
        F.size("readings").cast("long").alias("n_readings"), F.col("readings")[0].cast("string").alias("first_reading"))


@query("role_resolution", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'R' THEN 'event'
    WHEN 'A' THEN 'exam' ELSE 'signature' END ELSE CASE l_returnflag WHEN 'R' THEN 'birth' WHEN 'A' THEN 'print' ELSE 'unknown' END END AS role
FROM lineitem""")
def role_resolution(spark, folder):
    """Cues left of a date, one nearer than the other, right of it, or none."""
    day, flag = F.to_date("l_shipdate").cast("string"), F.col("l_returnflag")
    text = F.when(F.col("l_linestatus") == "F",
        F.when(flag == "R", F.concat(F.lit("Date de l'examen ou date de l'accident: "), day))
        .when(flag == "A", F.concat(F.lit("Né le patient, examen du "), day, F.lit(" reçu le soir")))
        .otherwise(F.concat(F.lit("SIGNÉ ÉLECTRONIQUEMENT LE "), day))
    ).otherwise(
        F.when(flag == "R", F.concat(day, F.lit(" (date de naissance)")))
        .when(flag == "A", F.concat(F.lit("imprimée le "), day)).otherwise(F.concat(F.lit("Total "), day)))
    items = spread(tables.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
        "l_linestatus"))
    lines = items.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"), day.alias("day"))
    at = F.length(F.element_at(F.split("text", r"[0-9]{4}-", 2), 1))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        dates.date_role(F.col("text"), at, PACK).alias("role"))


def _form_blocks(spark, folder):
    """Orders as forms: a heading, rated rows from the line items, a ticked box."""
    key = F.col("o_orderkey")
    ident = [F.lit("c").alias("case_id"), F.concat(F.lit("o"), key.cast("string")).alias("unit_id")]
    orders, items = tables.table(spark, folder, "orders"), tables.table(spark, folder, "lineitem")

    def line(df, kind, ord_, text, level=None):
        return df.select(
            *ident, F.lit(1).alias("pdf_index"), ord_.cast("int").alias("ord"),
            F.concat_ws("-", key, ord_).alias("block_id"), F.lit(kind).alias("type"), text.alias("text"),
            F.lit(1.0).alias("confidence"), F.lit(level).cast("int").alias("level"))

    tick = F.when(key % 3 == 0, F.lit("[x] Oui [ ] Non")).when(key % 3 == 1, F.lit("[ ] Oui [x] Non")).otherwise(
        F.lit("[ ] Oui [ ] Non"))
    # An order has some lines, so its window is small; their number holds for keys of any size.
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_linestatus"))
    rated = items.withColumn("nth", nth).withColumnRenamed("l_orderkey", "o_orderkey")
    place = 100 + F.col("nth")
    row = F.concat(F.lit("Code "), F.col("l_partkey").cast("string"), F.lit(" 7  "),
                   F.col("l_quantity").cast("int").cast("string"), F.lit(" %"),
                   F.when(F.col("l_linestatus") == "F", F.lit("  1,5 % sur antérieur")).otherwise(""))
    parts = [
        line(orders, "heading", F.lit(1), F.lit("ATTEINTE PERMANENTE"), 2),
        line(orders, "checkbox", F.lit(2), tick),
        line(orders.filter("o_orderstatus <> 'F'"), "heading", F.lit(3), F.lit("AUTRE SECTION"), 2),
        line(orders, "checkbox", F.lit(4), F.lit("[x] Oui consolidation")),
        line(orders, "heading", F.lit(5), F.lit("BILAN DES SÉQUELLES"), 2),
        line(rated, "table", place, row),
        line(orders, "heading", F.lit(90000001), F.lit("FIN"), 2),
        line(orders, "table", F.lit(90000002), F.lit("Code 1 1  99 %")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _forms(spark, folder):
    units = tables.table(spark, folder, "orders").select(
        F.lit("c").alias("case_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("unit_id"),
        F.when(F.col("o_orderkey") % 5 == 0, "9999").otherwise("2064").alias("form_serial"),
        F.when(F.col("o_orderkey") % 7 == 0, "1999-01").otherwise("2012-06").alias("form_revision"))
    return units


def _form_records(spark, folder):
    return shared(spark, folder, "form_records", lambda: templates.read_forms(
        shared(spark, folder, "form_blocks", lambda: _form_blocks(spark, folder)), _forms(spark, folder), PACK))


@query("template_lookup", """
SELECT 'o' || o_orderkey AS unit_id, CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN o_orderkey % 7 = 0
  THEN 'unknown_revision' ELSE 'exact' END AS status FROM orders""")
def template_lookup(spark, folder):
    return templates.lookup(_forms(spark, folder), PACK).select("unit_id", "status")


@query("checkbox_fields", """
WITH k AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
SELECT 'o' || o_orderkey AS unit_id, 'apipp' AS field, CASE o_orderkey % 3 WHEN 0 THEN 'rated' WHEN 1 THEN 'aucune'
  ELSE 'trop_tot' END AS value, FALSE AS derived FROM k
UNION ALL SELECT 'o' || o_orderkey, 'consolidation', 'oui', FALSE FROM k
UNION ALL SELECT 'o' || o_orderkey, 'limitations_fonctionnelles', 'absent', TRUE FROM k""")
def checkbox_fields(spark, folder):
    return _form_records(spark, folder).filter(~F.col("field").rlike("^bareme")).select(
        "unit_id", "field", "value", "derived")


@query("table_rows", """
WITH k AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0),
r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS nth,
    '{"code": "' || l_partkey || ' 7", "pct": "' || CAST(l_quantity AS INTEGER) || '"' || CASE l_linestatus WHEN 'F'
      THEN ', "prior_pct": "1,5"' ELSE '' END || '}' AS value FROM k JOIN lineitem ON l_orderkey = o_orderkey)
SELECT 'o' || o_orderkey AS unit_id, 'bareme.' || nth AS field, value FROM r
UNION ALL SELECT 'o' || o_orderkey, 'bareme.expected_count', coalesce((SELECT count(*) FROM r WHERE r.o_orderkey = k.o_orderkey), 0)::VARCHAR FROM k""")
def table_rows(spark, folder):
    return _form_records(spark, folder).filter(F.col("field").rlike("^bareme")).select(
        "unit_id", "field", "value")


@query("rating_totals", """
WITH k AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
SELECT 'o' || o_orderkey AS unit_id, count(l_orderkey) AS rated_rows, CAST(count(l_orderkey) AS INTEGER) AS expected_rows,
  CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) AS total_pct, TRUE AS complete
FROM k LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def rating_totals(spark, folder):
    return templates.rating_totals(_form_records(spark, folder)).withColumn(
        "total_pct", F.col("total_pct").cast("double"))
