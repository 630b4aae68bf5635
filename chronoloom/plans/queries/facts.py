"""Queries over orders and line items as units, date facts and printed lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ... import rules
from ...functions import text as tx
from ...operators import assemble, claims, corrections, cues, dates, delta, report
from ...session import shared_folder
from ...sinks import export, fragments
from ...sources import store, tables
from .registry import query, shared, text_date

PACK = rules.load("cnesst")

# --- SQL shared by the statements below -----------------------------------------------------

UNITS = """
u AS (
  SELECT 'o'||o_orderkey AS unit_id, 'c'||o_custkey AS case_id, 'b'||(o_orderkey % 4) AS bundle_id,
    CAST(o_orderkey + 1 AS INTEGER) AS first_page,
    CASE o_orderstatus WHEN 'F' THEN 'rapport_medical' WHEN 'O' THEN 'note_consultation'
      ELSE 'rapport_imagerie' END AS doc_class,
    CASE WHEN o_orderkey % 50 = 0 THEN 'illegible' ELSE 'legible' END AS legibility,
    o_orderpriority AS author, CASE WHEN o_orderkey % 97 = 0 THEN 'rule.seven' END AS excluded_by,
    CAST(o_orderdate AS DATE) AS o_date
  FROM orders)"""

FACTS = """
f AS (
  SELECT 'o'||l_orderkey AS unit_id, l_linenumber AS pdf_index, l_partkey AS start_at,
    CAST(l_suppkey * 64 + l_quantity AS INTEGER) AS ord,
    CASE WHEN l_linenumber = 6 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'event'
      WHEN l_returnflag = 'A' THEN 'exam' ELSE 'report' END AS role,
    CAST(l_shipdate AS DATE) AS d, l_linenumber = 7 AS ambiguous, l_linenumber = 5 AS inferred
  FROM lineitem)"""

ROW_DATES = """
placed AS (
  SELECT f.*, u.doc_class, u.legibility, u.case_id,
    CASE WHEN role = 'exam' THEN CASE doc_class WHEN 'note_consultation' THEN 2 ELSE 1 END
      WHEN role = 'report' THEN CASE doc_class WHEN 'rapport_medical' THEN 4
        WHEN 'rapport_imagerie' THEN 2 ELSE 0 END ELSE 0 END AS rnk
  FROM f JOIN u USING (unit_id)),
tiered AS (
  SELECT *, CASE WHEN role IN ('exam','report') AND rnk > 0 THEN 0
    WHEN role IN ('exam','report') THEN 1 WHEN role = 'unknown' AND NOT ambiguous THEN 2 END AS tier
  FROM placed),
picked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY tier,
      CASE WHEN tier = 0 THEN rnk ELSE 0 END, pdf_index, start_at, ord) AS rn
    FROM tiered WHERE tier IS NOT NULL) WHERE rn = 1),
others AS (
  SELECT unit_id, count(*) FILTER (WHERE role NOT IN ('exam','report')) AS n_other,
    string_agg(DISTINCT role, ', ' ORDER BY role) FILTER (WHERE role NOT IN ('exam','report')) AS roles,
    count(*) FILTER (WHERE role = 'unknown' AND NOT ambiguous) AS n_unlabelled
  FROM placed GROUP BY unit_id),
rd AS (
  SELECT u.unit_id, u.case_id, u.doc_class, u.legibility, u.author, u.bundle_id, u.first_page,
    u.excluded_by,
    CASE WHEN u.legibility = 'illegible' THEN NULL ELSE p.d END AS row_date,
    CASE WHEN u.legibility = 'illegible' THEN 'illegible' WHEN p.tier IS NULL THEN 'undated'
      WHEN p.tier < 2 AND p.ambiguous THEN 'ambiguous'
      WHEN p.tier = 0 AND NOT p.inferred THEN 'resolved' ELSE 'inferred' END AS date_status,
    CASE WHEN u.legibility <> 'illegible' THEN p.role END AS date_role,
    CASE WHEN u.legibility = 'illegible'
      THEN 'Unit is illegible; no date read and no model call permitted.'
    WHEN p.tier = 0 AND p.ambiguous THEN '''' || p.d::VARCHAR || ''' has 2 plausible readings (' ||
      p.d::VARCHAR || ', ' || (p.d + 1)::VARCHAR || '); needs a human.'
    WHEN p.tier = 0 THEN 'Role ' || p.role || ' selected from ''' || p.d::VARCHAR || '''' ||
      CASE WHEN p.inferred THEN ' (century resolved against the file''s own year anchors)'
        ELSE '' END ||
      CASE WHEN o.n_other > 0 THEN '; ' || o.n_other || ' structurally ineligible date(s) present ('
        || o.roles || ').' ELSE '.' END
    WHEN p.tier = 1 THEN 'No visit/exam/signature date found for ' || u.doc_class ||
      '; used the earliest eligible date, role ' || p.role || '.'
    WHEN p.tier = 2 THEN 'No labelled date for ' || u.doc_class || '; used ''' || p.d::VARCHAR ||
      ''', the first of ' || o.n_unlabelled || ' date(s) on the unit carrying no recognised label.'
      || ' Needs a human to confirm which date this row belongs to.'
    WHEN coalesce(o.n_other, 0) = 0 THEN 'No date found anywhere in the unit.'
    ELSE 'Dates found but all structurally ineligible to be the row date (' || o.roles ||
      '); the unit needs a date from a human.' END AS date_explanation
  FROM u LEFT JOIN picked p USING (unit_id) LEFT JOIN others o USING (unit_id))"""

EVENTS = """
ev AS (SELECT DISTINCT u.case_id, f.unit_id, f.d FROM f JOIN u USING (unit_id)
  WHERE role = 'event' AND NOT ambiguous),
att AS (
  SELECT rd.unit_id, rd.case_id, coalesce(own.d, prior.d) AS claim_event,
    CASE WHEN own.d IS NOT NULL THEN 'claim_event.declared'
      WHEN c.case_id IS NULL THEN 'claim_event.none_in_file'
      WHEN rd.row_date IS NULL THEN 'claim_event.undated_unit'
      WHEN prior.d IS NULL THEN 'claim_event.precedes_all'
      ELSE 'claim_event.most_recent_prior' END AS claim_rule, own.d IS NOT NULL AS declared
  FROM rd
  LEFT JOIN (SELECT unit_id, min(d) AS d FROM ev GROUP BY 1) own USING (unit_id)
  LEFT JOIN (SELECT DISTINCT case_id FROM ev) c USING (case_id)
  LEFT JOIN (SELECT rd.unit_id, max(e.d) AS d FROM rd JOIN (SELECT DISTINCT case_id, d FROM ev) e
    ON e.case_id = rd.case_id AND e.d <= rd.row_date GROUP BY 1) prior USING (unit_id))"""

LABEL = """CASE doc_class WHEN 'rapport_medical' THEN 'Rapport médical'
  WHEN 'note_consultation' THEN 'Note de consultation' WHEN 'rapport_imagerie'
  THEN 'Rapport d''imagerie' ELSE doc_class END"""

BUCKET = """
  'row_' || substr(sha256(case_id || '|' || CASE
    WHEN excluded_by IS NOT NULL THEN '["held","' || unit_id || '"]'
    WHEN row_date IS NULL OR date_status IN ('undated','illegible') THEN '["solo","' || unit_id || '"]'
    WHEN doc_class = 'rapport_imagerie' THEN '["study","' || row_date::VARCHAR || '","' || author
      || '","' || doc_class || '"]'
    ELSE '["encounter","' || row_date::VARCHAR || '","' || author || '"]' END), 1, 20) AS row_id"""

MERGED = """
lead_unit AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY row_id ORDER BY bundle_id, first_page) AS rn FROM bk) WHERE rn = 1),
grp AS (
  SELECT row_id, count(*) AS n_units, count(DISTINCT bundle_id) AS n_bundles,
    min(first_page) AS min_page, bool_or(legibility = 'illegible') AS illegible,
    string_agg(DISTINCT {label}, ' + ' ORDER BY {label}) AS classes
  FROM bk GROUP BY 1),
rws AS (
  SELECT l.row_id, l.case_id, l.row_date, l.date_status, l.doc_class, l.author, l.excluded_by,
    g.classes || ' — ' || l.author AS title, g.n_units, g.n_bundles, g.min_page, g.illegible,
    l.doc_class = 'rapport_imagerie' AS is_study
  FROM lead_unit l JOIN grp g USING (row_id))""".format(label=LABEL)

#: Units of an encounter: cases are nations, dates are months, so that rows merge.
ENCOUNTERS = """
e AS (
  SELECT u.* EXCLUDE (case_id), 'n' || c.c_nationkey AS case_id,
    CASE WHEN o.o_orderkey % 13 = 0 OR u.legibility = 'illegible' THEN NULL
      ELSE date_trunc('month', u.o_date)::DATE END AS row_date,
    CASE WHEN u.legibility = 'illegible' THEN 'illegible' WHEN o.o_orderkey % 13 = 0 THEN 'undated'
      WHEN o.o_orderkey % 17 = 0 THEN 'ambiguous' WHEN o.o_orderkey % 19 = 0 THEN 'inferred'
      ELSE 'resolved' END AS date_status
  FROM u JOIN orders o ON u.unit_id = 'o' || o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey),
bk AS (SELECT *, {bucket} FROM e)""".format(bucket=BUCKET)

BULLETS = """
cand AS (
  SELECT bk.row_id, bk.bundle_id, bk.first_page, bk.unit_id, l_linenumber AS pdf_index,
    CAST(l_suppkey * 64 + l_quantity AS INTEGER) AS ord, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS block_id,
    l_returnflag || ' ' || l_linestatus || ' ' || CAST(l_quantity AS INTEGER) AS text,
    round(1 - l_discount * 4, 2) AS confidence
  FROM lineitem JOIN bk ON bk.unit_id = 'o' || l_orderkey),
bl AS (
  SELECT row_id, text, block_id, bundle_id, first_page, pdf_index, ord, least_conf AS confidence,
    copies FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, lower(text)
        ORDER BY bundle_id, first_page, pdf_index, ord, block_id) AS rn,
      min(confidence) OVER (PARTITION BY row_id, lower(text)) AS least_conf,
      count(*) OVER (PARTITION BY row_id, lower(text)) AS copies FROM cand) WHERE rn = 1)"""

CONFIDENT = """
rc AS (
  SELECT rws.*, coalesce(b.least, 1.0) * CASE date_status WHEN 'resolved' THEN 1.0
      WHEN 'manual' THEN 1.0 WHEN 'inferred' THEN 0.9 WHEN 'ambiguous' THEN 0.7
      WHEN 'undated' THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, coalesce(b.n, 0) AS n_bullets
  FROM rws LEFT JOIN (SELECT row_id, min(confidence) AS least, count(*) AS n FROM bl GROUP BY 1) b
    USING (row_id))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


# --- building blocks ------------------------------------------------------------------------


def units(spark, folder) -> DataFrame:
    return tables.order_units(spark, folder)


def dated_units(spark, folder) -> DataFrame:
    base = units(spark, folder)
    facts = tables.item_facts(spark, folder)
    chosen = dates.select_row_dates(facts, base, PACK)
    return base.join(chosen, "unit_id")


def encounter_units(spark, folder) -> DataFrame:
    base = units(spark, folder).drop("case_id")
    owner = tables.table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("unit_id"), "o_orderkey",
        F.col("o_custkey").alias("c_custkey")
    ).join(tables.table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    key, dark = F.col("o_orderkey"), F.col("legibility") == "illegible"
    return base.join(owner, "unit_id").select(
        *base.columns, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("case_id"),
        F.when(~dark & (key % 13 != 0), F.trunc("o_date", "month")).alias("row_date"),
        F.when(dark, "illegible").when(key % 13 == 0, "undated").when(key % 17 == 0, "ambiguous")
        .when(key % 19 == 0, "inferred").otherwise("resolved").alias("date_status"),
        F.lit(None).cast("string").alias("date_role"), F.lit("").alias("date_explanation"),
        F.array().cast("array<date>").alias("date_alternatives"))


def encounters(spark, folder) -> DataFrame:
    return shared(spark, folder, "encounters",
                  lambda: assemble.bucket(encounter_units(spark, folder), PACK))


def encounter_rows(spark, folder) -> DataFrame:
    return shared(spark, folder, "encounter_rows",
                  lambda: assemble.build_rows(encounters(spark, folder), PACK))


def encounter_bullets(spark, folder) -> DataFrame:
    return shared(spark, folder, "encounter_bullets", lambda: assemble.union_bullets(
        tables.item_bullets(spark, folder, encounters(spark, folder))))


def confident_rows(spark, folder) -> DataFrame:
    return shared(spark, folder, "confident_rows", lambda: assemble.with_confidence(
        encounter_rows(spark, folder), encounter_bullets(spark, folder)))


def no_labels(spark, folder) -> DataFrame:
    """Printed labels: even first pages carry their number plus one hundred."""
    return encounters(spark, folder).select(
        "bundle_id", F.col("first_page").alias("pdf_index"),
        F.when(F.col("first_page") % 2 == 0, (F.col("first_page") + 100).cast("string"))
        .alias("printed_label"))


# --- dates and claims -----------------------------------------------------------------------


@query("row_date_selection", _with(UNITS, FACTS, ROW_DATES) + """
SELECT unit_id, row_date::VARCHAR AS row_date, date_status, date_role, date_explanation FROM rd""")
def row_date_selection(spark, folder):
    return dates.select_row_dates(
        tables.item_facts(spark, folder), units(spark, folder), PACK
    ).select("unit_id", text_date("row_date"), "date_status", "date_role", "date_explanation")


@query("claim_events", _with(UNITS, FACTS) + """
SELECT u.case_id, f.d::VARCHAR AS event, count(DISTINCT f.unit_id) AS declared_by
FROM f JOIN u USING (unit_id) WHERE role = 'event' AND NOT ambiguous GROUP BY 1, 2""")
def claim_events(spark, folder):
    return claims.case_events(tables.item_facts(spark, folder)).select(
        "case_id", text_date("event"), "declared_by")


@query("claim_attribution", _with(UNITS, FACTS, ROW_DATES, EVENTS) + """
SELECT case_id, unit_id, claim_event::VARCHAR AS claim_event, claim_rule, declared FROM att""")
def claim_attribution(spark, folder):
    dated = shared(spark, folder, "dated_units", lambda: dated_units(spark, folder))
    return claims.attribute(dated, tables.item_facts(spark, folder)).select(
        "case_id", "unit_id", text_date("claim_event"), "claim_rule", "declared")


# --- rows -----------------------------------------------------------------------------------


@query("chronology", _with(UNITS, FACTS, ROW_DATES, EVENTS, f"""
bk AS (SELECT *, {BUCKET} FROM rd)""", MERGED, """
ce AS (
  SELECT bk.row_id, min(att.claim_event) AS e0, max(att.claim_event) AS e1,
    arg_min(att.claim_rule, bk.bundle_id || lpad(bk.first_page::VARCHAR, 12, '0'))
      FILTER (WHERE att.claim_event IS NOT NULL) AS r_event,
    arg_min(att.claim_rule, bk.bundle_id || lpad(bk.first_page::VARCHAR, 12, '0')) AS r_any
  FROM bk JOIN att USING (unit_id) GROUP BY 1)""") + """
SELECT row_id, case_id, row_date::VARCHAR AS row_date, date_status, title, author, doc_class,
  n_units, n_bundles, min_page, illegible, excluded_by,
  CASE WHEN e0 = e1 THEN e0::VARCHAR END AS claim_event,
  CASE WHEN e0 = e1 THEN r_event WHEN e0 IS NOT NULL THEN 'claim_event.units_disagree'
    ELSE r_any END AS claim_rule
FROM rws JOIN ce USING (row_id)""")
def chronology(spark, folder):
    """Units and date facts to merged rows, undated first."""
    dated = shared(spark, folder, "dated_units", lambda: dated_units(spark, folder))
    events = claims.attribute(dated, tables.item_facts(spark, folder))
    rows = assemble.build_rows(assemble.bucket(dated, PACK), PACK, events)
    return rows.orderBy(*assemble.row_order()).select(
        "row_id", "case_id", text_date("row_date"), "date_status", "title", "author", "doc_class",
        "n_units", "n_bundles", "min_page", "illegible", "excluded_by", text_date("claim_event"),
        "claim_rule")


@query("encounter_merge", _with(UNITS, ENCOUNTERS, MERGED) + """
SELECT row_id, case_id, row_date::VARCHAR AS row_date, date_status, title, n_units, n_bundles,
  min_page, illegible, excluded_by FROM rws""")
def encounter_merge(spark, folder):
    return encounter_rows(spark, folder).select(
        "row_id", "case_id", text_date("row_date"), "date_status", "title", "n_units", "n_bundles",
        "min_page", "illegible", "excluded_by")


@query("bullet_union", _with(UNITS, ENCOUNTERS, BULLETS) + """
SELECT row_id, text, block_id, confidence, copies FROM bl""")
def bullet_union(spark, folder):
    return encounter_bullets(spark, folder).select(
        "row_id", "text", "block_id", "confidence", "copies")


@query("bullet_positions", _with(UNITS, ENCOUNTERS, BULLETS) + """
SELECT row_id, text, row_number() OVER (PARTITION BY row_id
  ORDER BY bundle_id, first_page, pdf_index, ord, block_id) - 1 AS pos FROM bl""")
def bullet_positions(spark, folder):
    return assemble.number_bullets(encounter_bullets(spark, folder)).select("row_id", "text", "pos")


@query("row_confidence", _with(UNITS, ENCOUNTERS, MERGED, BULLETS, CONFIDENT) + """
SELECT row_id, round(confidence, 6) AS confidence, confidence <= 0.75 AS warns, n_bullets FROM rc""")
def row_confidence(spark, folder):
    return confident_rows(spark, folder).select(
        "row_id", F.round("confidence", 6).alias("confidence"), "warns", "n_bullets")


@query("merge_metrics", _with(UNITS, ENCOUNTERS, MERGED) + """
SELECT case_id, count(*) AS "rows",
  count(*) FILTER (WHERE excluded_by IS NULL AND n_units > 1) AS merged_encounters,
  count(*) FILTER (WHERE excluded_by IS NULL AND is_study) AS split_studies,
  count(*) FILTER (WHERE excluded_by IS NULL AND n_bundles > 1) AS cross_bundle_unions,
  CAST(coalesce(sum(n_units) FILTER (WHERE excluded_by IS NOT NULL), 0) AS BIGINT) AS excluded_units,
  count(*) FILTER (WHERE row_date IS NULL) AS undated
FROM rws GROUP BY 1""")
def merge_metrics(spark, folder):
    return assemble.metrics(encounter_rows(spark, folder))


@query("row_locators", _with(UNITS, ENCOUNTERS) + """
SELECT row_id, unit_id, bundle_id, first_page,
  CASE WHEN first_page % 2 = 0 THEN (first_page + 100)::VARCHAR ELSE first_page::VARCHAR END
    AS display_page, first_page % 2 <> 0 AS flagged,
  'Dossier ' || bundle_id || chr(10) || 'p. ' || CASE WHEN first_page % 2 = 0
    THEN (first_page + 100)::VARCHAR ELSE first_page::VARCHAR || ' [pdf]' END AS locator
FROM bk""")
def row_locators(spark, folder):
    places = assemble.locators(encounters(spark, folder), no_labels(spark, folder))
    folders = places.select("bundle_id").distinct().withColumn(
        "folder_label", F.concat(F.lit("Dossier "), F.col("bundle_id")))
    return report.display_locators(places, folders, PACK).select(
        "row_id", "unit_id", "bundle_id", "first_page", "display_page", "flagged", "locator")


@query("review_queue", _with(UNITS, ENCOUNTERS, MERGED, BULLETS, CONFIDENT, """
fl AS (SELECT row_id, bool_or(first_page % 2 <> 0) AS flagged FROM bk GROUP BY 1)""") + """
SELECT row_id, date_status, round(confidence, 6) AS confidence, flagged,
  CASE WHEN date_status IN ('undated','illegible') THEN 0 WHEN date_status = 'ambiguous' THEN 1
    WHEN confidence <= 0.75 OR flagged THEN 2 ELSE 3 END AS rank
FROM rc JOIN fl USING (row_id)""")
def review_queue(spark, folder):
    places = assemble.locators(encounters(spark, folder), no_labels(spark, folder))
    return report.review_queue(confident_rows(spark, folder), places).orderBy(
        "rank", "confidence", *assemble.row_order()).select(
        "row_id", "date_status", F.round("confidence", 6).alias("confidence"), "flagged", "rank")


@query("row_display", _with(UNITS, ENCOUNTERS, MERGED, BULLETS, CONFIDENT) + """
SELECT row_id, CASE WHEN row_date IS NULL THEN '—' WHEN date_status = 'ambiguous'
    THEN row_date::VARCHAR || ' (?)' ELSE row_date::VARCHAR END AS date_cell,
  CASE doc_class WHEN 'rapport_medical' THEN '[RM] ' WHEN 'note_consultation' THEN '[CONS] '
    ELSE '[IMG] ' END || title AS title_cell,
  CASE WHEN illegible THEN 'Illisible — no text' END AS illegible_cell
FROM rc""")
def row_display(spark, folder):
    return report.display_rows(confident_rows(spark, folder), PACK, show_code=True).select(
        "row_id", "date_cell", "title_cell", "illegible_cell")


@query("removal_manifest", _with(UNITS, ENCOUNTERS, MERGED) + """
SELECT case_id, row_id, coalesce(row_date::VARCHAR, '—') AS date, title, excluded_by
FROM rws WHERE excluded_by IS NOT NULL""")
def removal_manifest(spark, folder):
    return export.removal_manifest(encounter_rows(spark, folder))


@query("release_gate", _with(UNITS, ENCOUNTERS, MERGED) + """
SELECT case_id, count(*) AS "rows", CAST(0 AS BIGINT) AS uncited, CAST(0 AS BIGINT) AS unlocated_rows,
  CAST(1.0 AS DOUBLE) AS coverage, any_value(pages) AS pages_total, any_value(pages) AS pages_covered,
  count(*) FILTER (WHERE flagged) AS rows_without_printed_label, TRUE AS passes
FROM rws JOIN (SELECT row_id, bool_or(first_page % 2 <> 0) AS flagged FROM bk GROUP BY 1)
  USING (row_id)
JOIN (SELECT case_id, count(*) AS pages FROM bk GROUP BY 1) USING (case_id) GROUP BY 1""")
def release_gate(spark, folder):
    bucketed = encounters(spark, folder)
    pages = bucketed.select("case_id", "bundle_id", F.col("first_page").alias("pdf_index"))
    bundles = bucketed.groupBy("case_id", "bundle_id").agg(F.sum("n_pages").alias("page_count"))
    return report.release_gate(
        encounter_rows(spark, folder), assemble.locators(bucketed, no_labels(spark, folder)),
        encounter_bullets(spark, folder), pages, bundles)


@query("plan_summary", _with(UNITS, ENCOUNTERS, """
n AS (SELECT case_id, count(*) AS units, count(DISTINCT bundle_id) AS bundles,
  count(*) FILTER (WHERE date_status = 'undated') AS undated,
  count(*) FILTER (WHERE date_status = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE legibility = 'illegible') AS illegible,
  count(*) FILTER (WHERE excluded_by IS NOT NULL) AS excluded_by_rule FROM e GROUP BY 1)""") + """
SELECT case_id, units, bundles, undated, ambiguous, illegible, excluded_by_rule,
  units || ' report units across ' || bundles || ' bundles · regime CNESST' ||
  CASE WHEN undated + ambiguous + illegible > 0 THEN ' · ' ELSE '' END ||
  concat_ws(', ', CASE WHEN undated > 0 THEN undated || ' undated' END,
    CASE WHEN ambiguous > 0 THEN ambiguous || ' ambiguous' END,
    CASE WHEN illegible > 0 THEN illegible || ' illegible' END) ||
  CASE WHEN excluded_by_rule > 0 THEN ' · ' || excluded_by_rule || ' excluded by rule or toggle'
    ELSE '' END || ' · est. ' || CAST(round_even(units * 0.4, 0) AS INTEGER) || ' s' AS summary
FROM n""")
def plan_summary(spark, folder):
    bucketed = encounters(spark, folder)
    bundles = bucketed.groupBy("case_id", "bundle_id").agg(F.sum("n_pages").alias("page_count"))
    return report.plan_summary(bucketed, bundles, PACK).select(
        "case_id", "units", "bundles", "undated", "ambiguous", "illegible", "excluded_by_rule",
        "summary")


@query("units_by_class", _with(UNITS, ENCOUNTERS) + f"""
SELECT case_id, {LABEL} AS label, count(*) AS n FROM e GROUP BY 1, 2""")
def units_by_class(spark, folder):
    return report.units_by_class(encounters(spark, folder), PACK)


@query("unit_listing", _with(UNITS, FACTS, ROW_DATES) + """
SELECT case_id, unit_id, doc_class, legibility, row_date::VARCHAR AS row_date, date_status,
  excluded_by FROM rd""")
def unit_listing(spark, folder):
    from ...operators.units import listing

    dated = shared(spark, folder, "dated_units", lambda: dated_units(spark, folder))
    return listing(dated.withColumn("form_revision", F.lit(None).cast("string"))).select(
        "case_id", "unit_id", "doc_class", "legibility", text_date("row_date"), "date_status",
        "excluded_by")


@query("unit_tally", _with(UNITS, ENCOUNTERS) + """
SELECT bundle_id, count(*) AS units, count(*) FILTER (WHERE date_status = 'undated') AS undated,
  count(*) FILTER (WHERE date_status = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE legibility = 'illegible') AS illegible,
  count(*) FILTER (WHERE excluded_by IS NOT NULL) AS excluded,
  CAST(0 AS BIGINT) AS off_regime FROM e GROUP BY 1""")
def unit_tally(spark, folder):
    from ...operators.units import tally

    run = F.array(F.struct(F.col("first_page").alias("first"), F.col("first_page").alias("last"),
                           F.col("n_pages").alias("n")))
    ready = encounters(spark, folder).withColumns({
        "spans": run, "needs_fallback": F.lit(False), "regime_source": F.lit("case_default"),
        "filters_unavailable": F.array().cast("array<string>")})
    return tally(ready).select(
        "bundle_id", "units", "undated", "ambiguous", "illegible", "excluded", "off_regime")


# --- change tracking ------------------------------------------------------------------------

NEW_BUNDLE = "b3"


#: Where a line stands in its row; lines of items are all of one kind and no field's.
_LINE_PLACE = ["bundle_id", "first_page", "pdf_index", "ord", "block_id"]


def _run_lines(spark, folder) -> DataFrame:
    """(row_id, before, after): each line of a row with its first place in either run.

    The runs differ by whole bundles only, so both are read off the same lines in one pass.
    """
    def folded():
        lines = tables.item_bullets(spark, folder, encounters(spark, folder))
        place = F.struct(*_LINE_PLACE, "text")
        return lines.groupBy("row_id", tx.fold(F.col("text")).alias("line")).agg(
            F.min(F.when(F.col("bundle_id") != NEW_BUNDLE, place)).alias("before"),
            F.min(place).alias("after")).drop("line")

    return shared(spark, folder, "run_lines", folded)


def _run(spark, folder, tag: str, bundles) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, numbered bullets, locators) of a run over some bundles."""
    placed = encounters(spark, folder).filter(bundles)
    rows = shared(spark, folder, f"run_rows_{tag}", lambda: assemble.build_rows(placed, PACK))
    lines = _run_lines(spark, folder).filter(F.col(tag).isNotNull()).select("row_id", f"{tag}.*")
    bullets = shared(spark, folder, f"run_bullets_{tag}", lambda: assemble.number_bullets(
        lines, _LINE_PLACE).select("row_id", "pos", "text"))
    return rows, bullets, placed.select("row_id", "bundle_id", "unit_id")


def _changes(spark, folder) -> DataFrame:
    """A bundle arrived after the approved run."""
    before = _run(spark, folder, "before", F.col("bundle_id") != NEW_BUNDLE)
    after = _run(spark, folder, "after", F.lit(True))
    return shared(spark, folder, "run_changes", lambda: delta.compare(
        before[0], after[0], before[1], after[1], before[2], after[2]))


def _run_sql(tag: str, where: str) -> str:
    return f"""
bk_{tag} AS (SELECT * FROM bk WHERE {where}),
ld_{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY row_id ORDER BY bundle_id, first_page) AS rn FROM bk_{tag}) WHERE rn = 1),
g_{tag} AS (SELECT row_id, string_agg(DISTINCT {LABEL}, ' + ' ORDER BY {LABEL}) AS classes,
  list_sort(list(DISTINCT bundle_id)) AS bundles FROM bk_{tag} GROUP BY 1),
b_{tag} AS (SELECT row_id, string_agg(text, '|' ORDER BY bundle_id, first_page, pdf_index, ord,
  block_id) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY row_id, lower(text)
    ORDER BY bundle_id, first_page, pdf_index, ord, block_id) AS rn
  FROM cand WHERE {where}) WHERE rn = 1 GROUP BY 1),
r_{tag} AS (SELECT l.row_id, l.case_id, l.row_date, g.classes || ' — ' || l.author AS title,
  g.bundles, coalesce(b.texts, '') AS texts FROM ld_{tag} l JOIN g_{tag} g USING (row_id)
  LEFT JOIN b_{tag} b USING (row_id))"""


CHANGES = _with(
    UNITS, ENCOUNTERS, BULLETS, _run_sql("a", "bundle_id <> 'b3'"), _run_sql("z", "TRUE"), """
chg AS (
  SELECT coalesce(z.case_id, a.case_id) AS case_id, coalesce(z.row_id, a.row_id) AS row_id,
    coalesce(z.title, a.title) AS title,
    CASE WHEN a.row_id IS NULL THEN 'new' WHEN z.row_id IS NULL THEN 'dropped'
      WHEN a.title = z.title AND a.texts = z.texts AND a.row_date IS NOT DISTINCT FROM z.row_date
        THEN CASE WHEN len(list_filter(z.bundles, lambda x: NOT list_contains(a.bundles, x))) > 0
          THEN 'gained_locator' ELSE 'unchanged' END
      WHEN a.row_date IS DISTINCT FROM z.row_date THEN 'date_changed'
      ELSE 'content_changed' END AS change,
    CASE WHEN a.row_id IS NULL OR z.row_id IS NULL THEN 0
      ELSE len(list_filter(z.bundles, lambda x: NOT list_contains(a.bundles, x))) END AS added_locators
  FROM r_a a FULL JOIN r_z z ON a.row_id = z.row_id)""")


@query("run_delta", CHANGES + """
SELECT case_id, row_id, change, title, CAST(added_locators AS BIGINT) AS added_locators,
  change <> 'unchanged' AS needs_review FROM chg""")
def run_delta(spark, folder):
    return _changes(spark, folder).select(
        "case_id", "row_id", "change", "title", "added_locators", "needs_review")


@query("delta_summary", CHANGES + """
SELECT case_id, count(*) FILTER (WHERE change = 'new') AS new,
  count(*) FILTER (WHERE change = 'gained_locator') AS gained_locator,
  count(*) FILTER (WHERE change = 'content_changed') AS content_changed,
  count(*) FILTER (WHERE change = 'date_changed') AS date_changed,
  count(*) FILTER (WHERE change = 'dropped') AS dropped,
  count(*) FILTER (WHERE change = 'unchanged') AS unchanged,
  count(*) FILTER (WHERE change <> 'unchanged') AS review_count FROM chg GROUP BY 1""")
def delta_summary(spark, folder):
    return delta.summary(_changes(spark, folder)).drop("summary")


@query("redated_rows", _with(UNITS, ENCOUNTERS, f"""
m AS (SELECT * EXCLUDE (row_date, row_id), CASE WHEN row_date IS NULL THEN NULL
    WHEN doc_class = 'rapport_medical' THEN row_date + 1 ELSE row_date END AS row_date FROM bk),
mk AS (SELECT *, {BUCKET} FROM m)""") + """
SELECT bk.row_id AS old_row, mk.row_id AS new_row, count(*) AS shared_units
FROM bk JOIN mk USING (unit_id)
WHERE bk.row_id NOT IN (SELECT row_id FROM mk) AND mk.row_id NOT IN (SELECT row_id FROM bk)
GROUP BY 1, 2""")
def redated_rows(spark, folder):
    """Encounters whose units moved to another date between two runs."""
    before = encounters(spark, folder)
    moved = encounter_units(spark, folder).withColumn("row_date", F.when(
        F.col("doc_class") == "rapport_medical", F.date_add("row_date", 1)).otherwise(F.col("row_date")))
    after = shared(spark, folder, "moved_units", lambda: assemble.bucket(moved, PACK))
    old, new = before.select("row_id").distinct(), after.select("row_id").distinct()
    changes = old.join(new, "row_id", "left_anti").withColumn("change", F.lit("dropped")).unionByName(
        new.join(old, "row_id", "left_anti").withColumn("change", F.lit("new")))
    return delta.redated(changes, before.select("row_id", "unit_id"), after.select("row_id", "unit_id"))


# --- corrections and logs -------------------------------------------------------------------

LOG = """
lg AS (
  SELECT lpad(event_id::VARCHAR, 12, '0') AS correction_id, 'o' || user_id AS subject_id,
    CASE event_type WHEN 'click' THEN 'doc_class' WHEN 'view' THEN 'regime'
      WHEN 'purchase' THEN 'row_date' ELSE event_type END AS field,
    CASE event_type WHEN 'click' THEN 'class_' || CAST(floor(value) AS INTEGER)
      WHEN 'view' THEN CASE WHEN value > 20 THEN 'saaq' ELSE 'ivac' END
      WHEN 'purchase' THEN CASE WHEN value <= 40
        THEN (DATE '2020-01-01' + CAST(floor(value) AS INTEGER))::VARCHAR END END AS new_value,
    'user' || (event_id % 7) AS actor, ts AS created_at FROM events),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, field
  ORDER BY created_at DESC, correction_id DESC) AS rn FROM lg) WHERE rn = 1)"""


@query("latest_correction", _with(LOG) + """
SELECT subject_id, field, correction_id, new_value, actor FROM lt""")
def latest_correction(spark, folder):
    return corrections.latest(tables.event_log(spark, folder)).select(
        "subject_id", "field", "correction_id", "new_value", "actor")


@query("corrections_overlay", _with(UNITS, FACTS, ROW_DATES, LOG, """
fx AS (SELECT subject_id AS unit_id,
  max(new_value) FILTER (WHERE field = 'doc_class') AS c, bool_or(field = 'doc_class') AS has_c,
  max(new_value) FILTER (WHERE field = 'regime') AS r, bool_or(field = 'regime') AS has_r,
  max(new_value) FILTER (WHERE field = 'row_date') AS d, bool_or(field = 'row_date') AS has_d,
  max(actor) FILTER (WHERE field = 'row_date') AS who FROM lt GROUP BY 1)""") + """
SELECT unit_id, CASE WHEN has_c THEN c ELSE doc_class END AS doc_class,
  CASE WHEN has_c THEN 'manual' ELSE 'zones' END AS class_source,
  CASE WHEN has_r THEN r ELSE 'cnesst' END AS regime,
  CASE WHEN has_d THEN d ELSE row_date::VARCHAR END AS row_date,
  CASE WHEN has_d THEN 'manual' ELSE date_status END AS date_status,
  CASE WHEN has_d THEN 'Set by ' || who || '.' ELSE date_explanation END AS date_explanation
FROM rd LEFT JOIN fx USING (unit_id)""")
def corrections_overlay(spark, folder):
    dated = shared(spark, folder, "dated_units", lambda: dated_units(spark, folder))
    return corrections.apply_to_units(dated, tables.event_log(spark, folder)).select(
        "unit_id", "doc_class", "class_source", "regime", text_date("row_date"), "date_status",
        "date_explanation")


@query("stage_progress", """
SELECT 'run' || (user_id % 5) AS run_id, CASE event_type WHEN 'view' THEN 'parse'
    WHEN 'click' THEN 'manifest' WHEN 'purchase' THEN 'extract' ELSE 'assemble' END AS stage,
  count(*) FILTER (WHERE event_type <> 'error' AND value < 10) AS queued,
  count(*) FILTER (WHERE event_type <> 'error' AND value >= 10) AS done,
  count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1, 2""")
def stage_progress(spark, folder):
    kind = F.col("event_type")
    jobs = tables.table(spark, folder, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("run_id"),
        F.when(kind == "view", "parse").when(kind == "click", "manifest")
        .when(kind == "purchase", "extract").otherwise("assemble").alias("stage"),
        F.when(kind == "error", "failed").when(F.col("value") < 10, "queued").otherwise("done")
        .alias("status"))
    return report.stage_progress(jobs, ["queued", "done", "failed"])


@query("audit_tail", """
SELECT run_id, audit_id, subject_id FROM (
  SELECT 'run' || (user_id % 5) AS run_id, lpad(event_id::VARCHAR, 12, '0') AS audit_id,
    'o' || user_id AS subject_id, row_number() OVER (PARTITION BY user_id % 5
      ORDER BY ts, lpad(event_id::VARCHAR, 12, '0')) AS nth FROM events) WHERE nth <= 500""")
def audit_tail(spark, folder):
    """The first five hundred entries of every run's log: the limit is the report."""
    return store.audit_of_runs(tables.audit_log(spark, folder)).select(
        "run_id", "audit_id", "subject_id")


@query("audit_by_subject", """
SELECT 'o' || user_id AS subject_id, count(*) AS entries, min(ts)::VARCHAR AS first_ts,
  count(*) FILTER (WHERE event_type = 'purchase') AS extractions FROM events GROUP BY 1""")
def audit_by_subject(spark, folder):
    return tables.audit_log(spark, folder).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min("ts").cast("string").alias("first_ts"),
        F.count_if(F.col("action") == "extract").alias("extractions"))


@query("case_state", _with(UNITS, ENCOUNTERS) + """
SELECT n.case_id, n.case_id AS name, 'cnesst' AS primary_pack, n.bundles, CAST(n.units AS BIGINT) AS pages, n.units,
  coalesce(l.blocks, 0) AS blocks, coalesce(c.corrections, 0) AS corrections, coalesce(c.runs, 0) AS runs, r."rows"
FROM (SELECT case_id, count(DISTINCT bundle_id) AS bundles, count(*) AS units FROM bk GROUP BY 1) n
LEFT JOIN (SELECT bk.case_id, count(*) AS blocks FROM lineitem JOIN bk
  ON bk.unit_id = 'o' || l_orderkey GROUP BY 1) l USING (case_id)
LEFT JOIN (SELECT bk.case_id, count(*) AS corrections, count(DISTINCT user_id % 5) AS runs FROM events JOIN bk
  ON bk.unit_id = 'o' || user_id GROUP BY 1) c USING (case_id)
JOIN (SELECT case_id, count(DISTINCT row_id) AS "rows" FROM bk GROUP BY 1) r USING (case_id)""")
def case_state(spark, folder):
    """What is held for each case: bundles, blocks, units, corrections of them, runs, rows."""
    bucketed = encounters(spark, folder)
    cases = bucketed.select("case_id").distinct().withColumns({
        "name": F.col("case_id"), "primary_pack": F.lit("cnesst")})
    bundles = bucketed.groupBy("case_id", "bundle_id").agg(F.sum("n_pages").alias("page_count"))
    home = bucketed.select("unit_id", "case_id")
    blocks = tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit_id")).join(home, "unit_id")
    fixes = tables.event_log(spark, folder).select(F.col("subject_id").alias("unit_id")).join(home, "unit_id")
    runs = tables.audit_log(spark, folder).select(F.col("subject_id").alias("unit_id"), "run_id").join(
        home, "unit_id").select("case_id", "run_id").distinct()
    return report.case_state(
        cases, bundles, blocks, bucketed, fixes, runs, encounter_rows(spark, folder))


# --- exports --------------------------------------------------------------------------------


def _export_parts(spark, folder):
    """Rows with confidence, numbered locators with folder names, numbered bullets."""
    from ...functions.ordered import running

    bullets = shared(spark, folder, "numbered_bullets", lambda: assemble.number_bullets(
        encounter_bullets(spark, folder)))
    places = shared(spark, folder, "numbered_locators", lambda: running(
        assemble.locators(encounters(spark, folder), no_labels(spark, folder)), ["row_id"],
        ["bundle_id", "first_page", "unit_id"], sums={"pos": F.lit(1)}
    ).withColumn("pos", F.col("pos") - 1))
    folders = places.select("bundle_id").distinct().withColumn(
        "folder_label", F.concat(F.lit("Dossier "), F.col("bundle_id")))
    return confident_rows(spark, folder), report.display_locators(places, folders, PACK), bullets


@query("json_export", _with(UNITS, ENCOUNTERS, MERGED, BULLETS, CONFIDENT) + """
SELECT row_id AS id, row_date::VARCHAR AS date, title, round(confidence, 4) AS confidence,
  n_units AS n_locators, n_bullets,
  coalesce((SELECT string_agg(text, '|' ORDER BY bundle_id, first_page, pdf_index, ord, block_id)
    FROM bl WHERE bl.row_id = rc.row_id), '') AS texts
FROM rc""")
def json_export(spark, folder):
    """The nested JSON objects, read back from their JSON text and summed up per row."""
    nested = export.json_rows(*_export_parts(spark, folder))
    read = nested.select(F.from_json(F.to_json(F.struct(*nested.columns)), (
        "id string, date string, title string, confidence double,"
        " locators array<struct<unit_id:string>>, bullets array<struct<text:string>>")).alias("r"))
    texts = F.array_join(F.transform("r.bullets", lambda b: b["text"]), "|")
    return read.select(
        "r.id", "r.date", "r.title", "r.confidence",
        F.coalesce(F.size("r.locators"), F.lit(0)).cast("long").alias("n_locators"),
        F.coalesce(F.size("r.bullets"), F.lit(0)).cast("long").alias("n_bullets"),
        F.coalesce(texts, F.lit("")).alias("texts"))


MARKDOWN = _with(UNITS, ENCOUNTERS, MERGED, BULLETS, CONFIDENT, """
loc AS (SELECT row_id, string_agg('Dossier ' || bundle_id || '<br>p. ' ||
    CASE WHEN first_page % 2 = 0 THEN (first_page + 100)::VARCHAR ELSE first_page || ' [pdf]' END,
    ' ; ' ORDER BY bundle_id, first_page) AS places FROM bk GROUP BY 1),
lin AS (SELECT row_id, string_agg('• ' || text, '<br>' ORDER BY bundle_id, first_page, pdf_index,
    ord, block_id) AS body FROM bl GROUP BY 1),
md AS (SELECT case_id, row_id, 2 AS section, '| ' || CASE WHEN row_date IS NULL THEN '—'
    WHEN date_status = 'ambiguous' THEN row_date::VARCHAR || ' (?)' ELSE row_date::VARCHAR END ||
  ' | ' || places || ' | ' || concat_ws('<br>', '**' || title || '**',
    CASE WHEN illegible THEN 'Illisible — no text' END, body,
    CASE WHEN confidence <= 0.75 THEN '⚠ confiance ' || printf('%.2f', round(confidence + 1e-9, 2)) END)
  || ' |' AS line
FROM rc JOIN loc USING (row_id) LEFT JOIN lin USING (row_id) WHERE excluded_by IS NULL
UNION ALL
SELECT case_id, row_id, 4, '| ' || coalesce(row_date::VARCHAR, '—') || ' | ' || title || ' | `' ||
  excluded_by || '` |' FROM rc WHERE excluded_by IS NOT NULL)""")


@query("markdown_export", MARKDOWN + """
SELECT case_id, section, line FROM md
UNION ALL
SELECT case_id, 0, '**SANS DATE — ' || count(*) || ' documents à dater**' FROM rc
WHERE excluded_by IS NULL AND row_date IS NULL GROUP BY 1
UNION ALL
SELECT case_id, 3, '**RETIRÉ PAR RÈGLE — ' || count(*) || ' document(s), conservés au dossier**'
FROM rc WHERE excluded_by IS NOT NULL GROUP BY 1""")
def markdown_export(spark, folder):
    """The printed tables; fixed head lines are left out of the comparison."""
    rows, places, bullets = _export_parts(spark, folder)
    lines = export.markdown_lines(report.display_rows(rows, PACK), places, bullets, PACK)
    fixed = (F.col("section") == 1) | (
        F.col("section").isin(0, 3) & ~F.startswith("line", F.lit("**")))
    return lines.filter(~fixed).select("case_id", "section", "line")


_HEADS = [c["header"] for c in PACK.output.get("columns", [])] or ["Date", "Document", "Contenu"]


@query("markdown_files", MARKDOWN + f"""
, fixed AS (
  SELECT case_id, count(*) FILTER (WHERE excluded_by IS NULL AND row_date IS NULL) AS undated,
    count(*) FILTER (WHERE excluded_by IS NOT NULL) AS held FROM rc GROUP BY 1),
every AS (
  SELECT case_id, 0 AS section, NULL::VARCHAR AS row_id, unnest(['**SANS DATE — ' || undated || ' documents à dater**', '']) AS line,
    generate_subscripts([1, 2], 1) AS part FROM fixed WHERE undated > 0
  UNION ALL SELECT case_id, 1, NULL, unnest(['| {" | ".join(_HEADS)} |', '|{"|".join(["---"] * len(_HEADS))}|']),
    generate_subscripts([1, 2], 1) FROM fixed
  UNION ALL SELECT case_id, section, row_id, line, 0 FROM md
  UNION ALL SELECT case_id, 3, NULL, unnest(['', '**RETIRÉ PAR RÈGLE — ' || held || ' document(s), conservés au dossier**', '',
    '| Date | Document | Règle |', '|---|---|---|']), generate_subscripts([1, 2, 3, 4, 5], 1) FROM fixed WHERE held > 0),
doc AS (SELECT e.case_id, string_agg(e.line || chr(10), '' ORDER BY section, (row_date IS NOT NULL), row_date, coalesce(author, ''),
    doc_class, min_page, row_id, part) AS text FROM every e LEFT JOIN rc USING (row_id) GROUP BY 1)
SELECT case_id AS document, strlen(text)::BIGINT AS n_bytes, sha256(text) AS sha256 FROM doc""")
def markdown_files(spark, folder):
    """The printed documents written as streams of fragments, and read back byte by byte."""
    rows, places, bullets = _export_parts(spark, folder)
    path = f"{shared_folder(spark)}/printed-{uuid.uuid4().hex}"
    fragments.write(fragments.markdown_fragments(report.display_rows(rows, PACK), places, bullets, PACK), path)
    return fragments.digests(rows.select(F.col("case_id").alias("document")).distinct(), path)


@query("required_fields", """
WITH r AS (SELECT 'o' || l_orderkey AS unit_id,
    CASE l_returnflag WHEN 'R' THEN 'consolidation' WHEN 'A' THEN 'apipp'
      ELSE 'limitations_fonctionnelles' END AS field,
    min(CASE WHEN l_quantity < 15 THEN 'oui' WHEN l_quantity < 30 THEN 'rated'
      ELSE 'trop_tot' END) AS state FROM lineitem GROUP BY 1, 2),
g AS (SELECT 'o' || o_orderkey AS unit_id, unnest(['apipp','consolidation',
    'limitations_fonctionnelles']) AS field FROM orders)
SELECT unit_id, field, state, state IS NOT NULL AS observed, state IS NULL AS missing,
  coalesce(CASE field WHEN 'consolidation' THEN state IN ('oui','non','trop_tot','absent')
    ELSE state IN ('rated','aucune','trop_tot','absent') END, FALSE) AS valid
FROM g LEFT JOIN r USING (unit_id, field)""")
def required_fields(spark, folder):
    return cues.required_report(units(spark, folder), _item_records(spark, folder), PACK)


def _item_records(spark, folder) -> DataFrame:
    """Line items as extracted fields."""
    flag, qty = F.col("l_returnflag"), F.col("l_quantity")
    return tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit_id"),
        F.when(F.col("l_linestatus") == "F", "4a").otherwise("4c").alias("stage"),
        F.when(flag == "R", "consolidation").when(flag == "A", "apipp")
        .otherwise("limitations_fonctionnelles").alias("field"),
        F.when(qty < 15, "oui").when(qty < 30, "rated").otherwise("trop_tot").alias("value"))


@query("fields_without_model", """
SELECT 'c' || o_custkey AS case_id, count(*) FILTER (WHERE l_linestatus = 'F') AS from_forms,
  count(*) AS total, round(count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 6) AS share
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def fields_without_model(spark, folder):
    read = _item_records(spark, folder).join(
        units(spark, folder).select("unit_id", "case_id"), "unit_id")
    return cues.share_without_model(read).withColumn("share", F.round("share", 6))


@query("resolved_fields", """
SELECT DISTINCT 'o' || l_orderkey AS unit_id, CASE l_returnflag WHEN 'R' THEN 'consolidation'
  WHEN 'A' THEN 'apipp' ELSE 'limitations_fonctionnelles' END AS field
FROM lineitem WHERE l_linestatus = 'F'""")
def resolved_fields(spark, folder):
    return cues.resolved_fields(_item_records(spark, folder))
