"""Queries over the lines of all documents, under the probe rules."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import (
    blocks, boundaries, classify, cues, dates, duplicates, pages, selection, tree_prints, units,
    worklist,
)
from ...operators.matching import document_hits
from ...sources import tables
from .probe import PROBE, REGIMES
from .registry import ORACLES, shared, text_date
from .registry import query as plain_query

# --- SQL shared by the statements below -----------------------------------------------------

LINES = r"""
ln AS (
  SELECT source AS case_id, doc_id::VARCHAR AS bundle_id,
    unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents),
pg AS (SELECT DISTINCT case_id, bundle_id, CAST(nth // 4 + 1 AS INTEGER) AS pdf_index FROM ln),
raw AS (
  SELECT case_id, bundle_id, CAST(nth // 4 + 1 AS INTEGER) AS pdf_index, CAST(nth AS INTEGER) AS ord,
    text AS line, trim(text, ' ' || chr(9) || chr(13)) AS text, nth % 4 AS slot
  FROM ln WHERE trim(text) <> ''),
lab AS (
  SELECT *, CASE WHEN slot IN (0, 3) THEN
    CASE WHEN regexp_matches(line, '(?i)^\s*(?:(?:p?age|p)\.?\s*)?(\d{1,4})\s*(?:de|of|/|sur)\s*\d{1,4}\s*$') THEN 'page_x_of_y'
      WHEN regexp_matches(line, '(?i)^\s*(?:p?age|p)\.?\s*(\d{1,4})\s*(?:de|of|sur)\s*$') THEN 'page_x_of_truncated'
      WHEN regexp_matches(line, '(?i)^\s*(?:p?age|p)\.?\s*(\d{1,4})\s*$') THEN 'page_n'
      WHEN regexp_matches(line, '^\s*(\d{1,4})\s*$') THEN 'bare_number' END END AS label_rule,
    slot = 0 AND length(line) <= 60 AS larger,
    coalesce(length(regexp_replace(line, '[^\p{Lu}]', '', 'g'))
      / nullif(length(regexp_replace(line, '[^\p{L}]', '', 'g')), 0), 0) > 0.8 AS dense,
    regexp_matches(line, '\d[^\d\s.,%/-]\d') AS degenerate
  FROM raw),
b AS (
  SELECT *, CASE WHEN label_rule IS NOT NULL THEN 'page_label'
    WHEN regexp_matches(text, '^\s*([^:\n]{1,60}?)\s*:\s*$') THEN 'empty'
    WHEN regexp_matches(text, '\[\s*[xX✓]?\s*\]') THEN 'checkbox'
    WHEN regexp_matches(text, '(?i)(^|\s)(de\s*:|from\s*:|à\s*:|to\s*:|fax|t[ée]l[ée]copie|p\.\s*\d{3}\b|re[çc]u\s+le)') THEN 'stamp'
    WHEN regexp_matches(text, '(?i)^\s*(sign[ée]|signature|dr[e]?\.?\s|<signature>)') THEN 'signature'
    WHEN (larger OR dense) AND length(text) <= 90 THEN 'heading'
    WHEN regexp_matches(text, '^\s*\S.*?(?:\s\d[\d\s.,%°/-]*){2,}\s*$') THEN 'table'
    ELSE 'paragraph' END AS type,
    'blk_' || substr(sha256(bundle_id || '|' || pdf_index || '|' || ord || '|' || line), 1, 20) AS block_id,
    CASE WHEN degenerate THEN 0.55 ELSE 1.0 END::DOUBLE AS confidence
  FROM lab)"""

WORDS = r"""
tk AS (SELECT bundle_id, pdf_index, ord, list_filter(list_transform(
    regexp_split_to_array(text, '\s+'), lambda t: trim(t, '.,;:()[]{}''"·–—-«»')),
    lambda t: regexp_matches(t, '\p{L}')) AS toks FROM b),
wc AS (SELECT bundle_id, pdf_index, ord, len(toks) AS alpha, len(list_filter(toks, lambda t:
    regexp_matches(t, '^[A-Za-zÀ-ÿ]{2,}$') AND regexp_matches(t, '(?i)[aeiouyàâäéèêëîïôöùûü]'))) AS good
  FROM tk)"""

GROUPS = r"""
qp AS (SELECT bundle_id, pdf_index, sum(good) / nullif(sum(alpha), 0) AS q FROM wc GROUP BY 1, 2),
sg AS (
  SELECT pg.case_id, pg.bundle_id, pg.pdf_index, s.bundle_id IS NULL AS empty,
    coalesce(qp.q, 0) >= 0.35 AND s.bundle_id IS NOT NULL AS readable,
    CASE WHEN s.declares THEN 7 ELSE 0 END + CASE WHEN s.heading THEN 5 ELSE 0 END
      + CASE WHEN s.k = 1 THEN 4 WHEN s.k IS NOT NULL THEN -7 ELSE 0 END AS tenths, s.k, s.n
  FROM pg LEFT JOIN (
    SELECT bundle_id, pdf_index,
      bool_or(slot IN (0, 1) AND regexp_matches(text, '(?i)«avec le»')) AS declares,
      bool_or(slot IN (0, 1) AND type = 'heading' AND regexp_matches(text,
        '(?i)«the»|«le»|«der»|«que»|license|copyright')) AS heading,
      any_value(CASE WHEN type = 'page_label' THEN TRY_CAST(nullif(regexp_extract(text,
        '(?i)^\s*(?:p(?:age)?\.?\s*)?(\d{1,4})\s*(?:de|of|/|sur)\s*(\d{1,4})\s*$', 1), '') AS INTEGER) END) AS k,
      any_value(CASE WHEN type = 'page_label' THEN TRY_CAST(nullif(regexp_extract(text,
        '(?i)^\s*(?:p(?:age)?\.?\s*)?(\d{1,4})\s*(?:de|of|/|sur)\s*(\d{1,4})\s*$', 2), '') AS INTEGER) END) AS n
    FROM b GROUP BY 1, 2) s USING (bundle_id, pdf_index) LEFT JOIN qp USING (bundle_id, pdf_index)),
st AS (SELECT *, empty OR tenths >= 5 OR NOT readable AS starts FROM sg),
op AS (
  SELECT *, starts OR lag(pdf_index) OVER w IS NULL OR NOT lag(readable) OVER w
    OR (k IS NOT NULL AND lag(k) OVER w IS NOT NULL AND NOT (n = lag(n) OVER w AND k = lag(k) OVER w + 1))
    AS opens FROM st WINDOW w AS (PARTITION BY bundle_id ORDER BY pdf_index)),
gp AS (SELECT *, max(CASE WHEN opens THEN pdf_index END) OVER (PARTITION BY bundle_id
    ORDER BY pdf_index ROWS UNBOUNDED PRECEDING) AS group_start FROM op),
un AS (
  SELECT case_id, bundle_id, group_start AS first_page, count(*) AS n_pages,
    'unit_' || substr(sha256(bundle_id || ':' || group_start || '-' || max(pdf_index) || '-' || count(*)), 1, 20) AS unit_id
  FROM gp GROUP BY 1, 2, 3),
up AS (SELECT gp.case_id, gp.bundle_id, gp.pdf_index, un.unit_id, gp.pdf_index = un.first_page AS is_first
  FROM gp JOIN un ON un.bundle_id = gp.bundle_id AND un.first_page = gp.group_start),
ub AS (SELECT b.*, up.unit_id, up.is_first FROM b JOIN up USING (bundle_id, pdf_index))"""

BODY = """
bt AS (SELECT unit_id, string_agg(text, chr(10) ORDER BY pdf_index, ord) AS body FROM ub
  WHERE type IN ('heading','paragraph','table') GROUP BY 1)"""

CLASSES = r"""
ft AS (SELECT unit_id, string_agg(text, chr(10) ORDER BY ord) AS page_text,
    coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (WHERE type = 'heading'), '') AS head
  FROM ub WHERE is_first GROUP BY 1),
zs AS (
  SELECT un.unit_id, ft.page_text IS NOT NULL AS has_text,
    coalesce(regexp_matches(ft.page_text, '(?i)«avec le»'), FALSE) AS named,
    [struct_pack(id := 'english', c := 0.9, h := regexp_matches(head, '(?i)«the»'),
       o := regexp_matches(body, '(?i)«with»|and\s*the')),
     struct_pack(id := 'french', c := 0.88, h := regexp_matches(head, '(?i)«le»'),
       o := regexp_matches(body, '(?i)«pour»|de\s*la')),
     struct_pack(id := 'german', c := 0.85, h := regexp_matches(head, '(?i)«der»'),
       o := regexp_matches(body, '(?i)«nicht»')),
     struct_pack(id := 'spanish', c := 0.79, h := regexp_matches(head, '(?i)«que»'),
       o := regexp_matches(body, '(?i)«para»')),
     struct_pack(id := 'legal', c := 0.95, h := regexp_matches(head, '(?i)license|copyright'),
       o := regexp_matches(body, '(?i)copyright|license'))] AS zones
  FROM un LEFT JOIN ft USING (unit_id) LEFT JOIN bt USING (unit_id)),
zx AS (SELECT unit_id, has_text, named, unnest(zones) AS z, generate_subscripts(zones, 1) AS place FROM zs),
zc AS (SELECT unit_id, z.id AS id, place, round(z.c * CASE WHEN coalesce(z.h, FALSE) AND coalesce(z.o, FALSE)
    THEN 1.0 WHEN coalesce(z.h, FALSE) THEN 0.9 ELSE 0.5 END, 4) AS score FROM zx
  WHERE coalesce(z.h, FALSE) OR coalesce(z.o, FALSE)),
zb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, place) AS rn
  FROM zc) WHERE rn = 1),
cl AS (
  SELECT zs.unit_id, CASE WHEN NOT has_text THEN 'unknown' WHEN named THEN 'french'
      WHEN zb.score >= 0.7 THEN zb.id ELSE 'unknown' END AS doc_class,
    CASE WHEN NOT has_text THEN 0.0 WHEN named THEN 0.88 ELSE coalesce(zb.score, 0.0) END::DOUBLE
      AS class_confidence,
    CASE WHEN has_text AND named THEN 'declared' ELSE 'zones' END AS class_source,
    has_text AND NOT named AND coalesce(zb.score, 0) < 0.7 AS needs_fallback
  FROM zs LEFT JOIN zb USING (unit_id))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def words(sql: str) -> str:
    """«word» in a statement is a whole word; the SQL engine's own \\b knows ASCII only."""
    edge = r"[^\p{L}\p{M}\p{Nd}_]"
    return re.sub("«([^»]+)»", lambda m: f"(?:^|{edge})(?:{m[1]})(?:$|{edge})", sql)


BASE = _with(LINES)
GROUPED = _with(LINES, WORDS, GROUPS)


def query(name: str, sql: str | None = None):
    return plain_query(name, None if sql is None else words(sql))


# --- building blocks ------------------------------------------------------------------------


def doc_blocks(spark, folder) -> DataFrame:
    return shared(spark, folder, "doc_blocks", lambda: blocks.from_lines(
        tables.printed(tables.document_lines(spark, folder))))


def doc_pages(spark, folder) -> DataFrame:
    # Lines are only counted here, so no text is dealt out for it.
    return shared(spark, folder, "doc_pages", lambda: tables.document_pages(
        tables.document_lines(spark, folder, pieces=1)))


def doc_grouped(spark, folder) -> DataFrame:
    return shared(spark, folder, "doc_grouped", lambda: boundaries.group_pages(
        boundaries.page_signals(doc_blocks(spark, folder), doc_pages(spark, folder), PROBE)))


def doc_spans(spark, folder) -> DataFrame:
    return shared(spark, folder, "doc_spans", lambda: units.unit_spans(
        units.page_groups(doc_grouped(spark, folder))))


def doc_members(spark, folder) -> DataFrame:
    grouped = doc_grouped(spark, folder)
    return shared(spark, folder, "doc_members", lambda: units.unit_pages(
        grouped, units.page_groups(grouped), doc_spans(spark, folder)))


def unit_blocks(spark, folder) -> DataFrame:
    return shared(spark, folder, "unit_blocks", lambda: units.unit_blocks(
        doc_blocks(spark, folder), doc_members(spark, folder)))


def doc_classes(spark, folder) -> DataFrame:
    return shared(spark, folder, "doc_classes", lambda: classify.classify(
        unit_blocks(spark, folder), units.headline(doc_members(spark, folder)), PROBE))


def doc_units(spark, folder) -> DataFrame:
    """Units with class and legibility, dated by a day that follows from their length."""
    read = classify.legibility(unit_blocks(spark, folder), doc_spans(spark, folder))
    return shared(spark, folder, "doc_units", lambda: doc_spans(spark, folder).join(
        doc_classes(spark, folder), "unit_id").join(read, "unit_id"))


# --- lines and pages ------------------------------------------------------------------------


@query("block_types", BASE + """
SELECT bundle_id, pdf_index, ord, block_id, type, text, confidence, degenerate, label_rule,
  CASE WHEN label_rule IS NOT NULL THEN regexp_extract(line, '(\\d{1,4})', 1) END AS label,
  CASE WHEN type = 'heading' THEN CASE WHEN larger THEN 1 ELSE 3 END END AS level FROM b""")
def block_types(spark, folder):
    return doc_blocks(spark, folder).select(
        "bundle_id", "pdf_index", "ord", "block_id", "type", "text", "confidence", "degenerate",
        "label_rule", "label", "level")


@query("block_attributes", BASE + """
SELECT block_id, 'font_size' AS k, CASE WHEN larger THEN '13' ELSE '10' END AS v FROM b
UNION ALL SELECT block_id, 'level', CASE WHEN larger THEN '1' ELSE '3' END FROM b WHERE type = 'heading'
UNION ALL SELECT block_id, 'structure', 'row_only' FROM b WHERE type = 'table'
UNION ALL SELECT block_id, 'raw', text FROM b WHERE type = 'checkbox'
UNION ALL SELECT block_id, 'degenerate_number', 'true' FROM b WHERE degenerate
UNION ALL SELECT block_id, 'rule', label_rule FROM b WHERE label_rule IS NOT NULL
UNION ALL SELECT block_id, 'label', regexp_extract(line, '(\\d{1,4})', 1) FROM b WHERE label_rule IS NOT NULL
UNION ALL SELECT block_id, 'field', regexp_extract(text, '^\\s*([^:\\n]{1,60}?)\\s*:\\s*$', 1) FROM b WHERE type = 'empty'""")
def block_attributes(spark, folder):
    return blocks.attributes(doc_blocks(spark, folder)).select(
        "block_id", F.explode("attrs").alias("k", "v"))


@query("text_quality", r"""
WITH t AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\s+'),
    lambda t: trim(t, '.,;:()[]{}''"·–—-«»')), lambda t: regexp_matches(t, '\p{L}')) AS toks FROM documents),
c AS (SELECT doc_id, text, len(toks) AS alpha, len(list_filter(toks, lambda t:
    regexp_matches(t, '^[A-Za-zÀ-ÿ]{2,}$') AND regexp_matches(t, '(?i)[aeiouyàâäéèêëîïôöùûü]'))) AS good FROM t)
SELECT doc_id, round(coalesce(good / nullif(alpha, 0), 0), 6) AS likeness,
  round(coalesce(length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))
    / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 0), 6) AS upper_share,
  regexp_matches(text, '[\x00-\x08\x0b-\x1f]') AS control,
  trim(text) = '' OR coalesce(good / nullif(alpha, 0), 0) < 0.35 AS needs_ocr FROM c""")
def text_quality(spark, folder):
    text = F.col("text")
    return tables.table(spark, folder, "documents").select(
        "doc_id", F.round(tx.word_likeness(text), 6).alias("likeness"),
        F.round(tx.upper_share(text), 6).alias("upper_share"),
        tx.has_control(text).alias("control"), blocks.page_text_needs_ocr(text).alias("needs_ocr"))


@query("year_anchors", BASE + r"""
SELECT bundle_id, min(y) AS first_year, max(y) AS last_year FROM (
  SELECT bundle_id, CAST(unnest(regexp_extract_all(text, '\b(?:19|20)\d{2}\b')) AS INTEGER) AS y FROM b)
GROUP BY 1""")
def year_anchors(spark, folder):
    return dates.year_anchors(doc_blocks(spark, folder))


@query("document_labels", BASE + """,
cd AS (SELECT * FROM (SELECT bundle_id, pdf_index, label_rule, regexp_extract(line, '(\\d{1,4})', 1) AS label,
    row_number() OVER (PARTITION BY bundle_id, pdf_index ORDER BY ord DESC) AS rn
  FROM b WHERE label_rule IS NOT NULL) WHERE rn = 1),
ct AS (SELECT *, count(*) FILTER (WHERE label_rule = 'bare_number') OVER (PARTITION BY bundle_id,
    label::INTEGER) AS seen FROM cd)
SELECT bundle_id, pdf_index, label AS printed_label FROM ct
WHERE label_rule <> 'bare_number' OR (label::INTEGER NOT BETWEEN 1900 AND 2100
  AND NOT (label::INTEGER > 20 AND seen > 1))""")
def document_labels(spark, folder):
    return pages.confirm_labels(pages.label_candidates(doc_blocks(spark, folder)))


@query("confirm_labels", """
WITH c AS (SELECT l_orderkey::VARCHAR AS bundle_id, l_linenumber AS pdf_index,
    CAST(arg_max(l_partkey * 7 % 60 + CASE WHEN l_partkey % 11 = 0 THEN 1900 ELSE 0 END, l_partkey) AS INTEGER) AS v,
    max(l_partkey) % 5 = 0 AS trusted FROM lineitem GROUP BY 1, 2),
n AS (SELECT bundle_id, v, count(*) AS seen FROM c WHERE NOT trusted GROUP BY 1, 2)
SELECT bundle_id, pdf_index, v::VARCHAR AS printed_label FROM c LEFT JOIN n USING (bundle_id, v)
WHERE trusted OR (v NOT BETWEEN 1900 AND 2100 AND NOT (v > 20 AND seen > 1))""")
def confirm_labels(spark, folder):
    """Line items as label blocks: the last of a page is its candidate."""
    part = F.col("l_partkey")
    value = part * 7 % 60 + F.when(part % 11 == 0, 1900).otherwise(0)
    marks = tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("bundle_id"), F.col("l_linenumber").alias("pdf_index"),
        part.alias("ord"), F.lit("page_label").alias("type"), value.cast("string").alias("label"),
        F.when(part % 5 == 0, "page_n").otherwise("bare_number").alias("label_rule"))
    return pages.confirm_labels(pages.label_candidates(marks))


@query("page_rows", BASE + """,
s AS (SELECT bundle_id, pdf_index, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM b GROUP BY 1, 2)
SELECT bundle_id, pdf_index, coalesce(chars, 0) AS char_count, coalesce(n, 0) AS n_blocks,
  CASE WHEN n IS NULL THEN 'unclaimed' ELSE 'text_layer' END AS parse_source
FROM pg LEFT JOIN s USING (bundle_id, pdf_index)""")
def page_rows(spark, folder):
    found = doc_blocks(spark, folder)
    labels = pages.confirm_labels(pages.label_candidates(found))
    return pages.page_rows(doc_pages(spark, folder), found, labels).select(
        "bundle_id", "pdf_index", "char_count", "n_blocks", "parse_source")


@query("parse_metrics", BASE + """,
s AS (SELECT bundle_id, pdf_index, count(*) AS n FROM b GROUP BY 1, 2)
SELECT bundle_id, count(*) AS pages, CAST(coalesce(sum(n), 0) AS BIGINT) AS blocks,
  count(*) FILTER (WHERE n IS NULL) AS unread_pages,
  round(count(*) FILTER (WHERE n IS NULL) / count(*), 6) AS unread_ratio
FROM pg LEFT JOIN s USING (bundle_id, pdf_index) GROUP BY 1""")
def parse_metrics(spark, folder):
    found = doc_blocks(spark, folder)
    labels = pages.confirm_labels(pages.label_candidates(found))
    return pages.parse_metrics(pages.page_rows(doc_pages(spark, folder), found, labels)).select(
        "bundle_id", "pages", "blocks", "unread_pages", F.round("unread_ratio", 6).alias("unread_ratio"))


@query("tier_routing", _with(LINES, WORDS) + """,
t AS (
  SELECT b.bundle_id, b.pdf_index, 0 AS tier, count(*) AS n,
    sum(CASE WHEN type IN ('heading','paragraph','table') THEN good ELSE 0 END)
      / nullif(sum(CASE WHEN type IN ('heading','paragraph','table') THEN alpha END), 0) AS q
  FROM b JOIN wc USING (bundle_id, pdf_index, ord) GROUP BY 1, 2
  UNION ALL
  SELECT bundle_id, pdf_index, 1, count(*),
    sum(CASE WHEN type IN ('heading','paragraph','table') AND alpha > 0 THEN alpha ELSE 0 END)
      / nullif(sum(CASE WHEN type IN ('heading','paragraph','table') THEN alpha END), 0)
  FROM b JOIN wc USING (bundle_id, pdf_index, ord) WHERE ord % 4 <> 3 GROUP BY 1, 2)
SELECT bundle_id, pdf_index, tier, n FROM (
  SELECT *, row_number() OVER (PARTITION BY bundle_id, pdf_index ORDER BY
    CASE WHEN coalesce(q, 0) >= 0.35 THEN 0 ELSE 1 END,
    CASE WHEN coalesce(q, 0) >= 0.35 THEN tier ELSE 0 END,
    CASE WHEN coalesce(q, 0) >= 0.35 THEN 0 ELSE -n END, tier) AS rn FROM t) WHERE rn = 1""")
def tier_routing(spark, folder):
    """Two tiers: the text as it is, and one that reads every word but misses the fourth line."""
    first = doc_blocks(spark, folder).withColumn("tier_rank", F.lit(0))
    real = F.filter(
        F.transform(F.split("text", r"(?U)\s+"), lambda t: F.btrim(t, F.lit(tx.TOKEN_TRIM))),
        lambda t: t.rlike(r"\p{L}"))
    clear = F.concat_ws(" ", F.transform(real, lambda t: F.lit("mot")))
    second = doc_blocks(spark, folder).filter(F.col("ord") % 4 != 3).withColumns({
        "tier_rank": F.lit(1), "text": clear, "good": F.col("alpha")})
    chosen = pages.choose_tier(first.unionByName(second))
    return chosen.groupBy("bundle_id", "pdf_index", F.col("tier_rank").alias("tier")).agg(
        F.count(F.lit(1)).alias("n"))


@query("fax_banners", r"""
WITH t AS (SELECT event_id, 'Fax ' || strftime(ts, '%-d/%-m/%Y, %-I:%M %p') || ' PAGE ' || (event_id % 9)
    || '/' || (user_id % 9) AS text, strftime(ts, '%-d/%-m/%Y %-I:%M %p') AS sent,
    event_id % 9 AS position, user_id % 9 AS total FROM events)
SELECT event_id, CASE WHEN total > 0 AND position <= total THEN sent END AS sent,
  CASE WHEN total > 0 AND position <= total THEN position END AS position,
  CASE WHEN total > 0 AND position <= total THEN total END AS total FROM t""")
def fax_banners(spark, folder):
    """Banner lines built from events, read back."""
    line = F.concat(
        F.lit("Fax "), F.date_format("ts", "d/M/yyyy, h:mm a"), F.lit(" PAGE "),
        (F.col("event_id") % 9).cast("string"), F.lit("/"), (F.col("user_id") % 9).cast("string"))
    read = tables.table(spark, folder, "events").select("event_id", pages.banner(line).alias("b"))
    return read.select("event_id", "b.sent", F.col("b.position").cast("long").alias("position"),
                       F.col("b.total").cast("long").alias("total"))


@query("missing_sheets", """
WITH p AS (SELECT user_id, event_id, CAST(1 + (event_id * 3) % 40 AS INTEGER) AS position,
    lag(CAST(1 + (event_id * 3) % 40 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after_page FROM events)
SELECT 'u' || user_id AS bundle_id, after_page::INTEGER AS after_page, position - before - 1 AS missing
FROM p WHERE position - before > 1""")
def missing_sheets(spark, folder):
    """Events of a user as sheets of one fax: jumps in the count are missing sheets."""
    banner = F.struct(
        F.lit("k#40").alias("key"), (1 + (F.col("event_id") * 3) % 40).cast("int").alias("position"),
        F.lit(40).alias("total"))
    sheets = tables.table(spark, folder, "events").select(
        F.lit("c").alias("case_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("bundle_id"),
        F.col("event_id").cast("int").alias("pdf_index"), F.lit(False).alias("starts"),
        F.lit(True).alias("readable"), F.lit(None).cast("struct<k:int,n:int>").alias("label_of"),
        banner.alias("banner"))
    return boundaries.missing_sheets(boundaries.group_pages(sheets)).select(
        "bundle_id", "after_page", "missing")


@query("page_signals", GROUPED + """
SELECT bundle_id, pdf_index, starts, readable, empty FROM st""")
def page_signals(spark, folder):
    return doc_grouped(spark, folder).select("bundle_id", "pdf_index", "starts", "readable", "empty")


@query("page_groups", GROUPED + "SELECT bundle_id, pdf_index, group_start FROM gp")
def page_groups(spark, folder):
    return doc_grouped(spark, folder).select("bundle_id", "pdf_index", "group_start")


@query("unit_spans", GROUPED + """
SELECT unit_id, case_id, bundle_id, first_page, n_pages, TRUE AS contiguous FROM un""")
def unit_spans(spark, folder):
    return doc_spans(spark, folder).select(
        "unit_id", "case_id", "bundle_id", "first_page", "n_pages", "contiguous")


# --- what a unit is -------------------------------------------------------------------------


@query("classification", _with(LINES, WORDS, GROUPS, BODY, CLASSES) + """
SELECT unit_id, doc_class, class_confidence, class_source, needs_fallback FROM cl""")
def classification(spark, folder):
    return doc_classes(spark, folder).drop("class_matched")


@query("legibility", _with(LINES, WORDS, GROUPS) + r"""
, s AS (SELECT un.unit_id, un.n_pages, count(ub.ord) AS n, sum(length(ub.text)) AS chars,
    sum(good) AS good, sum(alpha) AS alpha, sum(CAST(round(confidence * 10000) AS BIGINT)) AS conf,
    count(*) FILTER (WHERE degenerate) AS broken
  FROM un LEFT JOIN ub USING (unit_id) LEFT JOIN wc ON wc.bundle_id = ub.bundle_id
    AND wc.pdf_index = ub.pdf_index AND wc.ord = ub.ord GROUP BY 1, 2),
q AS (SELECT *, coalesce(good / nullif(alpha, 0), 0) AS q FROM s)
SELECT unit_id, CASE WHEN n = 0 OR chars / n_pages < 40 OR q < 0.35 THEN 'illegible'
  WHEN q < 0.60 OR conf / n / 10000 < 0.8 OR (broken > 0 AND broken / n >= 0.15) THEN 'degraded'
  ELSE 'legible' END AS legibility,
  CASE WHEN n = 0 THEN 'No text layer on any page of the unit; nothing was extracted.'
  WHEN chars / n_pages < 40 THEN 'Only ' || CAST(chars AS BIGINT) || ' characters across ' || n_pages || ' page(s); below the readable floor.'
  WHEN q < 0.35 THEN 'Text layer present but only ' || CAST(round_even(q * 100, 0) AS INTEGER) || '% of it reads as words; the scan''s own OCR pass failed.'
  WHEN q < 0.60 THEN CAST(round_even(q * 100, 0) AS INTEGER) || '% of the text reads as words; legible enough to review, not to trust unread.'
  WHEN conf / n / 10000 < 0.8 THEN 'Mean block confidence ' || printf('%.2f', conf / n / 10000) || ' is below 0.8.'
  WHEN broken > 0 AND broken / n >= 0.15 THEN broken || ' block(s) contain a malformed number; a wrong barème percentage is a legal error, not a typo.'
  WHEN broken > 0 THEN broken || ' block(s) flagged for a malformed number; review those values.'
  ELSE 'Text layer read cleanly.' END AS legibility_reason FROM q""")
def legibility(spark, folder):
    return classify.legibility(unit_blocks(spark, folder), doc_spans(spark, folder))


@query("clinical_content", GROUPED + """
SELECT unit_id, bool_or(type IN ('heading','paragraph','table') AND length(text) >= 40) AS has_clinical
FROM ub GROUP BY 1""")
def clinical_content(spark, folder):
    return classify.clinical_content(unit_blocks(spark, folder))


@query("exclusions", _with(LINES, WORDS, GROUPS, BODY, CLASSES) + r"""
, fa AS (SELECT unit_id, doc_class, coalesce(c.has, FALSE) AS has, doc_class = 'legal' AS adm FROM cl
  LEFT JOIN (SELECT unit_id, bool_or(type IN ('heading','paragraph','table') AND length(text) >= 40) AS has
    FROM ub GROUP BY 1) c USING (unit_id)),
sp AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY pdf_index, ord) AS nth FROM ub),
nm AS (SELECT * FROM sp WHERE nth <= 6 OR type = 'heading'),
rl AS (
  SELECT unit_id, 0 AS place, regexp_matches(text, '(?i)copyright') AS a, regexp_matches(text, '(?i)license') AS z,
    '(copyright)' AS pa, '(license)' AS pz, pdf_index, ord, text FROM nm
  UNION ALL SELECT unit_id, 1, regexp_matches(text, '@'), regexp_matches(text, '(?i)«the»'), '(@)', '(?:^|[^\p{L}\p{M}\p{Nd}_])(the)(?:$|[^\p{L}\p{M}\p{Nd}_])',
    pdf_index, ord, text FROM nm),
ht AS (SELECT unit_id, place, 0 AS nth, pdf_index, ord, regexp_extract(text, '(?i)' || pa, 1) AS ev FROM rl WHERE a
  UNION ALL SELECT unit_id, place, 1, pdf_index, ord, regexp_extract(text, '(?i)' || pz, 1) FROM rl WHERE z),
ok AS (SELECT ht.*, row_number() OVER (PARTITION BY unit_id ORDER BY place, nth, pdf_index, ord) AS rn
  FROM ht JOIN fa USING (unit_id) WHERE (place = 1 OR doc_class = 'legal') AND NOT (has AND NOT adm))
SELECT fa.unit_id, CASE WHEN ok.place = 0 THEN 'probe.legal' WHEN ok.place = 1 THEN 'probe.contact'
    WHEN adm AND NOT has THEN 'probe.empty' END AS excluded_by, ok.ev AS excluded_evidence,
  CASE WHEN ok.place IS NULL THEN 'probe.unbuilt' ELSE '' END AS unavailable
FROM fa LEFT JOIN (SELECT * FROM ok WHERE rn = 1) ok USING (unit_id)""")
def exclusions(spark, folder):
    placed = unit_blocks(spark, folder)
    facts = doc_classes(spark, folder).select("unit_id", "doc_class").join(
        classify.clinical_content(placed), "unit_id", "left")
    return classify.exclusions(placed, facts, PROBE).select(
        "unit_id", "excluded_by", "excluded_evidence",
        F.array_join("filters_unavailable", ",").alias("unavailable"))


@query("screening", _with(LINES, WORDS, GROUPS, BODY) + r"""
, sc AS (
  SELECT un.unit_id,
    least(1.0, 0.45 * (CASE WHEN regexp_matches(body, '(?i)«the»') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)«of»') THEN 1 ELSE 0 END) + 0.12 * (CASE WHEN regexp_matches(body, '(?i)«and»') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)«to»') THEN 1 ELSE 0 END)) AS e,
    least(1.0, 0.45 * (CASE WHEN regexp_matches(body, '(?i)«que»') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)«para»') THEN 1 ELSE 0 END) + 0.12 * CASE WHEN regexp_matches(body, '(?i)«de»') THEN 1 ELSE 0 END) AS s,
    least(1.0, 0.45 * (CASE WHEN regexp_matches(body, '(?i)«avec»') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)«pour»') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)de\s*la') THEN 1 ELSE 0 END)
      + 0.12 * (CASE WHEN regexp_matches(body, '(?i)«le»') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)«nicht»') THEN 1 ELSE 0 END)) AS w
  FROM un LEFT JOIN bt USING (unit_id))
SELECT unit_id, CASE WHEN w > e AND w > s AND w >= 0.5 THEN 'west' WHEN e >= s AND e >= 0.5 AND e > w AND e >= w
    THEN 'east' WHEN s > e AND s >= 0.5 AND s > w THEN 'south'
    ELSE 'west' END AS regime FROM sc""")
def screening(spark, folder):
    """Three toy regimes; the case is filed under the last of them."""
    heads = units.headline(doc_members(spark, folder))
    return classify.screen_regimes(unit_blocks(spark, folder), heads, REGIMES, "west").select(
        "unit_id", "regime")


@query("document_hits", _with(LINES, WORDS, GROUPS, BODY) + r"""
SELECT unit_id, p AS pattern FROM bt, (VALUES ('and\s*the', 'and\s*the'), ('de\s*la', 'de\s*la'),
  ('\bnicht\b', '«nicht»')) v(p, q) WHERE regexp_matches(body, '(?i)' || q)""")
def hits_over_lines(spark, folder):
    """Patterns that may run over line ends, against whole documents."""
    return document_hits(classify.body_of(unit_blocks(spark, folder)),
                         [r"and\s*the", r"de\s*la", r"\bnicht\b"])


# --- lines of a unit ------------------------------------------------------------------------


@query("repeated_lines", GROUPED + r"""
, f AS (SELECT unit_id, pdf_index, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS line FROM ub),
p AS (SELECT unit_id, count(DISTINCT pdf_index) AS pages FROM ub GROUP BY 1)
SELECT unit_id, line FROM f JOIN p USING (unit_id) GROUP BY unit_id, line, pages
HAVING pages > 1 AND count(DISTINCT pdf_index) >= greatest(2, ceil(pages * 0.75))""")
def repeated_lines(spark, folder):
    return selection.repeated_lines(unit_blocks(spark, folder))


@query("section_selection", GROUPED + r"""
, f0 AS (SELECT *, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS line FROM ub),
p AS (SELECT unit_id, count(DISTINCT pdf_index) AS pages FROM ub GROUP BY 1),
fu AS (SELECT unit_id, line FROM f0 JOIN p USING (unit_id) GROUP BY unit_id, line, pages
  HAVING pages > 1 AND count(DISTINCT pdf_index) >= greatest(2, ceil(pages * 0.75))),
f1 AS (SELECT f0.*, fu.line IS NOT NULL AS furn, type = 'heading' AS hd,
    regexp_matches(text, '(?i)«the»|«le»') AS inc, regexp_matches(text, '(?i)«der»') AS exc,
    regexp_matches(text, '(?i)@|«copyright»') AS sup,
    bool_or(type = 'heading' AND regexp_matches(text, '(?i)«the»|«le»')) OVER (PARTITION BY unit_id) AS sectioned
  FROM f0 LEFT JOIN fu USING (unit_id, line)),
f2 AS (SELECT *, hd AND NOT inc AND furn AS runhead,
    CASE WHEN hd AND NOT (NOT inc AND furn) THEN CASE WHEN exc THEN 0 WHEN inc THEN 1 END END AS sw FROM f1),
f3 AS (SELECT *, last_value(sw IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY pdf_index, ord
    ROWS UNBOUNDED PRECEDING) AS state FROM f2),
f4 AS (SELECT *, CASE WHEN runhead THEN 'repeats_on_every_page' WHEN hd THEN 'section_heading'
    WHEN type NOT IN ('heading','paragraph','table') THEN 'furniture_type'
    WHEN furn THEN 'repeats_on_every_page' WHEN sup THEN 'identity_or_letterhead'
    WHEN coalesce(state, CASE WHEN sectioned THEN 0 ELSE 1 END) = 0 THEN 'outside_content_section' END AS reason,
    NOT hd AND type IN ('paragraph','table') AND NOT furn AND NOT sup AS spare FROM f3),
f5 AS (SELECT *, bool_or(reason IS NULL) OVER (PARTITION BY unit_id) AS any_kept FROM f4)
SELECT block_id, unit_id, reason IS NULL OR (NOT any_kept AND spare) AS kept,
  CASE WHEN NOT any_kept AND spare THEN NULL ELSE reason END AS reason FROM f5""")
def section_selection(spark, folder):
    return selection.select_lines(unit_blocks(spark, folder), PROBE).select(
        "block_id", "unit_id", "kept", "reason")


@query("dropped_lines", "SELECT unit_id, reason, count(*) AS n FROM (" + ORACLES["section_selection"]
       + ") WHERE NOT kept GROUP BY 1, 2")
def dropped_lines(spark, folder):
    return selection.dropped_summary(selection.select_lines(unit_blocks(spark, folder), PROBE))


SUBDIVIDED = GROUPED + """
, x AS (SELECT *, length(text) AS len, sum(length(text)) OVER (PARTITION BY unit_id) AS total,
    bool_or(type = 'heading') OVER (PARTITION BY unit_id) AS headed,
    sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY pdf_index, ord
      ROWS UNBOUNDED PRECEDING) AS section FROM ub),
sz AS (SELECT unit_id, section, sum(len) AS size, min(section) OVER (PARTITION BY unit_id) AS fs
  FROM x WHERE total > 2000 AND headed GROUP BY 1, 2),
pn AS (SELECT unit_id, section, sum(CASE WHEN section = fs OR size >= 200 THEN 1 ELSE 0 END) OVER (
    PARTITION BY unit_id ORDER BY section ROWS UNBOUNDED PRECEDING) - 1 AS part FROM sz),
np AS (SELECT unit_id, max(part) + 1 AS n_parts FROM pn GROUP BY 1),
sd AS (SELECT x.*, CAST(coalesce(pn.part, 0) AS INTEGER) AS part, CASE WHEN total <= 2000 THEN 'short_enough'
    WHEN NOT headed THEN 'no_internal_structure' WHEN n_parts = 1 THEN 'structure_too_shallow'
    ELSE 'split_on_headings' END AS reason
  FROM x LEFT JOIN pn USING (unit_id, section) LEFT JOIN np USING (unit_id))"""


def parted(spark, folder) -> DataFrame:
    """Whole-document units (one per document) cut at headings; long means 2,000 characters."""
    # What requests and answers read of a line; its box and label stay where they are.
    return shared(spark, folder, "parted", lambda: worklist.subdivide(unit_blocks(spark, folder).select(
        "case_id", "unit_id", "pdf_index", "ord", "block_id", "type", "text", "confidence"), long_unit=2000))


@query("subdivide", SUBDIVIDED + """
SELECT unit_id, part, count(*) AS n_blocks, CAST(sum(len) AS BIGINT) AS chars, min(reason) AS reason
FROM sd GROUP BY 1, 2""")
def subdivide(spark, folder):
    return worklist.part_table(parted(spark, folder)).select(
        "unit_id", "part", "n_blocks", "chars", "reason")


@query("work_list", SUBDIVIDED + """
SELECT unit_id, part, reason, string_agg(block_id || ' | ' || length(text) || ' | ' || text, chr(10)
    ORDER BY pdf_index, ord) FILTER (WHERE type IN ('heading','paragraph','table')) AS listing
FROM sd GROUP BY 1, 2, 3""")
def work_list(spark, folder):
    told = doc_spans(spark, folder).join(doc_classes(spark, folder), "unit_id").withColumns({
        "legibility": F.lit("legible"), "row_date": F.lit(None).cast("date"),
        "date_status": F.lit("undated")})
    none = told.select("unit_id", F.lit("").alias("field")).filter(F.lit(False))
    return worklist.work_list(parted(spark, folder), told, none, PROBE.class_labels).filter(
        F.col("skipped").isNull()).select(
        "unit_id", "part", "reason", F.nullif("listing", F.lit("")).alias("listing"))


SELECTED = SUBDIVIDED + """
, sl AS (
  SELECT unit_id, part, CAST(ord * 2 AS INTEGER) AS seq, block_id, ord % 5 AS s,
    length(text) + (ord % 6) - 2 AS e FROM sd
  UNION ALL SELECT unit_id, part, CAST(ord * 2 + 1 AS INTEGER),
    CASE WHEN ord % 7 = 0 THEN 'blk_other' ELSE block_id END, ord % 5,
    length(text) + CASE WHEN ord % 3 = 0 THEN (ord % 6) - 2 ELSE 1 END FROM sd),
vf AS (
  SELECT sl.*, sd.text AS src, CASE WHEN e > length(sd.text) AND e - length(sd.text) <= 2 THEN length(sd.text) ELSE e END AS e1
  FROM sl LEFT JOIN sd USING (unit_id, part, block_id)),
vg AS (SELECT *, CASE WHEN src IS NULL THEN 'not_a_block_of_this_part'
    WHEN NOT (s >= 0 AND s < e1 AND e1 <= length(src)) THEN 'outside_block'
    WHEN length(trim(substr(src, CAST(s + 1 AS INTEGER), CAST(e1 - s AS INTEGER)))) < 3 THEN 'too_short' END AS r FROM vf),
vh AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY unit_id, part, block_id, s, e1, r IS NULL
    ORDER BY seq) > 1 THEN 'repeated' ELSE r END AS reason FROM vg)"""


def selections(spark, folder) -> DataFrame:
    """Two answers per line of the work list: some right, some past the end, some of another unit."""
    ord_, size = F.col("ord"), F.length("text")
    first = parted(spark, folder).select(
        "unit_id", "part", (ord_ * 2).cast("int").alias("seq"), "block_id",
        (ord_ % 5).cast("int").alias("start"), (size + ord_ % 6 - 2).cast("int").alias("end"),
        F.lit("autre").alias("field"))
    second = parted(spark, folder).select(
        "unit_id", "part", (ord_ * 2 + 1).cast("int").alias("seq"),
        F.when(ord_ % 7 == 0, "blk_other").otherwise(F.col("block_id")).alias("block_id"),
        (ord_ % 5).cast("int").alias("start"),
        (size + F.when(ord_ % 3 == 0, ord_ % 6 - 2).otherwise(1)).cast("int").alias("end"),
        F.lit("autre").alias("field"))
    return first.unionByName(second)


@query("verify_spans", SELECTED + """
SELECT unit_id, part, seq, reason, CASE WHEN reason IS NULL THEN
  trim(substr(src, CAST(s + 1 AS INTEGER), CAST(e1 - s AS INTEGER))) END AS value FROM vh""")
def verify_spans(spark, folder):
    return worklist.verify_spans(selections(spark, folder), parted(spark, folder)).select(
        "unit_id", "part", "seq", "reason", "value")


@query("groundedness", SELECTED + """
SELECT unit_id, count(*) AS selected, count(*) FILTER (WHERE reason IS NULL) AS kept,
  round(count(*) FILTER (WHERE reason IS NULL) / count(*), 6) AS groundedness FROM vh GROUP BY 1""")
def groundedness(spark, folder):
    return worklist.groundedness(worklist.verify_spans(
        selections(spark, folder), parted(spark, folder))).withColumn(
        "groundedness", F.round("groundedness", 6))


@query("span_records", SELECTED + """
SELECT unit_id, 'line.' || row_number() OVER (PARTITION BY unit_id ORDER BY part, seq) AS field,
  block_id, trim(substr(src, CAST(s + 1 AS INTEGER), CAST(e1 - s AS INTEGER))) AS value
FROM vh WHERE reason IS NULL""")
def span_records(spark, folder):
    kept = worklist.verify_spans(selections(spark, folder), parted(spark, folder))
    return worklist.span_records(kept, doc_spans(spark, folder), "prompt.x").select(
        "unit_id", "field", "block_id", "value")


# --- fields ---------------------------------------------------------------------------------


@query("abbreviations", _with(LINES, WORDS, GROUPS) + r"""
, w AS (SELECT * FROM ub WHERE type IN ('heading','paragraph','table')),
o AS (
  SELECT unit_id, pdf_index, ord, block_id, text, 'The' AS a,
    unnest(list_transform(regexp_extract_all(text, '(?:^|[^\w\p{L}-])The(?:$|[^\w\p{L}-])'), lambda x: 1)) AS one FROM w
  WHERE regexp_matches(text, '(?:^|[^\w\p{L}-])The(?:$|[^\w\p{L}-])')
  UNION ALL SELECT unit_id, pdf_index, ord, block_id, text, 'Le', 1 FROM w
  WHERE regexp_matches(text, '(?:^|[^\w\p{L}-])Le(?:$|[^\w\p{L}-])'))
SELECT DISTINCT unit_id, 'abbreviation.' || a AS field FROM o""")
def abbreviations(spark, folder):
    from ...operators.blocks import is_body

    body = unit_blocks(spark, folder).filter(is_body(F.col("type")))
    return cues.abbreviations(body, PROBE).select("unit_id", "field").distinct()


#: (field, value, order, word) of every cue of the probe rules.
CUE_WORDS = (
    (0, 0, 0, "the"), (0, 0, 1, "die"), (0, 0, 2, "with"), (0, 0, 3, "avec"), (0, 0, 4, "sur"),
    (1, 0, 0, "this"), (1, 0, 1, "pour"), (1, 0, 2, "nicht"),
    (2, 0, 0, "and"), (2, 1, 1, "que"), (2, 1, 2, "und"),
)


def _cue_hits() -> str:
    """One SELECT per cue, with the place of its first match in the line."""
    edge = r"[^\p{L}\p{M}\p{Nd}_]"
    parts = [
        f"SELECT *, {f} AS place, {v} AS val, {n} AS nth, CASE WHEN regexp_matches(text,"
        f" '(?i)^{w}(?:$|{edge})') THEN 0 ELSE 1 + length(string_split_regex(text,"
        f" '(?i){edge}{w}(?:$|{edge})')[1]) END AS pos FROM pr WHERE regexp_matches(text, '(?i)«{w}»')"
        for f, v, n, w in CUE_WORDS]
    return "h0 AS (" + " UNION ALL ".join(parts) + "),"


CUES = _with(LINES, WORDS, GROUPS) + r"""
, bd AS (SELECT * FROM ub WHERE type IN ('heading','paragraph','table')),
rp AS (SELECT unit_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM bd GROUP BY 1, 2 HAVING count(*) > 1),
pr AS (SELECT bd.* FROM bd ANTI JOIN rp ON rp.unit_id = bd.unit_id
    AND rp.k = lower(trim(regexp_replace(bd.text, '\s+', ' ', 'g'))) WHERE type <> 'heading'),
{hits}
h1 AS (SELECT *, pos - length(regexp_extract(substr(text, 1, pos), '[^.\n]*$')) AS s,
    least(pos + length(regexp_extract(substr(text, pos + 1), '^[^.\n]*')) + 1, length(text)) AS e FROM h0),
h2 AS (SELECT *, substr(text, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)) AS sentence FROM h1),
h3 AS (SELECT * FROM h2 WHERE place = 2 OR (
    len(regexp_extract_all(sentence, '\p{L}{2,}')) >= 5
    AND NOT regexp_matches(sentence, '(?i)\(?\b(inscrire|cocher|indiquer|remplir|veuillez|joindre)\b|\bsi\s+(?:la\s+r[ée]ponse|oui|non)\b|\b\w+-(?:elles?|ils?|vous|on)\b|\b[àa]\s+l.usage\s+d[eu]\b|\bformulaire\s+transmis\b|\bn[°o]\s*de\s*r[ée]f[ée]rence\b')
    AND coalesce(length(regexp_replace(sentence, '[^\p{Lu}]', '', 'g')) / nullif(length(regexp_replace(sentence, '[^\p{L}]', '', 'g')), 0), 0) <= 0.8)),
h4 AS (SELECT *, row_number() OVER (PARTITION BY unit_id, place ORDER BY val, pdf_index, ord, nth) AS rn FROM h3),
hit AS (SELECT * FROM h4 WHERE rn = 1)""".replace("{hits}", _cue_hits())


@query("cue_hits", CUES + """
SELECT unit_id, place, block_id, CAST(pos AS INTEGER) AS start_at, sentence FROM hit""")
def cue_hits(spark, folder):
    """The first deciding cue of every field in every document."""
    return cues.cue_hits(cues.prose(unit_blocks(spark, folder)), PROBE).select(
        "unit_id", "place", "block_id", F.col("h.start").alias("start_at"), "sentence")


@query("cue_fields", CUES + r"""
, kd AS (SELECT *, CASE WHEN regexp_matches(sentence, '(?i)«the»|«die»') THEN 1 ELSE 0 END AS up,
    CASE WHEN regexp_matches(sentence, '(?i)«with»|«avec»') THEN 1 ELSE 0 END AS dn,
    CASE WHEN regexp_matches(sentence, '(?i)«sur»') THEN 1 ELSE 0 END AS fl FROM hit)
SELECT un.unit_id, 'direction' AS field, CASE WHEN k.unit_id IS NULL OR up + dn + fl > 1 THEN 'absent'
    ELSE trim(sentence) END AS value FROM un LEFT JOIN (SELECT * FROM kd WHERE place = 0) k USING (unit_id)
UNION ALL SELECT unit_id, 'direction.enum', CASE WHEN up = 1 THEN 'up' WHEN dn = 1 THEN 'down'
    WHEN fl = 1 THEN 'flat' ELSE 'unclassified' END FROM kd WHERE place = 0 AND up + dn + fl <= 1
UNION ALL SELECT un.unit_id, 'mention', coalesce(trim(sentence), 'absent') FROM un
  LEFT JOIN (SELECT * FROM hit WHERE place = 1) k USING (unit_id)
UNION ALL SELECT un.unit_id, 'origin', CASE WHEN k.unit_id IS NULL THEN 'absent' WHEN val = 0 THEN 'north'
    ELSE 'south' END FROM un LEFT JOIN (SELECT * FROM hit WHERE place = 2) k USING (unit_id)
UNION ALL SELECT un.unit_id, 'evidence_weight', CASE WHEN k.unit_id IS NULL THEN 'none' ELSE 'strong' END
  FROM un LEFT JOIN (SELECT * FROM hit WHERE place = 2) k USING (unit_id) WHERE k.unit_id IS NULL OR val = 0""")
def cue_fields(spark, folder):
    told = doc_spans(spark, folder).withColumn("legibility", F.lit("legible"))
    fields_only = replace(PROBE, sections=PROBE.sections | {"abbreviations": {}})
    read = cues.read_fields(unit_blocks(spark, folder), told, fields_only)
    return read.filter(~F.col("field").rlike(r"\.cont")).select(
        "unit_id", "field", "value")


# --- duplicates -----------------------------------------------------------------------------

PRINTS = BASE + r"""
, pr AS (SELECT bundle_id, trim(string_agg(trim(regexp_replace(regexp_replace(
    strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g')), ' ' ORDER BY pdf_index, ord)) AS content
  FROM b WHERE type IN ('heading','paragraph','table') GROUP BY 1),
sm AS (SELECT bundle_id, to_json(list(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))
    ORDER BY trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')))) AS stamps
  FROM b WHERE type = 'stamp' GROUP BY 1),
d AS (SELECT doc_id::VARCHAR AS unit_id, 'all' AS case_id, lang AS doc_class,
    DATE '2020-01-01' + CAST(n_chars % 30 AS INTEGER) AS row_date, coalesce(content, '') AS content,
    coalesce(stamps, '[]') AS stamps
  FROM documents LEFT JOIN pr ON pr.bundle_id = doc_id::VARCHAR LEFT JOIN sm ON sm.bundle_id = doc_id::VARCHAR)"""


def document_units(spark, folder) -> DataFrame:
    """Documents as units of one case: class = language, date from the length."""
    return tables.table(spark, folder, "documents").select(
        F.lit("all").alias("case_id"), F.col("doc_id").cast("string").alias("unit_id"),
        F.col("doc_id").cast("string").alias("bundle_id"), F.col("lang").alias("doc_class"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("n_chars") % 30).cast("int")).alias("row_date"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("form_serial"))


def print_lines(spark, folder) -> DataFrame:
    """Typed lines of whole documents, no more of them than a fingerprint reads."""
    return blocks.from_lines(tables.printed(tables.document_lines(spark, folder))).select(
        F.col("bundle_id").alias("unit_id"), "pdf_index", "ord", "type", "text")


def _prints(spark, folder) -> DataFrame:
    return duplicates.fingerprints(print_lines(spark, folder), document_units(spark, folder))


def prints(spark, folder) -> DataFrame:
    return shared(spark, folder, "prints", lambda: _prints(spark, folder))


def print_keys(spark, folder) -> DataFrame:
    """Keys of the prints; the texts themselves are not written."""
    return shared(spark, folder, "print_keys", lambda: duplicates.keyed(_prints(spark, folder)))


@query("unit_fingerprint", PRINTS + """
SELECT unit_id, doc_class, row_date::VARCHAR AS row_date, length(content) AS size,
  sha256(content) AS content_id FROM d""")
def unit_fingerprint(spark, folder):
    return prints(spark, folder).select(
        "unit_id", "doc_class", F.col("row_date").cast("string").alias("row_date"),
        F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("content_id"))


@query("tree_fingerprint", PRINTS + """
SELECT unit_id, doc_class, row_date::VARCHAR AS row_date, min(unit_id) OVER (PARTITION BY content) AS same_content,
  min(unit_id) OVER (PARTITION BY stamps) AS same_marks FROM d""")
def tree_fingerprint(spark, folder):
    """Classes of equal text and of equal marks, from hash trees; no whole text is one value."""
    lines = shared(spark, folder, "print_lines", lambda: print_lines(spark, folder))
    keys = shared(spark, folder, "tree_keys", lambda: tree_prints.keyed(lines, document_units(spark, folder)))

    def first(name: str, alias: str) -> DataFrame:
        return keys.groupBy(name).agg(F.min("unit_id").alias(alias))

    return keys.join(first("content_id", "same_content"), "content_id").join(
        first("artifact_id", "same_marks"), "artifact_id").select(
        "unit_id", "doc_class", text_date("row_date"), "same_content", "same_marks")


@query("exact_duplicates", PRINTS + """
SELECT unit_id, first_id AS duplicate_of FROM (SELECT unit_id, min(unit_id) OVER (
  PARTITION BY doc_class, row_date, content, stamps) AS first_id FROM d) WHERE unit_id <> first_id""")
def exact_duplicates(spark, folder):
    return duplicates.removable(print_keys(spark, folder))


@query("duplicate_links", PRINTS + """
SELECT unit_id, min(unit_id) OVER (PARTITION BY doc_class, row_date, content, stamps) AS identical_to,
  min(unit_id) OVER (PARTITION BY doc_class, row_date, content) AS same_document_as,
  count(*) OVER (PARTITION BY doc_class, row_date) AS group_units FROM d""")
def duplicate_links(spark, folder):
    return duplicates.links(print_keys(spark, folder)).drop("case_id")


@query("duplicate_report", PRINTS + """
, p AS (SELECT CASE WHEN a.content = b.content AND a.stamps = b.stamps THEN 'identical'
    WHEN a.content = b.content THEN 'same_doc_different_artifact' ELSE 'related' END AS verdict
  FROM d a JOIN d b ON a.doc_class = b.doc_class AND a.row_date = b.row_date AND a.unit_id < b.unit_id)
SELECT 'all' AS case_id, verdict, count(*) AS pairs FROM p GROUP BY 1, 2""")
def duplicate_report(spark, folder):
    """Verdicts of all pairs, counted without forming a pair."""
    return duplicates.report(print_keys(spark, folder))


@query("near_duplicates")
def near_duplicate_removal(spark, folder):
    """Removal where very similar text is the same text; checked by brute force in the tests."""
    from ...operators import near_duplicates

    return near_duplicates.removable(prints(spark, folder))


@query("derived_keys", """
SELECT doc_id, substr(sha256(sha256(text) || '|' || lang || '|v1'), 1, 32) AS derived_key
FROM documents WHERE substr(sha256(sha256(text) || '|' || lang || '|v1'), 1, 32) NOT IN
  (SELECT substr(sha256(sha256(text) || '|' || lang || '|v1'), 1, 32) FROM documents JOIN labels USING (doc_id))""")
def derived_keys(spark, folder):
    """Documents whose content no labelled document has: what a second run must still do."""
    docs = tables.table(spark, folder, "documents").select(
        "doc_id", blocks.derived_key(F.sha2("text", 256), F.col("lang"), F.lit("v1")).alias("derived_key"))
    done = docs.join(tables.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return blocks.only_changed(docs, done)
