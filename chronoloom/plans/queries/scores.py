"""Queries that score, compare and measure runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import scoring
from ...sources import tables
from . import facts
from .registry import query, shared

KEY = """
un AS (SELECT l_orderkey::VARCHAR AS case_id, l_orderkey || '-' || l_returnflag AS unit_id,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS unit_ord, l_returnflag AS doc_class,
    CAST(min(l_shipdate) AS DATE) AS row_date FROM lineitem GROUP BY ALL),
gd AS (SELECT l_orderkey::VARCHAR AS case_id, l_orderkey || '#' || l_linestatus AS gold_id,
    CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS gold_ord, min(l_returnflag) AS doc_class,
    CAST(min(l_shipdate) AS DATE) + CAST(l_orderkey % 5 AS INTEGER) AS row_date
  FROM lineitem GROUP BY l_orderkey, l_linestatus),
pu AS (SELECT DISTINCT l_orderkey::VARCHAR AS case_id, l_orderkey || '-' || l_returnflag AS unit_id, l_linenumber AS pg FROM lineitem),
pk AS (SELECT DISTINCT l_orderkey::VARCHAR AS case_id, l_orderkey || '#' || l_linestatus AS gold_id, l_linenumber AS pg FROM lineitem),
ov AS (SELECT pu.case_id, gold_id, unit_id, count(*) / (any_value(nu) + any_value(ng) - count(*)) AS overlap
  FROM pu JOIN pk USING (case_id, pg) JOIN (SELECT unit_id, count(*) AS nu FROM pu GROUP BY 1) USING (unit_id)
  JOIN (SELECT gold_id, count(*) AS ng FROM pk GROUP BY 1) USING (gold_id) GROUP BY 1, 2, 3),
o2 AS (SELECT ov.*, gold_ord, unit_ord FROM ov JOIN gd USING (case_id, gold_id) JOIN un USING (case_id, unit_id)),
m0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overlap DESC, unit_ord) AS rn
  FROM o2 WHERE gold_ord = 0) WHERE rn = 1),
m1 AS (SELECT * FROM (SELECT o2.*, row_number() OVER (PARTITION BY o2.case_id ORDER BY o2.overlap DESC, o2.unit_ord) AS rn
  FROM o2 ANTI JOIN m0 USING (case_id, unit_id) WHERE o2.gold_ord = 1) WHERE rn = 1),
mt AS (SELECT case_id, gold_id, unit_id, overlap FROM m0 UNION ALL SELECT case_id, gold_id, unit_id, overlap FROM m1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _items(spark, folder):
    """Line items as pages of engine units (by return flag) and of key units (by status)."""
    return tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"), "l_orderkey", "l_returnflag", "l_linestatus",
        F.concat_ws("-", "l_orderkey", "l_returnflag").alias("unit_id"),
        F.concat_ws("#", "l_orderkey", "l_linestatus").alias("gold_id"),
        F.col("l_linenumber").alias("pdf_index"), F.to_date("l_shipdate").alias("day"))


def _key_units(spark, folder):
    items = _items(spark, folder)
    # Grouped by the ids alone, which name flag and status, so that joins on them need no other shuffle.
    units = items.groupBy("case_id", "unit_id").agg(
        F.min("l_returnflag").alias("doc_class"), F.min("day").alias("row_date")).withColumns({
            "unit_ord": F.when(F.col("doc_class") == "A", 0).when(F.col("doc_class") == "N", 1).otherwise(2),
            "regime": F.lit("cnesst"), "excluded_by": F.lit(None).cast("string")})
    gold = items.groupBy("case_id", "gold_id").agg(
        F.min("l_linestatus").alias("l_linestatus"), F.min("l_orderkey").alias("l_orderkey"),
        F.min("l_returnflag").alias("doc_class"), F.min("day").alias("day")).select(
        "case_id", "gold_id", F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("gold_ord"),
        "doc_class", F.date_add("day", (F.col("l_orderkey") % 5).cast("int")).alias("row_date"),
        F.lit(None).cast("string").alias("regime"), F.lit(None).cast("string").alias("excluded_by"))
    return units, gold


def _overlaps(spark, folder):
    """Overlaps of distinct pages.  Matching writes the pairs it tries, so they are not written before."""
    items = _items(spark, folder)
    return scoring.overlaps(
        items.select("case_id", "unit_id", "pdf_index"), items.select("case_id", "gold_id", "pdf_index"))


def _matched(spark, folder):
    units, gold = _key_units(spark, folder)
    return shared(spark, folder, "key_matched", lambda: scoring.match_units(
        _overlaps(spark, folder), gold.select("case_id", "gold_id", "gold_ord"),
        units.select("case_id", "unit_id", "unit_ord")))


@query("page_overlap", _with(KEY) + """
SELECT case_id, gold_id, unit_id, round(overlap, 6) AS overlap FROM ov""")
def page_overlap(spark, folder):
    return _overlaps(spark, folder).withColumn("overlap", F.round("overlap", 6))


@query("unit_match", _with(KEY) + "SELECT case_id, gold_id, unit_id, round(overlap, 6) AS overlap FROM mt")
def unit_match(spark, folder):
    return _matched(spark, folder).select(
        "case_id", "gold_id", "unit_id", F.round("overlap", 6).alias("overlap"))


@query("spurious_units", _with(KEY) + "SELECT case_id, unit_id FROM un ANTI JOIN mt USING (case_id, unit_id)")
def spurious_units(spark, folder):
    units, _ = _key_units(spark, folder)
    return scoring.spurious_units(units, _matched(spark, folder)).select("case_id", "unit_id")


@query("date_accuracy", _with(KEY) + """
SELECT gold_id, CASE WHEN un.row_date IS NULL THEN 'missing' WHEN un.row_date = gd.row_date THEN 'exact'
  WHEN abs(un.row_date - gd.row_date) <= 3 THEN 'near' ELSE 'wrong' END AS verdict
FROM gd LEFT JOIN mt USING (case_id, gold_id) LEFT JOIN un USING (case_id, unit_id)""")
def date_accuracy(spark, folder):
    units, gold = _key_units(spark, folder)
    paired = gold.select("case_id", "gold_id", F.col("row_date").alias("want")).join(
        _matched(spark, folder).select("case_id", "gold_id", "unit_id"), ["case_id", "gold_id"], "left"
    ).join(units.select("case_id", "unit_id", F.col("row_date").alias("got")), ["case_id", "unit_id"], "left")
    return paired.select("gold_id", scoring.date_accuracy(F.col("got"), F.col("want")).alias("verdict"))


@query("manifest_score", _with(KEY, """
j AS (SELECT gd.case_id, mt.overlap, mt.unit_id IS NOT NULL AS has, un.doc_class = gd.doc_class AS cls,
    abs(un.row_date - gd.row_date) AS off, un.doc_class = 'A' AS held, gd.case_id::BIGINT % 5 = 0 AS out,
    CASE WHEN gd.case_id::BIGINT % 2 = 0 THEN 'cnesst' WHEN gd.case_id::BIGINT % 3 = 0 THEN 'saaq' END AS reg
  FROM gd LEFT JOIN mt USING (case_id, gold_id) LEFT JOIN un USING (case_id, unit_id)),
s AS (SELECT case_id, 'boundary_exact' AS name, count(*) FILTER (WHERE overlap = 1) AS hits, count(*) AS total FROM j GROUP BY 1
  UNION ALL SELECT case_id, 'class_agreement', count(*) FILTER (WHERE has AND cls), count(*) FILTER (WHERE has) FROM j GROUP BY 1
  UNION ALL SELECT case_id, 'date_exact', count(*) FILTER (WHERE has AND off = 0), count(*) FILTER (WHERE has) FROM j GROUP BY 1
  UNION ALL SELECT case_id, 'date_within_3d', count(*) FILTER (WHERE has AND off <= 3), count(*) FILTER (WHERE has) FROM j GROUP BY 1
  UNION ALL SELECT case_id, 'regime_agreement', count(*) FILTER (WHERE has AND reg = 'cnesst'), count(*) FILTER (WHERE has AND reg IS NOT NULL) FROM j GROUP BY 1
  UNION ALL SELECT case_id, 'exclusion_agreement', count(*) FILTER (WHERE has AND out AND held), count(*) FILTER (WHERE has AND out) FROM j GROUP BY 1)""") + """
SELECT case_id, name, hits, total, round(coalesce(hits / nullif(total, 0), 1), 6) AS value FROM s""")
def manifest_score(spark, folder):
    """All six scores; keys state a regime for most cases and an exclusion for every fifth."""
    units, gold = _key_units(spark, folder)
    number = F.col("case_id").cast("long")
    units = units.withColumn("excluded_by", F.when(F.col("doc_class") == "A", F.lit("rule.x")))
    gold = gold.withColumns({
        "regime": F.when(number % 2 == 0, "cnesst").when(number % 3 == 0, "saaq"),
        "excluded_by": F.when(number % 5 == 0, F.lit("rule.x"))})
    return scoring.manifest_score(gold, _matched(spark, folder), units).select(
        "case_id", "name", "hits", "total", F.round("value", 6).alias("value"))


@query("field_recall", _with(KEY) + """
SELECT mt.case_id, 'field_recall' AS name, count(*) FILTER (WHERE CASE
    WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 <> 0 WHEN o_orderkey % 4 = 0 THEN FALSE
    WHEN o_orderkey % 7 = 0 THEN FALSE ELSE TRUE END) AS hits, count(*) AS total
FROM mt JOIN orders ON o_orderkey::VARCHAR = mt.case_id GROUP BY 1""")
def field_recall(spark, folder):
    """Keys ask for the order priority, or that there be one; the run found it, another, or none."""
    key = F.col("o_orderkey")
    orders = tables.table(spark, folder, "orders").select(
        key, "o_orderpriority", key.cast("string").alias("case_id"))
    want = _key_units(spark, folder)[1].select("case_id", "gold_id").join(orders, "case_id").select(
        "case_id", "gold_id", F.lit("priority").alias("field"),
        F.when(key % 3 == 0, "present").otherwise(F.col("o_orderpriority")).alias("expected"))
    units = _key_units(spark, folder)[0].select("case_id", "unit_id").join(orders, "case_id")
    read = units.select(
        "unit_id", F.lit("priority").alias("field"),
        F.when(key % 4 == 0, "absent").when(key % 7 == 0, "quite another thing")
        .otherwise(F.concat(F.lower("o_orderpriority"), F.lit(" "))).alias("value"))
    return scoring.field_recall(want, _matched(spark, folder), read).select(
        "case_id", "name", "hits", "total")


@query("run_score", """
WITH d AS (SELECT 'o' || user_id AS unit_id, CAST(floor(value) AS INTEGER) AS n FROM events
  WHERE event_type = 'purchase'),
c AS (SELECT 'c' || o_custkey AS case_id, d.* FROM d JOIN orders ON 'o' || o_orderkey = unit_id WHERE n % 11 <> 0)
SELECT case_id, 'not_truncated' AS name, count(*) FILTER (WHERE n % 10 <> 3) AS hits, count(*) AS total,
  count(*) FILTER (WHERE n % 10 <> 3) = count(*) AS holds FROM c GROUP BY 1
UNION ALL SELECT case_id, 'groundedness', CAST(sum(n - n % 2) AS BIGINT), CAST(sum(n) AS BIGINT),
  sum(n - n % 2) = sum(n) FROM c GROUP BY 1""")
def run_score(spark, folder):
    return scoring.run_score(tables.audit_log(spark, folder), tables.order_units(spark, folder)).select(
        "case_id", "name", "hits", "total", "holds")


@query("render_score", facts._with(facts.UNITS, facts.ENCOUNTERS, facts.MERGED, facts.BULLETS) + """
SELECT case_id, 'cited' AS name, count(*) AS hits, count(*) AS total, TRUE AS holds
FROM bl JOIN rws USING (row_id) GROUP BY 1
UNION ALL SELECT case_id, 'page_coverage', count(*), count(*), TRUE FROM bk GROUP BY 1""")
def render_score(spark, folder):
    gate = facts.release_gate(spark, folder)
    return scoring.render_score(
        gate, facts.encounter_bullets(spark, folder), facts.encounter_rows(spark, folder)
    ).select("case_id", "name", "hits", "total", "holds")


@query("must_hold", facts._with(facts.UNITS, facts.ENCOUNTERS) + """
SELECT case_id, 'dated' AS name, count(*) FILTER (WHERE row_date IS NOT NULL) AS hits, count(*) AS total,
  round(count(*) FILTER (WHERE row_date IS NOT NULL) / count(*), 6) AS value,
  count(*) FILTER (WHERE row_date IS NOT NULL) / count(*) >= 0.9 AS holds FROM e GROUP BY 1""")
def must_hold(spark, folder):
    counts = facts.encounters(spark, folder).groupBy("case_id").agg(
        F.count("row_date").alias("dated"), F.count(F.lit(1)).alias("units"))
    return scoring.score_table(counts, {"dated": ("dated", "units", 0.9)}, ["case_id"]).select(
        "case_id", "name", "hits", "total", F.round("value", 6).alias("value"), "holds")


@query("score_deltas", facts._with(facts.UNITS, facts.ENCOUNTERS, """
s AS (SELECT case_id, count(*) FILTER (WHERE row_date IS NOT NULL AND bundle_id <> 'b3')
    / nullif(count(*) FILTER (WHERE bundle_id <> 'b3'), 0) AS a,
  count(*) FILTER (WHERE row_date IS NOT NULL) / count(*) AS z FROM e GROUP BY 1)""") + """
SELECT case_id, 'dated' AS name, round(coalesce(a, 1), 6) AS baseline, round(z, 6) AS candidate,
  abs(z - coalesce(a, 1)) > 1e-9 AS moved FROM s""")
def score_deltas(spark, folder):
    def scored(units):
        counts = units.groupBy("case_id").agg(
            F.count("row_date").alias("dated"), F.count(F.lit(1)).alias("units"))
        return scoring.score_table(counts, {"dated": ("dated", "units", None)}, ["case_id"])

    units = facts.encounters(spark, folder)
    moved = scoring.score_deltas(
        scored(units.filter(F.col("bundle_id") != facts.NEW_BUNDLE)), scored(units))
    return moved.select("case_id", "name", F.round("baseline", 6).alias("baseline"),
                        F.round("candidate", 6).alias("candidate"), "moved")


SHADOW = facts._with(
    facts.UNITS, facts.ENCOUNTERS, facts.BULLETS, facts._run_sql("a", "bundle_id <> 'b3'"),
    facts._run_sql("z", "TRUE"), """
ka AS (SELECT * FROM (SELECT r_a.*, row_number() OVER (PARTITION BY r_a.case_id, r_a.row_date, title ORDER BY
    l.author DESC, l.doc_class DESC, mp DESC, r_a.row_id DESC) AS rn FROM r_a JOIN ld_a l USING (row_id)
  JOIN (SELECT row_id, min(first_page) AS mp FROM bk_a GROUP BY 1) USING (row_id)) WHERE rn = 1),
kz AS (SELECT * FROM (SELECT r_z.*, row_number() OVER (PARTITION BY r_z.case_id, r_z.row_date, title ORDER BY
    l.author DESC, l.doc_class DESC, mp DESC, r_z.row_id DESC) AS rn FROM r_z JOIN ld_z l USING (row_id)
  JOIN (SELECT row_id, min(first_page) AS mp FROM bk_z GROUP BY 1) USING (row_id)) WHERE rn = 1),
j AS (SELECT coalesce(a.case_id, z.case_id) AS case_id, a.row_id AS ra, z.row_id AS rz, a.texts AS ta, z.texts AS tz
  FROM ka a FULL JOIN kz z ON a.case_id = z.case_id AND a.row_date IS NOT DISTINCT FROM z.row_date AND a.title = z.title)""")


@query("shadow_diff", SHADOW + """
SELECT case_id, count(*) FILTER (WHERE ra IS NULL OR rz IS NULL OR ta <> tz) AS rows_changed,
  greatest(count(ra), count(rz)) AS rows_total FROM j GROUP BY 1""")
def shadow_diff(spark, folder):
    """Two runs side by side, rows met by date and title."""
    before = facts._run(spark, folder, "before", F.col("bundle_id") != facts.NEW_BUNDLE)
    after = facts._run(spark, folder, "after", F.lit(True))
    return scoring.shadow_rows(before[0], before[1], after[0], after[1])


@query("product_metrics", facts._with(facts.UNITS, facts.ENCOUNTERS, facts.MERGED, facts.BULLETS, facts.CONFIDENT, """
t AS (SELECT DISTINCT row_id FROM bk WHERE unit_id IN (SELECT 'o' || user_id FROM events)),
m AS (SELECT rc.*, t.row_id IS NOT NULL AS touched,
    date_status IN ('undated','ambiguous','illegible','inferred') OR confidence <= 0.75 AS flagged
  FROM rc LEFT JOIN t USING (row_id))""") + """
SELECT case_id, count(*) AS "rows", count(*) FILTER (WHERE NOT touched) AS accepted_unedited,
  count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE flagged AND touched) AS corrected,
  count(*) FILTER (WHERE NOT flagged AND touched) AS missed,
  round(count(*) FILTER (WHERE flagged AND touched) / nullif(count(*) FILTER (WHERE flagged), 0), 6) AS precision,
  round(count(*) FILTER (WHERE flagged AND touched) / nullif(count(*) FILTER (WHERE touched), 0), 6) AS recall,
  round(count(*) FILTER (WHERE NOT touched) / count(*), 6) AS accept_rate
FROM m GROUP BY 1""")
def product_metrics(spark, folder):
    out = scoring.product_metrics(
        facts.confident_rows(spark, folder), facts.encounters(spark, folder).select("row_id", "unit_id"),
        tables.event_log(spark, folder))
    return out.select(
        "case_id", "rows", "accepted_unedited", "flagged", "corrected", "missed",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accept_rate")])


