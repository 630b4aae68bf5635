"""Dates: found with their place, read in every plausible way, given a role, one chosen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..rules import Pack
from ..schemas import ELIGIBLE_ROLES

# --- Fixed values: month names, patterns and result wordings --------------------------------
MONTHS = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11,
    "décembre": 12, "decembre": 12,
}
YEAR = r"\b(19|20)\d{2}\b"
#: A signature that ends in the number of the one who signs, as in "Signé: Dr Martin 1950".
SIGNER_NUMBER = r"(?u)^(\s*(?:[Ss]ign|[Aa]pprouv).*\bDre?\.?(?:\s+\p{Lu}[\p{L}'’-]*)+)\s+\d+\s*$"
NUMERIC = r"\b(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})\b"
TEXTUAL = r"\b(\d{1,2})\s*(?:er)?\s+(" + "|".join(MONTHS) + r")\s+(\d{4})\b"
LOOKBACK_YEARS = 30
WORDING = {
    "illegible": "Unit is illegible; no date read and no model call permitted.",
    "picked": "Role %s selected from '%s'%s%s",
    "century": " (century resolved against the file's own year anchors)",
    "suppressed": "; %d structurally ineligible date(s) present (%s).",
    "ambiguous": "'%s' has %d plausible readings (%s); needs a human.",
    "unranked": "No %s date found for %s; used the earliest eligible date, role %s.",
    "unlabelled": (
        "No labelled date for %s; used '%s', the first of %d date(s) on the unit carrying no"
        " recognised label. Needs a human to confirm which date this row belongs to."),
    "none": "No date found anywhere in the unit.",
    "only_ineligible": (
        "Dates found but all structurally ineligible to be the row date (%s); the unit needs a"
        " date from a human."),
}
# -------------------------------------------------------------------------------------------


def year_anchors(blocks: DataFrame) -> DataFrame:
    """Earliest and latest four-digit year each bundle states, over all its blocks.

    A number that belongs to the name of the one who signs is no year.
    """
    text = F.regexp_replace("text", SIGNER_NUMBER, "$1")
    years = F.transform(
        F.regexp_extract_all(text, F.lit(tx.rx(YEAR, case=True)), F.lit(0)),
        lambda y: y.cast("int"))
    return (
        blocks.select("bundle_id", years.alias("y")).filter(F.size("y") > 0)
        .groupBy("bundle_id")
        .agg(F.min(F.array_min("y")).alias("first_year"), F.max(F.array_max("y")).alias("last_year"))
    )


def _date(y: Column, m: Column, d: Column) -> Column:
    """A calendar date, null where there is none such."""
    return F.when(
        (y >= 1) & m.between(1, 12) & d.between(1, 31),
        F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))


def _part(raw: Column, index: int) -> Column:
    return F.regexp_extract(raw, r"^(\d+)[-/.](\d+)[-/.](\d+)$", index)


def numeric_readings(raw: Column, first_year: Column, today: dt.date) -> Column:
    """All plausible dates of a numeric date, most likely order first."""
    a, b, c = (_part(raw, i) for i in (1, 2, 3))
    ai, bi, ci = (x.try_cast("int") for x in (a, b, c))

    def centuries(two: Column) -> Column:
        possible = F.filter(F.array(two + 1900, two + 2000), lambda y: y <= today.year)
        near = F.filter(possible, lambda y: y >= first_year - LOOKBACK_YEARS)
        return F.when(first_year.isNotNull() & (F.size(near) > 0), near).otherwise(possible)

    short = F.concat(
        F.transform(centuries(ai), lambda y: _date(y, bi, ci)),
        F.transform(centuries(ci), lambda y: _date(y, bi, ai)),
    )
    read = (
        F.when(F.length(a) == 4, F.array(_date(ai, bi, ci)))
        .when(F.length(c) == 4, F.array(_date(ci, bi, ai)))
        .otherwise(short)
    )
    return F.array_distinct(F.filter(read, lambda d: d <= F.lit(today)))


def textual_reading(raw: Column, today: dt.date) -> Column:
    number = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.element_at(number, F.lower(F.regexp_extract(raw, tx.rx(TEXTUAL), 2)))
    day = F.regexp_extract(raw, tx.rx(TEXTUAL), 1).try_cast("int")
    year = F.regexp_extract(raw, tx.rx(TEXTUAL), 3).try_cast("int")
    return F.filter(F.array(_date(year, month, day)), lambda d: d <= F.lit(today))


def date_role(text: Column, start: Column, pack: Pack) -> Column:
    """Role of the cue nearest to the left of a date; of the line's last cue if none is left.

    A greedy prefix finds the last place a cue starts.  One pattern per role, so the number of
    expressions follows the roles and not the cues.
    """
    def nearest(scope: Column) -> Column:
        found = []
        for place, (role, cues) in enumerate(pack.role_cues.items()):
            if not cues:
                continue
            prefix = F.regexp_extract(scope, tx.rx(rf"(?s)^(.*)(?:{tx.any_of(cues)})"), 1)
            found.append(F.when(tx.hits_any(scope, cues), F.struct(
                F.length(prefix).alias("at"), F.lit(-place).alias("place"),
                F.lit(role).alias("role"))))
        return F.array_max(F.array(*found))["role"] if found else F.lit(None).cast("string")

    left = F.substring(text, F.lit(1), start)
    return F.coalesce(nearest(left), nearest(text), F.lit("unknown"))


def find_dates(blocks: DataFrame, anchors: DataFrame, pack: Pack, today: dt.date) -> DataFrame:
    """One row per date found, with place, readings and role.

    Lines without a digit are set aside first.  Columns of ``blocks`` that name the unit pass
    through.
    """
    text = F.col("text")
    dated = blocks.filter(text.rlike("[0-9]") & (tx.hits(text, NUMERIC) | tx.hits(text, TEXTUAL)))
    known = dated.join(anchors.select("bundle_id", "first_year"), "bundle_id", "left")

    def mark(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            m["raw"].alias("raw")))

    each = known.withColumn("m", F.explode(F.concat(
        mark(0, tx.matches(text, TEXTUAL)), mark(1, tx.matches(text, NUMERIC)))))
    raw, kind = F.col("m.raw"), F.col("m.kind")
    readings = F.when(kind == 0, textual_reading(raw, today)).otherwise(
        numeric_readings(raw, F.col("first_year"), today))
    inferred = (kind == 1) & (F.length(_part(raw, 1)) != 4) & (F.length(_part(raw, 3)) != 4)
    unit = ["unit_id"] if "unit_id" in blocks.columns else []
    plausible = each.select(
        "case_id", "bundle_id", *unit, "block_id", "pdf_index", "ord", "text", "confidence",
        F.col("m.start").alias("start"), F.col("m.end").alias("end"), kind.alias("kind"),
        raw.alias("raw"), readings.alias("readings"), inferred.alias("century_inferred"),
    ).filter(F.size("readings") > 0)
    return plausible.withColumn("role", date_role(text, F.col("start"), pack)).drop("text")


def select_row_dates(facts: DataFrame, units: DataFrame, pack: Pack) -> DataFrame:
    """The one date a unit is filed under, with status and a one-line account.

    ``units``: unit_id, doc_class, legibility.  The choice is a minimum over a key per fact,
    combined before the shuffle; only the three alternatives of an unlabelled date need a rank.
    """
    by_class = pack.priorities
    fallback = by_class.get("unknown", [])
    roles = F.array(*[F.lit(r) for r in fallback]).cast("array<string>")
    if by_class:
        table = F.create_map(*[
            x for name, ranked in by_class.items()
            for x in (F.lit(name), F.array(*[F.lit(r) for r in ranked]).cast("array<string>"))
        ])
        roles = F.coalesce(F.try_element_at(table, F.col("doc_class")), roles)
    scoped = units.select("unit_id", "doc_class", "legibility", roles.alias("priority"))

    role = F.col("role")
    eligible = role.isin(*ELIGIBLE_ROLES)
    single = F.size("readings") == 1
    rank = F.array_position("priority", role)
    tier = (
        F.when(eligible & (rank > 0), F.lit(0)).when(eligible, F.lit(1))
        .when((role == "unknown") & single, F.lit(2))
    )
    place = F.struct(
        tier.alias("tier"), F.when(tier == 0, rank).otherwise(F.lit(0)).alias("rank"),
        "pdf_index", "start", "ord", "kind")
    fact = F.struct(
        tier.alias("tier"), "role", "readings", "raw", "block_id", "pdf_index", "start", "end",
        "century_inferred")
    placed = facts.join(scoped.select("unit_id", "priority"), "unit_id")
    chosen = placed.groupBy("unit_id").agg(
        F.min_by(fact, F.when(tier.isNotNull(), place)).alias("f"),
        F.count_if(~eligible).alias("n_other"),
        F.collect_set(F.when(~eligible, role)).alias("other_roles"),
        F.count_if((role == "unknown") & single).alias("n_unlabelled"),
    )
    order = Window.partitionBy("unit_id").orderBy("pdf_index", "start", "ord", "kind")
    next_three = (
        facts.filter((role == "unknown") & single)
        .select("unit_id", "pdf_index", "start", "ord", "kind", F.col("readings")[0].alias("d"))
        .withColumn("nth", F.row_number().over(order)).filter("nth <= 4").filter("nth > 1")
        .groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("nth", "d"))).alias("more"))
    )
    out = scoped.join(chosen, "unit_id", "left").join(next_three, "unit_id", "left")

    f = F.col("f")
    picked, first = f["tier"], F.get(f["readings"], F.lit(0))
    ambiguous = F.size(f["readings"]) > 1
    others = F.array_join(F.array_sort("other_roles"), ", ")
    tail = F.when(
        F.col("n_other") > 0, F.format_string(WORDING["suppressed"], "n_other", others)
    ).otherwise(".")
    century = F.when(f["century_inferred"], F.lit(WORDING["century"])).otherwise("")
    listed = F.array_join(F.transform(f["readings"], lambda d: d.cast("string")), ", ")
    rest = F.slice(f["readings"], 2, 100)
    nothing = F.array().cast("array<date>")

    def decide(value: Column, status: Column, role_: Column, why: Column, more: Column) -> Column:
        return F.struct(
            value.cast("date").alias("row_date"), status.alias("date_status"),
            role_.cast("string").alias("date_role"), why.alias("date_explanation"),
            more.alias("date_alternatives"))

    confirmed = F.when(f["century_inferred"], F.lit("inferred")).otherwise("resolved")
    null = F.lit(None)
    verdict = (
        F.when(F.col("legibility") == "illegible", decide(
            null, F.lit("illegible"), null, F.lit(WORDING["illegible"]), nothing))
        .when((picked == 0) & ambiguous, decide(
            first, F.lit("ambiguous"), f["role"],
            F.format_string(WORDING["ambiguous"], f["raw"], F.size(f["readings"]), listed), rest))
        .when(picked == 0, decide(
            first, confirmed, f["role"],
            F.format_string(WORDING["picked"], f["role"], f["raw"], century, tail), nothing))
        .when(picked == 1, decide(
            first, F.when(ambiguous, F.lit("ambiguous")).otherwise("inferred"), f["role"],
            F.format_string(WORDING["unranked"], F.array_join("priority", "/"),
                            F.col("doc_class"), f["role"]),
            F.when(ambiguous, rest).otherwise(nothing)))
        .when(picked == 2, decide(
            first, F.lit("inferred"), F.lit("unknown"),
            F.format_string(WORDING["unlabelled"], F.col("doc_class"), f["raw"],
                            F.col("n_unlabelled")),
            F.coalesce(F.transform("more", lambda m: m["d"]), nothing)))
        .otherwise(decide(
            null, F.lit("undated"), null,
            F.when(F.coalesce("n_other", F.lit(0)) == 0, F.lit(WORDING["none"]))
            .otherwise(F.format_string(WORDING["only_ineligible"], others)), nothing))
    )
    return out.select(
        "unit_id", verdict.alias("v"),
        F.concat(F.lit(f"{pack.id}.dates."), F.col("doc_class")).alias("date_rule"),
        F.when(F.col("legibility") != "illegible", f["block_id"]).alias("date_block_id"),
        F.when(F.col("legibility") != "illegible", f["start"]).alias("date_start"),
        F.when(F.col("legibility") != "illegible", f["end"]).alias("date_end"),
    ).select("unit_id", "v.*", "date_rule", "date_block_id", "date_start", "date_end")


def render_date(value: Column, status: Column) -> Column:
    """A date as printed in a row: a dash without one, a mark where it is unsure."""
    day = value.cast("string")
    return F.when(value.isNull(), F.lit("—")).when(
        status == "ambiguous", F.concat(day, F.lit(" (?)"))).otherwise(day)
