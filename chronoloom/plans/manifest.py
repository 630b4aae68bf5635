"""From typed blocks to described units: the manifest of a corpus, all cases at once."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import boundaries, classify, corrections, dates, units
from ..operators.matching import document_hits
from ..session import cut


@dataclass(frozen=True)
class Settings:
    """What a run may vary.  Kept with the run, so two runs can be compared."""

    rejoin: bool = False
    screen: bool = False
    use_templates: bool = True
    today: dt.date = field(default_factory=dt.date.today)
    packs: tuple[str, ...] = rules.INSTALLED


@dataclass(frozen=True)
class Manifest:
    units: DataFrame
    pages: DataFrame
    blocks: DataFrame
    facts: DataFrame
    gaps: DataFrame


@dataclass(frozen=True)
class Dated:
    """Pages grouped into units, and the dates on them: all that the dates of a corpus need."""

    grouped: DataFrame
    spans: DataFrame
    members: DataFrame
    facts: DataFrame


def date_units(blocks: DataFrame, pages: DataFrame, pack: rules.Pack, settings: Settings) -> Dated:
    signals = boundaries.page_signals(blocks, pages, pack)
    grouped = boundaries.group_pages(signals)
    groups = units.page_groups(grouped)
    if settings.rejoin:
        groups = units.rejoin(groups)
    groups = cut(groups)
    spans = units.unit_spans(groups)
    members = units.unit_pages(grouped, groups, spans)
    # Dates are looked for where the lines are; only what is found goes to its unit.
    found = dates.find_dates(blocks, dates.year_anchors(blocks), pack, settings.today)
    facts = cut(units.unit_blocks(found, members).select(*[
        c for name in found.columns for c in ((name, "unit_id") if name == "bundle_id" else (name,))]))
    return Dated(grouped, spans, members, facts)


def build(blocks: DataFrame, pages: DataFrame, pack: rules.Pack, settings: Settings,
          fixes: DataFrame | None = None, dated: Dated | None = None) -> Manifest:
    """Describe every unit of the corpus under one primary pack.

    ``dated``: the same blocks and pages as ``date_units`` leaves them, if that was done before.
    """
    dated = dated or date_units(blocks, pages, pack, settings)
    spans, members, facts = dated.spans, dated.members, dated.facts
    # Read by every step below, so written once.
    placed = cut(units.unit_blocks(blocks, members))
    heads = units.headline(members)

    packs = [rules.load(p) for p in settings.packs] if settings.screen else []
    patterns = [p for c in pack.classes for p in c.get("body", [])]
    patterns += [p for k in packs for s in ("strong", "weak") for p in k.identity.get(s, [])]
    hits = cut(document_hits(classify.body_of(placed), patterns))

    classes = cut(classify.classify(placed, heads, pack, hits))
    readable = cut(classify.legibility(placed, spans))
    described = classes.select("unit_id", "doc_class").join(
        readable.select("unit_id", "legibility"), "unit_id")
    chosen = dates.select_row_dates(facts, described, pack)
    verdicts = classify.exclusions(
        placed,
        classes.select("unit_id", "doc_class").join(
            classify.clinical_content(placed), "unit_id", "left"),
        pack)
    regimes = (
        classify.screen_regimes(placed, heads, packs, pack.id, hits) if settings.screen else None)
    built = units.build(spans, heads, classes, readable, chosen, verdicts, regimes, pack.id)
    if fixes is not None:
        built = corrections.apply_to_units(built, fixes)
    built = cut(built)
    return Manifest(built, members, placed, facts, boundaries.missing_sheets(dated.grouped))


def describe_cases(blocks: DataFrame, pages: DataFrame, cases: DataFrame, settings: Settings,
                   fixes: DataFrame | None = None) -> DataFrame:
    """Units of cases that differ in their primary pack: one pass per pack, then a union.

    A case whose pack is not among ``settings.packs`` is an error, not a case without units.
    """
    other = cases.filter(~F.coalesce(F.col("primary_pack").isin(list(settings.packs)), F.lit(False)))
    found = other.select("case_id", "primary_pack").first()
    if found is not None:
        raise ValueError(f"case {found.case_id} needs pack {found.primary_pack}, which is not loaded")
    parts = []
    for pack_id in settings.packs:
        mine = cases.filter(F.col("primary_pack") == pack_id).select("case_id")
        part = build(
            blocks.join(mine, "case_id", "left_semi"), pages.join(mine, "case_id", "left_semi"),
            rules.load(pack_id), settings, fixes)
        parts.append(part.units)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
