"""Written case files through the whole flow, all cases in one run."""

import datetime as dt

import fixture_pages as fp
import pytest
from pyspark.sql import functions as F

from chronoloom import rules
from chronoloom.operators import blocks, duplicates, near_duplicates, pages, report
from chronoloom.plans import chronology, manifest
from chronoloom.session import cut
from chronoloom.sinks import export

PACK = rules.load("cnesst")


@pytest.fixture(scope="module")
def corpus(spark):
    lines, sheets = fp.tables(spark)
    found = cut(blocks.from_lines(lines))
    settings = manifest.Settings(rejoin=True, screen=True, today=fp.TODAY)
    told = manifest.build(found, sheets, PACK, settings)
    labels = cut(pages.confirm_labels(pages.label_candidates(found)))
    made = chronology.build(told, labels, PACK, settings, drop_duplicates=True)
    return {"sheets": sheets, "blocks": found, "manifest": told, "labels": labels, "made": made}


@pytest.fixture(scope="module")
def units(corpus):
    return [r.asDict(recursive=True) for r in corpus["manifest"].units.collect()]


def _pages(unit):
    return [p for s in unit["spans"] for p in range(s["first"], s["last"] + 1)]


@pytest.mark.parametrize("case", list(fp.UNITS))
def test_units(units, case):
    mine = {tuple(_pages(u)): u for u in units if u["case_id"] == case}
    assert set(mine) == set(fp.UNITS[case])
    for sheets, (cls, day, status, excluded) in fp.UNITS[case].items():
        unit = mine[sheets]
        assert unit["doc_class"] == cls
        assert unit["excluded_by"] == excluded
        if status is not None:
            assert str(unit["row_date"] or "None") == str(day)
            assert unit["date_status"] == status


def test_ambiguous_date_keeps_both_readings(units):
    unit = next(u for u in units if u["date_status"] == "ambiguous")
    assert unit["row_date"] == dt.date(2003, 4, 5)
    assert unit["date_alternatives"] == [dt.date(2005, 4, 3)]


def test_nothing_is_dropped(corpus, units):
    assert sum(u["n_pages"] for u in units) == corpus["sheets"].count()


def test_regimes(units):
    got = {u["first_page"]: u["regime"] for u in units if u["case_id"] == "deux_regimes"}
    assert got == {1: "saaq", 2: "cnesst"}


def test_unbuilt_filters_are_named(units):
    kept = next(u for u in units if u["case_id"] == "bureau" and u["first_page"] == 2)
    assert kept["filters_unavailable"] == [
        "cnesst.filter.duplicate_of_included", "cnesst.filter.out_of_claim_scope"]


def test_printed_labels(corpus):
    got = {(r.bundle_id, r.pdf_index): r.printed_label for r in corpus["labels"].collect()}
    assert got[("scierie/Tome A", 1)] == "27"
    assert got[("scierie/Tome A", 3)] == "2"
    assert ("archive/Tome A", 1) not in got


def _records(corpus, case, page):
    unit = corpus["manifest"].units.filter(
        (F.col("case_id") == case) & (F.col("first_page") == page)).first().unit_id
    return {r.field: r for r in corpus["made"].records.filter(F.col("unit_id") == unit).collect()}


def test_form_fields(corpus):
    got = _records(corpus, "scierie", 5)
    assert got["consolidation"].value == "oui"
    assert (got["consolidation"].span_start, got["consolidation"].span_end) == (0, 7)
    assert got["diagnostic"].value == "Ténosynovite de De Quervain"
    rem = _records(corpus, "archive", 7)
    assert rem["apipp"].value == "rated"
    assert rem["limitations_fonctionnelles"].value == "absent" and rem["limitations_fonctionnelles"].derived
    assert rem["bareme.1"].value == '{"code": "103 499", "pct": "4"}'
    assert rem["bareme.2"].value == '{"code": "210 087", "pct": "3°1"}'
    assert rem["bareme.2"].confidence == 0.55
    assert rem["bareme.expected_count"].value == "2"


def test_cue_fields(corpus):
    got = _records(corpus, "expertise", 2)
    assert got["trajectory"].value.startswith("Nette amélioration du sommeil")
    assert got["trajectory.enum"].value == "amelioration"
    assert got["confounder.cont1"].value == "ancienne de la hanche opposée."
    assert "une chute dans un escalier" in got["intercurrent_event"].value
    assert got["procured_by"].value == "insurer_expert"
    assert got["evidence_weight"].value == "contestable"
    assert "genou gauche" in got["claimed_but_unrated"].value
    control = _records(corpus, "expertise", 1)
    assert {r.value for f, r in control.items() if f != "evidence_weight"} == {"absent"}


def test_every_record_is_cited_or_derived(corpus):
    loose = corpus["made"].records.filter(~F.col("derived") & F.col("block_id").isNull())
    assert loose.count() == 0


def test_duplicates(corpus):
    prints = cut(duplicates.fingerprints(corpus["manifest"].blocks, corpus["manifest"].units))
    where = {
        (r.bundle_id, r.first_page): r.unit_id
        for r in corpus["manifest"].units.filter("case_id = 'deux_tomes'").collect()}
    one, two = "deux_tomes/Clinique", "deux_tomes/Hôpital"
    pairs = corpus["blocks"].sparkSession.createDataFrame(
        [(where[(two, i)], where[(one, i)]) for i in (1, 2, 3)], "a string, b string")
    got = {r.a: r.verdict for r in duplicates.compare(pairs, prints).collect()}
    assert got == {where[(two, 1)]: "identical",
                   where[(two, 2)]: "same_doc_different_artifact", where[(two, 3)]: "different"}
    counted = {(r.case_id, r.verdict): r.pairs
               for r in duplicates.report(duplicates.keyed(prints)).collect()}
    assert counted == {
        ("deux_tomes", "identical"): 1, ("deux_tomes", "same_doc_different_artifact"): 1}
    removed = [tuple(r) for r in near_duplicates.removable(prints).collect()]
    assert [set(r) for r in removed] == [{where[(one, 1)], where[(two, 1)]}]


def test_rows(corpus):
    rows = [r.asDict() for r in corpus["made"].rows.collect()]
    consult = [r for r in rows if r["case_id"] == "deux_tomes" and str(r["row_date"]) == "2020-07-29"]
    assert len(consult) == 1 and consult[0]["n_units"] == 2 and consult[0]["n_bundles"] == 2
    assert [r["excluded_by"] for r in rows if r["case_id"] == "deux_tomes" and r["excluded_by"]] == [
        "dedupe.identical"]
    rem = next(r for r in rows if r["doc_class"] == "rapport_evaluation_medicale")
    assert rem["claim_event"] == dt.date(1987, 11, 30)
    assert rem["claim_rule"] == "claim_event.declared"
    assert abs(rem["confidence"] - 0.495) < 1e-9 and rem["warns"]
    assert rem["title"] == "Rapport d'évaluation médicale — Dre Odile Marchand, physiatre"


def test_bullets_use_the_pack_wording(corpus):
    texts = {r.text for r in corpus["made"].bullets.collect()}
    assert {"Consolidation : oui", "Barème 103 499 — 4 %", "Atteinte permanente : oui",
            "Facteur confondant : Les progrès restent confondus par une arthrose",
            } <= texts
    assert not any(t.startswith(("Signé", "{")) for t in texts)


def test_release_gate(corpus):
    bundles = corpus["sheets"].groupBy("case_id", "bundle_id").agg(F.count("*").alias("page_count"))
    made = corpus["made"]
    gates = report.release_gate(
        made.rows, made.locators, made.bullets, corpus["manifest"].pages, bundles).collect()
    assert len(gates) == len({case for case, _ in fp.BUNDLES}) and all(g.passes and g.coverage == 1.0 for g in gates)


def test_exports(corpus, tmp_path):
    from chronoloom.functions.ordered import running

    made = corpus["made"]
    folders = corpus["sheets"].select("bundle_id").distinct().withColumn("folder_label", F.col("bundle_id"))
    places = running(made.locators, ["row_id"], ["bundle_id", "first_page"], sums={"pos": F.lit(1)})
    places = report.display_locators(places.withColumn("pos", F.col("pos") - 1), folders, PACK)
    export.write_json(export.json_rows(made.rows, places, made.bullets), str(tmp_path / "json"))
    export.write_markdown(
        export.markdown_lines(report.display_rows(made.rows, PACK), places, made.bullets, PACK),
        str(tmp_path / "md"))
    archive = "\n".join(
        p.read_text(encoding="utf-8") for p in sorted((tmp_path / "md" / "case_id=archive").glob("*.txt")))
    assert archive.startswith("**SANS DATE — 2 documents à dater**")
    assert "| 2003-04-05 (?) | archive/Tome A<br>p. 1 |" in archive
    assert "⚠ confiance 0.50" in archive or "⚠ confiance 0.49" in archive
    read = corpus["blocks"].sparkSession.read.json(str(tmp_path / "json"))
    assert read.count() == made.rows.count()
