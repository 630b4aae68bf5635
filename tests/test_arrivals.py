"""Bundles that arrive one after the other: the state equals a run over everything at once."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import assemble, blocks, pages, report
from chronoloom.plans import chronology, manifest
from chronoloom.plans.queries import casefiles
from chronoloom.plans.queries import intake as queries
from chronoloom.session import cut, shared_folder
from chronoloom.sources import tables
from chronoloom.streaming import intake
from chronoloom.streaming.state import State, advance

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
PACK, SETTINGS = casefiles.PACK, casefiles.SETTINGS


def lines_of(spark, second):
    items = tables.table(spark, FOLDER, "lineitem").where("l_orderkey < 50")
    orders = tables.table(spark, FOLDER, "orders").where("o_orderkey < 50").withColumn(
        "o_custkey", F.col("o_custkey") % 3)
    return cut(tables.written_lines(*queries.arrival(items, orders, second)))


def told(df, *drop):
    return sorted(map(str, df.drop("batch", *drop).collect()))


@pytest.fixture(scope="module")
def made(spark):
    state = State(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    parts = [lines_of(spark, False), lines_of(spark, True)]
    advance(state, parts[0], intake.pages_of(parts[0]), 0, PACK, SETTINGS)
    first = told(state.log("row_counts", 1))
    state.approve(state.log("arrived", 1), 0)
    advance(state, parts[1], intake.pages_of(parts[1]), 1, PACK, SETTINGS)
    return state, parts, first


def test_state_equals_a_run_over_everything(spark, made):
    state, (old, new), _ = made
    came = new.select("bundle_id").distinct()
    merged = cut(old.join(came, "bundle_id", "left_anti").unionByName(new))
    typed = cut(blocks.from_lines(merged))
    whole = manifest.build(typed, intake.pages_of(merged), PACK, SETTINGS)
    labels = pages.confirm_labels(pages.label_candidates(typed))
    want = chronology.build(whole, labels, PACK, SETTINGS)

    read = {n: spark.read.parquet(f"{state.root}/{n}/batch=1") for n in ("rows", "bullets", "locators")}
    ids = state.log("touched", 2).select("row_id", F.lit(2).alias("limit")).distinct()
    got = {n: state.rows(n, 2, df.schema, ids) for n, df in read.items()}
    # Whose claim a row belongs to is a matter of the whole case, and not of the state.
    assert told(got["rows"].drop("claim_event", "claim_rule")) == told(
        want.rows.drop("claim_event", "claim_rule").select(*got["rows"].drop("claim_event", "claim_rule").columns))
    assert told(got["bullets"]) == told(want.bullets.select(*got["bullets"].columns))
    assert told(got["locators"]) == told(want.locators.select(*got["locators"].columns))
    plan = report.plan_summary(
        assemble.bucket(whole.units, PACK), intake.pages_of(merged).groupBy("case_id", "bundle_id").agg(
            F.count(F.lit(1)).alias("page_count")), PACK)
    assert told(spark.read.parquet(f"{state.root}/plan/batch=1")) == told(plan)


def test_delta_tells_new_gained_changed_and_dropped_rows(spark, made):
    state, _, _ = made
    kinds = {r["change"] for r in spark.read.parquet(f"{state.root}/delta/batch=1").collect()}
    assert {"new", "gained_locator", "dropped"} <= kinds
    for r in spark.read.parquet(f"{state.root}/summary/batch=1").collect():
        assert "inchangées" in r["summary"] and r["unchanged"] >= 0


def test_a_batch_that_runs_again_changes_nothing(spark, made):
    state, (_, new), first = made
    names = ("units", "candidates", "rows", "bullets", "locators", "touched", "delta", "summary", "plan")
    before = {n: told(spark.read.parquet(f"{state.root}/{n}/batch=1")) for n in names}
    advance(state, new, intake.pages_of(new), 1, PACK, SETTINGS)
    assert {n: told(spark.read.parquet(f"{state.root}/{n}/batch=1")) for n in names} == before
    assert told(state.log("row_counts", 1)) == first


def test_the_same_bundles_again_change_no_row(spark, made):
    state, (_, new), _ = made
    state.approve(state.log("arrived", 2), 1)
    advance(state, new, intake.pages_of(new), 2, PACK, SETTINGS)
    rows = spark.read.parquet(f"{state.root}/delta/batch=2")
    assert rows.where("change <> 'unchanged'").count() == 0 and rows.count() > 0
    assert {r["summary"] for r in spark.read.parquet(f"{state.root}/summary/batch=2").collect()} == {
        "aucun changement depuis la version approuvée"}
