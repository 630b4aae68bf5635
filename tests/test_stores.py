"""The clustered block store, and a session without any settings of its surroundings."""

import os
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoloom.session import shared_folder
from chronoloom.sinks import store as sink
from chronoloom.sources import store

ROOT = Path(__file__).resolve().parents[1]


def read_rows(df):
    """Rows that the scan of a plan took from its files: those of the row groups it opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_and_scans_open_few_row_groups(spark):
    n = 400_000
    blocks = spark.range(n).select(
        F.lit("c").alias("case_id"), F.format_string("b%03d", F.col("id") % 97).alias("bundle_id"),
        (F.col("id") / 97 / 30).cast("int").alias("pdf_index"), ((F.col("id") / 97).cast("int") % 30).alias("ord"),
        F.concat(F.lit("blk_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20)).alias("block_id"),
        F.lit(62.0).alias("x0"), F.md5(F.col("id").cast("string")).alias("text"))
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    sink.write_blocks(blocks, root, "1", group_bytes=1 << 18)
    stored = store.current(spark, root, "blocks", "1")
    wanted = stored.where("bundle_id = 'b050'").select("block_id").head()[0]
    assert read_rows(stored.where(F.col("block_id") == wanted)) < n / 4
    assert read_rows(stored.where("block_id = 'blk_none'")) < n / 4
    assert read_rows(stored.where("bundle_id = 'b050'")) < n / 4
    one = store.blocks_of_bundle(stored, "b050").collect()
    assert [(r["pdf_index"], r["ord"]) for r in one] == sorted((r["pdf_index"], r["ord"]) for r in one)
    labels = spark.createDataFrame([("b050", one[0]["pdf_index"], "7")], "bundle_id string, pdf_index int, printed_label string")
    assert store.block_with_label(stored, labels, one[0]["block_id"]).head()["printed_label"] == "7"


@pytest.mark.parametrize("code", ["cut(spark.range(3)).count()"])
def test_scratch_tables_without_settings(tmp_path, code):
    """No file of defaults names a shared folder: a local session makes its own."""
    program = ("from chronoloom.session import cut, local_session, shared_folder\n"
               "spark = local_session(2)\n"
               f"assert {code} == 3\nassert shared_folder(spark) == shared_folder(spark)\n")
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", program], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_written_files_are_stored_once_in_reading_order(spark):
    """Typed lines are the clustered store itself: no copy of it, and no wide row is shuffled."""
    from chronoloom.plans.queries import casefiles

    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("no test tables")
    stored = casefiles.typed_blocks(spark, folder)
    assert stored.inputFiles() and all("/blocks/v=1/" in f for f in stored.inputFiles())
    places = stored.select("bundle_id", "pdf_index", "ord", F.input_file_name().alias("f"), F.col(
        "_metadata.row_index").alias("at")).collect()
    by_file = {}
    for r in sorted(places, key=lambda r: (r["f"], r["at"])):
        by_file.setdefault(r["f"], []).append((r["bundle_id"], r["pdf_index"], r["ord"]))
    assert all(rows == sorted(rows) for rows in by_file.values())
    ranges = sorted((rows[0], rows[-1]) for rows in by_file.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_dates_of_files_need_no_described_unit(spark, monkeypatch):
    """Every date comes from pages and lines; documents are not classified for it."""
    from chronoloom.plans import manifest
    from chronoloom.plans.queries import casefiles

    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("no test tables")
    whole = casefiles._manifest(spark, folder)
    lines = whole.blocks.select("block_id", "pdf_index", "unit_id")
    facts = whole.facts.select("block_id", "pdf_index", "unit_id")
    assert facts.count() > 0 and facts.join(lines, facts.columns, "left_anti").isEmpty()
    casefiles.kept.__globals__["_KEPT"].clear()
    monkeypatch.setattr(manifest, "document_hits", None)
    assert casefiles.casefile_dates(spark, folder).count() == whole.facts.count()


def test_labels_of_files_need_no_typed_line(spark, monkeypatch):
    """Page labels come from the lines in the label band alone, as typing would find them."""
    from chronoloom.operators import pages
    from chronoloom.plans.queries import casefiles

    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("no test tables")
    typed = pages.confirm_labels(pages.label_candidates(casefiles.typed_blocks(spark, folder)))
    want = sorted(map(tuple, typed.collect()))
    monkeypatch.setattr(casefiles, "typed_blocks", None)
    got = sorted(map(tuple, casefiles.casefile_labels(spark, folder).collect()))
    assert want and got == want
