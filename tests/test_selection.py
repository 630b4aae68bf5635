"""Choosing the lines of a unit: the patterns run once, and furniture is known by its unit."""

from pyspark.sql import functions as F

from chronoloom import rules
from chronoloom.operators import selection, worklist

PACK = rules.load("cnesst")


def lines(spark):
    rows = [("u", page, 1, "paragraph", "Clinique  du Nord") for page in (1, 2, 3)]
    rows += [("u", page, 2, "paragraph", f"Constat {page}") for page in (1, 2, 3)]
    rows += [("v", page, 1, "paragraph", f"Clinique du Nord {page}") for page in (1, 2)]
    rows += [("w", 1, 1, "signature", "Dr Martin"), ("w", 1, 2, "paragraph", None)]
    return spark.createDataFrame(rows, "unit_id string, pdf_index int, ord int, type string, text string")


def test_furniture_of_one_unit_is_none_of_another(spark):
    got = {(r["unit_id"], r["pdf_index"], r["ord"]): (r["kept"], r["reason"])
           for r in selection.select_lines(lines(spark), PACK).collect()}
    assert len(got) == 10
    assert all(got["u", page, 1] == (False, "repeats_on_every_page") for page in (1, 2, 3))
    assert all(got["u", page, 2] == (True, None) for page in (1, 2, 3))
    assert all(got["v", page, 1] == (True, None) for page in (1, 2))
    assert got["w", 1, 1] == (False, "furniture_type")


def test_patterns_and_running_state_are_not_worked_out_again(spark):
    chosen = selection.select_lines(lines(spark), PACK).filter(F.col("kept"))
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "Window" not in plan


def test_verifying_shuffles_texts_and_answers_once(spark):
    """Equal spans are told apart where their block was joined; before, all was joined and shuffled twice."""
    parted = spark.createDataFrame(
        [("u", 0, "b1", "un texte assez long", 1.0), ("u", 0, "b2", "autre", 0.5)],
        "unit_id string, part int, block_id string, text string, confidence double")
    answers = spark.createDataFrame(
        [("u", 0, 5, "b1", 0, 8, "f"), ("u", 0, 2, "b1", 0, 8, "f"), ("u", 0, 3, "b1", 0, 20, "f"),
         ("u", 0, 4, "b1", 0, 19, "f"), ("u", 0, 6, "b2", None, 3, "f"), ("u", 0, 7, "b2", None, 3, "f"),
         ("u", 0, 8, "b9", 0, 3, "f")],
        "unit_id string, part int, seq int, block_id string, start int, end int, field string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = worklist.verify_spans(answers, parted)
        got = {r.seq: (r.reason, r.value) for r in out.collect()}
        plan = out._jdf.queryExecution().sparkPlan().toString()
        ran = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {
        2: (None, "un texte"), 5: ("repeated", None), 3: (None, "un texte assez long"), 4: ("repeated", None),
        6: ("offsets_missing", None), 7: ("offsets_missing", None), 8: ("not_a_block_of_this_part", None)}
    assert plan.count("Join") == 1
    assert sum(" Exchange " in x and "Reused" not in x for x in ran.splitlines()) == 2


def test_subdividing_keeps_lines_without_a_place(spark):
    rows = [("u", "b0", None, None, "paragraph", "sans place"), ("u", "b1", 1, 0, "heading", "Titre"),
            ("u", "b2", 1, 1, "paragraph", "x" * 300), ("u", "b3", 2, 0, "heading", "Suite"),
            ("u", "b4", 2, 1, "paragraph", "y" * 300), ("v", "b5", 1, 0, "paragraph", "court")]
    blocks = spark.createDataFrame(
        rows, "unit_id string, block_id string, pdf_index int, ord int, type string, text string")
    got = {r.block_id: (r.part, r.reason) for r in worklist.subdivide(blocks, long_unit=100).collect()}
    assert {k: v[0] for k, v in got.items()} == {"b0": 0, "b1": 1, "b2": 1, "b3": 2, "b4": 2, "b5": 0}
    assert got["b5"][1] == "short_enough" and got["b4"][1] == "split_on_headings"
