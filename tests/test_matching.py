"""Document patterns over line ends, and page labels of any length."""

import math

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import blocks, matching

CROSSED = {
    r"alpha\s*beta": 1, r"alpha\s*beta\s+gamma": 2, r"a[\s\S]*b": math.inf, r"a[^.]{0,40}b": 40,
    r"a(?:\s+\w+){0,5}\s+b": 6, r"(?s)a.*b": math.inf, r"a.*b": 0, r"a\Sb": 0, r"a\Wb": 1,
    r"(?:a\s*b|c)": 1, r"[^\n]+": 0, r"(?<n>a)\s": 1, r"a\n{2,3}b": 3, r"(a)\1": math.inf,
}


@pytest.mark.parametrize("pattern", list(CROSSED))
def test_line_ends_crossed(pattern):
    assert matching.line_ends_crossed(pattern) == CROSSED[pattern]


def test_no_match_over_lines_is_missed(spark):
    """Documents whose match begins anywhere and crosses 0 to 60 line ends."""
    rows, want = [], set()
    repeated, anything = r"alpha(?:\s+\w+){0,60}\s+beta", r"alpha[\s\S]*beta"
    for gap in (1, 2, 7, 47, 48, 49, 60, 61, 130):
        for start in (0, 1, 46, 47, 48, 95):
            unit = f"u{gap}-{start}"
            lines = ["x"] * start + ["alpha"] + ["word"] * (gap - 1) + ["beta", "y"]
            rows += [(unit, 1, i, t) for i, t in enumerate(lines)]
            want.add((unit, anything))
            if gap <= 61:
                want.add((unit, repeated))
    body = spark.createDataFrame(rows, "unit_id string, pdf_index int, ord int, text string")
    got = matching.document_hits(body, [repeated, anything, r"alpha\s*zzz"])
    assert {tuple(r) for r in got.collect()} == want


def test_labels_with_long_gaps(spark):
    df = spark.createDataFrame([("p. 12",), ("p." + " " * 70 + "12",), ("3" + " " * 200 + "de 9",)],
                               "text string")
    got = df.select(blocks.page_label(F.col("text"), F.lit(780.0), F.lit(790.0),
                                      F.lit(792.0)).alias("l")).collect()
    assert [(r.l.rule, r.l.label) for r in got] == [
        ("page_n", "12"), ("page_n", "12"), ("page_x_of_y", "3")]
