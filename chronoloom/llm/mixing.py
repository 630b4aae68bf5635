"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic; a cell's weight is its number of tokens
(here words).  Raking scales the cells until the token shares of all sources, all languages and
all topics meet their targets.  A cell's factor is its raked weight over its own; documents are
sampled with a probability in proportion to their cell's factor, at most 1, so that the expected
tokens of the sample are a given share of all.  The draw of a document depends on its id and
text alone and is the same in every run.

Only cells are raked: counts come from one aggregation over all documents, and the rounds run as
aggregations over the cells by their margins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS = ("source", "language", "topic")
NONE = "(none)"


def topic(text: Column) -> Column:
    """A coarse topic of a text by its form: table, markup, licence, list, note or prose."""
    size = F.length(text)
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&<>{}", ""))
    lines = size - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.when(size == 0, "empty").when(100 * bars > size, "table")
            .when(50 * marks > size, "markup").when(F.instr(text, "Licensed under") > 0, "licence")
            .when(100 * lines > size, "list").when(size < 600, "note").otherwise("prose"))


def tokens(text: Column) -> Column:
    """Words of a text, as runs between blanks; a text without words counts as one token."""
    folded = F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " "))
    return (F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit(""))) + 1).cast("long")


def _facts(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           language_col: str = "lang", topic_of=topic) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return {
        "source": F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)),
        "language": F.coalesce(F.col(language_col).cast("string"), F.lit(NONE)),
        "topic": F.coalesce(topic_of(text), F.lit(NONE)), "tokens": tokens(text),
        "draw": F.shiftrightunsigned(F.xxhash64(key, text), 11) / F.lit(float(1 << 53))}


def described(docs: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """doc_id, source, language, topic, tokens and draw (0 to 1) of every row; null: "(none)"."""
    facts = _facts(id_col, **columns)
    return docs.select(F.col(id_col).alias("doc_id"), *(v.alias(k) for k, v in facts.items()))


def targets(cells: DataFrame, dimension: str, wanted: dict[str, float] | None,
            flatten: float) -> DataFrame:
    """Target share of each value of a dimension.

    ``wanted`` gives shares by value (others share nothing); without it a value's target is in
    proportion to its own tokens to the power ``flatten``.  Values without tokens do not count.
    """
    own = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("w"))
    if wanted is not None:
        pairs = [x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.element_at(F.create_map(*pairs), F.col(dimension)) if pairs else F.lit(0.0)
        own = own.withColumn("t", F.coalesce(share, F.lit(0.0)))
    else:
        own = own.withColumn("t", F.pow("w", F.lit(flatten)))
    total = own.agg(F.sum("t").alias("all")).first()["all"]
    return own.select(dimension, (F.col("t") / F.lit(total or 1.0)).alias("target"))


def rake(cells: DataFrame, wanted: dict[str, dict[str, float] | None] | None = None,
         flatten: float = 0.7, tol: float = 1e-6, rounds: int = 40) -> DataFrame:
    """``cells`` (source, language, topic, n, tokens) with raked: weights whose sum is 1 and
    whose margins meet the targets within ``tol`` after at most ``rounds`` rounds.

    Where empty cells make the targets contradict each other, the last round's weights are
    given; then the topics' margins are met and the others as nearly as raking comes.
    """
    wanted = wanted or {}
    goals = {d: cut(targets(cells, d, wanted.get(d), flatten)) for d in DIMENSIONS}
    total = cells.agg(F.sum("tokens").alias("all")).first()["all"]
    state = cells.select(*DIMENSIONS, "n", "tokens",
                         (F.col("tokens") / F.lit(float(total or 1))).alias("raked"))
    for _ in range(rounds):
        off = None
        for d in DIMENSIONS:
            step = state.groupBy(d).agg(F.sum("raked").alias("now")).join(goals[d], d)
            if off is None:
                # How far the first margin is off after the others were fitted.
                off = step.agg(F.max(F.abs(F.col("target") - F.col("now"))).alias("off"))
            state = state.join(step.select(d, "target", "now"), d).select(
                *DIMENSIONS, "n", "tokens", F.when(
                    F.col("now") > 0, F.col("raked") * F.col("target") / F.col("now"))
                .otherwise(F.lit(0.0)).alias("raked"))
        state = cut(state)
        worst = off.first()["off"]
        if worst is None or worst < tol:
            break
    return state


def probabilities(raked: DataFrame, share: float = 0.5, rounds: int = 60) -> DataFrame:
    """``raked`` with factor (raked over own share of tokens) and p, a document's probability.

    p is the factor times a common scale, at most 1; the scale is such that the expected tokens
    are ``share`` of all (or all that the factors allow), found by halving.
    """
    whole = raked.agg(F.sum("tokens").alias("all")).first()["all"]
    if not whole:
        return raked.withColumns({"factor": F.lit(0.0), "p": F.lit(0.0)})
    told = raked.withColumn("factor", F.col("raked") / (F.col("tokens") / F.lit(float(whole))))
    # By steps of a thousandth of the logarithm: however many cells there are, the factors of
    # all fall into a bounded number of steps.
    steps = told.where("factor > 0").groupBy(
        F.round(F.log("factor") * 1000).cast("long").alias("step")).agg(
        F.sum("tokens").alias("tokens"), F.sum("raked").alias("raked")).collect()
    if not steps:
        return told.withColumn("p", F.lit(0.0))
    groups = [(r["raked"] / (r["tokens"] / whole), r["tokens"] / whole) for r in steps]
    low, high = 0.0, 1 / min(f for f, _ in groups)
    for _ in range(rounds):
        middle = (low + high) / 2
        if math.fsum(min(1.0, middle * f) * w for f, w in groups) < share:
            low = middle
        else:
            high = middle
    return told.withColumn("p", F.least(F.lit(1.0), F.col("factor") * F.lit(high)))


def plan(docs: DataFrame, share: float = 0.5, wanted: dict | None = None, flatten: float = 0.7,
         **columns) -> DataFrame:
    """Every document with its cell, tokens, factor, p, draw and sampled (draw below p).

    Equal rows have equal draws.  An empty table gives an empty table.
    """
    rows = cut(described(docs, **columns))
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("tokens").alias("tokens")))
    told = cut(probabilities(rake(cells, wanted, flatten), share).select(
        *DIMENSIONS, "factor", "p"))
    return rows.join(told, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "tokens", "factor", "p", "draw",
        (F.col("draw") < F.col("p")).alias("sampled"))


def sample(docs: DataFrame, share: float = 0.5, wanted: dict | None = None,
           flatten: float = 0.7, **columns) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their columns as they are.

    Cells are few, so it is their probabilities that travel to the documents where Spark finds
    them small enough; else the join is by cell, and adaptive execution splits hot ones.
    """
    facts = _facts(**columns)
    cells = cut(docs.select(*(v.alias(k) for k, v in facts.items())).groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")))
    told = cut(probabilities(rake(cells, wanted, flatten), share).select(
        *(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.col("p").alias("__p")))
    own = docs.withColumns({f"__own_{k}": facts[k] for k in (*DIMENSIONS, "draw")})
    same = [own[f"__own_{d}"] == told[f"__{d}"] for d in DIMENSIONS]
    return own.join(told, same).where("__own_draw < __p").select(*docs.columns)
