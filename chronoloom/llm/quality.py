"""Quality of documents by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0).  Votes are combined by a naive Bayes model
of a hidden class; expectation-maximisation finds the share of good documents and how often each
rule is right when it votes, and a document's probability of being good follows.  The model sees
vote patterns with their counts, of which there are at most 3 to the number of rules however
many documents there are; every document is counted.

A word is a run of characters other than space and tab to carriage return.  Repeats of five-word
windows are found inside a row by 64-bit hashes of the windows, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent short words of some European languages; a fixed list.
COMMON = ("the of and to in a is that it for on was with as be at by this are from "
          "de la le et les des en un une est que pour qui dans "
          "der die und den von zu das mit sich ist "
          "el los las y del por con para una no").split()

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letter_words", "n_common", "n_closed_lines")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document, all long: FEATURES beside doc_id.

    Null or empty text: all zero.  Equal rows stay equal rows; other columns are ignored.
    """
    text = F.col("text")
    blank = "[ \\t-\\r]"
    split = texts(docs, id_col, text_col).select(
        "doc_id", "text",
        F.filter(F.split(text, blank + "+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0).alias("lines"),
        _without(text, BLANKS).alias("packed"))
    w, n, lines = F.col("w"), F.size("w"), F.col("lines")
    counted = split.select(
        "doc_id", n.alias("n_words"),
        F.length("packed").alias("word_chars"),
        (F.length("packed") - F.length(_without(F.col("packed"), SYMBOLS))).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("[.!?:]" + blank + "*$"))).alias("n_closed_lines"),
        F.size(F.filter(w, lambda x: F.lower(x) != F.upper(x))).alias("n_letter_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(COMMON))).alias("n_common"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
            *(F.get(w, i + k) for k in range(WINDOW))))).alias("h"))
    h = F.col("h")
    # Most documents repeat no window; only the others are sorted.
    placed = counted.withColumn("s", F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("s")
    found = placed.withColumn("p", F.sort_array(F.transform(
        F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])))
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x,
                                                                      F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).select(
        "doc_id", *(F.col(c).cast("long").alias(c) for c in FEATURES))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The rules by name, as votes over FEATURES."""
    n, chars = F.col("n_words"), F.col("word_chars")
    lines = F.col("n_lines")
    return {
        "length": _vote(n >= 50, n < 12),
        "word_length": _vote(chars.between(3 * n, 9 * n), (chars < 2 * n) | (chars > 14 * n)),
        "symbols": _vote(100 * F.col("n_symbols") <= chars, 10 * F.col("n_symbols") > chars),
        "lines": _vote((lines > 1) & (F.col("n_dup_lines") == 0),
                       10 * F.col("n_dup_lines") > 3 * lines),
        "repeats": _vote((n >= 20) & (F.col("n_repeat_words") == 0),
                         10 * F.col("n_repeat_words") > n),
        "letters": _vote(10 * F.col("n_letter_words") >= 9 * n, 2 * F.col("n_letter_words") < n),
        "common": _vote(F.col("n_common") * 20 >= n, (n >= 30) & (F.col("n_common") == 0)),
        "closed": _vote(2 * F.col("n_closed_lines") >= lines,
                        (lines >= 4) & (F.col("n_closed_lines") == 0)),
    }


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)


def log_odds(votes: dict[str, Column], model: dict) -> Column:
    """Log odds of good: the prior's, and each vote's by its rule's accuracy."""
    out = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, vote in votes.items():
        a = model["accuracy"][name]
        out = out + vote.cast("double") * F.lit(math.log(a / (1 - a)))
    return out


def fit(votes: DataFrame, names: list[str], rounds: int = 20, tol: float = 1e-6) -> dict:
    """The share of good documents and the accuracy of each rule, by expectation-maximisation.

    ``votes`` has a column of 1, 0 or -1 for each rule.  The rounds run over the patterns of
    votes (at most 3 ** len(names) rows) with their counts; each round is one aggregation whose
    result is one row.  Accuracies stay within 0.55 and 0.99, so that a rule can neither be
    turned round nor decide alone; the prior stays within 0.05 and 0.95.  No rows: the start.
    """
    patterns = cut(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    model = {"prior": 0.8, "accuracy": dict.fromkeys(names, 0.75)}
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-log_odds({x: F.col(x) for x in names}, model)))
        told = patterns.withColumn("p", p).agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good"),
            *(F.sum(F.when(F.col(x) != 0, F.col("n"))).alias(f"{x}_n") for x in names),
            *(F.sum(F.col("n") * F.when(F.col(x) == 1, F.col("p")).when(
                F.col(x) == -1, 1 - F.col("p"))).alias(f"{x}_ok") for x in names)).first()
        if not told["n"]:
            return model
        new = {"prior": min(0.95, max(0.05, told["good"] / told["n"])), "accuracy": {
            x: min(0.99, max(0.55, (told[f"{x}_ok"] + 1) / (told[f"{x}_n"] + 2)))
            if told[f"{x}_n"] else model["accuracy"][x] for x in names}}
        moved = max(abs(new["prior"] - model["prior"]),
                    *(abs(new["accuracy"][x] - model["accuracy"][x]) for x in names))
        model = new
        if moved < tol:
            break
    return model


def assess(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Every document with its counts, base_failed, its probability of being good, and kept.

    Kept: the base rule holds and the probability is ``threshold`` or more.  A document without
    words fails the base rule.  An empty table gives an empty table.
    """
    counts = cut(features(docs, id_col, text_col))
    votes = rules()
    model = fit(counts.select(*(v.alias(k) for k, v in votes.items())), list(votes))
    p = 1 / (1 + F.exp(-log_odds(votes, model)))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), p.alias("p_good"),
        (~base_failed() & (p >= threshold)).alias("kept"))
