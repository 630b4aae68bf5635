"""Rule patterns over the text of a whole document, without building that text where possible.

A pattern may run over line ends, because rules write ``\\s*`` between words.  How many line ends
a match can cross follows from the pattern's parsed form.  Lines are joined in overlapping pieces:
every piece takes a fixed number of lines and as many of the next ones as the longest pattern can
cross, so a match in the document is a match in a piece.  A pattern that can cross any number of
line ends is matched on the joined document.
"""

from __future__ import annotations

import math
import re
from re import _constants as op
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import joined_text, running

PIECE_LINES = 48
CHUNK_PAGES = 64
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _takes_line_end(item: tuple) -> bool:
    """Whether a single-character item can be a line end."""
    code, arg = item
    if code == op.LITERAL:
        return arg == 10
    if code == op.NOT_LITERAL:
        return arg != 10
    if code == op.IN:
        parts, negated = list(arg), False
        if parts and parts[0][0] == op.NEGATE:
            parts, negated = parts[1:], True
        hit = any(
            c == op.LITERAL and a == 10 or c == op.RANGE and a[0] <= 10 <= a[1]
            or c == op.CATEGORY and a in (op.CATEGORY_SPACE, op.CATEGORY_NOT_WORD,
                                          op.CATEGORY_NOT_DIGIT)
            for c, a in parts)
        return hit != negated
    return False


def _only_blanks(item: tuple) -> bool:
    """Whether an item is ``\\s`` or a class of blanks alone."""
    code, arg = item
    return code == op.IN and all(
        c == op.CATEGORY and a == op.CATEGORY_SPACE
        or c == op.LITERAL and chr(a).isspace() for c, a in arg)


def _crossed(items, any_char: bool) -> float:
    total = 0.0
    for code, arg in items:
        if code in _REPEATS:
            _, most, inner = arg
            if len(inner) == 1 and _only_blanks(inner[0]):
                # No line is blank, so a run of blanks holds one line end at most.
                total += float(_takes_line_end(inner[0]))
                continue
            own = _crossed(inner, any_char)
            total += 0 if not own else math.inf if most == op.MAXREPEAT else own * most
        elif code == op.SUBPATTERN:
            total += _crossed(arg[3], any_char or bool(arg[1] & re.S))
        elif code == op.BRANCH:
            total += max(_crossed(x, any_char) for x in arg[1])
        elif code == op.ATOMIC_GROUP:
            total += _crossed(arg, any_char)
        elif code in (op.ASSERT, op.ASSERT_NOT):
            total += _crossed(arg[1], any_char)
        elif code in (op.GROUPREF, op.GROUPREF_EXISTS):
            return math.inf
        elif code == op.ANY:
            total += any_char
        else:
            total += _takes_line_end((code, arg))
    return total


def line_ends_crossed(pattern: str) -> float:
    """The most line ends that a match can hold or look at; infinite where nothing bounds it.

    A pattern that Python's parser does not know (other syntaxes) counts as unbounded.
    """
    try:
        tree = parser.parse(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except (re.error, OverflowError):
        return math.inf
    return _crossed(tree, bool(tree.state.flags & re.S))


def pieces(body: DataFrame, overlap: int) -> DataFrame:
    """(unit_id, piece, text): joined lines of body blocks, in order, overlapping.

    A piece has PIECE_LINES lines and the ``overlap`` lines behind them, so a line belongs to
    every piece that begins at most so many lines before it.
    """
    counted = running(
        body.select("unit_id", "pdf_index", "ord", "text"), ["unit_id"], ["pdf_index", "ord"],
        chunk=F.floor(F.col("pdf_index") / CHUNK_PAGES), sums={"nth": F.lit(1)},
    ).withColumn("nth", F.col("nth") - 1)
    home = F.floor(F.col("nth") / PIECE_LINES)
    first = F.greatest(F.lit(0).cast("long"),
                       F.ceil((F.col("nth") - PIECE_LINES - overlap + 1) / PIECE_LINES))
    placed = counted.select(
        "unit_id", "nth", "text", F.explode(F.sequence(first, home)).alias("piece"))
    return placed.groupBy("unit_id", "piece").agg(joined_text("text", ["nth"], "\n").alias("text"))


def document_hits(body: DataFrame, patterns: list[str]) -> DataFrame:
    """(unit_id, pattern): which patterns occur in which document.

    ``body``: unit_id, pdf_index, ord, text of non-blank lines.
    """
    unique = list(dict.fromkeys(patterns))
    crossed = {p: line_ends_crossed(p) for p in unique}
    bounded = [p for p in unique if crossed[p] < math.inf]
    unbounded = [p for p in unique if crossed[p] == math.inf]
    found = body.select("unit_id", F.lit("").alias("pattern")).filter(F.lit(False))
    if bounded:
        found = found.union(_hits(pieces(body, int(max(crossed[p] for p in bounded))), bounded))
    if unbounded:
        whole = body.groupBy("unit_id").agg(
            joined_text("text", ["pdf_index", "ord"], "\n").alias("text"))
        found = found.union(_hits(whole, unbounded))
    return found.distinct()


def _hits(texts: DataFrame, patterns: list[str]) -> DataFrame:
    text = F.col("text")
    # One joint pattern sets most texts aside before the single patterns run.
    return texts.filter(tx.hits_any(text, patterns)).select(
        "unit_id", F.explode(tx.matched_patterns(text, patterns)).alias("pattern"))
