"""Column functions over text: pattern translation, normal forms, offsets, word quality."""

from __future__ import annotations

import operator
import re
import unicodedata
import warnings
from collections.abc import Callable
from functools import lru_cache, reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -------------------------------------------------------------------------
#: Punctuation dropped from both ends of a token before it is judged.
TOKEN_TRIM = ".,;:()[]{}'\"·–—-«»"
WORD = "^[A-Za-zÀ-ÿ]{2,}$"
VOWEL = "[aeiouyàâäéèêëîïôöùûü]"
#: A digit, something that is no digit, space or number punctuation, and a digit again.
BROKEN_NUMBER = r"\d[^\d\s.,%/-]\d"
CONTROL = r"[\x00-\x08\x0b-\x1f]"
# -------------------------------------------------------------------------------------------


def rx(pattern: str, *, case: bool = False) -> str:
    """A rule pattern in Java form.

    Rule packs are written for an engine whose classes and case folding know Unicode; Java
    needs flags for both.  Named groups also differ by one letter.
    """
    return ("(?uU)" if case else "(?iuU)") + pattern.replace("(?P<", "(?<")


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of ``patterns`` does."""
    return "|".join(f"(?:{p})" for p in patterns)


#: Lower-case text that holds one of these may fold to letters that it does not show (ſ, ı, İ).
FOLDS = ("\u017f", "\u0131", "\u0307")
#: Letters that a needed word has at least, and patterns from which on a look for them pays.
NEEDED_CHARS, NEEDED_FROM = 3, 3


def _runs(items) -> list[str]:
    """Stretches of ASCII characters that every match holds, in lower case."""
    runs = [""]
    for code, arg in items:
        if code == op.LITERAL and arg < 128:
            runs[-1] += chr(arg).lower()
        elif code == op.SUBPATTERN:
            first, *rest = _runs(arg[3])
            runs[-1] += first
            runs += rest
        elif code not in (op.AT, op.ASSERT, op.ASSERT_NOT):
            runs.append("")
    return runs


def _needed(items) -> tuple[str, ...]:
    if len(items) == 1 and items[0][0] == op.BRANCH:
        parts = [_needed(list(branch)) for branch in items[0][1][1]]
        return tuple(one for part in parts for one in part) if all(parts) else ()
    if len(items) == 1 and items[0][0] == op.SUBPATTERN:
        return _needed(list(items[0][1][3]))
    best = max(_runs(items), key=len)
    return (best,) if len(best) >= NEEDED_CHARS else ()


@lru_cache(maxsize=4096)
def needed(pattern: str) -> tuple[str, ...]:
    """Words of which the lower-case text of every match of a rule pattern holds one; () if unknown."""
    if "[[" in pattern or "&&" in pattern:  # other meanings in Java's classes
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error", FutureWarning)
            tree = parser.parse(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except (re.error, OverflowError, FutureWarning):
        return ()
    return _needed(list(tree))


def holds(low: Column, words: list[str]) -> Column:
    """Whether lower-case text holds one of the words, or a letter that may fold to others."""
    return reduce(operator.or_, [F.contains(low, F.lit(w)) for w in dict.fromkeys([*words, *FOLDS])])


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once however often ``make`` reads it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def hits(text: Column, pattern: str, *, case: bool = False) -> Column:
    return text.rlike(rx(pattern, case=case))


def hits_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found.  Most lines hold none of the words the patterns need, and are
    set aside without Unicode classes and word borders, which cost much more."""
    if not patterns:
        return F.lit(False)
    told = [p for p in patterns if needed(p)]
    if len(told) < NEEDED_FROM:
        return hits(text, any_of(patterns))
    words = [w for p in told for w in needed(p)]
    found = once(F.lower(text), lambda low: holds(low, words)) & hits(text, any_of(told))
    rest = [p for p in patterns if not needed(p)]
    return found | hits(text, any_of(rest)) if rest else found


def matched_patterns(text: Column, patterns: list[str]) -> Column:
    """The patterns found in ``text``, in pack order."""
    if not patterns:
        return F.array().cast("array<string>")

    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(holds(low, list(needed(p))) & hits(text, p) if needed(p) else hits(text, p), F.lit(p))
            for p in patterns]))

    return once(F.lower(text), found)


def group(text: Column, pattern: str, index: int = 1, *, case: bool = False) -> Column:
    """A capture group, null where the pattern or the group did not match."""
    return F.nullif(F.regexp_extract(text, rx(pattern, case=case), index), F.lit(""))


#: Every white-space character, worked out from the character table.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Case-insensitive form of a line, for spotting the same line twice."""
    return F.replace(F.lower(squeeze(text)), F.lit("ß"), F.lit("ss"))


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters and their accent-free form, worked out from the Unicode decomposition."""
    single_from, single_to, several = [], [], []
    for code in [*range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07),
                 *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char or not plain:
            continue
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        else:
            several.append((char, plain))
    return "".join(single_from), "".join(single_to), tuple(several)


def unaccent(text: Column) -> Column:
    source, target, several = _plain_letters()
    # The multi-letter forms are rare: one scan decides whether any replacement runs, and a scan for
    # a few ranges that hold them all, which costs far less, decides on that scan.
    codes = sorted(ord(a) for a, _ in several)
    low = [c for c in codes if c < 0x100]
    ranges = f"[\\x{{{low[0]:x}}}-\\x{{{low[-1]:x}}}\\x{{{codes[len(low)]:x}}}-\\x{{{codes[-1]:x}}}]"
    rare = "[" + "".join(re.escape(a) for a, _ in several) + "]"

    def spell(out: Column) -> Column:
        spelled = out
        for char, plain in several:
            spelled = F.replace(spelled, F.lit(char), F.lit(plain))
        return F.when(out.rlike(ranges) & out.rlike(rare), spelled).otherwise(out)

    plain = F.regexp_replace(once(F.translate(text, source, target), spell), r"\p{Mn}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def compare_form(text: Column) -> Column:
    """Lower case, no accents, only letters a-z, digits and single blanks."""
    return once(F.lower(text), lambda low: F.trim(
        F.regexp_replace(unaccent(low), "[^a-z0-9]+", " ")))


def score_form(text: Column) -> Column:
    """Lower case, no accents, single blanks; punctuation stays."""
    return squeeze(unaccent(F.lower(text)))


def upper_share(text: Column) -> Column:
    """Share of capitals among the letters, 0 where there is no letter."""
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(capitals / F.nullif(letters, F.lit(0)), F.lit(0.0))


#: What Java's ``(?U)\\s`` takes for white space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
#: A letter, with the rest of its token; and a token that reads as a word, trimmed or not.
ALPHA_TOKEN = r"\p{L}[^ ]*+"
_ENDS = "[" + "".join("\\" + c for c in TOKEN_TRIM) + "]*+"
GOOD_TOKEN = (
    f"(?<![^ ]){_ENDS}(?=[A-Za-zÀ-ÿ]*?[{VOWEL[1:-1]}{VOWEL[1:-1].upper()}])[A-Za-zÀ-ÿ]{{2,}}+{_ENDS}(?![^ ])")


def word_counts(text: Column) -> Column:
    """struct(alpha, good): tokens with a letter, and those among them that read as words.

    Counts add up over the lines of a page or a document, so quality never needs the lines
    to be joined into one string.  Tokens are counted where they stand, not cut out one by one.
    """
    blanked = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return once(blanked, lambda line: F.struct(
        F.regexp_count(line, F.lit(ALPHA_TOKEN)).alias("alpha"),
        F.regexp_count(line, F.lit(GOOD_TOKEN)).alias("good")))


def counted_words(columns: list[str]) -> Column:
    """Word counts a table already carries, or else counted from its text."""
    if "alpha" in columns and "good" in columns:
        return F.struct(F.col("alpha").alias("alpha"), F.col("good").alias("good"))
    return word_counts(F.col("text"))


def share(good: Column, alpha: Column) -> Column:
    """Word-likeness from two counts; 0 when nothing can be judged."""
    return F.coalesce(good / F.nullif(alpha, F.lit(0)), F.lit(0.0))


def word_likeness(text: Column) -> Column:
    counts = word_counts(text)
    return share(counts["good"], counts["alpha"])


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def broken_number(text: Column) -> Column:
    # The first pattern is cheap and matches wherever the second can.
    return text.rlike(r"\p{Nd}.\p{Nd}") & hits(text, BROKEN_NUMBER)


def matches(text: Column, pattern: str, *, case: bool = False) -> Column:
    """Every match of ``pattern`` with its place: array<struct<start,end,raw>>.

    The text between matches and the matches themselves alternate, so running lengths of
    the two lists give the offsets.  Both lists are made once, and one walk adds the lengths up.
    """
    java = rx(pattern, case=case)
    nothing = F.array().cast("array<struct<start:int,end:int,raw:string>>")

    def walk(two: Column) -> Column:
        pairs = F.arrays_zip(
            F.slice(two["between"], 1, F.size(two["found"])).alias("gap"), two["found"].alias("raw"))

        def step(done: Column, pair: Column) -> Column:
            start = done["at"] + F.length(pair["gap"])
            end = start + F.length(pair["raw"])
            one = F.struct(start.alias("start"), end.alias("end"), pair["raw"].alias("raw"))
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

        return F.aggregate(
            pairs, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda done: done["out"])

    lists = F.struct(
        F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("found"),
        F.split(text, java, -1).alias("between"))
    return F.when(text.rlike(java), once(lists, walk)).otherwise(nothing)


def cut_out(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with zero-based offsets."""
    return F.substring(text, start + 1, end - start)


def _since_stop(text: Column) -> Column:
    """What stands behind the last dot or line end: one scan, whatever the length."""
    return F.substring_index(F.substring_index(text, "\n", -1), ".", -1)


def _until_stop(text: Column) -> Column:
    """What stands before the first dot or line end."""
    return F.substring_index(F.substring_index(text, "\n", 1), ".", 1)


def sentence_bounds(text: Column, at: Column) -> Column:
    """struct(start, end) of the sentence around offset ``at``; the closing dot is inside."""
    before = F.substring(text, F.lit(1), at)
    after = F.substring(text, at + 1, F.length(text))
    start = at - F.length(_since_stop(before))
    run = F.length(_until_stop(after))
    end = F.least(at + run + 1, F.length(text))
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def sentence_at(text: Column, at: Column) -> Column:
    """The sentence around ``at`` without its closing dot, trimmed."""
    before = F.substring(text, F.lit(1), at)
    after = F.substring(text, at + 1, F.length(text))
    return strip(F.concat(_since_stop(before), _until_stop(after)))


def first_start(text: Column, pattern: str) -> Column:
    """Offset of the first match, null without one."""
    java = rx(pattern)
    head = F.element_at(F.split(text, java, 2), 1)
    return F.when(text.rlike(java), F.length(head))


def first_match(text: Column, pattern: str) -> Column:
    """struct(start, end) of the first match, null without one."""
    java = rx(pattern)
    start = F.length(F.element_at(F.split(text, java, 2), 1))
    end = start + F.length(F.regexp_extract(text, java, 0))
    return F.when(text.rlike(java), F.struct(start.alias("start"), end.alias("end")))


def digest(*parts: Column, size: int, prefix: str = "", sep: str = "|") -> Column:
    """A content-derived id."""
    body = F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, size)
    return F.concat(F.lit(prefix), body) if prefix else body
