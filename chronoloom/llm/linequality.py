"""Quality of documents from their lines, by a linear-chain conditional random field.

A document is a chain of lines (a line of over UNIT bytes is several units of the chain), each
good or bad.  A line's features are ranges of simple measures of itself, of the line before and
of the line after it, and of the whole text; neighbours also meet in the transition weights.
Forward-backward gives each line's marginal; a document's score is their mean, weighted by the
lines' lengths.

Labels are known for documents only, so in fitting every line of a document has its label; what
a line says on its own then follows from all the documents it is like.

The chain needs no loop over lines: a line is a 2 x 2 matrix, the first of a document has equal
rows and so forgets what came before, and products over all ranges that matter come from doubling
steps over a whole batch of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces, texts

#: Bytes of a unit at most.
UNIT = 1 << 16
#: Bytes whose classes and hashes are in memory at once.
SLICE = 1 << 20
#: A document counts as good from this score on.
GOOD = 0.3

# Byte classes.
_KINDS = ("upper", "lower", "digit", "blank", "symbol", "mark", "other")
_KIND = np.full(256, 6, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[*b"#*$%&|<>{}[]\\^~_=+@/"]] = 4
_KIND[[*b".,;:!?'\"()-"]] = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: Measures of a line, with the borders of their ranges.
LINE_MEASURES = {
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.15, 0.3),
    "upper": (0.01, 0.03, 0.06, 0.12, 0.3, 0.7),
    "digits": (0.001, 0.03, 0.1, 0.3),
    "marks": (0.005, 0.02, 0.04, 0.07, 0.12, 0.2),
    "words": (1, 2, 3, 5, 8, 12, 20, 40, 80, 160, 500),
    "word_length": (2, 3, 4, 5, 6, 7, 9, 12, 20),
    "repeats": (0.001, 0.02, 0.05, 0.15, 0.4),
    "distinct": (0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95, 0.9999),
    "again": (0.5,),
}
#: Measures of the whole text.
TEXT_MEASURES = {
    "text_words": (1, 3, 5, 8, 12, 20, 35, 60, 120, 300, 1000, 5000),
    "text_lines": (1.5, 2.5, 4.5, 8.5, 20.5, 100.5),
    "text_distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "text_again": (0.001, 0.05, 0.15, 0.3, 0.6),
}


def _bases() -> tuple[dict[str, int], int]:
    at, out = 0, {}
    for name, borders in LINE_MEASURES.items():
        for side in ("own", "before", "after"):
            out[f"{name} {side}"] = at
            # One more range where there is no such line.
            at += len(borders) + 2
    for name, borders in TEXT_MEASURES.items():
        out[name] = at
        at += len(borders) + 1
    out["constant"] = at
    return out, at + 1


BASES, N_WEIGHTS = _bases()


def chain(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units and the text of each; an empty text is one empty unit."""
    size = np.diff(at)
    ends = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([at[:-1][size > 0], ends[ends < at[-1]]]))
    length = np.diff(np.append(starts, at[-1]))
    parts = -(-length // UNIT)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + (np.arange(len(first)) - first) * UNIT
    text = np.searchsorted(at, starts, side="right") - 1
    empty = np.flatnonzero(size == 0)
    starts, text = np.append(starts, at[empty]), np.append(text, empty)
    order = np.lexsort((starts, text))
    return starts[order], text[order]


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Different values of each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n)


def _counted(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each kind [unit, kind], and the unit and hash of every word of ``data``."""
    n = len(starts)
    length = np.diff(np.append(starts, len(data)))
    unit = np.repeat(np.arange(n, dtype=np.int32), length)
    kind = _KIND[data]
    # Letters of two bytes in Latin script: the second byte tells the case.
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    kind[second & (data >= 0x80) & (data <= 0x9E)] = 0
    kind[second & (data >= 0xA0)] = 1
    counts = np.bincount(unit * np.int64(7) + kind, minlength=n * 7).reshape(n, 7)

    inside = kind != 3
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (unit[1:] != unit[:-1])
    first = np.flatnonzero(start)
    if not len(first):
        return counts, np.zeros(0, np.int32), np.zeros(0, np.uint64)
    # A polynomial hash of the word's bytes, by powers that begin anew at each word.
    word = np.maximum(np.cumsum(start, dtype=np.int32) - 1, 0)
    place = np.maximum(np.arange(len(data), dtype=np.int64) - first[word], 0)
    power = np.cumprod(np.full(int(place.max()) + 1, _FACTOR, np.uint64))
    value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0))
    return counts, unit[first], np.add.reduceat(value, first)


def measures(data: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Measures of all units of the texts between the offsets ``at``, their text and length."""
    starts, text = chain(at, data)
    n, n_texts = len(starts), len(at) - 1
    # Bytes are looked at in slices of whole units, so that memory follows SLICE.
    edges = [0, *(np.flatnonzero(np.diff(starts // SLICE)) + 1).tolist(), n]
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        end = starts[hi] if hi < n else len(data)
        counts, words, hashed = _counted(data[starts[lo]:end] if n else data, starts[lo:hi] - starts[lo])
        parts.append((counts, words.astype(np.int64) + lo, hashed))
    counts, words, hashed = (np.concatenate(x) for x in zip(*parts))
    word_text = text[words]
    n_of = dict(zip(_KINDS, counts.T))
    length = counts.sum(1)

    n_words = np.bincount(words, minlength=n)
    same = np.zeros(len(words), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (words[1:] == words[:-1])
    repeats = np.bincount(words[same], minlength=n)
    # A unit's hash takes its words in order; equal to an earlier one of its text: again.
    turn = np.cumprod(np.full(int(n_words.max(initial=0)) + 1, _FACTOR | np.uint64(2), np.uint64))
    nth = np.arange(len(words)) - (np.cumsum(n_words) - n_words)[words]
    line = np.zeros(n, np.uint64)
    np.add.at(line, words, hashed * turn[nth])
    again = np.zeros(n, bool)
    order = np.lexsort((np.arange(n), line, text))
    again[order[1:]] = ((line[order[1:]] == line[order[:-1]])
                        & (text[order[1:]] == text[order[:-1]]) & (n_words[order[1:]] > 0))

    def per_text(values):
        return np.bincount(text, weights=values, minlength=n_texts)[text]

    letters, solid = n_of["upper"] + n_of["lower"], length - n_of["blank"]

    def share(part, whole):
        return part / np.maximum(whole, 1)

    text_words = per_text(n_words)
    out = {
        "symbols": share(n_of["symbol"], solid), "upper": share(n_of["upper"], letters),
        "digits": share(n_of["digit"], solid), "marks": share(n_of["mark"], solid),
        "words": n_words, "word_length": share(solid, n_words),
        "repeats": share(repeats, n_words), "distinct": share(_distinct(words, hashed, n), n_words),
        "again": again.astype(float),
        "text_words": text_words, "text_lines": per_text(np.ones(n)),
        "text_distinct": share(_distinct(word_text, hashed, n_texts)[text], text_words),
        "text_again": share(per_text(again * length), per_text(length)),
    }
    return out, text, length


def features(told: dict[str, np.ndarray], text: np.ndarray) -> np.ndarray:
    """Places in the weights [unit, feature]: the range of each measure."""
    n, columns = len(text), []
    for name, borders in LINE_MEASURES.items():
        own = np.searchsorted(borders, told[name], side="right")
        for side, step in (("own", 0), ("before", -1), ("after", 1)):
            near = np.full(n, len(borders) + 1)
            at = np.arange(n) + step
            ok = (at >= 0) & (at < n)
            ok[ok] = text[at[ok]] == text[ok]
            near[ok] = own[at[ok]]
            columns.append(BASES[f"{name} {side}"] + near)
    for name, borders in TEXT_MEASURES.items():
        columns.append(BASES[name] + np.searchsorted(borders, told[name], side="right"))
    columns.append(np.full(n, BASES["constant"]))
    return np.stack(columns, 1).astype(np.uint16)


def _products(m: np.ndarray, longest: int, back: bool) -> np.ndarray:
    """Products of all matrices up to each one (``back``: from each one on), each scaled.

    Ranges double until they cover ``longest`` units, which reach a document's first one.
    """
    m, step = m.copy(), 1
    while step < longest:
        new = m[:-step] @ m[step:]
        new /= new.max((1, 2), keepdims=True)
        if back:
            m[:-step] = new
        else:
            m[step:] = new
        step *= 2
    return m


def marginals(unary: np.ndarray, text: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each unit, and P(state before, state) of each unit but the first of a text.

    ``unary`` is the score of good; that of bad is 0.
    """
    n = len(unary)
    own = np.stack([np.zeros(n), unary], 1)
    own = np.exp(own - own.max(1, keepdims=True))
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    m = np.exp(moves)[None] * own[:, None, :]
    m[first] = own[first][:, None, :]
    longest = int(np.diff(np.append(np.flatnonzero(first), n)).max(initial=1))
    forward = _products(m, longest, False)[:, 0, :]
    after = _products(m, longest, True)
    last = np.append(first[1:], True)
    backward = np.ones((n, 2))
    # What follows a unit begins with the next unit's matrix.
    backward[:-1][~last[:-1]] = after[1:].sum(2)[~last[:-1]]
    backward /= backward.max(1, keepdims=True)
    joint = forward * backward
    good = joint[:, 1] / joint.sum(1)
    inner = np.flatnonzero(~first)
    pair = forward[inner - 1][:, :, None] * m[inner] * backward[inner][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return good, pair


class Model:
    """Weights of features for the state good, and scores of moves between states."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @staticmethod
    def fit(places: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.2,
            decay: float = 1e-3) -> Model:
        """Maximum likelihood of the units' labels, by full gradient steps of adaptive size."""
        w, moves = np.zeros(N_WEIGHTS), np.zeros((2, 2))
        if not places:
            return Model(w, moves)
        rows = np.concatenate(places)
        text = np.repeat(np.arange(len(places)), [len(p) for p in places])
        label = np.repeat(np.asarray(labels, float), [len(p) for p in places])
        # Long documents count as one document, not as many lines.
        weight = 1 / np.sqrt(np.bincount(text))[text]
        pairs = np.flatnonzero(np.append(False, text[1:] == text[:-1]))
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[pairs - 1].astype(int), label[pairs].astype(int)), weight[pairs])
        size = weight.sum()
        first, second = np.zeros(N_WEIGHTS + 4), np.zeros(N_WEIGHTS + 4)
        for t in range(1, rounds + 1):
            good, pair = marginals(w[rows].sum(1), text, moves)
            push = np.bincount(rows.ravel(), np.repeat((label - good) * weight, rows.shape[1]),
                               minlength=N_WEIGHTS)
            turn = seen - (pair * weight[pairs][:, None, None]).sum(0)
            grad = np.append(push, turn.ravel()) / size - decay * np.append(w, moves.ravel())
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
            move = rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
            w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
        return Model(w, moves)

    def scores(self, column: pa.Array) -> np.ndarray:
        """P(good) of every text of a batch: marginals weighted by the lines' lengths."""
        data, at = as_bytes(column)
        told, text, length = measures(data, at)
        rows = features(told, text)
        good, _ = marginals(self.weights[rows].sum(1), text, self.moves)
        size = np.maximum(length, 1)
        return (np.bincount(text, good * size, minlength=len(at) - 1)
                / np.bincount(text, size, minlength=len(at) - 1))


def held_out(column: str = "doc_id"):
    """The test fold: every fifth by the checksum of the id as text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, n_docs: int = 2000, units_per_doc: int = 48) -> Model:
    """A model from a bounded sample of labelled documents.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) meet on the first ``n_docs`` labelled
    ids by hash; ids whose labels disagree teach nothing, as do those without one.  Tasks read
    whole texts and send ranges of measures, for at most ``units_per_doc`` lines in a row.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where(
        "label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    rows = texts(docs).join(F.broadcast(known.select("doc_id", "label")), "doc_id")

    def told(batches):
        for batch in pieces(batches, "text"):
            data, at = as_bytes(batch.column("text"))
            found, text, _ = measures(data, at)
            places = np.split(features(found, text), np.flatnonzero(np.diff(text)) + 1)
            # A stretch in the middle, so that starts of texts are not all that is learned.
            cut = [(len(p) - units_per_doc) // 2 if len(p) > units_per_doc else 0 for p in places]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.string()),
                "label": batch.column("label").cast(pa.int32()),
                "places": pa.array([p[i:i + units_per_doc].tobytes()
                                    for p, i in zip(places, cut)], pa.binary())})

    # The order makes the fit the same in every run; a repeated id may add rows, hence the limit.
    got = rows.select("doc_id", "text", "label").mapInArrow(
        told, "doc_id string, label int, places binary").orderBy(
        F.xxhash64("doc_id"), "doc_id", "places").limit(n_docs).collect()
    width = 3 * len(LINE_MEASURES) + len(TEXT_MEASURES) + 1
    return Model.fit([np.frombuffer(bytes(r["places"]), np.uint16).reshape(-1, width) for r in got],
                     [r["label"] for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, P(good) between 0 and 1, for every row of ``docs`` (doc_id, text).

    A null text is empty; an empty text is one empty line and has a score like any other.  Equal
    rows stay equal rows, and other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "score": pa.array(held.value.scores(batch.column("text")))})

    slim = texts(docs)
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(judge, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Fit on labels outside the test fold, then score every row of ``docs``.

    Without any label the score is a half for every text.  Returns doc_id, held_out, score and
    predicted (1 from GOOD on).
    """
    model = fit(docs, labels.where(~held_out()).select("doc_id", "quality"), **bounds)
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"))
