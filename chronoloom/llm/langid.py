"""Language of texts by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ORDER bytes long is counted.  The probability of
a byte is that of the longest context known: with n bytes seen after a context, t of them
different, a byte seen c times there has c / (n + t), and the escape to the context shorter by
one has t / (n + t); below the empty context every byte is equally likely.  Statistics are frozen
after fitting, so a text's code length in bits is a sum over its bytes.

The contexts of all languages together are closed under suffixes, so "the longest known context"
is the state of a deterministic automaton over bytes: a table gives the next state, another one
the code length of the byte for every language.  A text is cut into lanes that are stepped
together; as a state depends on the last ORDER bytes only, a lane that starts ORDER bytes early
is in the right state at its own first byte, and lane sums add up to the text's exact length.

Fitting uses a bounded sample: per language about ``docs_per_language`` documents (by hash), at
most ``chars_per_doc`` characters each; scoring covers every byte of every text.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import grid, lanes
from .common import as_bytes, give_back, held, pieces, texts

ORDER = 4
#: A context is kept where the sample has it at least so often (in any language).
LEAST = 12
LANE = 256
NO_LETTER = "und"


class Model:
    """Context trees of all languages: a context's counts of next bytes, per language."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, least: int = LEAST):
        self.order, self.languages = order, sorted(samples)
        counts = []
        for language in self.languages:
            own: list[Counter] = [Counter() for _ in range(order + 2)]
            for text in samples[language]:
                data = text.lower().encode()
                for k in range(1, order + 2):
                    own[k].update(data[i:i + k] for i in range(len(data) - k + 1))
            counts.append(own)
        seen = Counter()
        for own in counts:
            for k in range(1, order + 1):
                seen.update(own[k])
        # A suffix of a context occurs at least as often, but for a text's first bytes.
        known = {b""} | {c for c, n in seen.items() if n >= least}
        self.contexts = sorted((c for c in known if all(c[i:] in known for i in range(len(c)))),
                               key=lambda c: (len(c), c))
        place = {c: i for i, c in enumerate(self.contexts)}
        # Parallel lists of (language, context, byte, count).
        self.entries = np.array([
            (j, place[g[:-1]], g[-1], n) for j, own in enumerate(counts)
            for k in range(1, order + 2) for g, n in own[k].items() if g[:-1] in place
        ], dtype=np.int32).reshape(-1, 4)

    def compiled(self) -> tuple[np.ndarray, np.ndarray]:
        """Next states [state, byte] and code lengths in bits [state, byte, language].

        Byte 256 pads lanes: it leads to the root and costs nothing.
        """
        place = {c: i for i, c in enumerate(self.contexts)}
        n_states, n_langs = len(self.contexts), len(self.languages)
        # The tables are filled in place, one context after the other: a worker holds them once.
        step = np.zeros((n_states, 257), np.int32)
        bits = np.zeros((n_states, 257, n_langs), np.float32)
        e = self.entries[np.argsort(self.entries[:, 1], kind="stable")]
        edge = np.searchsorted(e[:, 1], np.arange(n_states + 1))
        longer: dict[bytes, list[int]] = {}
        for i, c in enumerate(self.contexts[1:], 1):
            longer.setdefault(c[:-1], []).append(i)
        for i, c in enumerate(self.contexts):
            own = e[edge[i]:edge[i + 1]]
            count = np.zeros((256, n_langs), np.float32)
            count[own[:, 2], own[:, 0]] = own[:, 3]
            # A context is reached from the one without its last byte, else from a shorter one.
            shorter = place[c[1:]] if c else 0
            step[i] = step[shorter]
            for k in longer.get(c, ()):
                step[i, self.contexts[k][-1]] = k
            below = bits[shorter, :256] if c else np.full((256, n_langs), 8, np.float32)
            n, t = count.sum(0), (count > 0).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log2(n + t) - np.log2(count)
                # Where a context was never seen, going on to the shorter one costs nothing.
                escape = np.where(n > 0, np.log2(n + t) - np.log2(t), 0)
                bits[i, :256] = np.where(count > 0, seen, below + escape)
        return step, bits


def _tables(handle) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """A worker compiles the model once, not once for each task."""
    def make():
        model = handle.value
        return model.languages, model.order, *model.compiled()

    return held(("language", handle.id), make)


class Handle:
    """A model as broadcast, with the id by which workers know it."""

    def __init__(self, broadcast, id_: str):
        self.broadcast, self.id = broadcast, id_

    @staticmethod
    def of(docs: DataFrame, model: Model) -> Handle:
        return Handle(docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex)

    @property
    def value(self) -> Model:
        return self.broadcast.value


def code_lengths(data: np.ndarray, at: np.ndarray, order: int, step: np.ndarray,
                 bits: np.ndarray) -> np.ndarray:
    """Bits of each text [text, language]; texts lie between the offsets ``at``."""
    n_langs = bits.shape[2]
    out = np.zeros((len(at) - 1, n_langs))
    start, end, text = lanes(at, LANE)
    if not len(text):
        return out
    early = np.maximum(start - order, at[:-1][text])
    step, bits, data = step.ravel(), bits.reshape(-1, n_langs), data.astype(np.int16)
    for lo in range(0, len(text), 8192):
        part = slice(lo, lo + 8192)
        symbols = grid(data, early[part], end[part], 256)
        state = np.zeros(symbols.shape[1], np.int32)
        total = np.zeros((symbols.shape[1], n_langs))
        warm = start[part] - early[part]
        for j, row in enumerate(symbols):
            where = state * 257 + row
            cost = bits[where]
            if j < order:
                cost = cost * (warm <= j)[:, None]
            total += cost
            state = step[where]
        np.add.at(out, text[part], total)
    return out


def sample(docs: DataFrame, docs_per_language: int, chars_per_doc: int) -> dict[str, list[str]]:
    """Texts to fit from, per language: rows whose hash falls under the share that is wanted.

    ``docs`` has doc_id, text and lang.  The driver gets about docs_per_language x languages
    rows, in expectation, of at most chars_per_doc characters, whatever the size of the input.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for k, n in counts.items()
                           for x in (k, min(1.0, docs_per_language / n))))
    out: dict[str, list[str]] = {}
    for r in known.where(at < share[F.col("lang")]).select(
            "doc_id", "lang", F.substring("text", 1, chars_per_doc).alias("text")).collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def fit(docs: DataFrame, docs_per_language: int = 250, chars_per_doc: int = 2000) -> Model:
    """A model from a bounded sample of ``docs`` (doc_id, text, lang).

    Rows without language or letter teach nothing.  Without any row the model knows no language.
    """
    return Model(sample(docs, docs_per_language, chars_per_doc))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte for every row of ``docs`` (doc_id, text).

    The language with the shortest code wins (ties: the first by name); the score is its share
    of the languages' probabilities, each taken per eight bytes of text at most 64 times, so that
    a long text does not saturate.  A text that is null or has no letter is ``und`` with score 0,
    as is every text where no language was learned.  Equal rows stay equal rows.
    """
    handle = Handle.of(docs, model)

    def score(batches):
        for batch in pieces(batches, "text"):
            names, share, rate = _judged(handle, batch.column("text"), batch.column("letter"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(share), "bits_per_byte": pa.array(rate)})

    slim = texts(docs).withColumn("letter", F.col("text").rlike("\\p{L}"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        score, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def _judged(handle: Handle, text: pa.Array, letter: pa.Array) -> tuple:
    """Names, scores and bits per byte of a batch of texts."""
    languages, order, step, bits = _tables(handle)
    data, at = as_bytes(pa.compute.utf8_lower(text))
    letter = letter.to_numpy(zero_copy_only=False).astype(bool)
    size = np.maximum(np.diff(at), 1)
    if not languages:
        return np.full(len(size), NO_LETTER, object), 0.0 * size, 0.0 * size
    total = code_lengths(data, at, order, step, bits)
    scale = np.minimum(1, 64 / size)[:, None]
    share = 1 / np.exp2((total.min(1, keepdims=True) - total) * scale).sum(1)
    names = np.array(languages, object)[total.argmin(1)]
    return (np.where(letter, names, NO_LETTER), np.where(letter, share, 0.0),
            np.where(letter, total.min(1) / size, 0.0))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more.

    Rows pass with all their columns; nothing is joined or shuffled.  A row whose text is null
    or has no letter is rejected.
    """
    handle, mark, schema = Handle.of(docs, model), "__letter", docs.schema

    def choose(batches):
        for batch in pieces(batches, "text"):
            names, share, _ = _judged(handle, batch.column("text"), batch.column(mark))
            keep = pa.array((names != NO_LETTER) & (share >= least))
            yield batch.select(schema.names).filter(keep)
        give_back()

    return docs.where(F.col("text").isNotNull()).withColumn(
        mark, F.col("text").rlike("\\p{L}")).mapInArrow(choose, schema)


def held_out(column="doc_id"):
    """The test fold: every fifth by the checksum of the id as text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Fit on the rows outside the test fold, then predict every row of ``docs``."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), **bounds)
    return predict(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
