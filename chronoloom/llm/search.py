"""Exact top-k search by BM25 over an inverted index with block maxima.

Documents are indexed where they are read, in segments of a bounded number of words: sorted
terms, and for each its postings (document, frequency).  The index is written once.  Document
frequencies and lengths that scores need are those of all documents.

A query is the set of its words.  Queries are taken in blocks of a bounded number of terms; each
block is sent to all segments.  In a segment the postings of a query's rare terms are added up
first.  Its frequent terms have a score in most documents; for these, documents form ranges of
RANGE, the greatest impact of a term in each range is known, and a query's sum of them bounds
what a document of the range can still gain.  Only documents whose sum and bound reach the
query's k-th best score so far (over all segments that the task has seen) are scored in full.
Bounds are never below scores, so the merged result is that of scoring everything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, cut, pieces, texts
from .neardup import _P, _mix, _powers

K1, B = 1.2, 0.75
SEGMENT_WORDS = 3_000_000
RANGE = 32
#: A term in one of so many documents or more (and in so many) is frequent.
FREQUENT = 16
BLOCK_TERMS = 400_000
#: Letters and digits of ASCII and all bytes of other characters make words.
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower case, and each text's n + 1 offsets among them."""
    data, ends = as_bytes(pc.utf8_lower(column))
    word = _IN_WORD[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[ends] = True
    before = np.concatenate([[False], word[:-1]]) & ~opens[:-1] if len(data) else word
    after = np.concatenate([word[1:], [False]]) & ~opens[1:] if len(data) else word
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[:-1], out=total[1:])
    hashes = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _P)
    return hashes, np.searchsorted(start, ends)


def _segment(ids: list, hashes: list[np.ndarray], sizes: list[np.ndarray]) -> tuple:
    """One segment's columns from its documents' words."""
    words, size = np.concatenate(hashes), np.concatenate(sizes)
    doc = np.repeat(np.arange(len(size), dtype=np.int64), size)
    order = np.lexsort((doc, words))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    frequency = np.diff(np.append(at, len(words)))
    words, doc = words[at], doc[at]
    first = np.ones(len(words), bool)
    first[1:] = words[1:] != words[:-1]
    start = np.flatnonzero(first)
    return (ids, len(size), int(size.sum()), size.astype("<u4").tobytes(),
            words[start].astype("<u8").tobytes(),
            np.append(start, len(words)).astype("<u4").tobytes(), doc.astype("<u4").tobytes(),
            frequency.astype("<u4").tobytes())


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the inverted index over every row of ``docs``.

    Null and empty texts are documents of length zero.
    """
    slim = texts(docs, id_col, text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["ids", "n_docs", "n_words", "lengths", "terms", "starts", "docs", "counts"]

    def run(batches):
        ids, hashes, sizes, n, form = [], [], [], 0, None

        def out():
            row = _segment(ids, hashes, sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.list_(form)), pa.array([row[1]], pa.int64()),
                 pa.array([row[2]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[3:])],
                names)

        for batch in pieces(batches, "text"):
            form = batch.column("doc_id").type
            found, at = terms(batch.column("text"))
            ids += batch.column("doc_id").to_pylist()
            hashes.append(found)
            sizes.append(np.diff(at))
            n += len(found)
            if n >= SEGMENT_WORDS:
                yield out()
                ids, hashes, sizes, n = [], [], [], 0
        if ids:
            yield out()

    return slim.mapInArrow(run, f"ids array<{kind}>, n_docs long, n_words long, lengths binary, "
                           "terms binary, starts binary, docs binary, counts binary")


class Segment:
    """An index segment with impacts under the corpus' mean length; those of frequent terms also as
    a table of term and document, with its maxima by range."""

    def __init__(self, row: dict, mean: float):
        self.ids = row["ids"]
        self.n = len(self.ids)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.docs = np.frombuffer(row["docs"], "<u4").astype(np.int64)
        tf = np.frombuffer(row["counts"], "<u4").astype(np.float64)
        length = np.frombuffer(row["lengths"], "<u4")[self.docs]
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        size = np.diff(self.starts)
        frequent = np.flatnonzero((size * FREQUENT >= self.n) & (size >= FREQUENT))
        self.row = np.full(len(self.terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        width = -(-self.n // RANGE)
        self.full = np.zeros((len(frequent), width * RANGE))
        for r, t in enumerate(frequent.tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            self.full[r, self.docs[at]] = self.impact[at]
        self.most = self.full.reshape(len(frequent), width, RANGE).max(2)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted terms (sorted), -1 where the segment lacks one."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def best(self, places: np.ndarray, weights: np.ndarray, k: int, floor: float
             ) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of at least the k best ones that reach ``floor``."""
        row = self.row[places]
        rare = row < 0
        start = self.starts[places[rare]]
        size = self.starts[places[rare] + 1] - start
        posting = _ranges(start, size)
        sums = np.bincount(self.docs[posting], np.repeat(weights[rare], size)
                           * self.impact[posting], self.n)
        row, weight = row[~rare], weights[~rare][:, None]
        bound = sums + np.repeat((weight * self.most[row]).sum(0), RANGE)[:self.n]
        bound *= 1 + 1e-9

        def scored(docs: np.ndarray) -> np.ndarray:
            if 8 * len(docs) < self.n:
                return sums[docs] + (weight * self.full[row[:, None], docs]).sum(0)
            # Whole rows are read faster than many places of them; the order of sums is the same.
            every = np.zeros(self.full.shape[1])
            for r, w in zip(row, weight[:, 0]):
                every += self.full[r] * w
            return sums[docs] + every[docs]

        if self.n > 4 * k:
            # The most promising ones raise the floor before the others are looked at.
            first = scored(np.argpartition(bound, self.n - 2 * k)[-2 * k:])
            floor = max(floor, float(np.partition(first, k)[k]) - 1e-6)
        hit = np.flatnonzero((bound >= floor) & (bound > 0))
        score = scored(hit)
        keep = (score >= floor) & (score > 0)
        return hit[keep], score[keep]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``start``, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


def _query_terms(queries: DataFrame) -> DataFrame:
    """query_id and the sorted different terms of every query that has one."""
    kind = queries.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "text"):
            found, at = terms(batch.column("text"))
            sets = [np.unique(found[a:b]).view(np.int64) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                ["query_id", "terms"])

    return queries.mapInArrow(run, f"query_id {kind}, terms array<long>").where(
        F.size("terms") > 0)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id and score of each query's k best documents.

    Ties go to the lesser id.  Documents without a word of the query have no rank, so a query
    may have fewer than k rows or none.  Equal rows of ``docs`` are ranked each; equal rows of
    ``queries`` are one query.  Query ids should not repeat with other texts.
    """
    spark = docs.sparkSession
    segments = cut(index(docs, id_col, text_col))
    wanted = cut(_query_terms(texts(queries, id_col, text_col).where(
        "doc_id is not null")).dropDuplicates(["query_id"]))
    facts = segments.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w")).first()
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    asked = wanted.schema["query_id"].dataType.simpleString()
    n_terms = wanted.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    mean = (facts["w"] or 0) / max(facts["n"] or 0, 1) or 1.0
    blocks = max(1, math.ceil(n_terms / BLOCK_TERMS))
    parts = []
    for block in range(blocks):
        # About BLOCK_TERMS terms, whatever the number of queries; the blocks take turns.
        rows = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        sets = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        every = np.unique(np.concatenate(sets))
        shared = spark.sparkContext.broadcast(every)

        def count(batches, shared=shared):
            total = np.zeros(len(shared.value), np.int64)
            for batch in batches:
                for t, s in zip(batch.column("terms").to_pylist(),
                                batch.column("starts").to_pylist()):
                    own, size = np.frombuffer(t, "<u8"), np.diff(np.frombuffer(s, "<u4"))
                    if len(own):
                        at = np.minimum(np.searchsorted(own, shared.value), len(own) - 1)
                        total += np.where(own[at] == shared.value, size[at], 0)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])],
                                             ["term", "df"])

        told = segments.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy(
            "term").agg(F.sum("df").alias("df")).toPandas()
        df = np.zeros(len(every))
        df[told["term"].to_numpy(np.int64)] = told["df"].to_numpy(np.float64)
        idf = np.log(1 + (facts["n"] - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast(
            ([r["query_id"] for r in rows], every, idf,
             [np.searchsorted(every, s) for s in sets]))

        def run(batches, shared=shared):
            names, every, idf, sets = shared.value
            kept: list[list[tuple]] = [[] for _ in names]
            floor = np.zeros(len(names))
            form = None
            for batch in batches:
                form = batch.schema.field("ids").type.value_type
                for i in range(batch.num_rows):
                    segment = Segment(batch.slice(i, 1).to_pylist()[0], mean)
                    place = segment.find(every)
                    for q, own in enumerate(sets):
                        at = place[own]
                        there = at >= 0
                        if not there.any():
                            continue
                        hit, score = segment.best(at[there], idf[own[there]], k, floor[q])
                        if len(hit):
                            # Rounded, as sums of equal documents may differ in the last bits.
                            found = kept[q] + [(-round(s, 9), segment.ids[d])
                                               for d, s in zip(hit.tolist(), score.tolist())]
                            found.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
                            kept[q] = found[:k]
                            if len(found) >= k:
                                floor[q] = -kept[q][-1][0] - 1e-6
            rows_ = [(n, d, -s) for n, found in zip(names, kept) for s, d in found]
            if rows_:
                q, d, s = zip(*rows_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(d, form), pa.array(s, pa.float64())],
                    ["query_id", "doc_id", "score"])

        parts.append(cut(segments.select(
            "ids", "lengths", "terms", "starts", "docs", "counts").mapInArrow(
            run, f"query_id {asked}, doc_id {kind}, score double")))
    if not parts:
        return spark.createDataFrame([], f"query_id {asked}, rank int, doc_id {kind}, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    # At most k rows of a query come from a task.
    place = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "score")
