"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of its five-word shingles: the logarithmic count of a shingle times
its inverse document frequency, damped by a fourth root: in a group of thousands of copies the
common shingles are frequent and the differing ones rare, and undamped weights would count a few
differing words as more than all the text in common.  Frequencies are counted over all documents in a fixed
number of hashed buckets.  Improved consistent weighted sampling draws SAMPLES samples; two
documents agree in each with the probability of their weighted Jaccard similarity.  ROWS samples
make a band, and documents that share a band are candidates.

No pairs within a bucket are listed.  Equal texts are one node throughout.  In each bucket the
nodes are paired with one pivot only, the node that shares most with others over all its
buckets; pairs are verified by their exact weighted Jaccard similarity, and linked nodes form
components.  Where a bucket still holds several components, its nodes outside the main one are
compared with all others by their samples, block by block, and every pair of two components whose
samples agree enough is verified in the task, once, in the first band that it shares.  A link
between components is thus missed only if its samples agree in too few places or share no band.

Results are component labels: nothing about documents goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, let_go, pieces, texts
from .components import components

WORDS = 5
SAMPLES, ROWS = 80, 4
BUCKETS = 1 << 18
#: Bytes of text that a worker shingles at a time.
PIECE = 1 << 20
#: Bits of the map of documents that have a candidate.
BITS = 1 << 25
#: Members of a bucket compared with one another's blocks at a time, and queries among them.
BLOCK, QUERIES = 512, 512
#: Pairs whose samples agree in fewer places are not verified: a pair of similarity 0.8 agrees
#: in 64 of 80 on average and in fewer than 50 once in three thousand times.
LEAST_AGREEING = 50

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * PIECE)
        for name, factor in (("up", _P), ("down", _P_INVERSE)):
            out = np.full(size, factor, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Shingled:
    """Shingle hashes of a batch of texts; those of text i lie between at[i] and at[i + 1].

    Words are runs without blanks, in lower case.  A text of fewer than five words has one
    shingle of them all; one without words has none.  ``keys`` are two hashes of all words.
    """

    def __init__(self, column: pa.Array):
        data, ends = as_bytes(pc.utf8_lower(column))
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        word = np.concatenate([~blank, [False]])
        first = word[:-1].copy()
        first[1:] &= blank[:-1]
        first[ends[:-1][ends[:-1] < len(data)]] = word[ends[:-1][ends[:-1] < len(data)]]
        last = word[:-1].copy()
        last[:-1] &= blank[1:]
        stops = ends[1:][ends[1:] > 0] - 1
        last[stops] = word[stops]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:-1], out=total[1:])
        words = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        w = np.searchsorted(start, ends)
        n = np.diff(w)
        self.words = n
        # The shingles of a text start at all its words but the last four.
        count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
        self.at = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(w[:-1] - self.at[:-1], count) + np.arange(self.at[-1])
        bound = np.repeat(w[1:], count)
        out = np.zeros(len(place), np.uint64)
        padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
        for k in range(WORDS):
            out = np.where(place + k < bound, _mix(out * _P + padded[place + k]), out)
        self.hashes = out
        self.keys = []
        for salt in _mix(np.arange(1, 3, dtype=np.uint64)):
            each = _mix(padded[:-WORDS] + salt)
            run = np.concatenate([[np.uint64(0)], np.cumsum(each * _powers(len(each) + 1)[0][:-1])])
            # Powers count from the batch's start; dividing makes the hash the text's own.
            key = (run[w[1:]] - run[w[:-1]]) * _powers(len(each) + 1)[1][np.minimum(
                w[:-1], len(each))]
            self.keys.append(_mix(key + n.astype(np.uint64)).view(np.int64))

    def sets(self):
        """Each text's different shingles and their counts."""
        for lo, hi in zip(self.at, self.at[1:]):
            yield np.unique(self.hashes[lo:hi], return_counts=True)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


class Weights:
    """Weights of shingles from the hashed document frequencies of the whole corpus."""

    def __init__(self, frequency: np.ndarray, documents: int):
        rare = np.log((documents + 1.0) / (np.minimum(frequency, documents) + 1.0))
        self.idf = ((1 + rare / np.log(BUCKETS)) ** 0.25).astype(np.float32)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)).astype(np.float32) * self.idf[bucket(hashes)]


class Sampler:
    """Consistent weighted samples.  The random numbers of a shingle come from three tables,
    each entered by other bits of its hash."""

    def __init__(self, samples: int = SAMPLES, seed: int = 17):
        rng = np.random.default_rng(seed)
        shape = (4096, samples)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.inverse = 1 / self.r
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.number = np.arange(samples)
        self.salt = _mix(np.arange(1, samples + 1).astype(np.uint64))

    def draw(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """64-bit samples of one weighted set that is not empty."""
        best = np.full(len(self.number), np.inf, np.float32)
        shingle = np.zeros(len(self.number), np.uint64)
        level = np.zeros(len(self.number), np.float32)
        logs = np.log(weights)[:, None]
        for lo in range(0, len(hashes), 512):
            h = hashes[lo:lo + 512]
            i, j, k = ((h >> np.uint64(s) & np.uint64(4095)).astype(np.int64) for s in (0, 12, 24))
            r, beta = self.r[i], self.beta[j]
            t = np.floor(logs[lo:lo + 512] * self.inverse[i] + beta)
            a = self.log_c[k] - r * (t - beta + 1)
            row = a.argmin(0)
            least = a[row, self.number]
            new = least < best
            best = np.where(new, least, best)
            shingle = np.where(new, h[row], shingle)
            level = np.where(new, t[row, self.number], level)
        return _mix(shingle + self.salt * (level.astype(np.int64).view(np.uint64)
                                           + np.uint64(1 << 20)))


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    """One per worker."""
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two sets, each as sorted hashes and weights."""
    (x, u), (y, v) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = float(np.minimum(u[both], v[at[both]]).sum())
    return common / (float(u.sum()) + float(v.sum()) - common)


def frequencies(slim: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a shingle in each bucket, and the number of documents.

    Each task counts its own rows; its at most BUCKETS sums are added up by Spark, and the
    driver receives at most BUCKETS rows, whatever the input.
    """
    def count(batches):
        let_go()
        total, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in pieces(batches, "text", PIECE):
            told = Shingled(batch.column("text"))
            documents += batch.num_rows
            for hashes, _ in told.sets():
                total[np.unique(bucket(hashes))] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], documents))],
            ["bucket", "n"])

    rows = slim.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    real = rows[rows["bucket"] >= 0]
    out[real["bucket"].to_numpy()] = real["n"].to_numpy()
    return out, int(rows.loc[rows["bucket"] < 0, "n"].sum())


def signatures(slim: DataFrame, weights) -> DataFrame:
    """doc_id, k1, k2 (the text's hashes), words, bands (hashes), samples (32 bits each)."""
    kind = slim.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        let_go()
        draw = sampler().draw
        w = weights.value
        number = np.arange(SAMPLES // ROWS, dtype=np.uint64)
        for batch in pieces(batches, "text", PIECE):
            told = Shingled(batch.column("text"))
            bands, samples = [], []
            for hashes, counts in told.sets():
                if not len(hashes):
                    bands.append(None)
                    samples.append(None)
                    continue
                drawn = draw(hashes, w.of(hashes, counts))
                key = number
                for k in range(ROWS):
                    key = _mix(key * _P + drawn[k::ROWS])
                bands.append(key.view(np.int64))
                samples.append((drawn >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(told.keys[0]), pa.array(told.keys[1]),
                 pa.array(told.words, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(samples, pa.binary())],
                ["doc_id", "k1", "k2", "words", "bands", "samples"])

    return slim.mapInArrow(sign, f"doc_id {kind}, k1 long, k2 long, words long, "
                           "bands array<long>, samples binary")


def verify(pairs: DataFrame, slim: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' weighted Jaccard similarity reaches ``threshold``.

    The second text comes by a join on a node that may have many partners: adaptive execution
    splits such a join, and nothing is grouped by the node.
    """
    kind = slim.schema["doc_id"].dataType.simpleString()

    def compare(batches):
        let_go()
        w = weights.value
        for batch in pieces(batches, "text_a", PIECE):
            sets = []
            for column in ("text_a", "text_b"):
                told = Shingled(batch.column(column))
                sets.append([(h, w.of(h, c)) for h, c in told.sets()])
            keep = pa.array([similarity(x, y) >= threshold for x, y in zip(*sets)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    one = slim.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = slim.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        compare, f"a {kind}, b {kind}")


def _with_ids(slim: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``slim`` whose id is among ``ids`` (doc), and some others.

    The ids become a bit map of fixed size, which is sent to all tasks, so that the text of
    documents without candidates is not shuffled.  Where ids are so many that most bits are set,
    more rows pass; the joins that follow are exact in any case.
    """
    def place(column):
        return F.pmod(F.xxhash64(column), F.lit(BITS))

    marks = ids.select(place("doc").alias("at")).groupBy(
        F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr(
            "shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    told = slim.withColumn("at", place("doc_id")).withColumn("word", F.shiftright("at", 6))
    # At most BITS / 64 rows of two numbers.
    return told.join(F.broadcast(marks), "word").where(
        F.expr("shiftright(bits, cast(at & 63 as int)) & 1 = 1")).select(*slim.columns)


def _candidates(group: pa.Table):
    """Rows q and c of a group, where q asks and c are all members that it may be linked to: of
    another component, alike in LEAST_AGREEING samples, and met in no earlier band.

    Of two nodes outside the main component, which ask each other, the greater one counts.
    """
    asks = group.column("asks").to_numpy()
    outside = group.column("outside").to_numpy()
    band = group.column("band")[0].as_py()
    drawn = np.frombuffer(b"".join(group.column("samples").to_pylist()), "<u4").reshape(
        len(asks), -1)
    rank, labels = (np.unique(np.array(group.column(c).to_pylist(), object),
                              return_inverse=True)[1] for c in ("doc", "label"))
    there = np.flatnonzero(~asks)
    for q in np.flatnonzero(asks):
        same = drawn[there] == drawn[q]
        agree = same.sum(1)
        near = np.flatnonzero((agree >= LEAST_AGREEING) & (labels[there] != labels[q])
                              & (~outside[there] | (rank[there] < rank[q])))
        first = same[near].reshape(len(near), SAMPLES // ROWS, ROWS).all(2).argmax(1)
        near = near[first == band]
        if len(near):
            yield q, there[near[np.argsort(-agree[near], kind="stable")]], labels


def _linked(group: pa.Table, sets: list[tuple], threshold: float):
    """Row pairs whose similarity reaches ``threshold``, without those that only repeat that two
    components are linked: every other candidate of the group is compared."""
    at = np.cumsum([0, *(len(h) for h, _ in sets)])
    names, place = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    total = np.add.reduceat(weight, at[:-1])
    mine, root = np.zeros(len(names)), None
    for q, near, labels in _candidates(group):
        root = np.arange(len(sets)) if root is None else root
        own = place[at[q]:at[q + 1]]
        mine[own] = weight[at[q]:at[q + 1]]
        while len(near := near[root[labels[near]] != root[labels[q]]]):
            now, near = near[:64], near[64:]
            n = at[now + 1] - at[now]
            starts = np.cumsum(n) - n
            rows = np.arange(n.sum()) + np.repeat(at[now] - starts, n)
            common = np.add.reduceat(np.minimum(mine[place[rows]], weight[rows]), starts)
            told = common / (total[q] + total[now] - common)
            # Sums of other precision are only trusted away from the threshold.
            for c in now[told >= threshold - 1e-3]:
                x, y = root[labels[q]], root[labels[c]]
                if x != y and similarity(sets[q], sets[c]) >= threshold:
                    root[root == y] = x
                    yield q, c
        mine[own] = 0


def _other_components(buckets: DataFrame, labels: DataFrame, samples: DataFrame,
                      there: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (a, b) between the components of every bucket.

    Nodes outside their bucket's main component are compared with the members of all others,
    block by block.  Those that have a candidate get their text, and all their candidates are
    verified in the task.  Of the links that hold it gives those that tie components together,
    so rows do not grow with the square of a bucket.  After this pass every candidate of two
    components has been verified, or links that hold join the two.
    """
    named = cut(buckets.join(labels, buckets["doc"] == labels["node"], "left").select(
        "key", "band", "doc", F.coalesce("label", "doc").alias("label")))
    # Buckets that hold one component only need no look.
    open_ = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("n")).where("parts > 1").select(
        # The main component is the largest: as few nodes as can be ask, and members are
        # copied once for every QUERIES nodes that ask.
        "key", F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / QUERIES).alias("turns"))
    rows = cut(named.join(open_, "key").join(samples, "doc").withColumn(
        "outside", F.expr("label != main")))
    told = ["key", "band", "block", "turn", "doc", "label", "samples", "outside"]
    member = rows.withColumn("block", F.pmod(F.xxhash64("doc", "key"), "blocks")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(
        *told, F.lit(False).alias("asks"))
    asking = rows.where("outside").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "turn", F.pmod(F.xxhash64("doc"), "turns")).select(*told, F.lit(True).alias("asks"))
    kind = buckets.schema["doc"].dataType.simpleString()

    def met(group: pa.Table) -> pa.Table:
        used = np.zeros(group.num_rows, bool)
        for q, near, _ in _candidates(group):
            used[q] = used[near] = True
        return group.filter(pa.array(used))

    def compare(group: pa.Table) -> pa.Table:
        w, sets = weights.value, []
        for batch in pieces(group.to_batches(), "text"):
            sets += [(h, w.of(h, c)) for h, c in Shingled(batch.column("text")).sets()]
        docs = group.column("doc").to_pylist()
        out = [sorted((docs[q], docs[c])) for q, c in _linked(group, sets, threshold)]
        form = group.schema.field("doc").type
        return pa.table({"a": pa.array([y for _, y in out], form),
                         "b": pa.array([x for x, _ in out], form)})

    both = member.union(asking)
    some = cut(both.groupBy("key", "block", "turn").applyInArrow(met, both.schema))
    return some.join(there.withColumnRenamed("doc_id", "doc"), "doc").groupBy(
        "key", "block", "turn").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _name(text):
    """What a text is known by: rows of one id may hold different texts, and each of them counts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """own (id), name (of the text), class (a text's name; null: no words) and class_id by row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(_name(F.col(text_col)).alias("name"), F.col(id_col).alias("own")).alias("doc_id"),
        F.coalesce(text_col, F.lit("")).alias("text"))
    slim = rows.select(F.col("doc_id.name").alias("doc_id"), "text")
    frequency, documents = frequencies(slim)
    weights = spark.sparkContext.broadcast(Weights(frequency, documents))
    signed = cut(signatures(rows, weights).select(
        "doc_id.own", "doc_id.name", "k1", "k2", "words", "bands", "samples"))
    # Texts of equal words become one node, named by the least name.
    nodes = cut(signed.where("words > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("name", "bands", "samples")).alias("r"), F.min("own").alias("own")).select(
        "k1", "k2", "own", F.col("r.name").alias("doc"), "r.bands", "r.samples"))
    keyed = nodes.select("doc", F.posexplode("bands").alias("band", "hash")).select(
        "doc", "band", F.xxhash64("band", "hash").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(keyed.join(sizes, "key"))
    shared = met.groupBy("doc").agg(F.sum("n").alias("shared"))
    buckets = cut(met.join(shared, "doc").select("key", "band", "doc", "shared"))
    pivots = buckets.groupBy("key").agg(F.max(F.struct("shared", "doc")).alias("top"))
    tested = cut(buckets.join(pivots, "key").select(
        F.greatest("doc", "top.doc").alias("a"), F.least("doc", "top.doc").alias("b")).where(
        "a > b").distinct())
    there = cut(_with_ids(slim, buckets).dropDuplicates(["doc_id"]))
    links = cut(verify(tested, there, weights, threshold))
    samples = nodes.select("doc", "samples")
    labels = cut(components(links))
    new = cut(_other_components(buckets, labels, samples, there, weights, threshold))
    labels = cut(components(links.union(new)))
    named = nodes.join(labels, nodes["doc"] == labels["node"], "left").select(
        "k1", "k2", "own", F.coalesce("label", "doc").alias("class"))
    told = named.join(named.groupBy("class").agg(F.min("own").alias("class_id")), "class").select(
        "k1", "k2", "class", "class_id")
    with_words = signed.where("words > 0").select("own", "name", "k1", "k2").join(
        told, ["k1", "k2"], "left").select("own", "name", "class", "class_id")
    without = signed.where("words = 0").select(
        "own", "name", F.lit(None).cast("binary").alias("class"), F.col("own").alias("class_id"))
    return with_words.union(without)


def classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id and class_id, the least id among its near-duplicates, for every row of ``docs``.

    A document alone is its own class, as is every one without words (null or empty text).
    Rows with a null id take part by their text; where no row of a class has an id, its class_id
    is null.  Equal rows stay equal rows, in one class.  Where an id has several texts, each row
    has the class of its own text; classes that begin with one id then share a class_id.  Ids
    must be of a type with an order.
    """
    return _classes(docs, threshold, id_col, text_col).select(
        F.col("own").alias("doc_id"), "class_id")


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each class: the one of the least id.

    Rows without an id stay.  Different texts of one id are documents of their own; equal texts
    of one id count as one document, and rows without words as one for each id.  The text is
    shuffled for repeated rows only.
    """
    told = cut(_classes(docs, threshold, "doc_id", "text").where("own is not null"))
    alone = F.when(F.col("class").isNull(), F.col("own"))
    first = told.groupBy("class", alone.alias("alone")).agg(
        F.min(F.struct("own", "name")).alias("r")).select("r.own", "r.name")
    kept = told.join(first, ["own", "name"], "left_semi").groupBy("own", "name").agg(
        F.count(F.lit(1)).alias("n")).withColumnRenamed("own", "doc_id").withColumnRenamed("name", "__name")
    keys = ["doc_id", "__name"]
    stay = docs.withColumn("__name", _name(F.col("text"))).join(kept, keys).drop("__name")
    once = stay.where("n = 1").drop("n")
    twice = stay.where("n > 1").drop("n").dropDuplicates(["doc_id", "text"])
    return once.union(twice).union(docs.where("doc_id is null").select(*once.columns)).select(*docs.columns)
