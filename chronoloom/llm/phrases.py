"""Collocations: phrases of two or three words that occur together more often than their parts.

Counts come from depth-truncated suffix trees, built by vertical partitioning:

1. Words are counted (added up in tasks before they are shuffled).  These are the trees' first
   level.  A bit map of fixed size marks the frequent ones; a rare word starts no tree and ends
   every suffix, since no phrase that holds it can be frequent.
2. The suffixes, cut after three words, are written once, equal ones of a block of text as one
   with a count.  They are dealt by the hash of their first word into slots, and those of a block
   and slot make one packet (steps of codes, and each word once), so that a shuffle moves few and
   small rows.  The packets of a slot over the memory budget are split by the second and, if need
   be, the third word.  Slots are then packed into groups within the budget, so that a word that
   starts a third of all suffixes is many groups.
3. Each group sorts its suffixes, which gives the tree's leaves in order, and reads the counts
   of its nodes as sums over leaves.  Where prefixes have three words, the nodes of two words
   above them lie in several groups, whose sums are added.

Words are compared as text everywhere; hashes only choose slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, let_go, pieces

#: Languages of rows that have none.
NO_LANG = "und"
#: Bits of the map of frequent words (1 MB); a false mark costs a row, never a result.
MARKS = 1 << 23
#: Suffixes that one group may hold.
BUDGET = 1 << 19
#: Words of one block, whose equal suffixes become one.
BLOCK = 1 << 21
#: Slots of prefixes of one word at least and at most, and what a longer prefix splits one into.
SLOTS, SPLIT = (256, 1 << 16), 64

# Byte classes: part of a word, blank, end of a piece.
_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_WORDS = "lang string, word string, f long"
_PACKETS = "s1 int, s2 int, s3 int, size long, packet binary"
_NODES = "lang string, w1 string, w2 string, w3 string, f long, whole boolean"


def tokens(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of a batch of texts, each one's text, and whether it goes on from the last one."""
    data, at = as_bytes(column)
    data = _LOWER[data]
    kind = _CLASS[data]
    inside = kind == _WORD
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    first = first[:-1]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    start = np.flatnonzero(start)
    # Every word's length is the number of word bytes up to the next word.
    kept = np.cumsum(inside, dtype=np.int64)
    before = kept[start] - 1
    offsets = np.append(before, kept[-1] if len(kept) else 0)
    words = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes()))
    breaks = np.cumsum((kind == _BREAK).astype(np.int32) + first, dtype=np.int32)[start]
    goes_on = np.zeros(len(start), bool)
    goes_on[1:] = breaks[1:] == breaks[:-1]
    text = np.searchsorted(at, start, side="right") - 1
    return words.dictionary_encode(), text, goes_on


class Block:
    """Words of one or more batches: codes of (language, word), and which ones go on."""

    def __init__(self):
        self.words, self.langs, self.goes_on, self.n = [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        words, text, goes_on = tokens(batch.column("text"))
        langs = batch.column("lang").cast(pa.large_string()).dictionary_encode()
        self.words.append(words)
        self.langs.append(langs.take(pa.array(text)))
        self.goes_on.append(goes_on)
        self.n += len(words)

    def close(self) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """Codes, goes_on, and per code its language and its word."""
        words = pa.chunked_array(self.words).unify_dictionaries().combine_chunks()
        langs = pa.chunked_array(self.langs).unify_dictionaries().combine_chunks()
        goes_on = np.concatenate(self.goes_on)
        self.words, self.langs, self.goes_on = [], [], []
        n = max(1, len(words.dictionary))
        both = langs.indices.to_numpy().astype(np.int64)
        both *= n
        both += words.indices.to_numpy()
        room = n * len(langs.dictionary)
        if room <= 2 * len(both) + (1 << 16):
            # A table of all (language, word) is smaller than what sorting the codes would take.
            seen = np.zeros(room, bool)
            seen[both] = True
            told = np.flatnonzero(seen)
            code = np.cumsum(seen, dtype=np.int32)[both]
            code -= 1
        else:
            told, code = np.unique(both, return_inverse=True)
            code = code.astype(np.int32)
        del both
        return (code, goes_on, langs.dictionary.take(pa.array(told // n)),
                words.dictionary.take(pa.array(told % n)))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    block = Block()
    for batch in pieces(batches, "text"):
        block.add(batch)
        if block.n >= size:
            yield block
            block = Block()
    if block.n:
        yield block


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [part.split() for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) and c.type == kinds[k] else pa.array(c).cast(kinds[k])
         for c, (_, k) in zip(columns, names)], names=[n for n, _ in names])


def count_words(slim: DataFrame, size: int = BLOCK) -> DataFrame:
    """lang, word and f, the number of its occurrences."""
    def count(batches):
        let_go()
        for block in blocks(batches, size):
            code, _, lang, word = block.close()
            yield _batch(_WORDS, lang, word, np.bincount(code, minlength=len(word)))

    return slim.mapInArrow(count, _WORDS).groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _mark(lang: str, word: str) -> Column:
    return F.pmod(F.xxhash64(lang, word), F.lit(MARKS))


def marks(words: DataFrame, least: int) -> np.ndarray:
    """The bit map of frequent words: at most MARKS / 32768 rows of 4 KB come to the driver."""
    at = _mark("lang", "word")
    rows = words.where(F.col("f") >= least).groupBy(F.bitmap_bucket_number(at).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(MARKS // 8 + 4096, np.uint8)
    for r in rows:
        out[r["b"] * 4096:][:4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _hashes(lang: pa.Array, word: pa.Array) -> np.ndarray:
    """Spark's xxhash64 of (language, word)."""
    seeds = {one: xxhash.xxh64_intdigest(one.encode(), 42) for one in lang.unique().to_pylist()}
    out = np.empty(len(word), np.uint64)
    for at in range(0, len(word), 1 << 16):  # few words at a time are Python objects
        part = slice(at, at + (1 << 16))
        out[part] = [xxhash.xxh64_intdigest(w.encode(), seeds[one])
                     for one, w in zip(lang[part].to_pylist(), word[part].to_pylist())]
    return out


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether words are marked, as in bitmap_bucket_number (from 1, 0 for the value 0 alone)
    and bitmap_bit_position."""
    at = (hashes & np.uint64(MARKS - 1)).astype(np.int64)
    bucket = np.where(at > 0, 1 + (at - 1) // 32768, 0)
    place = np.where(at > 0, (at - 1) % 32768, 0)
    return bits[bucket * 4096 + place // 8] >> (place % 8).astype(np.uint8) & 1 > 0


def _zstd() -> pa.Codec:
    """How packets are compressed."""
    return pa.Codec("zstd", compression_level=3)


def _planes(x: np.ndarray) -> bytes:
    """Steps from number to number, lowest bytes first: what is sorted becomes small and alike."""
    step = np.diff(x, prepend=0)
    step = ((step << 1) ^ (step >> 63)).astype("<i8")
    return step.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: memoryview, n: int) -> np.ndarray:
    """What ``_planes`` made of n numbers."""
    step = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<i8")[:, 0]
    return np.cumsum((step >> 1) ^ -(step & 1))


def _packed(lang: np.ndarray, langs: pa.Array, code: np.ndarray, words: pa.Array,
            c: np.ndarray) -> bytes:
    """Suffixes as one value: three codes of words each (-1: none), the language's code, counts,
    and the languages and words that occur, each once."""
    told, own = np.unique(code, return_inverse=True)
    own = own.reshape(code.shape)
    if len(told) and told[0] < 0:
        told, own = told[1:], own - 1
    used, lang = np.unique(lang, return_inverse=True)
    spoken = langs.take(pa.array(used)).dictionary_encode()
    lang = spoken.indices.to_numpy()[lang] if len(lang) else lang
    lists = []
    for column in (spoken.dictionary, words.take(pa.array(told))):
        text, at = as_bytes(column)
        lists.append((len(column), len(text), _planes(np.diff(at)) + text.tobytes()))
    numbers = [_planes(x.astype(np.int64)) for x in (lang, *own, c)]
    raw = b"".join([*(x for *_, x in lists), *numbers])
    head = np.array([len(raw), len(c), *(n for one in lists for n in one[:2])], "<i8")
    return head.tobytes() + _zstd().compress(raw, asbytes=True)


def _opened(packet: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """What ``_packed`` was given, but for the numbering of languages and words."""
    size, n, *lists = np.frombuffer(packet, "<i8", 6).tolist()
    raw = memoryview(_zstd().decompress(memoryview(packet)[48:], size, asbytes=True))
    at, told = 0, []
    for count, length in zip(lists[::2], lists[1::2]):
        ends = np.cumsum(_numbers(raw[at:at + 8 * count], count))
        at += 8 * count
        told.append(pa.LargeStringArray.from_buffers(
            count, pa.py_buffer(np.append(0, ends).astype("<i8").tobytes()),
            pa.py_buffer(bytes(raw[at:at + length]))))
        at += length
    lang, *code, c = (_numbers(raw[i:i + 8 * n], n) for i in range(at, at + 40 * n, 8 * n)) if n else (
        np.zeros((5, 0), np.int64))
    return lang, told[0], np.stack(code), told[1], c


def _unified(parts: list[tuple[np.ndarray, pa.Array]]) -> tuple[np.ndarray, pa.Array]:
    """Codes of several dictionaries (-1: none), one after the other, as codes of one."""
    arrays = [pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32), mask=code < 0), told)
              for code, told in parts]
    one = pa.chunked_array(arrays).unify_dictionaries().combine_chunks()
    return one.indices.fill_null(-1).to_numpy().astype(np.int64), one.dictionary


def _unpacked(packets: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Several packets as one, in the form that ``_packed`` takes."""
    lang, langs, code, words, c = zip(*map(_opened, packets))
    at, words = _unified([(x.ravel(), w) for x, w in zip(code, words)])
    cuts = np.cumsum([0] + [x.size for x in code])
    code = np.concatenate([at[lo:hi].reshape(3, -1) for lo, hi in zip(cuts, cuts[1:])], axis=1)
    lang, langs = _unified(list(zip(lang, langs)))
    return lang, langs, code, words, np.concatenate(c)


def _dealt(lang: np.ndarray, langs: pa.Array, code: np.ndarray, words: pa.Array, c: np.ndarray,
           slot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The suffixes of each slot: slot, number, packet."""
    order = np.argsort(slot, kind="stable")
    edges = np.flatnonzero(np.diff(slot[order], prepend=-1, append=1 << 40))
    for lo, hi in zip(edges, edges[1:]):
        own = order[lo:hi]
        yield int(slot[own[0]]), hi - lo, _packed(lang[own], langs, code[:, own], words, c[own])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)],
        names=["s1", "s2", "s3", "size", "packet"])


def suffixes(slim: DataFrame, bits: np.ndarray, slots: int = SLOTS[0],
             size: int = BLOCK) -> DataFrame:
    """Packets of suffixes of two or three words (w3 null: two) of marked words, by slot s1."""
    held = slim.sparkSession.sparkContext.broadcast(bits)

    def make(batches):
        let_go()
        for block in blocks(batches, size):
            code, goes_on, lang, word = block.close()
            hashes = _hashes(lang, word)
            marked = _marked(held.value, hashes)[code]
            two = np.zeros(len(code), bool)
            two[:-1] = marked[:-1] & marked[1:] & goes_on[1:]
            at = np.flatnonzero(two)
            three = np.append(two[1:], False)[at]
            last = np.where(three, code[np.minimum(at + 2, len(code) - 1)], np.int32(-1))
            first, second = code[at], code[at + 1]
            # Codes are of (language, word); a language has as many codes as words.
            del code, goes_on, marked, two, three, at
            order = np.lexsort((last, second, first))
            first, second, last = first[order], second[order], last[order]
            del order
            new = np.ones(len(first), bool)
            new[1:] = ((first[1:] != first[:-1]) | (second[1:] != second[:-1])
                       | (last[1:] != last[:-1]))
            where = np.flatnonzero(new)
            c = np.diff(where, append=len(new))
            first, second, last = first[where], second[where], last[where]
            del new, where
            slot = ((hashes >> np.uint64(48)).astype(np.int32) % slots)[first]
            path = np.stack([first, second, last])
            del first, second, last
            rows = []
            for one, number, packet in _dealt(path[0], lang, path, word, c, slot):
                rows.append((one, None, None, number, packet))
                if len(rows) == 64:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return slim.mapInArrow(make, _PACKETS)


def _extended(packets: DataFrame, depth: int) -> DataFrame:
    """The packets split by the hash of their word number ``depth``."""
    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                suffixes_ = _unpacked([row["packet"]])
                code, words = suffixes_[2][depth - 1], suffixes_[3]
                slot_of = np.array([xxhash.xxh64_intdigest(w.encode()) % SPLIT
                                    for w in words.to_pylist()] + [0], np.int64)
                keys = (row["s1"],) if depth == 2 else (row["s1"], row["s2"])
                rows = [((*keys, one, None)[:3] + (number, packet))
                        for one, number, packet in _dealt(*suffixes_, slot_of[code])]
                yield _rows(rows)

    return packets.mapInArrow(split, _PACKETS)


def partition(packets: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The packets with their ``part``, a group of prefixes of at most ``budget`` suffixes.

    Packets of a slot over the budget are split by one more word, twice at most; those whose
    prefixes have three words have s3.  The driver packs slots: at most SLOTS[1], and SPLIT for
    each one over the budget, of which there are no more than suffixes / budget.
    """
    spark, names = packets.sparkSession, ["s1", "s2", "s3"]
    done, sizes = [], []
    for depth in (1, 2, 3):
        keys = names[:depth]
        told = [tuple(r) for r in packets.groupBy(keys).agg(F.sum("size")).collect()]
        big = [r[:-1] for r in told if r[-1] > budget and depth < 3]
        sizes += [r for r in told if r[-1] <= budget or depth == 3]
        if not big:
            done.append(packets)
            break
        over = F.broadcast(spark.createDataFrame(big, ", ".join(f"{k} int" for k in keys)))
        done.append(packets.join(over, keys, "left_anti"))
        packets = cut(_extended(packets.join(over, keys, "left_semi").select(
            *names, "size", "packet").repartition(max(1, len(big))), depth + 1))
    # Next fit over falling sizes: each group but the last is more than half full.
    part, used, packed = 0, 0, []
    for row in sorted(sizes, key=lambda r: (-r[-1], r[:-1])):
        if used and used + row[-1] > budget:
            part, used = part + 1, 0
        used += row[-1]
        packed.append((*row[:-1], *[-1] * (4 - len(row)), part))
    given = F.broadcast(spark.createDataFrame(packed, "k1 int, k2 int, k3 int, part int"))
    both = done[0].select(*names, "size", "packet")
    for more in done[1:]:
        both = both.unionByName(more.select(*names, "size", "packet"))
    meet = [F.coalesce(n, F.lit(-1)) == F.col(f"k{i}") for i, n in enumerate(names, 1)]
    return both.join(given, meet).select(*names, "size", "packet", "part")


def nodes(packets: DataFrame, least: int, budget: int = BUDGET) -> DataFrame:
    """lang, w1, w2, w3 (null: a node of two words) and f of the trees' nodes with f >= least."""
    def tree(table: pa.Table) -> pa.Table:
        deep = table.column("s3").null_count == 0
        lang, langs, code, words, c = _unpacked(table.column("packet").to_pylist())
        code = np.concatenate([lang[None], code])
        order = np.lexsort(code[::-1])
        code, c = code[:, order], c[order]
        new = np.zeros(len(c), bool)
        new[:1] = True
        out = []
        for level in range(4):
            # A node begins where its word, or one above it, is another one.
            new[1:] |= code[level, 1:] != code[level, :-1]
            if level < 2:
                continue
            at = np.flatnonzero(new)
            f = np.add.reduceat(c, at)
            whole = level == 3 or not deep
            keep = (f >= least) | (not whole)
            if level == 3:
                keep &= code[3, at] >= 0
            at, f = at[keep], f[keep]
            columns = {"f": pa.array(f), "whole": pa.array(np.full(len(f), whole))}
            for i, name in enumerate(("lang", "w1", "w2", "w3")):
                own = code[i, at] if i <= level else np.full(len(at), -1)
                told = words if i else langs
                columns[name] = told.take(pa.array(own, mask=own < 0)).cast(pa.string())
            out.append(pa.RecordBatch.from_pydict(
                {name: columns[name] for name in ("lang", "w1", "w2", "w3", "f", "whole")}))
        return pa.Table.from_batches(out)

    # A group's packets have prefixes of one length: deep ones are never packed with others.
    parted = partition(packets, budget)
    made = cut(parted.groupBy("part", F.col("s3").isNotNull()).applyInArrow(tree, _NODES))
    added = made.where(~F.col("whole")).groupBy("lang", "w1", "w2").agg(F.sum("f").alias("f"))
    return made.where("whole").drop("whole").unionByName(
        added.where(F.col("f") >= least), allowMissingColumns=True)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: 38 digits hold a up to 10^16."""
    a, left, right = (f"cast({x} as decimal(16,0))" for x in (a, left, right))
    return F.expr(f"cast((1000000BD * {a} * {a}) div (cast({left} * {right} as decimal(38,0))) as bigint)")


def mine(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50,
         budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (lang, text).

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those at
    blanks into words.  A phrase of two or three words that occurs ``least`` times or more within
    pieces is a candidate; it goes if a longer candidate holds it and occurs in ``share`` percent
    of its places or more.  Its score is that of its weakest cut, a * a / (l * r) in millionths
    for a occurrences of the phrase, l and r of the parts (ties: the first cut).

    Returns lang, rank, phrase, a, l, r, n (words of the language) and score, ranked by score and
    a falling, then by phrase in byte order, so that no two rows tie.  A null text is empty, a
    null language is ``und``; repeated rows count each time, no other column is read, and a table
    without words gives no row.
    """
    slim = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"),
                       F.coalesce("text", F.lit("")).alias("text"))
    words = cut(count_words(slim, block))
    often = words.where(F.col("f") >= least)
    n_words = often.agg(F.coalesce(F.sum("f"), F.lit(0))).head()[0]
    slots = min(SLOTS[1], max(SLOTS[0], 1 << (4 * n_words // budget).bit_length()))
    found = nodes(cut(suffixes(slim, marks(words, least), slots, block)), least, budget)
    two = found.where(F.col("w3").isNull()).select("lang", "w1", "w2", F.col("f").alias("a"))
    three = found.where(F.col("w3").isNotNull()).withColumnRenamed("f", "a")

    def with_word(df: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(often.select("lang", F.col("word").alias(word), F.col("f").alias(name)),
                       ["lang", word])

    def with_pair(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
        return df.join(two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second),
                                  F.col("a").alias(name)), ["lang", first, second])

    # The most frequent candidate of three words that holds a pair.
    holds = three.select("lang", "w1", "w2", "a").unionByName(
        three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")
    ).groupBy("lang", "w1", "w2").agg(F.max("a").alias("held"))
    pairs = two.join(holds, ["lang", "w1", "w2"], "left").where(
        F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    pairs = with_word(with_word(pairs, "w1", "l"), "w2", "r").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r",
        _score("a", "l", "r").alias("score"))

    both = with_word(with_pair(with_word(with_pair(three, "w2", "w3", "r1"), "w1", "l1"),
                               "w1", "w2", "l2"), "w3", "r2")
    both = both.withColumn("x1", _score("a", "l1", "r1")).withColumn("x2", _score("a", "l2", "r2"))
    one = F.col("x1") <= F.col("x2")
    triples = both.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(one, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(one, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.when(one, F.col("x1")).otherwise(F.col("x2")).alias("score"))

    ranked = _first(pairs.unionByName(triples), top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """Ranks up to ``top`` per language; a language's rows meet in ever fewer, smaller groups."""
    for salts in (4096, 64, 1):
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        order = Window.partitionBy("lang", salt).orderBy(
            F.desc("score"), F.desc("a"), F.asc("phrase"))
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows
