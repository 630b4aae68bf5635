"""Line quality, whitening and collocations against plain recounts."""

import collections
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("chronoloom.llm")

from chronoloom.llm import linequality, phrases, whitening  # noqa: E402
from chronoloom.llm.common import as_bytes  # noqa: E402

SF = Path("/root/testdata/sf0.1")


# --- Collocations ---------------------------------------------------------------------------

def mined(rows, least, top, share=50):
    count = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        kept = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        ranked = []
        for p, a in kept.items():
            if any(p in (q[:2], q[1:]) and 100 * c >= share * a
                   for q, c in kept.items() if len(p) == 2 and len(q) == 3):
                continue
            score, k = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n, -s))
    return sorted(out)


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_rows(df):
    return sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in df.collect())


@pytest.mark.parametrize("budget,block", [(1 << 19, 1 << 22), (40, 500), (3, 60)])
def test_collocations_are_the_brute_force_s(spark, budget, block):
    rng = random.Random(3)
    vocabulary = ["The", "the", "of", "é", "naïve", "a\x0bb", "日本", "x" * 70, "to", "In", "rare1"]
    weights = [30, 20, 20, 5, 5, 3, 5, 2, 9, 9, 1]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 40))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "? "]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    rows += [("en", None), ("en", ""), ("en", " \t.,"), ("en", "of the " * 400)]
    rows += [rows[0]] * 30
    df = spark.createDataFrame([(t, lang, "w", 1, "p", i) for i, (lang, t) in enumerate(rows)],
                               "text string, lang string, word string, f int, phrase string, n int")
    want = mined(rows, 4, 12)
    assert len(want) > 20
    assert phrase_rows(phrases.mine(df.repartition(3), 4, 12, budget=budget, block=block)) == want
    if budget == 3:
        assert phrases.mine(df.limit(0)).count() == 0
        assert phrases.mine(df.where("text = ''")).count() == 0


def test_collocations_split_a_prefix_that_all_suffixes_share(spark):
    """One word, or one pair of words, opens most suffixes: no group passes the budget."""
    rows = [("en", f"hot pair w{i % 50} . hot w{i % 40} z .") for i in range(2000)]
    slim = spark.createDataFrame(rows, "lang string, text string")
    words = phrases.count_words(slim)
    leaves = phrases.suffixes(slim.repartition(8), phrases.marks(words, 10))
    parted = phrases.partition(leaves, 60).groupBy("part").agg({"size": "sum"}).collect()
    assert max(r[1] for r in parted) <= 60 and len(parted) > 5
    got = phrases.nodes(leaves, 10, 60).where("w1 = 'hot' and w2 = 'pair' and w3 is null").collect()
    assert [r["f"] for r in got] == [2000]


def test_frequent_words_are_marked(spark):
    words = [f"w{i}é" for i in range(3000)]
    df = spark.createDataFrame([("en", w, 10 + i % 2) for i, w in enumerate(words)],
                               "lang string, word string, f long")
    bits = phrases.marks(df, 11)
    told = phrases._marked(bits, phrases._hashes(pa.array(["en"] * 3000), pa.array(words)))
    assert told[1::2].all() and told[::2].mean() < 0.01


# --- Whitening ------------------------------------------------------------------------------

def whitened(rows, k):
    d = collections.Counter(len(v) for _, v in rows).most_common(1)[0][0]
    rows = [(i, [math.floor(64 * c) + 10 ** 6 for c in v]) for i, v in rows if len(v) == d]
    listed = np.array(sorted({tuple(v) for _, v in rows}), object)
    n, s = len(listed), listed.sum(0)
    x = ((listed * n - s) / n).astype(float)
    values, q = np.linalg.eigh(x.T @ x / n)
    order = values.argsort()[::-1][:k]
    values, q = values[order], q[:, order]
    out = {}
    for i, v in rows:
        spread = np.array(v, object) * n - s
        out[i] = (n, int((spread ** 2).sum()), (spread / n).astype(float) @ q / np.sqrt(values))
    return out, values / np.trace(x.T @ x / n)


def test_whitening_is_the_brute_force_s(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 40)) * np.linspace(2, 0.2, 40)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(50)]
    bad = [(2000, None), (2001, [None] * 40), (2002, [float("nan")] * 40), (2003, []),
           (2004, [float("inf")] + [0.0] * 39), (2005, [1.0, 2.0]), (2006, [1e30] + [0.0] * 39)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + bad],
                               "vec_id long, embedding array<float>, label int, x int, v string")
    want, share = whitened(rows, 16)
    got = whitening.whiten(df.repartition(4)).collect()
    assert len(got) == 16 * len(rows)
    by = collections.defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        assert r["identity_error"] < 1e-10
    sign = np.sign([by[0][c + 1]["whitened"] * want[0][2][c] for c in range(16)])
    for i, (n, deviation, z) in want.items():
        assert {(r["n"], r["deviation"]) for r in by[i].values()} == {(n, deviation)}
        mine = np.array([by[i][c + 1]["whitened"] for c in range(16)])
        assert np.abs(mine * sign - z).max() < 1e-8


def test_whitening_of_odd_tables(spark):
    schema = "vec_id string, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    assert whitening.whiten(empty).count() == 0
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)
    assert whitening.whiten(one).count() == 0
    # Two vectors span one direction; ids may be null and repeat.
    two = spark.createDataFrame([(None, [0.0, 0.0]), ("a", [1.0, 1.0]), ("a", [1.0, 1.0])], schema)
    got = sorted((str(r["vec_id"]), r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9),
                  round(r["explained"], 9)) for r in whitening.whiten(two).collect())
    assert got == [("None", 1, 2, 8192, 1.0, 1.0), *[("a", 1, 2, 8192, 1.0, 1.0)] * 2]
    # Entries whose squares pass 64 bits: no number of theirs is wrong.
    wide = spark.createDataFrame([("a", [2.0 ** 50, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 0.0])], schema)
    assert {r["deviation"] for r in whitening.whiten(wide).collect()} == {None}


def test_filtered_iteration_finds_clustered_eigenvalues():
    rng = np.random.default_rng(0)
    for values in (np.linspace(1, 1.2, 120), np.r_[np.zeros(100), 1, 1, 1, 2, 5],
                   np.logspace(-6, 3, 90)):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        v = (q * values) @ q.T
        got, u = whitening.leading(lambda b: v @ b, len(values), 16)
        assert np.allclose(got, np.sort(values)[::-1][:16], atol=1e-10 * values.max())
        assert np.linalg.norm(v @ u - u * got) < 1e-9 * values.max()


# --- Quality of lines -----------------------------------------------------------------------

def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(4)
    text = np.repeat([0, 1, 2, 5], [1, 4, 7, 3])
    unary, moves = rng.normal(size=len(text)) * 3, rng.normal(size=(2, 2)) * 2
    good, pair = linequality.marginals(unary, text, moves)
    want, pairs = [], []
    for t in np.unique(text):
        u = unary[text == t]
        paths = list(itertools.product((0, 1), repeat=len(u)))
        weight = np.array([math.exp(sum(u[i] * s for i, s in enumerate(p))
                                    + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        want += [sum(w for w, p in zip(weight, paths) if p[i]) for i in range(len(u))]
        pairs += [[[sum(w for w, p in zip(weight, paths) if p[i - 1:i + 1] == (a, b))
                    for b in (0, 1)] for a in (0, 1)] for i in range(1, len(u))]
    assert np.allclose(good, want) and np.allclose(pair, pairs)


def test_marginals_of_long_chains_stay_finite():
    n = 50_000
    good, pair = linequality.marginals(np.full(n, 30.0), np.zeros(n, int), np.eye(2) * 20)
    assert np.allclose(good, 1) and np.allclose(pair[:, 1, 1], 1)
    good, _ = linequality.marginals(np.resize([900.0, -900.0], n), np.zeros(n, int), np.eye(2))
    assert np.array_equal(good.round(), np.resize([1, 0], n))


def test_measures_are_the_plain_ones():
    sample = ["", "one two two.\nÉA été &&& 12\n\none two two.\n", " ", "\n\n", "x" * 10, "a\na\nb"]
    data, at = as_bytes(pa.array(sample))
    told, text, length = linequality.measures(data, at)
    for t, s in enumerate(sample):
        lines = re.findall("[^\n]*\n|[^\n]+", s) or [""]
        own = np.flatnonzero(text == t)
        assert length[own].tolist() == [len(x.encode()) for x in lines]
        seen = set()
        for i, line in zip(own, lines):
            words = line.split()
            assert told["words"][i] == len(words)
            assert told["repeats"][i] == sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
            assert told["distinct"][i] == len(set(words)) / max(1, len(words))
            assert told["again"][i] == (bool(words) and tuple(words) in seen)
            seen.add(tuple(words))
            letters = [c for c in line if c.isalpha()]
            assert told["upper"][i] == sum(c.isupper() for c in letters) / max(1, len(letters))
        words = s.split()
        assert set(told["text_words"][own]) == {len(words)}
        assert set(told["text_distinct"][own]) == {len(set(words)) / max(1, len(words))}


def test_measures_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(9)
    sample = ["".join(rng.choice("ab \n,É&") for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    data, at = as_bytes(pa.array(sample))
    whole = linequality.measures(data, at)
    monkeypatch.setattr(linequality, "SLICE", 64)
    parts = linequality.measures(data, at)
    for name in whole[0]:
        assert np.array_equal(whole[0][name], parts[0][name]), name
    assert np.array_equal(whole[1], parts[1]) and np.array_equal(whole[2], parts[2])


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    made = linequality.classify(docs, labels, n_docs=1200)
    assert made.count() == docs.count()
    rows = made.where("held_out").join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, score string, label int, places int, predicted int"
    docs = spark.createDataFrame(
        [(1, "a fine line of words\nand one more", "x", 1, 1, 1), (2, None, "x", 1, 1, 1),
         (3, "", "x", 1, 1, 1), (4, "&&& ### $$$", "x", 1, 1, 1), (4, "&&& ### $$$", "x", 1, 1, 1),
         (None, "x", "x", 1, 1, 1), (6, "y\n" * 70_000, "x", 1, 1, 1), (7, "z" * 200_000, "x", 1, 1, 1)],
        schema)
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (4, 0), (7, 0), (7, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = linequality.classify(docs, labels).collect()
    assert len(rows) == 8
    told = {r["doc_id"]: r for r in rows}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert told[1]["score"] > told[4]["score"] and told[2]["score"] == told[3]["score"]
    assert linequality.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in linequality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_a_block_of_words_closes_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 1 << 18
    text = " ".join(f"w{i}" for i in rng.integers(0, 20000, n))
    block = phrases.Block()
    block.add(pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]}))
    tracemalloc.start()
    code, goes_on, lang, word = block.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n
    assert len(code) == n and goes_on.sum() == n - 1 and set(lang.to_pylist()) == {"en"}
    assert " ".join(word.take(pa.array(code)).to_pylist()) == text


def test_packets_of_suffixes_hold_each_word_once():
    """What is packed comes back, and many small packets are not much larger than one large one."""
    rng = np.random.default_rng(3)
    words = pa.array([f"wort{i}\u00e9" for i in range(3000)], pa.large_string())
    langs = pa.array(["de\nx" if i % 2 else "" for i in range(3000)], pa.large_string())
    code = np.stack([rng.integers(0, 3000, 40_000) for _ in range(3)])
    code[2, rng.random(40_000) < 0.2] = -1
    code = code[:, np.lexsort(code[::-1])].astype(np.int32)
    c, slot = rng.integers(1, 1 << 40, 40_000), code[0] % 1000
    def rows(lang, langs, code, words, c):
        spoken, told = langs.to_pylist(), [*words.to_pylist(), None]
        return sorted(zip((spoken[i] for i in lang), *([told[i] for i in x] for x in code), c.tolist()), key=repr)

    want = rows(code[0], langs, code, words, c)
    dealt = list(phrases._dealt(code[0], langs, code, words, c, slot))
    assert sum(n for _, n, _ in dealt) == 40_000
    assert rows(*phrases._unpacked([p for *_, p in dealt])) == want
    one = phrases._packed(code[0], langs, code, words, c)
    assert rows(*phrases._unpacked([one])) == want
    empty = phrases._packed(code[0][:0], langs, code[:, :0], words, c[:0])
    assert rows(*phrases._unpacked([empty, one])) == want
    ones = np.ones(40_000, np.int64)
    many = sum(len(p) for *_, p in phrases._dealt(code[0], langs, code, words, ones, slot))
    assert many < 3.5 * len(phrases._packed(code[0], langs, code, words, ones))
