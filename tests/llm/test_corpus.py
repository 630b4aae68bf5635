"""Operators on whole corpora: near-duplicates, search, mixing, chats, and the pipeline."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("chronoloom.llm")

from chronoloom.llm import chat, components, mixing, neardup, search  # noqa: E402
from chronoloom.llm.common import cut  # noqa: E402

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]


def text(n, rng):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def union(pairs):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(label)}


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)]
    links += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    links = [(a, b) for a, b in links if a != b]
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(df).collect()}
    assert got == union(links)
    assert components.components(df.limit(0)).count() == 0


def test_samples_estimate_the_weighted_similarity():
    rng, sampler = np.random.default_rng(0), neardup.Sampler()
    for share in (0.5, 0.8, 0.95):
        seen, exact = [], []
        for _ in range(60):
            h = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
            k = int(300 * (1 - share) / (1 + share))
            other = np.unique(np.r_[h[k:], rng.integers(0, 2**63, k).astype(np.uint64)])
            u = rng.uniform(1, 1.5, len(h)).astype(np.float32)
            v = rng.uniform(1, 1.5, len(other)).astype(np.float32)
            seen.append((sampler.draw(h, u) == sampler.draw(other, v)).mean())
            exact.append(neardup.similarity((h, u), (other, v)))
        assert abs(np.mean(seen) - np.mean(exact)) < 0.04


def near_corpus():
    rng = random.Random(12)
    docs = [" ".join(text(rng.randint(30, 200), rng)) for _ in range(120)]
    for i in range(30):
        w = docs[i].split()
        for _ in range(1 + i % 3):
            copy = list(w)
            copy[rng.randrange(len(w))] = "changed"
            docs.append(" ".join(copy))
    docs += [docs[40].upper(), "  " + docs[41] + "\n", docs[42], docs[42]]
    # A chain: each shares most with the one before, the ends share little.
    chain = text(200, rng)
    for step in range(8):
        docs.append(" ".join(chain))
        chain = chain[:step * 20] + text(6, rng) + chain[step * 20 + 6:]
    return docs + ["", None, "one two", "one two", "a b c d", " \n"]


def test_near_duplicates_against_all_pairs(spark):
    docs = near_corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(docs)],
                               "doc_id long, text string, label int, key string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    sets = [shingles(t) for t in docs]
    sure, maybe = [], []
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            (sure if j >= 0.83 else maybe if j >= 0.75 else []).append((a, b))
    for a, b in sure:
        assert got[a] == got[b], (a, b)
    wide = union(sure + maybe)
    for i, c in got.items():
        assert c == i or wide.get(i) == wide.get(c)
    assert got[len(docs) - 6] != got[len(docs) - 1]
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def families(seed, count, members, words=160):
    """Edited copies of templates, about as alike as the threshold asks: many components meet in
    one bucket."""
    rng = random.Random(seed)
    docs = []
    for _ in range(count):
        base = text(words, rng)
        for _ in range(members):
            w = list(base)
            for at in rng.sample(range(0, words, 6), rng.randint(1, 4)):
                w[at] = rng.choice(VOCABULARY)
            docs.append(" ".join(w))
    return docs


def exact_classes(spark, docs, threshold=0.8):
    """Components of all pairs whose exact weighted similarity reaches the threshold."""
    import pyarrow as pa

    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    w = neardup.Weights(*neardup.frequencies(df))
    sets = [(h, w.of(h, c)) for h, c in neardup.Shingled(pa.array(docs)).sets()]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2)
             if neardup.similarity(sets[a], sets[b]) >= threshold]
    label = union(pairs)
    return df, [label.get(i, i) for i in range(len(docs))]


def test_near_duplicates_of_many_components_in_a_bucket(spark):
    df, want = exact_classes(spark, families(8, 4, 60))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert 4 < len(set(want)) < len(want)
    assert [got[i] for i in range(len(want))] == want


def test_one_repair_pass_leaves_no_bucket_open(spark):
    docs = families(7, 3, 90)
    df, want = exact_classes(spark, docs)
    assert {r["doc_id"] for r in neardup.one_of_each(df).collect()} == set(want)


def test_near_duplicates_of_a_large_group_and_of_odd_rows(spark):
    rng = random.Random(2)
    base = text(150, rng)
    docs = [(0, " ".join(base))]
    for i in range(1, 900):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(150)] = rng.choice(VOCABULARY)
        docs.append((i, " ".join(w)))
    docs += [(5000, docs[0][1])] * 3 + [(None, docs[1][1]), (None, "alone here"), (7000, " ".join(
        text(80000, rng)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = neardup.classes(df).collect()
    assert len(rows) == len(docs)
    group = [r["class_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] <= 5000]
    assert collections.Counter(group)[0] >= 0.99 * len(group)
    assert {r["class_id"] for r in rows if r["doc_id"] == 7000} == {7000}
    assert neardup.classes(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "p q r s t u")] * 3 + [(2, "p q r s t u")],
                                  "doc_id long, text string")
    assert [r["doc_id"] for r in neardup.one_of_each(again).collect()] == [1]


def test_no_text_is_lost_and_no_copy_kept_where_ids_repeat(spark):
    rng = random.Random(11)
    a, b = (" ".join(text(60, rng)) for _ in range(2))
    schema = "doc_id long, text string"
    rows = neardup.one_of_each(spark.createDataFrame([(1, a), (1, b), (2, a)], schema)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted([(1, a), (1, b)])
    rows = neardup.one_of_each(spark.createDataFrame(
        [(0, b), (1, a), (1, b), (2, a), (1, a), (1, a)], schema)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted([(0, b), (1, a)])
    # Families of edited copies under ids that several of them share.
    docs = families(5, 3, 40)
    df, want = exact_classes(spark, docs)
    shared = df.withColumn("doc_id", (df["doc_id"] / 3).cast("long"))
    texts_of = [r["text"] for r in df.orderBy("doc_id").collect()]
    got = [r["text"] for r in neardup.one_of_each(shared).collect()]
    classes_got = [want[texts_of.index(t)] for t in got]
    assert sorted(classes_got) == sorted(set(want))


def test_search_against_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT_WORDS", 3000)
    monkeypatch.setattr(search, "BLOCK_TERMS", 500)
    rng = random.Random(6)
    common = VOCABULARY[:40]
    docs = [" ".join(rng.choice(common if rng.random() < 0.5 else VOCABULARY[:400])
                     for _ in range(rng.randint(0, 120))) for _ in range(400)]
    docs += [docs[3], docs[3], None, "", "É É!é, x-y", "rare " * 70000, docs[100]]
    rows = [(i, t, "z") for i, t in enumerate(docs)]
    df = spark.createDataFrame([*rows, rows[7], (None, docs[9], "z")],
                               "doc_id long, text string, rank string").repartition(4)
    queries = df.where("doc_id % 20 = 0 or doc_id > 400")
    got = collections.defaultdict(list)
    for r in search.search(df, queries, 7).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    every = [*enumerate(docs), (7, docs[7]), (None, docs[9])]
    bags = [(i, collections.Counter(re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())))
            for i, t in every]
    n, mean = len(bags), sum(sum(c.values()) for _, c in bags) / len(bags)
    df_ = collections.Counter(w for _, c in bags for w in c)
    asked = {i: c for i, c in bags if i is not None and (i % 20 == 0 or i > 400)}
    for q, own in asked.items():
        scores = []
        for i, c in bags:
            size = sum(c.values())
            s = sum(math.log(1 + (n - df_[w] + .5) / (df_[w] + .5)) * c[w] * 2.2
                    / (c[w] + 1.2 * (.25 + .75 * size / mean)) for w in own if w in c)
            if s > 0:
                scores.append((-round(s, 5), i is not None, i if i is not None else 0, i))
        want = [(k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:7])]
        assert [(k, i, round(s, 5)) for k, i, s in sorted(got[q])] == want
    assert search.search(df.limit(0), df.limit(0)).count() == 0
    assert search.search(df, df.limit(0)).count() == 0


def test_raking_meets_all_margins(spark):
    rng = random.Random(1)
    cells = [(f"s{a}", f"l{b}", f"t{c}", 5, rng.randint(1, 5000) * (50 if a == 0 else 1))
             for a in range(4) for b in range(3) for c in range(3)]
    df = spark.createDataFrame(cells, "source string, language string, topic string, n long, "
                               "tokens long")
    wanted = {"source": {"s0": .1, "s1": .2, "s2": .3, "s3": .4}, "language": {
        "l0": .5, "l1": .3, "l2": .2}}
    rows = mixing.rake(df, wanted, rounds=60).collect()
    w = np.array([float(c[4]) for c in cells])
    tokens_of = collections.Counter()
    for c in cells:
        tokens_of[c[2]] += c[4]
    flat = {t: v ** 0.7 for t, v in tokens_of.items()}
    goals = [wanted["source"], wanted["language"], {t: v / sum(flat.values())
                                                    for t, v in flat.items()}]
    w /= w.sum()
    for _ in range(200):
        for d, goal in enumerate(goals):
            now = collections.Counter()
            for c, x in zip(cells, w):
                now[c[d]] += x
            w = np.array([x * goal[c[d]] / now[c[d]] for c, x in zip(cells, w)])
    want = {c[:3]: x for c, x in zip(cells, w)}
    for r in rows:
        assert r["raked"] == pytest.approx(want[r["source"], r["language"], r["topic"]], rel=1e-3)


def test_mixture(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(text(rng.randint(5, 300), rng)) + rng.choice(["", "\n| a | b |\n" * 9]),
             "big" if i % 3 else f"s{i % 7}", rng.choice(["en", "de", None])) for i in range(900)]
    docs += [(None, None, None, None), (901, "", "big", "en"), (902, "x " * 60000, "huge", "en"),
             (3, docs[3][1], docs[3][2], docs[3][3])]
    df = spark.createDataFrame([(*d, "q") for d in docs],
                               "doc_id long, text string, source string, lang string, p string")
    rows = mixing.plan(df, 0.5).collect()
    assert len(rows) == len(docs)
    every = sum(r["tokens"] for r in rows)
    assert sum(r["tokens"] * r["p"] for r in rows) == pytest.approx(0.5 * every, rel=0.01)
    taken = sum(r["sampled"] for r in rows)
    assert 0.3 * len(docs) < taken < 0.9 * len(docs)
    by_id = collections.defaultdict(set)
    for r in rows:
        assert 0 <= r["p"] <= 1 and r["sampled"] == (r["draw"] < r["p"])
        by_id[r["doc_id"]].add(r["sampled"])
    assert len(by_id[3]) == 1
    kept = mixing.sample(df, 0.5)
    assert kept.columns == df.columns and kept.count() == taken
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(r["doc_id"]) for r in rows if r["sampled"])
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.sample(df.limit(0)).count() == 0


def least_cost(roles):
    """All ways to treat every turn, tried one by one."""
    best = math.inf

    def go(i, state, cost):
        nonlocal best
        if cost >= best:
            return
        if i == len(roles):
            best = cost
            return
        role = roles[i]
        for new in chat.LEGAL[state]:
            go(i + 1, new, cost + (0 if role in (0, new) else chat.RELABEL))
        if state:
            go(i + 1, state, cost + chat.MERGE + (0 if role in (0, state) else chat.RELABEL))
        for between in chat.LEGAL[state]:
            if between != chat.SYSTEM:
                for new in chat.LEGAL[between]:
                    go(i + 1, new, cost + chat.INSERT + (0 if role in (0, new) else chat.RELABEL))

    go(0, chat.START, 0)
    return best


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def test_repair_is_least_cost():
    rng = random.Random(5)
    for _ in range(150):
        roles = [rng.randrange(4) for _ in range(rng.randint(1, 6))]
        cost, ways = chat.repair(roles)
        assert cost == least_cost(roles)
        # Chunks composed by their matrices cost the same.
        k = rng.randint(0, len(roles))
        whole = chat.compose(chat.matrix(roles[:k]), chat.matrix(roles[k:]))
        assert whole[chat.START].min() == cost and len(ways) == len(roles)


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 8)
    rng = random.Random(4)
    names = ["user", "assistant", "system", "Human", "AI", None, "narrator", "user", "assistant"]
    rows = [(c, t, rng.choice(names), f"t{c}-{t}") for c in range(60)
            for t in range(rng.randint(1, 7))]
    rows += [(777, t, rng.choice(names[:5]), "x") for t in range(300)]
    rows += [(None, 1, "user", None), (None, None, "assistant", ""), (5, 1, "user", "again"),
             (5, 1, "user", "again"), (800, 0, "user", "long " * 50000)]
    df = spark.createDataFrame([(*r, 1) for r in rows],
                               "conv_id long, turn long, role string, text string, chunk int")
    out = chat.format_chats(df).collect()
    assert len(out) == len(rows)
    talks = collections.defaultdict(list)
    for r in out:
        talks[r["conv_id"]].append(r)
    code = {None: 0, **chat.NAMES}
    for key, turns in talks.items():
        turns.sort(key=lambda r: r["place"])
        assert [r["place"] for r in turns] == list(range(len(turns)))
        given = sorted((r for r in rows if r[0] == key), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        assert [(r["turn"], r["role"]) for r in turns] == [(g[1], g[2]) for g in given]
        roles = [code.get((g[2] or "").lower(), 0) for g in given]
        assert sum(r["cost"] for r in turns) == chat.repair(roles)[0]
        whole = "".join(r["rendered"] for r in turns)
        shown = re.findall(r"<\|(user|assistant|system)\|>\n", whole)
        assert legal(shown) and whole.count(chat.CLOSE) == len(shown) and whole.endswith(chat.CLOSE)
        at = 0
        for g in given:
            at = whole.index(g[3] or "", at) + len(g[3] or "")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from chronoloom.llm.queries import tokenizer_path

    rng = random.Random(10)
    words = {"xx": VOCABULARY[:300], "yy": [w[::-1] + "z" for w in VOCABULARY[:300]]}
    rows = []
    for i in range(150):
        lang = "xx" if i % 3 else "yy"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, f"s{i % 4}"))
    rows[20] = (20, rows[20][1] + " mail me.now@host7.example.com here", *rows[20][2:])
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(0, 30, 3)]
    rows += [(300, "123 456 !!", "xx", "s1"), (301, None, "xx", "s1"), (302, "", "yy", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "personal_data", "mixture", "sequences"]
    now = cut(stages["language"](spark, docs, ""))
    assert now.columns == docs.columns and now.count() == len(rows) - 3
    now = cut(stages["near_duplicates"](spark, now, ""))
    assert sorted(r["doc_id"] for r in now.collect()) == list(range(150))
    now = cut(stages["personal_data"](spark, now, ""))
    assert now.columns == docs.columns
    told = {r["doc_id"]: r for r in now.collect()}
    assert "[EMAIL]" in told[20]["text"] and "@" not in told[20]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in told.values())
    sampled = cut(stages["mixture"](spark, now, ""))
    assert sampled.columns == docs.columns and 0 < sampled.count() < 150
    assert {r["text"] for r in sampled.collect()} <= {r["text"] for r in told.values()}
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    packed = stages["sequences"](spark, sampled, "").collect()
    ids = collections.defaultdict(dict)
    for r in packed:
        ids[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for r in sampled.collect():
        want = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(v for _, v in sorted(ids[r["doc_id"]].items())) == want.tobytes()
    folder = str(tmp_path / "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in whole} == set(ids)
