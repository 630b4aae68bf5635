"""Steps that follow an order inside a group, against plain statements of their rule."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.similarity import reaches
from chronoloom.operators import duplicates, near_duplicates, rejoin, scoring, units

PRINT = ("case_id string, bundle_id string, unit_id string, doc_class string, row_date date, author string,"
         " form_serial string, content string, annotations array<string>, transmission array<string>")


def _near_copies(seed):
    import datetime as dt

    rng = random.Random(seed)
    day = dt.date(2020, 1, 1)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 400))) for _ in range(4)]
    rows = []
    for i in range(60):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 15])):
            at = rng.randrange(len(text))
            action = rng.random()
            if action < 0.4:
                text[at] = rng.choice("xyz")
            elif action < 0.7:
                del text[at]
            else:
                text.insert(at, rng.choice("xyz"))
        rows.append(("c", "b", f"u{i:03d}", rng.choice("AB"), day if i % 9 else None, rng.choice([None, "w"]),
                     None, "".join(text).strip(), [], []))
    return rows


def _greedy(rows):
    out = {}
    for j, b in enumerate(rows):
        for a in rows[:j]:
            same = a[3:7] == b[3:7] and a[4] is not None and a[8:] == b[8:]
            if same and a[2] not in out and (
                    a[7] == b[7] or SequenceMatcher(None, a[7], b[7]).ratio() >= 0.97):
                out[b[2]] = a[2]
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_follow_the_greedy_rule(spark, seed):
    rows = _near_copies(seed)
    df = spark.createDataFrame(rows, PRINT).repartition(4)
    got = {r.unit_id: r.duplicate_of for r in near_duplicates.removable(df).collect()}
    assert got == _greedy(rows)
    assert got


@pytest.mark.parametrize("block, close", [(3, 16), (512, 0)])
def test_near_duplicates_in_crowds_follow_the_greedy_rule(spark, monkeypatch, block, close):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "CLOSE", close)
    rows = _near_copies(5)
    df = spark.createDataFrame(rows, PRINT).repartition(4)
    got = {r.unit_id: r.duplicate_of for r in near_duplicates.removable(df).collect()}
    assert got == _greedy(rows) and got


def test_unlike_texts_with_a_common_part_do_not_meet(spark):
    """A letter sent many times over is no reason to compare what else was written."""
    rng = random.Random(11)
    rows = [("g", f"c{i}", (f"b{i}", f"u{i}"), "the same words at the end " * 12 + "".join(
        rng.choice("abcdefghijklm nopqrstuvwxyz") for _ in range(400))) for i in range(12)]
    df = spark.createDataFrame(
        rows, "grp string, cid string, first struct<bundle_id: string, unit_id: string>, text string")
    assert near_duplicates._listed(df, 0.97).isEmpty()
    twin = spark.createDataFrame([("g", "d", ("c", "u"), rows[0][3] + "x")], df.schema)
    assert {r.cid for r in near_duplicates._listed(df.unionByName(twin), 0.97).collect()} == {"c0", "d"}


def test_similarity_bound_is_exact(spark):
    rows = _near_copies(4)
    pairs = [(a[7], b[7]) for a in rows[:25] for b in rows[25:50]]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.v for r in df.select("i", reaches(F.col("a"), F.col("b"), 0.97).alias("v")).collect()}
    assert [got[i] for i in range(len(pairs))] == [
        SequenceMatcher(None, a, b).ratio() >= 0.97 for a, b in pairs]


def test_verdict_counts_equal_all_pairs(spark):
    import datetime as dt

    rng = random.Random(9)
    rows = [
        ("c", "b", f"u{i:03d}", rng.choice("AB"), rng.choice([None, dt.date(2020, 1, 1), dt.date(2020, 1, 2)]),
         rng.choice([None, "w"]), rng.choice([None, "9"]), rng.choice(["one", "two"]), rng.choice([[], ["n"]]), [])
        for i in range(80)]
    df = spark.createDataFrame(rows, PRINT)
    pairs = spark.createDataFrame(
        [(a[2], b[2]) for i, a in enumerate(rows) for b in rows[i + 1:]], "a string, b string")
    each = duplicates.compare(pairs, df).groupBy("verdict").count().collect()
    want = {r.verdict: r["count"] for r in each if r.verdict != "different"}
    assert {r.verdict: r.pairs for r in duplicates.report(duplicates.keyed(df)).collect()} == want


def _rejoin(groups):
    """Groups: list of (pages, first label, last label, author)."""
    live = [dict(p=list(p), first=f, last=z, opened_by=w, closed_by=w) for p, f, z, w in groups]
    for i in range(len(live) - 1, -1, -1):
        part = live[i]
        if part["first"] is None or part["first"][0] == 1:
            continue
        for j in range(i - 1, -1, -1):
            host = live[j]
            chain = host["last"] is not None and host["last"][1] == part["first"][1] and (
                host["last"][0] + 1 == part["first"][0])
            hand = bool(host["closed_by"]) and host["closed_by"] == part["opened_by"]
            if chain or hand:
                if max(part["p"]) > max(host["p"]):
                    host["last"], host["closed_by"] = part["last"], part["closed_by"]
                host["p"] = sorted(host["p"] + part["p"])
                live.pop(i)
                break
    return sorted(tuple(x["p"]) for x in live)


@pytest.mark.parametrize("seed,chunk", [(0, 1 << 14), (1, 1 << 14), (2, 3), (3, 4), (4, 1)])
def test_rejoin(spark, seed, chunk):
    rng = random.Random(seed)
    rows, want = [], []
    for b in range(25):
        groups, page = [], 1
        for _ in range(rng.randint(1, 14 if chunk > 1 else 6)):
            label = rng.choice([None, (1, 3), (2, 3), (3, 3), (2, 2)])
            author = rng.choice([None, None, "x", "y"])
            groups.append(([page], label, label, author))
            k, n = label or (None, None)
            rows.append((f"c{b}", f"b{b}", page, page, 1, k, n, None, author, k, n, None, author))
            page += 1
        want += [(f"b{b}", p) for p in _rejoin(groups)]
    df = spark.createDataFrame(rows, (
        "case_id string, bundle_id string, group_start int, last_page int, n_pages long, first_k int,"
        " first_n int, first_serial string, first_author string, last_k int, last_n int,"
        " last_serial string, last_author string"))
    spans = units.unit_spans(units.rejoin(df, chunk)).collect()
    assert sorted((r.bundle_id, tuple(s.first for s in r.spans)) for r in spans) == sorted(want)


def _swept(rows):
    """One file from its last run to its first, each part looked for among all runs before it."""
    live = [dict(k=k, n=n, s=s, a=a, lk=k, ln=n, ls=s, la=a, p=[i]) for i, (k, n, s, a) in enumerate(rows)]
    for i in range(len(live) - 1, 0, -1):
        part = live[i]
        if part["k"] is None or part["k"] <= 1:
            continue
        for host in reversed(live[:i]):
            chain = host["lk"] is not None and (host["ln"], host["lk"] + 1) == (part["n"], part["k"])
            if host["ls"] and part["s"]:
                hand = host["ls"] == part["s"]
            else:
                hand = bool(host["la"]) and host["la"] == part["a"]
            if chain or hand:
                if max(part["p"]) > max(host["p"]):
                    host.update({k: part[k] for k in ("lk", "ln", "ls", "la")})
                host["p"] += part["p"]
                live.pop(i)
                break
    return sorted((min(x["p"]), p) for x in live for p in x["p"] if p != min(x["p"]))


def test_rejoin_of_one_large_file(spark):
    """Many runs of one file in chunks: serials, authors and long chains of sheets."""
    rng = random.Random(7)
    rows = []
    for _ in range(4000):
        k = rng.choice([None, 1, 1, 2, 3, 4])
        rows.append((k, rng.choice([4, 5, 6]) if k else None, rng.choice([None, None, *"stuvw"]),
                     rng.choice([None, *"abcdefgh"])))
    # A chain of forty sheets whose parts lie far apart.
    for k in range(1, 41):
        rows[100 * (k - 1)] = (k, 99, None, None)
    want = _swept(rows)
    assert len(want) > 1500
    df = spark.createDataFrame(
        [("c", "b", i, i, 1, k, n, s, a, k, n, s, a) for i, (k, n, s, a) in enumerate(rows)], (
            "case_id string, bundle_id string, group_start int, last_page int, n_pages long, first_k int,"
            " first_n int, first_serial string, first_author string, last_k int, last_n int,"
            " last_serial string, last_author string"))
    for chunk in (1 << 14, 1000):
        moved = units.rejoin(df, chunk).where("host_start <> group_start").collect()
        assert sorted((r["host_start"], r["group_start"]) for r in moved) == want


def test_rejoin_goes_through_many_files_in_one_pass():
    """A task's files share one call, and a file may run over from one batch to the next."""
    columns = list(rejoin._COLUMNS)
    rows = [{**dict.fromkeys(columns), "bundle_id": f"b{b:04}", "group_start": k, "last_page": k, "first_k": k,
             "first_n": 3, "last_k": k, "last_n": 3, "chunk": 0, "top": 0, "cell": 0, "itself": True}
            for b in range(1500) for k in (1, 2, 3)]
    kinds = dict(zip(columns, rejoin._KINDS)) | {"cell": pa.int32(), "itself": pa.bool_()}
    table = pa.Table.from_pylist(rows, pa.schema(kinds))
    for size in (1, 2, 4500):
        got = [r for b in rejoin._visits(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert [(r["bundle_id"], r["group_start"], r["host_start"]) for r in got] == [
            (r["bundle_id"], r["group_start"], None if r["group_start"] == 1 else 1) for r in rows]
    assert list(rejoin._visits(iter(table.slice(0, 0).to_batches()))) == []


def test_unit_match_follows_the_key_order(spark):
    rng = random.Random(2)
    pairs, gold, us, want = [], [], [], {}
    for c in range(30):
        case, table = f"c{c}", {}
        us += [(case, f"{case}u{j}", j) for j in range(5)]
        gold += [(case, f"{case}g{i}", i) for i in range(4)]
        for i in range(4):
            for j in range(5):
                if rng.random() < 0.6:
                    table[(i, j)] = rng.choice([0.2, 0.5, 1.0])
                    pairs.append((case, f"{case}g{i}", f"{case}u{j}", table[(i, j)]))
        used = set()
        for i in range(4):
            best = max(((v, -j) for (g, j), v in table.items() if g == i and j not in used), default=None)
            if best:
                used.add(-best[1])
                want[f"{case}g{i}"] = f"{case}u{-best[1]}"
    tables = (
        spark.createDataFrame(pairs, "case_id string, gold_id string, unit_id string, overlap double"),
        spark.createDataFrame(gold, "case_id string, gold_id string, gold_ord int"),
        spark.createDataFrame(us, "case_id string, unit_id string, unit_ord int"))
    for chunk in (1 << 16, 4):
        got = scoring.match_units(*tables, chunk_pairs=chunk)
        assert {r.gold_id: r.unit_id for r in got.collect()} == want
    assert scoring.match_units(tables[0].limit(0), *tables[1:]).count() == 0


def test_unit_match_goes_through_many_cases_in_one_pass():
    """A task's cases share one call, and a case may run over from one batch to the next."""
    rows = [(f"c{c}", f"c{c}g{g}", g, f"c{c}u{u}", 0.5) for c in range(2000) for g in (0, 1) for u in (0, 1)]
    names = ["case_id", "gold_id", "gold_ord", "unit_id", "overlap"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    for size in (1, 3, 8000):
        got = [r for b in scoring._choose(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert [(r["gold_id"], r["unit_id"]) for r in got] == [
            (f"c{c}g{g}", f"c{c}u{g}") for c in range(2000) for g in (0, 1)]


def test_unit_match_with_one_large_case_among_small_ones(spark):
    """Only the large case is cut into chunks; all are matched as without chunks."""
    rng = random.Random(5)
    pairs = [("big", f"g{i}", f"u{j}", rng.choice([0.2, 0.5, 1.0])) for i in range(40) for j in range(40)
             if rng.random() < 0.3]
    pairs += [(f"s{c}", "g0", f"u{j}", 0.5) for c in range(50) for j in (1, 0)]
    df = spark.createDataFrame(pairs, "case_id string, gold_id string, unit_id string, overlap double")
    gold = df.select("case_id", "gold_id", F.substring("gold_id", 2, 9).cast("int").alias("gold_ord")).distinct()
    us = df.select("case_id", "unit_id", F.substring("unit_id", 2, 9).cast("int").alias("unit_ord")).distinct()
    whole, cut_up = (
        {(r.case_id, r.gold_id): r.unit_id for r in scoring.match_units(df, gold, us, chunk_pairs=n).collect()}
        for n in (1 << 16, 25))
    assert whole == cut_up
    assert len(whole) > 80 and all(whole[f"s{c}", "g0"] == "u0" for c in range(50))


def test_unit_match_along_a_chain_of_ten_thousand_rivals(spark):
    """Each gold unit would rather have what the one before it takes."""
    n = 10_000
    steps = spark.range(n).select(
        F.lit("c").alias("case_id"), F.format_string("g%05d", "id").alias("gold_id"), F.col("id").cast("int").alias("gold_ord"))
    us = spark.range(n).select(
        F.lit("c").alias("case_id"), F.format_string("u%05d", "id").alias("unit_id"), F.col("id").cast("int").alias("unit_ord"))
    pairs = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("id >= k").select(
        F.lit("c").alias("case_id"), F.format_string("g%05d", "id").alias("gold_id"),
        F.format_string("u%05d", F.col("id") - F.col("k")).alias("unit_id"), (0.5 + F.col("k") * 0.25).alias("overlap"))
    # Seven rounds of about 3,000 pairs; the first unit is taken by the first, and all others move up.
    got = scoring.match_units(pairs, steps, us, chunk_pairs=3000).collect()
    assert {r.gold_id: r.unit_id for r in got} == {f"g{i:05}": f"u{i:05}" for i in range(n)}


def test_only_one_setting_may_move(spark):
    def table(**kw):
        return spark.createDataFrame([(k, str(v)) for k, v in kw.items()], "key string, value string")

    assert scoring.require_one_setting(table(a=1, b=2), table(a=1, b=3)) == "b"
    for other in (table(a=1, b=2), table(a=5, b=3)):
        with pytest.raises(scoring.NotOneSetting):
            scoring.require_one_setting(table(a=1, b=2), other)


def test_fuzzy_match(spark):
    df = spark.createDataFrame([("Été  chaud", "ete chaud"), ("abc", "xyz"), (None, None), (None, "a"),
                                ("amélioration", "amelioratoin")], "a string, b string")
    got = [r[0] for r in df.select(scoring.fuzzy_match(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, False, True]


def test_overlaps_count_a_page_once_and_read_each_side_once(spark, tmp_path):
    units = [("c", "u", 1), ("c", "u", 1), ("c", "u", 2), ("c", "u", None), ("c", "v", 3), (None, "w", 1)]
    gold = [("c", "g", 1), ("c", "g", 2), ("c", "g", None), ("c", "h", 3), ("c", "h", 4), ("c", None, 2)]
    for name, rows in (("unit", units), ("gold", gold)):
        spark.createDataFrame(rows, f"case_id string, {name}_id string, pdf_index int").write.parquet(
            f"{tmp_path}/{name}")
    u, g = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("unit", "gold"))
    found = scoring.overlaps(u, g)
    assert {(r.gold_id, r.unit_id): r.overlap for r in found.collect()} == {("g", "u"): 2 / 4, ("h", "v"): 1 / 2}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scoring.overlaps(u, g)
        plan.collect()
        ran = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # Pages of both sides, pairs, and the counts with the pairs dealt out for them; before, pages
    # were shuffled again for the join and for the counts.
    own = [x for x in ran.splitlines() if " Exchange " in x and "ReusedExchange" not in x]
    assert len(own) <= 7 and ran.count("ReusedExchange") >= 2
