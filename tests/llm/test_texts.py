"""Operators on single texts: token counts, packing, personal data, language, quality, pages."""

import collections
import html
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("chronoloom.llm")
P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from chronoloom.llm import htmltext, langid, packing, pii, quality, tokencount  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
RNG = random.Random(5)
ODD = [
    "", " ", "'", "''s it's 'tis don't'll 'rex x'ver've", "İstanbul ΣΑΣ Σ", "日本語テキスト 12345 ١٢٣",
    "<|endoftext|>a<|startoftext|>b <|endoftext|", "é café́ é 👍🏽👍", "   x\x85y\x1cz\x0bq", "a" * 5000,
    "ab'" * 999, "".join(map(chr, range(1, 0x800))), "𝔘𝔫𝔦 ﬁ ﬀ Ⅷ ½ ² ª º", "hello world " * 4000,
    *("".join(RNG.choice("abcdeéß'.,1 \n") for _ in range(n)) for n in (10, 300, 3000)),
]
SCHEMA = "doc_id long, text string, words string, n_tokens string, letter int, k1 int"


def rows_of(texts):
    return [(i, t, "x", "y", 1, 2) for i, t in enumerate(texts)]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_token_counts_are_the_library_s(spark):
    texts = [*ODD, None, "repeated row", "repeated row"]
    df = spark.createDataFrame([*rows_of(texts), (99, "same", "", "", 0, 0),
                                (99, "same", "", "", 0, 0), (None, "no id", "", "", 0, 0)], SCHEMA)
    out = tokencount.count_tokens(df, PATH, limit=100).collect()
    assert len(out) == len(texts) + 3
    told = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        n = len(library_ids(t))
        assert (told[i]["n_tokens"], told[i]["n_bytes"], told[i]["over_limit"]) == (
            n, len((t or "").encode()), n > 100), repr(t)[:60]
    assert told[None]["n_tokens"] == len(library_ids("no id"))
    assert sum(r["doc_id"] == 99 for r in out) == 2
    assert tokencount.count_tokens(df.limit(0), PATH).count() == 0


def test_transducer_tables_can_be_dropped():
    words, small = tokencount.Words(PATH), tokencount.Transducer(PATH, limit=1)
    for _ in range(3):
        symbols, at, special = words.symbols(ODD)
        got = small.count(symbols, at) + special
        assert got.tolist() == [len(library_ids(t)) for t in ODD]


def check_packing(rows, texts, max_tokens, end_id=2):
    ids = {i: np.array([*library_ids(t), end_id], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == ids[key].tobytes()
        assert [r["start"] for r in pieces] == np.cumsum(
            [0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(ids[key])}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == np.cumsum(
            [0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert n == max_tokens or n & (n - 1) == 0 and n < max_tokens
    return by_sequence


@pytest.mark.parametrize("limits", [(4096, 64, 4096), (64, 3, 64), (32, 8, 20), (16, 1, 5)])
def test_packing_round_trip(spark, limits):
    texts = {i: t for i, t in enumerate([*ODD, None, *(f"word {i} of some" for i in range(60))])}
    df = spark.createDataFrame(rows_of(texts.values()), SCHEMA).repartition(3)
    tokens, segments, loss = limits
    rows = packing.pack(df, PATH, tokens, segments, loss).collect()
    for pieces in check_packing(rows, texts, tokens).values():
        assert len(pieces) <= segments
        assert sum(r["loss_tokens"] for r in pieces) <= loss
        assert all(r["loss_tokens"] == r["length"] - 1 for r in pieces)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_packing_encodes_few_texts_at_a_time():
    """What encoding holds beside the tokenizer follows its pieces, not the batch it is given."""
    import json
    import tracemalloc

    import pyarrow as pa

    from chronoloom.llm.common import pieces

    coder = packing.Encoder(PATH)
    with open(PATH, encoding="utf-8") as f:
        listed = {t["content"] for t in json.load(f)["added_tokens"]}
    assert all(coder.words.special.fullmatch(t) for t in listed)
    rng = random.Random(1)
    batch = pa.RecordBatch.from_pydict({"text": [
        " ".join(rng.choice(("one", "other", "thing", "of", "two")) for _ in range(400)) for _ in range(2500)]})
    assert sum(map(len, batch.column("text").to_pylist())) > 4 << 20
    tracemalloc.start()
    try:
        for piece in pieces(iter([batch]), "text", packing.PIECE):
            coder.encode(piece.column("text").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20


def test_packing_counts_loss_after_the_prompt(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", 4), (2, "x y z", 100), (3, "q", None)],
                               "doc_id long, text string, prompt long")
    rows = packing.pack(df, PATH, 64, 8, 64, prompt_col="prompt").collect()
    told = collections.Counter()
    for r in rows:
        # Tokens past the prompt, but the first of a piece has nothing before it.
        told[r["doc_id"]] += r["loss_tokens"]
        prompt = {1: 4, 2: 100, 3: 0}[r["doc_id"]]
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"] + 1, prompt))
    assert told[2] == 0 and told[1] > 0


def brute_spans(t):
    out = [(0, m.start(), m.end()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in
            re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if pii.valid_card(m[0])]
    return out + [(3, m.start(), m.end()) for m in
                  re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if pii.valid_phone(m[0])]


def test_pattern_spans_against_the_plain_patterns():
    rng, n = random.Random(2), 0
    for _ in range(20000):
        t = "".join(rng.choice("ab1234567890..@@+- ()") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t
        n += len(brute_spans(t))
    assert n > 1000
    assert pii.base_spans("1" * 200_000) == []
    assert pii.base_spans("a@" * 50_000) == []


@pytest.fixture(scope="module")
def model():
    return pii.trained(pii._made_up(700))


def test_model_gradient():
    windows = pii._made_up(3)
    codes = np.stack([pii._codes(w) for w, _ in windows])
    tags = np.stack([pii._tagged(pii.WIDTH, s) for _, s in windows])
    net = pii.Model()
    _, g = net._gradient(codes, tags)
    for name, at in (("embed", (5, 2)), ("hf", (3, 7)), ("xb", (2, 20)), ("move", (1, 2))):
        old = net.p[name][at]
        losses = []
        for d in (1e-5, -1e-5):
            net.p[name][at] = old + d
            losses.append(net._gradient(codes, tags)[0])
        net.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-5


def test_model_finds_what_it_was_trained_on(model):
    """Only writings that no pattern finds count: what the model itself adds."""
    held_out = pii._made_up(300, seed=77)
    hit = total = wrong = 0
    for window, spans in held_out:
        text = window.replace("\0", "")
        base, every = pii.find([text], model)
        own = [s for s in spans if s not in base[0] and s[2] <= len(text)]
        total += len(own)
        hit += sum(s in every[0] for s in own)
        wrong += sum(s not in spans and s not in base[0] for s in every[0])
    assert total > 60 and hit >= 0.9 * total and wrong <= 0.02 * total


def test_marginals_are_sums_over_all_taggings():
    import itertools

    codes = np.array([[3, 7, 1, 9]])
    net = pii.Model()
    net.p["move"] = np.random.default_rng(1).normal(size=net.p["move"].shape)
    tags, sure = net.decode(codes)
    e = net.emissions(codes)[0]
    paths = list(itertools.product(range(e.shape[1]), repeat=4))
    weight = np.exp([net.p["first"][p[0]] + sum(e[t, s] for t, s in enumerate(p))
                     + sum(net.p["move"][a, b] for a, b in zip(p, p[1:])) for p in paths])
    weight /= weight.sum()
    assert tuple(tags[0]) == paths[int(weight.argmax())]
    for t in range(4):
        want = sum(w for w, p in zip(weight, paths) if p[t] == tags[0, t])
        assert abs(sure[0, t] - want) < 1e-9


def test_reconcile_takes_the_surest_without_overlap():
    found = [(0, 0, 5, .9), (1, 4, 12, 1.0), (2, 11, 15, .95), (3, 20, 30, .9), (3, 21, 31, .99)]
    assert sorted(pii.reconcile(found, [(3, 40, 50)])) == [(0, 0, 5), (2, 11, 15), (3, 21, 31)]
    assert pii.reconcile([(3, 45, 60, 1.0)], [(3, 40, 50)]) == []


def test_personal_data(spark, model):
    long = "x" * 200_000 + " a.b@c.de " + "y" * 100_000
    texts = ["mail a.b@c.de now", None, "", "none", "ip 1.2.3.4, card 4111 1111 1111 1111", long,
             "+1 (988) 555-2485", "é👍 a@b.cd"]
    df = spark.createDataFrame([*rows_of(texts), (6, texts[6], "", "", 0, 0)], SCHEMA)
    rows = pii.detect(df, model).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base"]]
        assert base == brute_spans(texts[r["doc_id"]] or "")
        every = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"]]
        assert set(base) <= set(every) and every == sorted(every)
    masked = {r["doc_id"]: r for r in pii.mask(df, model).collect()}
    assert masked[0]["text"] == "mail [EMAIL] now" and masked[1]["text"] is None
    assert masked[5]["text"] == long.replace("a.b@c.de", "[EMAIL]")
    assert masked[7]["text"] == "é👍 [EMAIL]" and masked[0]["words"] == "x"
    assert pii.detect(df.limit(0)).count() == 0


def plain_bits(model, language, text):
    """Code length of a text by walking the context trees, without the automaton."""
    j = model.languages.index(language)
    counts = collections.defaultdict(dict)
    for lang, c, b, n in model.entries.tolist():
        if lang == j:
            counts[model.contexts[c]][b] = n
    data, total = text.lower().encode(), 0.0
    for i, b in enumerate(data):
        c = next(data[k:i] for k in range(max(0, i - model.order), i + 1)
                 if data[k:i] in set(model.contexts))
        while True:
            seen = counts[c]
            n, t = sum(seen.values()), len(seen)
            if b in seen:
                total += np.log2(n + t) - np.log2(seen[b])
                break
            total += np.log2(n + t) - np.log2(t) if n else 0
            if not c:
                total += 8
                break
            c = c[1:]
    return total


def test_code_lengths_are_exact():
    samples = {"aa": ["abra cadabra " * 40], "bb": ["bumble bee bob " * 30 + "xyz"]}
    model = langid.Model(samples, least=3)
    texts = ["abra", "", "bob éé", "zq" * 400, "cadabra bee " * 60]
    step, bits = model.compiled()
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = langid.code_lengths(np.frombuffer(b"".join(raw), np.uint8), at, model.order, step, bits)
    for i, t in enumerate(texts):
        for j, language in enumerate(model.languages):
            assert got[i, j] == pytest.approx(plain_bits(model, language, t), rel=1e-4)


def test_language(spark):
    rng = random.Random(1)
    words = {"xx": "foo bar baz qux".split(), "yy": "lorem ipsum dolor sit".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang)
            for i in range(200) for lang in ("xx", "yy")]
    rows = [(2 * i + k, *r[1:]) for k in (0, 1) for i, r in enumerate(rows[k::2])]
    extra = [(1000, None, "xx"), (1001, "123 !!", "yy"), (1002, "", None), (1003, "foo bar", None),
             (None, "ipsum", "yy"), (1004, "lorem " * 30000, None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    out = langid.identify(df.withColumn("score", df.lang)).collect()
    assert len(out) == len(rows) + len(extra)
    told = {r["doc_id"]: r for r in out}
    for i, _, lang in rows:
        assert told[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert told[i]["lang_pred"] == lang and 0.5 < told[i]["score"] <= 1
    assert [told[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert (told[1003]["lang_pred"], told[1004]["lang_pred"]) == ("xx", "yy")
    kept = langid.accepted(df, langid.fit(df))
    assert kept.columns == df.columns and kept.count() == len(rows) + 3
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, langid.Model({})).collect()} == {"und"}


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1
               for k in range(5)}
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n)


def test_quality_counts(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t ", "one", "a b c d e " * 7, "x\ny\nx\n\n \nx", "tail ok.\x0b\x0c\r\n*#|<>",
             "é👍 " * 30, "u\xa0v w x", "w " * 30000,
             *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)),
             *("\n".join(rng.choice(["p q", "r", " ", ""]) for _ in range(20)) for _ in range(20)),
             *(" ".join(f"word{rng.randint(0, 9999)}" for _ in range(100)) + "." for _ in range(99))]
    df = spark.createDataFrame([*rows_of(texts), *rows_of(texts)[:2]], SCHEMA)
    out = quality.assess(df.withColumn("n_words", df.text)).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"], r["base_failed"]) == brute_quality(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["p_good"] <= 1
    assert quality.assess(df.limit(0)).count() == 0


def test_em_finds_accuracies(spark):
    rng = random.Random(4)
    truth = {"a": 0.95, "b": 0.8, "c": 0.65}
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.7
        rows.append(tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < p) == good else -1)
                          for p in truth.values()))
    model = quality.fit(spark.createDataFrame(rows, "a int, b int, c int"), list(truth), 200, 1e-7)
    assert abs(model["prior"] - 0.7) < 0.06
    for name, p in truth.items():
        assert abs(model["accuracy"][name] - p) < 0.06


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="notice">
<header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div id="cookie-notice">We use</div>
<div class="wrap"><div class="post"><h2>Title &amp; more</h2><p>Some  long text &lt;of&gt; the
article, <a href="x">a link</a> in it.<p>Another <b>bold</b>&nbsp;one<br>here.<script>var a="</p>";
</script><ul><li>one<li>two</ul></div><div class="comments"><p>I disagree strongly with it</div>
</div><aside>side</aside><form><label>name</label></form><footer>foot</footer></body></html>"""


def test_pages(spark):
    assert htmltext.main_text(PAGE) == ("Title & more Some long text <of> the article, a link in it."
                                        " Another bold one here. one two")
    sections = "<article><h1>Head</h1>" + "".join(
        f"<section><p>{'word ' * 60}s{i}<p>{'text ' * 50}</section>" for i in range(3)) + "</article>"
    out = htmltext.main_text(f"<body><div class='ad'>buy</div>{sections}</body>")
    assert out.startswith("Head word") and all(f"s{i}" in out for i in range(3)) and "buy" not in out
    cases = {"": "", "plain": "plain", "<": "<", "<p": "<p", "<p>a": "a", "</p></div>x": "x",
             "<nav>n</nav>": "", "<script>x": "", "<div><div>a</div></div>": "a",
             "<a>link only</a>": "link only", "&lt;b&gt; x": "<b> x", "a<!-- <p>b</p> -->c": "ac"}
    pages = [(i, f"u{i}", h, 1) for i, h in enumerate(cases)] + [
        (50, "u", None, 1), (51, None, "<p>" + "long text " * 50000, 1), (51, None, "<p>q", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    rows = htmltext.extract(df, keep=("url",)).collect()
    told = {r["page_id"]: r for r in rows}
    for i, want in enumerate(cases.values()):
        assert (told[i]["text"], told[i]["n_chars"], told[i]["url"]) == (want, len(want), f"u{i}")
    assert told[50]["text"] == "" and {r["n_chars"] for r in rows if r["page_id"] == 51} == {
        len("long text " * 50000) - 1, 1}
    assert htmltext.main_text("<b>" * 3000 + "deep" + "<p>" * 3000) == "deep"
    assert htmltext.extract(df.limit(0)).count() == 0


def test_wrappers_with_names_of_other_parts_keep_the_article():
    article = f"<article><h1>Head</h1><p>{'word ' * 80}end</p></article>"
    plain = f"<div><h1>Head</h1><p>{'word ' * 80}end</p></div>"
    ad = "<div class='ad'>buy</div><div class='cookie-notice'>we use</div>"
    want = f"Head {'word ' * 80}end"
    for mark in ("class='layout has-sidebar'", "class='no-sidebar'", "class=ad-free",
                 "class='post-with-comments'", "id='social-media-report'", "class='sidebar'",
                 "class='page widget'"):
        for inner in (article, plain):
            assert htmltext.main_text(f"<body><div {mark}>{ad}{inner}</div></body>") == want, mark
        assert htmltext.main_text(f"<body>{ad}<div {mark}><div class=share>{article}</div></div>"
                                  ) == want
    comments = f"<div id='comments'><article>{'I disagree ' * 200}</article></div>"
    assert htmltext.main_text(f"<body>{article}{comments}</body>") == want
    assert htmltext.main_text(f"<div class='sidebar'>{article}{comments}</div>") == want


def test_sections_without_an_article_element_stay_whole():
    dense = "".join(f"<p>{'word ' * 120}p{i}</p>" for i in range(5))
    table = "<table>" + "".join(f"<tr><td>cell{i}</td><td>v{i}</td></tr>" for i in range(20)
                                ) + "</table>"
    links = "<div>" + "".join(f"<a href=x>go{i}</a> " for i in range(30)) + "</div>"
    parts = f"<h1>Head</h1><section>{dense}</section><section>{table}</section>"
    more = "<section><h2>Code</h2><pre>x = 1</pre><ul><li>one<li>two <a>l</a></ul></section>"
    for page in (f"<div>{parts}{more}</div>", f"{links}<div>{parts}{more}{links}</div>",
                 f"<div><div>{parts}</div>{links}</div><div>{more}</div>"):
        out = htmltext.main_text(f"<body>{page}</body>")
        assert out.startswith("Head word") and out.endswith("Code x = 1 one two l")
        assert all(f"p{i}" in out for i in range(5)) and "go1" not in out
        assert all(f"cell{i} v{i}" in out for i in range(20))


def test_addresses_with_endless_zeros_are_rows_like_others(spark):
    texts = ["1.2.3." + "0" * 5000, "1.2.3." + "0" * 5000 + "7", "1.2.3." + "9" * 5000, "0000.1.2.003"]
    assert [len(pii.base_spans(t)) for t in texts] == [1, 1, 0, 1]
    assert [pii.valid_ip(t) for t in texts] == [True, True, False, True]


WORDS = "word " * 80 + "end"
ARTICLE = f"<article><h1>Head</h1><p>{WORDS}</p></article>"


def test_parts_that_hold_the_article_stay():
    want, menu = f"Head {WORDS}", "<ul><li><a href=x>menu</a></ul>"
    for page in (f"<form id=aspnetForm><input>{ARTICLE}</form>", f"<form><input>{ARTICLE}",
                 f"<nav>{menu}{ARTICLE}", f"<header><h1>Site</h1>{menu}{ARTICLE}",
                 f"<aside>{ARTICLE}</aside>", f"<div role=form>{ARTICLE}</div>",
                 f"<div hidden>{ARTICLE}</div>", f"<head><meta x>{ARTICLE}",
                 f"<form><nav>{menu}</nav><div><h1>Head</h1><p>{WORDS}</p></div><footer>f</footer>",
                 f"<div>Home About us</div>{ARTICLE}<div>Copyright 2020</div>loose",
                 f"<h1>Head</h1><article>{WORDS}</article><div>Copyright 2020</div>"):
        assert htmltext.main_text(f"<body>{page}</body>") == want, page.replace(WORDS, "")
    # A teaser in a sidebar is not the article, and neither are forms, menus and hidden parts.
    body = f"<div><h1>Head</h1><p>{WORDS}</p></div>"
    for part in ("<aside><article>teaser</article></aside>", "<form><label>Name</label></form>",
                 f"<div hidden>{WORDS}</div>", f"<nav>{menu}</nav>", "<footer>foot</footer>"):
        assert htmltext.main_text(f"<body>{part}{body}{part}</body>") == want, part
    assert htmltext.main_text("<form><label>Name</label><input></form>") == ""
    two = f"{ARTICLE}<div>Copyright</div><article><p>{WORDS}</p></article>"
    assert htmltext.main_text(f"<body><div>{two}</div></body>") == f"{want} {WORDS}"


def test_time_of_damaged_pages_grows_with_their_length():
    for part in ("<a ", '<a "', "<a \"' ", "</b>", "<i><b></i>", "<b><div><i><i></b>", "<li>",
                 "<nav><p>", "<form><b>", "<td><tr>", "<!--", "<![CDATA[", "<x '"):
        start = time.time()
        htmltext.main_text(f"<div>{part * (400_000 // len(part))}")
        assert time.time() - start < 20, part


def test_ends_of_tags_equal_those_of_a_plain_pattern():
    plain = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
    rng = random.Random(11)
    for _ in range(3000):
        page = "".join(rng.choice("<<a >\"'x=") for _ in range(rng.randint(1, 40)))
        tags = htmltext._Tags(page)
        for at in range(len(page)):
            m = plain.match(page, at)
            assert tags.end(at) == (m.end() if m else -1), (page, at)


def _random_tree(rng, depth: int) -> str:
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["plain text", "a &amp; b", "x" * rng.randint(1, 90), ""])
    name = rng.choice(["div", "section", "a", "b", "td", "article", "main", "h2"])
    inner = "".join(_random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4)))
    return f"<{name}>{inner}</{name}>"


def test_densities_equal_a_recursive_count():
    def counts(n):
        """Characters, tags, characters in links, link tags."""
        c = t = lc = lt = 0
        for p in n.parts:
            if isinstance(p, str):
                c += len("".join(html.unescape(p).split()))
                continue
            pc, pt, plc, plt = counts(p)
            c, t, lc, lt = c + pc, t + pt + 1, lc + plc, lt + plt + (p.name == "a")
        return c, t, c if n.name == "a" else lc, lt

    def density(n, body):
        c, t, lc, lt = counts(n)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + body[2] / max(body[0], 1) * c + math.e)
        t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
        return max(0.0, c / t * math.log(c / lc * t / lt) / math.log(base) if base > 1.0001
                   else c / t)

    rng = random.Random(5)
    for _ in range(150):
        root = htmltext.parse("".join(_random_tree(rng, 4) for _ in range(4)))
        body = counts(root)
        for n in htmltext.measure(root):
            assert math.isclose(n.density, density(n, body), abs_tol=1e-9)
            assert math.isclose(n.score, sum(
                density(p, body) for p in n.parts
                if not isinstance(p, str) and p.name not in htmltext.INLINE), abs_tol=1e-9)
