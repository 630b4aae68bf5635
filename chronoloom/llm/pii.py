"""Personal data in texts: four exact patterns, and a character model that adds to them.

The patterns (emails, IP addresses, card numbers, phone numbers) are matched over whole texts,
leftmost and non-overlapping per kind; a match that fails its check is dropped.

The model is a bidirectional LSTM over characters with a linear-chain CRF on top, written in
numpy and trained here from labelled spans: windows of a bounded sample of documents, labelled
by the patterns, and made-up spans in writings that the patterns miss.  Every place of a text
that holds a digit or an at sign (no personal data of these kinds lacks one) lies in the core of
one window; windows overlap by their margins.  Each window is decoded by itself; the spans of
all windows of a text that pass their kind's check are then reconciled over the whole text: of
overlapping ones those with the greatest total confidence stay, and pattern spans always do.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces, texts

KINDS = ("email", "ip", "card", "phone")
CORE, MARGIN = 64, 32
WIDTH = CORE + 2 * MARGIN
#: Characters left off at either end of a window for training.
CROP = 24
SURE = 0.9

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def valid_ip(text: str) -> bool:
    parts = text.split(".")
    # Zeros in front do not count; a part may have more digits than an int() takes.
    return len(parts) == 4 and all(
        p.isdecimal() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255
        for p in parts)


def valid_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """One look at each at sign: the run of local characters before it, the host behind it."""
    out, done = [], 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start; ends are exclusive."""
    if not _TRIGGER.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    for kind, pattern, check in ((1, _IP, valid_ip), (2, _CARD, valid_card),
                                 (3, _PHONE, valid_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if check(m[0])]
    return out


def windows(text: str) -> list[int]:
    """Starts of the cores that hold a digit or an at sign, in order."""
    out, at = [], 0
    while m := _TRIGGER.search(text, at):
        start = m.start() // CORE * CORE
        out.append(start)
        at = start + CORE
    return out


_SYMBOLS = "\0a A0@._%+-()/:;,='\"[]{}<>|#*&!?\n"
_TABLE = np.full(128, 1, np.int64)
for _i, _c in enumerate(_SYMBOLS):
    _TABLE[ord(_c)] = _i
for _c in range(128):
    if chr(_c).isdigit():
        _TABLE[_c] = _SYMBOLS.index("0")
    elif chr(_c).isupper():
        _TABLE[_c] = _SYMBOLS.index("A")
    elif chr(_c).islower():
        _TABLE[_c] = _SYMBOLS.index("a")
_TABLE[9] = _TABLE[13] = _SYMBOLS.index(" ")
TAGS = 1 + 2 * len(KINDS)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.where(codes < 128, codes, ord("a"))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Model:
    """Bidirectional LSTM and CRF.  All parameters are in ``p``; batches are [window, place]."""

    def __init__(self, embed: int = 10, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = 1 / np.sqrt(hidden)
        self.p = {"embed": rng.normal(0, 0.5, (len(_SYMBOLS), embed)),
                  "out": rng.normal(0, scale, (2 * hidden, TAGS)), "bias": np.zeros(TAGS),
                  "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, scale, (embed, 4 * hidden))
            self.p[f"h{d}"] = rng.normal(0, scale, (hidden, 4 * hidden))
            self.p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)

    def _pass(self, codes: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction [window, place, hidden]."""
        n, width = codes.shape
        size = self.hidden
        table = self.p["embed"] @ self.p[f"x{d}"] + self.p[f"c{d}"]
        kind = table.dtype
        h, c = np.zeros((n, size), kind), np.zeros((n, size), kind)
        out = np.empty((n, width, size), kind)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            z = table[codes[:, t]] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * size:(k + 1) * size]) for k in range(3))
            g = np.tanh(z[:, 3 * size:])
            if keep is not None:
                keep.append((t, h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            if keep is not None:
                keep[-1] += (c,)
            out[:, t] = h
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._pass(codes, d, None if keep is None else
                                          keep.setdefault(d, [])) for d in "fb"], 2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["out"] + self.p["bias"]

    def _gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        keep: dict = {}
        e = self.emissions(codes, keep)
        n, width, _ = e.shape
        move, first = self.p["move"], self.p["first"]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + first
        for t in range(1, width):
            a[:, t] = e[:, t] + _logsum(a[:, t - 1, :, None] + move, 1)
        for t in range(width - 2, -1, -1):
            b[:, t] = _logsum(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = _logsum(a[:, -1], 1)
        rows, places = np.arange(n)[:, None], np.arange(width)
        gold = e[rows, places, tags].sum(1) + first[tags[:, 0]] \
            + move[tags[:, :-1], tags[:, 1:]].sum(1)
        loss = float((z - gold).sum() / n)
        one = np.exp(a + b - z[:, None, None])
        de = one.copy()
        de[rows, places, tags] -= 1
        g = {"first": de[:, 0].sum(0), "move": np.zeros_like(move)}
        for t in range(1, width):
            g["move"] += np.exp(a[:, t - 1, :, None] + move + (e[:, t] + b[:, t])[:, None, :]
                                - z[:, None, None]).sum(0)
        np.subtract.at(g["move"], (tags[:, :-1], tags[:, 1:]), 1)
        both, size = keep["both"], self.hidden
        g["out"] = np.einsum("nth,ntk->hk", both, de)
        g["bias"] = de.sum((0, 1))
        dboth = de @ self.p["out"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        for k, d in enumerate("fb"):
            dtable = np.zeros((len(_SYMBOLS), 4 * size), both.dtype)
            g[f"h{d}"] = np.zeros_like(self.p[f"h{d}"])
            dh = dc = np.zeros((n, size), both.dtype)
            for t, h0, c0, i, f, o, gg, c in reversed(keep[d]):
                dh = dh + dboth[:, t, k * size:(k + 1) * size]
                th = np.tanh(c)
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f),
                                     dh * th * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                np.add.at(dtable, codes[:, t], dz)
                g[f"h{d}"] += h0.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            g[f"c{d}"] = dtable.sum(0)
            g[f"x{d}"] = self.p["embed"].T @ dtable
            g["embed"] += dtable @ self.p[f"x{d}"].T
        return loss, {name: x / n for name, x in g.items()}

    def train(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 13, batch: int = 48,
              rate: float = 0.02, seed: int = 3) -> float:
        """Adam over shuffled batches; gives the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, mean = 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(codes)), []
            pace = rate * (1 - 0.9 * epoch / epochs)
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                loss, g = self._gradient(codes[pick], tags[pick])
                losses.append(loss)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                for k, x in g.items():
                    x = x * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (pace * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags [window, place], and each place's probability of its tag.

        The probability is the field's marginal, from a forward and a backward pass over the
        window: it weighs all taggings, with their transitions.
        """
        e = self.emissions(codes)
        n, width, _ = e.shape
        score, back = e[:, 0] + self.p["first"], np.zeros(e.shape, np.int8)
        move = np.exp(self.p["move"])
        near = np.exp(e - e.max(2, keepdims=True))
        ahead = np.empty_like(near)
        ahead[:, 0] = near[:, 0] * np.exp(self.p["first"] - self.p["first"].max())
        for t in range(1, width):
            step = score[:, :, None] + self.p["move"]
            back[:, t] = step.argmax(1)
            score = step.max(1) + e[:, t]
            now = (ahead[:, t - 1] @ move) * near[:, t]
            ahead[:, t] = now / now.sum(1, keepdims=True)
        tags = np.empty((n, width), np.int64)
        tags[:, -1] = score.argmax(1)
        behind = np.ones_like(near[:, 0])
        sure = np.empty((n, width), near.dtype)
        for t in range(width - 1, -1, -1):
            if t < width - 1:
                tags[:, t] = back[np.arange(n), t + 1, tags[:, t + 1]]
                behind = (near[:, t + 1] * behind) @ move.T
                behind /= behind.sum(1, keepdims=True)
            joint = ahead[:, t] * behind
            sure[:, t] = joint[np.arange(n), tags[:, t]] / joint.sum(1)
        return tags, sure

    def frozen(self) -> Model:
        """A copy in single precision, for decoding."""
        out = Model.__new__(Model)
        out.hidden, out.p = self.hidden, {k: x.astype(np.float32) for k, x in self.p.items()}
        return out


def _tagged(width: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(width, np.int64)
    for kind, start, end in spans:
        start, end = max(start, 0), min(end, width)
        if start < end and not tags[start:end].any():
            tags[start:end] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
    return tags


def _made_up(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with one made-up span or number each, in writings with and without a pattern."""
    rng = random.Random(seed)

    def num(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word(a=2, b=8):
        return "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(a, b)))

    def card():
        body = "4" + num(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def span():
        kind = rng.randrange(8)
        if kind == 0:
            return 0, f"{word()}{rng.choice(['.', '_', ''])}{num(2)}@{word()}{num(1)}.{word()}.com"
        if kind == 1:
            return 0, f"{word()} @ {word()}.com"
        if kind == 2:
            return 1, ".".join(str(rng.randint(1, 255)) for _ in range(4))
        if kind == 3:
            c = card()
            return 2, rng.choice([c, " ".join(c[i:i + 4] for i in range(0, 16, 4)),
                                  ".".join(c[i:i + 4] for i in range(0, 16, 4))])
        if kind == 4:
            return 3, f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"
        if kind == 5:
            return 3, f"({num(3)}) {num(3)}-{num(4)}"
        if kind == 6:
            return 3, rng.choice("-.").join([num(3), num(3), num(4)])
        return -1, rng.choice([f"{num(4)}-{num(2)}-{num(2)}", num(rng.randint(1, 6)), num(2) + ".0",
                               f"{num(1)}.{num(1)}.{num(1)}", f"@{word()}", num(4) + "%",
                               f"password={num(6)}{word()}{num(5)}", f"${num(3)}.{num(2)}",
                               f"{num(8)}{word(2, 4)}{num(6)}{word(2, 4)}"])

    out = []
    for _ in range(n):
        kind, text = span()
        left = " ".join([word() for _ in range(12)])[-rng.randint(MARGIN, MARGIN + CORE - 1):]
        left += rng.choice([" ", " ", "\n", ": ", ", "])
        right = rng.choice([" ", " ", ". ", ",", "\n"]) + " ".join(word() for _ in range(20))
        window = (left + text + right)[:WIDTH].ljust(WIDTH, "\0")
        out.append((window, [(kind, len(left), len(left) + len(text))] if kind >= 0 else []))
    return out


def _window(text: str, start: int) -> str:
    lo = start - MARGIN
    return "\0" * max(0, -lo) + text[max(lo, 0):lo + WIDTH]


def sample(docs: DataFrame, n_docs: int = 300, per_doc: int = 3) -> list[tuple[str, list]]:
    """Labelled windows of about ``n_docs`` documents, chosen by hash, ``per_doc`` each."""
    told = docs.where(F.col("text").rlike("[0-9@]"))
    n = told.count()
    if not n:
        return []
    share = min(1.0, n_docs / n)
    chosen = told.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))

    def cut(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for start in windows(text)[:per_doc]:
                    rows.append((_window(text, start).ljust(WIDTH, "\0"), [
                        x for k, s, e in spans for x in (k, s - start + MARGIN, e - start + MARGIN)
                    ]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0].replace("\0", "\x01") for r in rows], pa.string()),
                     pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["window", "spans"])

    got = chosen.select("text").mapInArrow(cut, "window string, spans array<long>").collect()
    return sorted((r["window"].replace("\x01", "\0"),
                   [tuple(r["spans"][i:i + 3]) for i in range(0, len(r["spans"]), 3)])
                  for r in got)


def fit(docs: DataFrame, n_docs: int = 300, made_up: int = 600) -> Model:
    """A model trained on the driver from at most some thousands of windows."""
    labelled = sample(docs, n_docs) + _made_up(made_up)
    return trained(labelled)


def trained(labelled: list[tuple[str, list]]) -> Model:
    """A model from windows with their spans, of which the core and a little more are used."""
    codes = np.stack([_codes(w) for w, _ in labelled])[:, CROP:-CROP]
    tags = np.stack([_tagged(WIDTH, spans) for _, spans in labelled])[:, CROP:-CROP]
    model = Model()
    model.train(codes, tags)
    return model.frozen()


def _plausible(kind: int, text: str) -> bool:
    """Whether a decoded span is what its kind has to be."""
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?@ ?[\w-]+(?:\.[\w-]+)+", text))
    if kind == 1:
        return valid_ip(text)
    if kind == 2:
        return valid_card(text) and not re.search(r"[^0-9 .\-]", text)
    return valid_phone(text) and bool(re.fullmatch(
        r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}", text))


def _spans_of(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    out, t = [], 0
    width = len(tags)
    while t < width:
        if tags[t] % 2:
            end = t + 1
            while end < width and tags[end] == tags[t] + 1:
                end += 1
            out.append((int(tags[t] - 1) // 2, t, end, float(sure[t:end].mean())))
            t = end
        else:
            t += 1
    return out


def reconcile(found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]
              ) -> list[tuple[int, int, int]]:
    """Of the found spans (kind, start, end, confidence) those without overlap among them or
    with the base spans that have the greatest total confidence."""
    free = sorted({(e, s, k, c) for k, s, e, c in found
                   if not any(s < b and a < e for _, a, b in base)})
    ends = [x[0] for x in free]
    best: list[tuple[float, tuple]] = [(0.0, ())]
    for i, (e, s, k, c) in enumerate(free):
        before = best[bisect_right(ends, s, 0, i)]
        taken = (before[0] + c, (i, before[1]))
        best.append(max(best[-1], taken, key=lambda x: x[0]))
    out, chain = [], best[-1][1]
    while chain:
        e, s, k, _ = free[chain[0]]
        out.append((k, s, e))
        chain = chain[1]
    return out


def find(texts_: list[str], model: Model) -> tuple[list, list]:
    """Base spans and all spans of each text, by kind and start."""
    base = [base_spans(t) for t in texts_]
    places = [(i, w) for i, t in enumerate(texts_) for w in windows(t)]
    found: dict[int, list] = {}
    for lo in range(0, len(places), 512):
        part = places[lo:lo + 512]
        codes = np.stack([_codes(_window(texts_[i], w).ljust(WIDTH, "\0")) for i, w in part])
        tags, sure = model.decode(codes)
        for row in np.flatnonzero(tags.any(1)).tolist():
            i, w = part[row]
            for kind, s, e, c in _spans_of(tags[row], sure[row]):
                s, e = s + w - MARGIN, e + w - MARGIN
                if c >= SURE and 0 <= s and e <= len(texts_[i]) \
                        and _plausible(kind, texts_[i][s:e]):
                    found.setdefault(i, []).append((kind, s, e, c))
    every = [sorted(b + reconcile(found[i], b)) if i in found else b for i, b in enumerate(base)]
    return base, every


def detect(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points) for every row.

    Null or empty text has none.  Equal rows stay equal rows; other columns are ignored.
    Without a model one is fitted on a bounded sample of ``docs``.
    """
    slim = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(slim))
    kind = slim.schema["doc_id"].dataType.simpleString()
    form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in pieces(batches, "text"):
            both = find(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(
                [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in spans],
                form) for spans in both)], ["doc_id", "base", "spans"])

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return slim.mapInArrow(run, f"doc_id {kind}, base {span}, spans {span}")


def mask(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets.

    All columns stay as they are but the text; a null text stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        model or fit(texts(docs.withColumn("__id", F.lit(0)), "__id", text_col)))

    def run(batches):
        for batch in pieces(batches, text_col):
            old = batch.column(text_col).to_pylist()
            _, spans = find([t or "" for t in old], shared.value)
            new = []
            for text, row in zip(old, spans):
                at, parts = 0, []
                for s, e, k in sorted((s, e, k) for k, s, e in row):
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    elif e > at:
                        parts += [f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                new.append(text if not row else "".join(parts) + text[at:])
            place = batch.schema.get_field_index(text_col)
            yield batch.set_column(place, text_col, pa.array(new, pa.string()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
