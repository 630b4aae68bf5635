"""Token counts by a finite-state transducer compiled from a public BPE tokenizer file.

The tokenizer lower-cases a text, cuts it into words and merges each word's bytes by rank.  Of a
word's prefix only this matters for what follows: its longest suffix that begins a token, and at
each position where a token may have begun the last token of the prefix up to there and how many
tokens that prefix has.  (The last token of a prefix is the one token ending there that stays apart from the last
token before it when the two are encoded together; that is one check on a pair.)  Those facts are
the states; reading a byte leads to the next state and emits the change of the token count, and a
word's last byte leads back to the ground state.  States are made when a text first needs them.

A text's word bytes are cut into chunks that are stepped side by side with numpy.  A chunk's map
from entry state to exit state and count is evaluated at the ground state first.  A chunk that
holds a word's end leaves in one state whatever it is entered in, so the maps are composed by a
prefix scan: each chunk takes its predecessor's exit, only the bytes before its first word end
are stepped again, and chunks inside one long word repeat this until no exit changes.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import grid, lanes
from .common import pieces, texts

LANE = 256
SPACE, LETTER, NUMBER, OTHER = range(4)
UNKNOWN = 255
#: Characters whose lower case, class and composition hold without asking the tokenizer.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\|")
_SHIFT, _ZERO = 6, 32


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level tokenizer files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain), *zip(rest, range(256, 512))]}


class Words:
    """Normalises texts and marks where words end, as the tokenizer's file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Asked from the library: the file as Python objects would take far more than the tokenizer.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))
                                  or r"(?!)")
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def normal(self, text: str) -> tuple[str, int]:
        """The normalised text, and how many special tokens stood in it (now blanks)."""
        if not _PLAIN.search(text):
            return text.lower(), 0
        parts = self.special.split(text)
        return " ".join(map(self.tokenizer.normalizer.normalize_str, parts)), len(parts) - 1

    def _learn(self, codes: np.ndarray) -> None:
        """Ask the tokenizer how it cuts each character that was not met before."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for code in np.unique(codes).tolist():
            if 0xD800 <= code < 0xE000:
                continue
            c = chr(code)
            pair = cut(c + c)
            self.classes[code] = (SPACE if not pair else NUMBER if len(pair) == 2
                                  else LETTER if len(cut(c + "a")) == 1 else OTHER)

    def symbols(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word bytes of all texts (a word's last one plus 256), offsets, special tokens."""
        normal = [self.normal(t) for t in texts_]
        joined = "\n".join([t for t, _ in normal] + [""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[codes]
        if (kind == UNKNOWN).any():
            self._learn(codes[kind == UNKNOWN])
            kind = self.classes[codes]
        last = np.ones(len(codes), bool)
        last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == NUMBER)
        self._contractions(codes, kind, last)
        data = np.frombuffer(joined.encode(), np.uint8)
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        ends = np.cumsum(size)
        symbols = data.astype(np.int16)
        symbols[ends[last] - 1] += 256
        keep = np.repeat(kind != SPACE, size)
        lengths = np.array([len(t) + 1 for t, _ in normal], np.int64)
        at = np.concatenate([[0], np.cumsum(keep)[ends[np.cumsum(lengths) - 1] - 1]])
        return symbols[keep], at, np.array([n for _, n in normal], np.int64)

    @staticmethod
    def _contractions(codes: np.ndarray, kind: np.ndarray, last: np.ndarray) -> None:
        """An apostrophe that opens a word takes 's 't 'm 'd 're 've 'll as a word of its own."""
        at = np.flatnonzero(codes[:-2] == ord("'"))
        at = at[(at == 0) | (kind[at - 1] != OTHER)]
        for one in "stmd":
            hit = at[codes[at + 1] == ord(one)]
            last[hit], last[hit + 1] = False, True
        for two in ("re", "ve", "ll"):
            hit = at[(codes[at + 1] == ord(two[0])) & (codes[at + 2] == ord(two[1]))]
            last[hit], last[hit + 1], last[hit + 2] = False, False, True


class Transducer:
    """The table of next states and emitted counts, filled as texts ask for it.

    A table with more than ``limit`` cells is dropped before the next texts and made anew, which
    bounds memory and changes no count.
    """

    def __init__(self, path: str, limit: int = 1 << 25):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end, self.limit = model["end_of_word_suffix"], limit
        letters = _byte_letters()

        def token(name: str) -> str:
            final = name.endswith(self.end)
            inner = [letters[c] for c in name.removesuffix(self.end if final else "")]
            return "".join(map(chr, inner[:-1])) + chr(inner[-1] + 256 * final)

        self.ranks, self.tokens = {}, {chr(i) for i in range(512)}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = token(a), token(b)
            self.ranks.setdefault(pair, rank)
            self.tokens.add(pair[0] + pair[1])
        self.begins = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.columns = np.full(512, -1, np.int32)
        self.by_column: list[int] = [-1]
        self.states = [("", ((0, None, 0),))]
        self.place = {self.states[0]: 0}
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[:, 0] = np.arange(1024) << _SHIFT | _ZERO

    def merged(self, word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i)
                          for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stays_apart(self, a: str, b: str) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if (a, b) in self.ranks:
                return False
            if len(self.apart) > 400_000:
                self.apart.clear()
            known = self.apart[a, b] = self.merged(a + b) == [a, b]
        return known

    def read(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The state after ``symbol``, and the change of the token count."""
        suffix, starts = state
        seen = suffix + chr(symbol)
        for i, before, count in starts:
            token = seen[i:]
            if token in self.tokens and (before is None or self.stays_apart(before, token)):
                break
        change = count + 1
        if symbol >= 256:
            return self.states[0], change
        cut = 0
        while cut < len(seen) and seen[cut:] not in self.begins:
            cut += 1
        kept = [(i - cut, before, count - change) for i, before, count in starts
                if i >= cut and seen[i:] in self.begins]
        return (seen[cut:], (*kept, (len(seen) - cut, token, 0))), change

    def column(self, symbols: np.ndarray) -> np.ndarray:
        new = np.unique(symbols[self.columns[symbols] < 0]) if len(symbols) else symbols
        for s in new.tolist():
            self.columns[s] = len(self.by_column)
            self.by_column.append(s)
        if len(self.by_column) > self.table.shape[1]:
            wide = np.full((len(self.table), self.table.shape[1] * 2), -1, np.int32)
            while len(self.by_column) > wide.shape[1]:
                wide = np.full((len(self.table), wide.shape[1] * 2), -1, np.int32)
            wide[:, :self.table.shape[1]] = self.table
            self.table = wide
        return self.columns[symbols]

    def compile(self, wanted: np.ndarray) -> None:
        """Fill in transitions, given as state * columns + column."""
        for k in wanted.tolist():
            state, column = divmod(k, self.table.shape[1])
            to, change = self.read(self.states[state], self.by_column[column])
            number = self.place.get(to)
            if number is None:
                number = self.place[to] = len(self.states)
                self.states.append(to)
                if number >= len(self.table):
                    grown = np.full((len(self.table) * 2, self.table.shape[1]), -1, np.int32)
                    grown[:len(self.table)] = self.table
                    grown[:, 0] = np.arange(len(grown)) << _SHIFT | _ZERO
                    self.table = grown
            self.table[state, column] = number << _SHIFT | (change + _ZERO)

    def run(self, columns: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step every lane through its symbols [step, lane]: exit states and counts."""
        count = np.zeros(columns.shape[1], np.int64)
        for row in columns:
            where = state * self.table.shape[1] + row
            to = self.table.ravel()[where]
            if (to < 0).any():
                self.compile(np.unique(where[to < 0]))
                to = self.table.ravel()[where]
            count += (to & (1 << _SHIFT) - 1) - _ZERO
            state = to >> _SHIFT
        return state, count

    def count(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text, whose word bytes lie between the offsets ``at``."""
        if self.table.size > self.limit:
            self.clear()
        out = np.zeros(len(at) - 1, np.int64)
        start, end, text = lanes(at, LANE)
        if not len(text):
            return out
        columns = self.column(symbols)
        exits, counts = np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
        for lo in range(0, len(text), 8192):
            part = slice(lo, lo + 8192)
            exits[part], counts[part] = self.run(
                grid(columns, start[part], end[part], 0), exits[part])
        # The first word end of each lane; behind it the lane's map is constant.
        stops = np.append(np.flatnonzero(symbols >= 256), len(symbols))
        head = np.minimum(stops[np.searchsorted(stops, start)] + 1, end)
        resets = symbols[head - 1] >= 256
        entry = np.zeros(len(text), np.int32)
        inner = np.flatnonzero(text[1:] == text[:-1]) + 1
        while True:
            changed = inner[exits[inner - 1] != entry[inner]]
            if not len(changed):
                break
            new = exits[changed - 1]
            symbols_ = grid(columns, start[changed], head[changed], 0)
            old_exit, old = self.run(symbols_, entry[changed])
            new_exit, told = self.run(symbols_, new)
            counts[changed] += told - old
            exits[changed] = np.where(resets[changed], exits[changed], new_exit)
            entry[changed] = new
        np.add.at(out, text, counts)
        return out


_MADE: dict[str, tuple[Words, Transducer]] = {}


def transducer(path: str) -> tuple[Words, Transducer]:
    """Kept in the worker, so that states made for one task serve the next ones."""
    if path not in _MADE:
        _MADE[path] = Words(path), Transducer(path)
    return _MADE[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for every row.

    ``path`` is a tokenizer file with word-end BPE, present on every machine.  Null or empty
    text: no bytes, no tokens.  Equal rows stay equal rows; other columns are ignored.
    """
    slim = texts(docs, id_col, text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def count(batches):
        words, machine = transducer(path)
        for batch in pieces(batches, "text", 2 << 20):
            symbols, at, special = words.symbols(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"),
                 pa.array(machine.count(symbols, at) + special, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    return slim.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
