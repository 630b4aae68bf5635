"""Packing of examples into sequences of fixed length, as vector bin packing.

An example is its token ids and an end id.  A sequence has three limits at once: tokens, segments
(pieces of examples) and loss-bearing tokens.  The next piece of an open sequence is the example
in the pool whose demand, as a share of each limit, has the greatest dot product with what the
sequence has left; where none fits, the longest one is cut to fill it.  Parts of an example that
fill a sequence alone leave the pool at once.  A sequence that ends short (because its segments
or loss tokens are used up, or at the end of the input) is cut into sequences whose lengths are
powers of two, so that nothing is padded.

Packing runs inside the tasks that read the table, over a pool of bounded size; nothing is
shuffled.  A retried task packs the same rows in the same way.  Sequence ids are unique: the
task's partition in the upper bits, a counter in the lower ones.

Ids come from a cache of words: the tokenizer's normalised words are found with numpy, looked up
by two 64-bit hashes, and only words not yet met are merged by the tokenizer's own model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held, pieces
from .tokencount import Words, _byte_letters

MAX_WORDS = 2_000_000
#: Bytes of texts that are encoded at once; what a task holds beside its pool grows with them.
PIECE = 1 << 19
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Encoder:
    """Token ids of many texts at once."""

    def __init__(self, path: str):
        self.words = Words(path)
        self.letters = str.maketrans({b: c for c, b in _byte_letters().items()})
        self.size = 0
        self.clear()

    def clear(self) -> None:
        bits = MAX_WORDS.bit_length()
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros((2, 1 << 14), np.uint64)
        self.at = np.zeros((1 << 14) + 1, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.n = 0

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) > self.size:
            self.size = 1 << max(18, (len(data) - 1).bit_length())
            self.powers = [_powers(f, self.size) for f in _FACTORS]
            self.inverse = [_powers(np.uint64(pow(int(f), -1, 1 << 64)), self.size)
                            for f in _FACTORS]
        out = np.empty((2, len(start)), np.uint64)
        for k in range(2):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data + np.uint64(1)) * self.powers[k][:len(data)], out=total[1:])
            h = (total[end] - total[start]) * self.inverse[k][start]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[k] = h ^ (h >> np.uint64(32))
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others."""
        found = np.full(hashes.shape[1], -1, np.int32)
        left = np.arange(hashes.shape[1])
        slot = (hashes[0] >> self.shift).astype(np.int64)
        while len(left):
            at = self.slots[slot]
            hit = (at >= 0) & (self.keys[0][at] == hashes[0][left]) \
                & (self.keys[1][at] == hashes[1][left])
            found[left[hit]] = at[hit]
            go = (at >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) % len(self.slots)
        return found

    def _add(self, word: bytes, key: np.ndarray) -> None:
        ids = [t.id for t in self.words.tokenizer.model.tokenize(
            word.decode("latin-1").translate(self.letters))]
        if self.n >= self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], 1)
            self.at = np.concatenate([self.at, np.zeros(len(self.at) - 1, np.int64)])
        end = self.at[self.n] + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.at[self.n]:end] = ids
        self.keys[:, self.n] = key
        self.at[self.n + 1] = end
        slot = int(key[0] >> self.shift)
        while self.slots[slot] >= 0:
            slot = (slot + 1) % len(self.slots)
        self.slots[slot] = self.n
        self.n += 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets."""
        if self.n > MAX_WORDS // 2:
            self.clear()
        symbols, at, special = self.words.symbols(texts)
        data = (symbols & 255).astype(np.uint8)
        end = np.flatnonzero(symbols >= 256) + 1
        start = np.concatenate([[0], end])[:-1].astype(np.int64)
        hashes = self._hashes(data, start, end)
        number = self._find(hashes)
        while (missing := np.flatnonzero(number < 0)).size:
            _, first = np.unique(hashes[0][missing], return_index=True)
            raw = data.tobytes()
            for i in missing[first].tolist():
                self._add(raw[start[i]:end[i]], hashes[:, i])
            number[missing] = self._find(hashes[:, missing])
        size = self.at[number + 1] - self.at[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[number] - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(end, at, side="right")]
        bounds[0] = 0
        if special.any():
            # Strings of special tokens stand among the words: rare, left to the library.
            parts = [ids[bounds[i]:bounds[i + 1]] if not special[i] else np.array(
                self.words.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
                for i in range(len(texts))]
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


class Packer:
    """Sequences from a stream of examples; gives rows of pieces as they are placed."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = 1024):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.pool = max_tokens, pool
        self.examples: list[tuple] = []
        self.left = np.zeros(0, np.int64)
        self.loss = np.zeros(0, np.int64)
        self.used, self.done = 0, []
        self.sequences = 0

    @staticmethod
    def loss_tokens(start: int, length: int, prompt: int) -> int:
        """Tokens of a piece that bear loss: past the prompt, and not its first one, which has
        no token before it to be predicted from."""
        return max(0, start + length - max(start + 1, prompt))

    def add(self, key, ids: np.ndarray, prompt: int) -> None:
        start = 0
        while len(ids) - start >= self.max_tokens and self.loss_tokens(
                start, self.max_tokens, prompt) <= self.limits[2]:
            self._close([(key, ids, start, self.max_tokens, prompt)])
            start += self.max_tokens
        if start == len(ids):
            return
        if self.used == len(self.left):
            grown = max(64, 2 * self.used)
            self.left, self.loss = (np.concatenate([x, np.zeros(grown - self.used, np.int64)])
                                    for x in (self.left, self.loss))
        self._put(self.used, key, ids, start, prompt)
        self.used += 1
        if self.used >= self.pool:
            while self.used > self.pool // 2:
                self._fill()

    def _put(self, i: int, key, ids, start: int, prompt: int) -> None:
        row = (key, ids, start, prompt)
        if i == len(self.examples):
            self.examples.append(row)
        else:
            self.examples[i] = row
        self.left[i] = len(ids) - start
        self.loss[i] = self.loss_tokens(start, len(ids) - start, prompt)

    def _take(self, i: int, length: int) -> tuple:
        """Take ``length`` tokens of example i; it leaves the pool when it is used up."""
        key, ids, start, prompt = self.examples[i]
        if start + length < len(ids):
            self._put(i, key, ids, start + length, prompt)
        else:
            self.used -= 1
            last = self.examples.pop()
            if i < self.used:
                self.examples[i] = last
                self.left[i], self.loss[i] = self.left[self.used], self.loss[self.used]
        return key, ids, start, length, prompt

    def _fill(self) -> None:
        """Make one sequence from the pool."""
        rest, placed = self.limits.copy(), []
        while self.used and rest[0] >= 1 and rest[1] >= 1:
            left, loss = self.left[:self.used], self.loss[:self.used]
            gain = (left * (rest[0] / self.limits[0] ** 2) + rest[1] / self.limits[1] ** 2
                    + loss * (rest[2] / self.limits[2] ** 2))
            gain[(left > rest[0]) | (loss > rest[2])] = -1
            i = int(gain.argmax())
            if gain[i] >= 0:
                length = int(left[i])
            else:
                i = int(left.argmax())
                _, _, start, prompt = self.examples[i]
                # So many tokens that neither limit is passed.
                free = max(0, prompt - start - 1) if prompt > start else 0
                length = int(min(rest[0], left[i], rest[2] + max(1, free + 1)))
                while length and self.loss_tokens(start, length, prompt) > rest[2]:
                    length -= 1
                if not length:
                    break
            piece = self._take(i, length)
            placed.append(piece)
            rest -= (length, 1, self.loss_tokens(piece[2], length, piece[4]))
        self._close(placed)

    def _close(self, placed: list[tuple]) -> None:
        """Number the pieces of a sequence, or of several where it is short."""
        total = sum(p[3] for p in placed)
        room = total if total == self.max_tokens else 1 << total.bit_length() - 1
        offset = 0
        for key, ids, start, length, prompt in placed:
            while length:
                n = min(length, room - offset)
                self.done.append((key, start, n, ids[start:start + n], len(ids),
                                  self.sequences, offset, self.loss_tokens(start, n, prompt)))
                start, length, offset = start + n, length - n, offset + n
                if offset == room:
                    total -= room
                    self.sequences, offset = self.sequences + 1, 0
                    room = 1 << total.bit_length() - 1 if total else 0

    def flush(self) -> None:
        while self.used:
            self._fill()

    def rows(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, path: str, max_tokens: int = 4096, max_segments: int = 64,
         max_loss: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
         prompt_col: str | None = None) -> DataFrame:
    """The pieces of all examples: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset and loss_tokens.

    ``prompt_col`` (long) says how many of an example's leading ids bear no loss; without it all
    may.  Null or empty text: the end id alone.  Equal rows are packed each.  An empty table
    gives no piece.  Other columns are ignored.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0)
    slim = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       prompt.cast("long").alias("prompt"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 40
        key_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            key, start, length, ids, n, sequence, offset, loss = zip(*rows)
            return pa.RecordBatch.from_arrays([
                pa.array(key, key_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n, pa.int64()),
                pa.array([base + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
                pa.array(loss, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset",
                 "loss_tokens"])

        for batch in pieces(batches, "text", PIECE):
            key_type = batch.column("doc_id").type
            ids, at = encode(batch.column("text").to_pylist())
            # Each example owns its ids, so that the batch can go while some are in the pool.
            for i, (key, p) in enumerate(zip(batch.column("doc_id").to_pylist(),
                                             batch.column("prompt").to_pylist())):
                packer.add(key, np.append(ids[at[i]:at[i + 1]], end_id).astype("<u4"), p)
            if packer.done:
                yield out(packer.rows())
        packer.flush()
        if packer.done:
            yield out(packer.rows())
        give_back()

    return slim.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, "
                           "doc_tokens long, sequence_id long, offset long, loss_tokens long")
