"""Stepping a deterministic automaton through many pieces of bytes at once, with numpy."""

from __future__ import annotations

import numpy as np


def lanes(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut the texts between the offsets ``at`` into lanes of at most ``length`` symbols.

    Returns each lane's start, its end and its text; a text without symbols has no lane.
    """
    size = np.diff(at)
    n = -(-size // length)
    text = np.repeat(np.arange(len(size)), n)
    first = np.cumsum(n) - n
    start = at[:-1][text] + (np.arange(len(text)) - first[text]) * length
    return start, np.minimum(start + length, at[1:][text]), text


def grid(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    """Symbols by step and lane, so that a step reads one row; short lanes are padded."""
    width = int((end - start).max(initial=0))
    where = start + np.arange(width)[:, None]
    out = symbols[np.minimum(where, len(symbols) - 1)]
    out[where >= end] = pad
    return out
