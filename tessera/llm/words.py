"""Vectorised word splitting over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of these
are ASCII, so bytes and code points give the same runs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import flat_string

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Text(NamedTuple):
    data: np.ndarray  # uint8, all texts end to end
    offsets: np.ndarray  # int64, one more than texts


class Words(NamedTuple):
    start: np.ndarray  # in data, of each word
    end: np.ndarray
    first: np.ndarray  # number of the first word of each text, and one past the last


def text_of(col: pa.Array) -> Text:
    a = flat_string(col)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[: len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return Text(data, offsets)


def words_of(t: Text) -> Words:
    n = len(t.data)
    solid = ~SPACE[t.data]
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = t.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = solid[inner]  # a text that starts with a word, whatever ends the one before
        ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, t.offsets))


def take_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as a string array (one copy, no Python objects)."""
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    out = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])] if len(start) else np.zeros(0, np.uint8)
    return strings(out, offsets)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over the buffer, without a copy."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def word_strings(t: Text, w: Words) -> pa.Array:
    """All words as a string array: the text without its white space."""
    return strings(t.data[~SPACE[t.data]], np.concatenate(([0], np.cumsum(w.end - w.start))))


def codes(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense integer codes of the strings, and the string of each code."""
    d = strings.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (one more than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]
