"""Token ids of whole texts with the tokenizers library, one call per distinct chunk.

A chunk is a run of ASCII white space and the word after it.  Both kinds of
tokenizer used here split at such places before they merge bytes, so the ids
of a text are the ids of its chunks end to end.  Each record batch is cut into
distinct chunks; ids are remembered in two generations of bounded size, and
only new chunks go to the tokenizer.  Texts with other white space characters,
where that does not hold, are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import parts
from .words import SPACE, Text, codes, strings, text_of

#: White space beyond ASCII, and controls that some tables count as such (fixed values).
OTHER_SPACE = "[\x00\x1c-\x1f\u0085  ᠎ -‏ -  ⁠　﻿]"
ASCII_SPACE = " \t\n\x0b\x0c\r"
MEMORY = 250_000
PART_ROWS = 3_072
BLOCK_BYTES = 12_000_000


class Encoder:
    """Ids of arrays of texts; one per task."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = re.compile(OTHER_SPACE)
        self.memory, self.young, self.old = memory, {}, {}
        vocab = self.tokenizer.get_vocab()
        self.bare = any(x.endswith("</w>") for x in vocab)  # white space is dropped, words are normalised
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # of each token; a byte is one character there
        for x, i in vocab.items():
            self.bytes[i] = len(x.removesuffix("</w>"))

    def _call(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 5000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 5000], add_special_tokens=False)]
        return out

    def _width(self, chunk: str) -> int:
        """Bytes that the tokens of a chunk stand for."""
        if not self.bare:
            return len(chunk.encode())
        word = chunk.lstrip(ASCII_SPACE)
        return len(word) if word.isascii() else len(unicodedata.normalize("NFC", word).lower().encode())

    def _joined(self, texts: list[str]) -> list[bytes]:
        """As _call, for chunks that start with white space: many in one call, told apart by the bytes of their tokens."""
        groups = [texts[i : i + 250] for i in range(0, len(texts), 250)]
        out = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            done = np.cumsum(self.bytes[ids])
            ends = np.cumsum([self._width(c) for c in group])
            at = np.searchsorted(done, ends)
            if len(done) and done[-1] == ends[-1] and (done[np.minimum(at, len(done) - 1)] == ends).all():
                raw, at = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
                out += [raw[i:j] for i, j in zip(at, at[1:])]
            else:
                out += self._call(group)
        return out

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as 32-bit integers."""
        young, old = self.young, self.old
        out = [young.get(c) for c in chunks]
        new, alone = [], []
        for i, x in enumerate(out):
            if x is None:
                x = old.get(chunks[i])
                if x is None:
                    c = chunks[i]
                    (new if c[:1] in ASCII_SPACE and len(c) > 1 and "<|" not in c and not self.odd.search(c) and c[-1] not in ASCII_SPACE else alone).append(i)
                else:
                    young[chunks[i]] = out[i] = x
        for i, ids in zip(new + alone, self._joined([chunks[i] for i in new]) + self._call([chunks[i] for i in alone])):
            young[chunks[i]] = out[i] = ids
        if len(young) > self.memory:
            self.old, self.young = young, {}
        return out

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and the number of ids of each text."""
        t = text_of(col)
        odd = pc.match_substring_regex(strings(t.data, t.offsets), OTHER_SPACE).to_numpy(zero_copy_only=False)
        start, first = chunks_of(t)
        whole = np.flatnonzero(odd)
        if len(whole):  # one chunk for each of them
            text = np.repeat(np.arange(len(odd)), np.diff(first))
            lead = np.zeros(len(start), bool)
            lead[first[:-1][np.diff(first) > 0]] = True
            start = start[~odd[text] | lead]
            first = np.searchsorted(start, t.offsets)
        code, chunks = codes(strings(t.data, np.append(start, len(t.data))))
        known = self._known(chunks.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        narrow = np.int32 if len(t.data) < 1 << 28 else np.int64  # a byte is a few tokens at most
        flat = np.frombuffer(b"".join(known), np.uint32)
        lead = np.cumsum(size) - size
        n = size[code]
        run = np.concatenate(([0], np.cumsum(n)))
        if len(code):
            at = np.repeat((lead[code] - run[:-1]).astype(narrow), n)
            at += np.arange(run[-1], dtype=narrow)
            ids = flat[at]
        else:
            ids = flat
        return ids, run[first[1:]] - run[first[:-1]]


@lru_cache(maxsize=2)
def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """The encoder of this Python worker; tasks that follow each other share what it remembers."""
    return Encoder(path, memory)


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """ids with end_id after each text."""
    out = np.empty(len(ids) + len(ends), ids.dtype)
    real = np.ones(len(out), bool)
    last = ends + np.arange(len(ends))
    real[last] = False
    out[real] = ids
    out[last] = end_id
    return out


def chunks_of(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start, and the bounds of each text among them.  White space at the end of a text is a chunk."""
    gap = SPACE[t.data]
    begin = gap.copy()
    begin[1:] &= ~gap[:-1]
    lead = t.offsets[:-1][np.diff(t.offsets) > 0]
    begin[lead] = True
    start = np.flatnonzero(begin)
    return start, np.searchsorted(start, t.offsets)


def text_blocks(rows: pa.RecordBatch, text: int = 1, size: int = BLOCK_BYTES):
    """(rows, texts) of a batch in blocks of bounded size."""
    for some, col in parts(rows, text, PART_ROWS):
        for i, j in blocks(col, size):
            yield some.slice(i, j - i), col.slice(i, j - i)


def blocks(col: pa.Array, size: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Rows of a large string array in blocks of about so many bytes."""
    at = np.frombuffer(col.buffers()[1], np.int64)[: len(col) + 1]
    edges = [0, *(np.flatnonzero(np.diff(at[:-1] // size)) + 1).tolist(), len(col)]
    return [(i, j) for i, j in zip(edges, edges[1:]) if j > i]
