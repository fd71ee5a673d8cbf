"""Quality rules by suffix-array repetition.

A suffix array over the words of each text (prefix doubling that sorts only
the groups still tied, all texts of a block at once) and its LCP array give the
maximal repeated substrings: the LCP intervals of ``min_words`` or more.  The
union of their spans may cover so many percent of the words, and the longest
may have so many words.  Base rules on length and on repeated 8-word windows
come first.

Defined results: a null text counts as empty; a text without a word has zero
everywhere and fails the base rules; repeated rows are judged one by one;
columns other than those named pass through untouched, and a column of the
input with the name of a result is replaced.  Memory is bounded by a block of
``BLOCK_WORDS`` words or the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, parts
from .words import SPACE, code_points, codes, sums, take_spans, text_of, word_strings, words_of

#: Base rules.
BASE_WINDOW, BASE_MIN_WORDS, BASE_MAX_PERCENT = 8, 20, 30
#: The method: repeats of MIN_WORDS or more may cover so many percent of the words; the longest may have so many words.
MIN_WORDS, MAX_PERCENT, MAX_LONGEST = 5, 40, 100
BLOCK_WORDS = 200_000

RESULT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_covered_words", "long"), ("longest_repeat", "long"), ("base_failed", "boolean"), ("kept", "boolean")]
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def longest_repeats(code: np.ndarray, first: np.ndarray, least: int = 1) -> np.ndarray:
    """For each word: length of the longest prefix of its suffix that occurs elsewhere in the same text, 0 if under ``least``.

    code: word codes of all texts end to end; first: bounds of the texts.
    """
    n = len(code)
    longest = np.zeros(n, np.int32)
    if not n:
        return longest
    stop = np.repeat(first[1:], np.diff(first))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # rank: where in the order the group of suffixes with the same first h words begins
    key = text * (int(code.max()) + 1) + code
    tied, rank, levels, h = np.arange(n), np.zeros(n, np.int32), [], 1
    base = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        group = tied[order]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        if h == 1:
            rank[group] = begin
        else:  # places inside the former group
            old = base[group]
            lead = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), np.arange(len(s)), 0))
            rank[group] = old + begin - lead
        levels.append(rank.copy())
        alone = new & np.concatenate((new[1:], [True]))
        tied = group[~alone]
        if not len(tied):
            break
        base = rank.astype(np.int64)
        after = tied + h
        key = base[tied] * (n + 1) + np.where(after < stop[tied], base[np.minimum(after, n - 1)] + 1, 0)
        h *= 2
    array = np.empty(n, np.int64)  # the suffix array
    array[rank] = np.arange(n)
    # LCP of neighbours, from those that share their first words, by halving steps
    at = min(len(levels) - 1, max(0, int(np.log2(least))))
    near = np.flatnonzero(levels[at][array[1:]] == levels[at][array[:-1]])
    a, b = array[near], array[near + 1]
    lcp = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        same = (x < stop[a]) & (y < stop[b])
        same &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        lcp[same] += 1 << k
    lcp = np.where(lcp >= least, lcp, 0).astype(np.int32)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def _covered(longest: np.ndarray, least: int, first: np.ndarray) -> np.ndarray:
    """Words of each text inside the union of the repeats of ``least`` words or more."""
    n = len(longest)
    p = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, p, 1)
    np.add.at(edge, p + longest[p], -1)
    return sums(np.cumsum(edge[:n]) > 0, first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    n = len(offsets) - 1
    ends = np.flatnonzero(data == 10)
    # a line starts at each text and after each newline, and ends before a newline or the end of the text
    start = np.sort(np.concatenate((offsets[:-1], ends + 1)), kind="stable")
    owner = np.concatenate((np.arange(n), np.searchsorted(offsets, ends, side="right") - 1))
    order = np.argsort(np.concatenate((offsets[:-1], ends + 1)), kind="stable")
    owner = owner[order]
    # a newline that ends a text opens an empty line at the start of the next one: order by owner first
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    last = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.zeros(0, bool)
    stop = np.where(last, offsets[owner + 1], np.concatenate((start[1:] - 1, [0])))
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    full = np.flatnonzero(solid[stop] > solid[start])
    if not len(full):
        return np.zeros(n, np.int64)
    code, seen = codes(take_spans(data, start[full], stop[full]))
    key = owner[full] * len(seen) + code
    _, lead = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[lead] = False
    return np.bincount(owner[full][again], minlength=n)


def measure(col: pa.Array, min_words: int = MIN_WORDS, max_percent: int = MAX_PERCENT, max_longest: int = MAX_LONGEST) -> dict[str, np.ndarray]:
    """The columns of RESULT for an array of texts."""
    t = text_of(col)
    w = words_of(t)
    n_words = np.diff(w.first)
    points = code_points(t.data)
    chars = sums(points[w.end] - points[w.start], w.first)
    symbols = sums(SYMBOL[t.data], t.offsets)
    code, _ = codes(word_strings(t, w))
    least = min(min_words, BASE_WINDOW)
    longest = longest_repeats(code, w.first, least)
    repeat = _covered(longest, BASE_WINDOW, w.first)
    covered = _covered(longest, min_words, w.first)
    most = np.zeros(len(n_words), np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(n_words)), n_words), np.where(longest >= min_words, longest, 0))
    base = (n_words < BASE_MIN_WORDS) | (100 * repeat > BASE_MAX_PERCENT * n_words)
    kept = ~base & (100 * covered <= max_percent * n_words) & (most <= max_longest)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": _dup_lines(t.data, t.offsets), "n_repeat_words": repeat, "n_covered_words": covered, "longest_repeat": most, "base_failed": base, "kept": kept}


def _blocks(col: pa.Array) -> list[tuple[int, int]]:
    """Rows of the array in blocks of about BLOCK_WORDS words (7 bytes each)."""
    size = np.cumsum(np.diff(np.frombuffer(col.buffers()[1], np.int64)[: len(col) + 1])) // (7 * BLOCK_WORDS)
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(col)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def quality(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_percent: int = MAX_PERCENT, max_longest: int = MAX_LONGEST, keep: list[str] | None = None) -> DataFrame:
    """docs with the columns of RESULT.  keep: the columns of docs to return (all if None)."""
    named = [x for x, _ in RESULT]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in named]
    src = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(c, T.LongType() if k == "long" else T.BooleanType()) for c, k in RESULT])

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for some, col in parts(b, text):
            for i, j in _blocks(col):
                got = measure(col.slice(i, j - i), min_words, max_percent, max_longest)
                rows = some.slice(i, j - i)
                out.append(pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(got[c]) for c in named], names=keep + named))
        return out

    return map_arrow(src, run, schema)
