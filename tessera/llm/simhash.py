"""SimHash near duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 23, 23 and 18 bits (the last
is padded).  The binary Golay code of length 23 is perfect: each segment lies
within 3 bits of exactly one codeword.  Decoding a segment and its 23
neighbours gives one codeword, or six; two segments that differ in up to two
bits always have a codeword in common, for a vector halfway between them is a
neighbour of both.  Of four errors dealt over three segments, the two luckiest
segments hold two at most, so each linked pair shares a key made of two
codeword indices (24 bits) and the pair of segments.  Keys are shuffled, the
distances inside each key verified, and a spanning forest of the links goes on
to a distributed union-find: no link between different fingerprints is lost,
and no group is expanded into all its pairs.

Equal fingerprints are grouped before the search, so exact copies cost one row.
In a task, the fingerprints under one key are compared as a plain array of 8
bytes each; that is all that grows with a key's group.

Defined results: null and empty texts have fingerprint zero and link like any
other; a row with a null id has a fingerprint but no component; rows that share
an id are rows of their own, each with the component of its text; columns
beyond id and text are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow, parts
from .components import Forest, components
from .words import LOWER, SPACE, Text, text_of, words_of

SEED, SHINGLE, DISTANCE = 42, 4, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
BLOCK_BYTES = 1_000_000


def normal(t: Text) -> Text:
    """Lower-case A-Z and one space after each word, all texts end to end."""
    data = LOWER[t.data]
    gap = SPACE[data]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    inner = t.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    keep[inner] = ~gap[inner]  # no space at the front of a text
    if len(data):
        keep[0] = not gap[0]
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=run[1:])
    out = data[keep]
    out[SPACE[out]] = 0x20
    return Text(out, run[t.offsets])


def fingerprints(col: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of an array of texts."""
    t = normal(text_of(col))
    w = words_of(t)
    count = np.diff(w.first)
    n = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], n)
    last = np.minimum(at + shingle, np.repeat(w.first[1:], n)) - 1
    raw, h = t.data.tobytes(), xxhash.xxh64_intdigest
    starts, ends = w.start[at].tolist(), w.end[last].tolist()
    hashes = np.fromiter(map(h, map(raw.__getitem__, map(slice, starts, ends)), repeat(seed)), np.uint64, len(at))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(n)
    out = np.zeros(len(count), np.uint64)
    if len(full):
        ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for rows, col in parts(b, 1):
            size = np.frombuffer(col.buffers()[1], np.int64)[: len(col) + 1]
            edges = [0, *(np.flatnonzero(np.diff(size[:-1] // BLOCK_BYTES)) + 1).tolist(), len(col)]
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    out.append(batch({"doc_id": rows.column(0).slice(i, j - i), "fp": fingerprints(col.slice(i, j - i)).view(np.int64)}))
        return out

    return map_arrow(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


class Golay:
    """Fuzzy keys of 23-bit vectors: indices of the codewords near them."""

    GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def __init__(self):
        v = np.arange(1 << 12, dtype=np.int64)
        low = self._divide(v)
        high = self._divide(v[: 1 << 11] << 12)
        self.low, self.high = low, high
        errors = np.zeros(1 << 11, np.int64)
        one = 1 << np.arange(23, dtype=np.int64)
        two = np.bitwise_or.outer(one, one).ravel()
        three = np.bitwise_or.outer(two, one).ravel()
        for e in (three, two, one, np.zeros(1, np.int64)):
            errors[self._syndrome(e)] = e
        self.errors = errors

    def _divide(self, v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= np.where(v >> bit & 1, self.GENERATOR << (bit - 11), 0)
        return v

    def _syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.low[v & 0xFFF] ^ self.high[v >> 12]

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and its distance."""
        e = self.errors[self._syndrome(v)]
        return (v ^ e) >> 11, np.bitwise_count(e)

    def keys(self, v: np.ndarray) -> np.ndarray:
        """Six indices a vector, -1 where it has one only."""
        out = np.full((len(v), 6), -1, np.int64)
        out[:, 0], far = self.decode(v)
        far = np.flatnonzero(far == 3)
        # of the vector and its 23 neighbours, each of six codewords is nearest to four
        near = v[far, None] ^ np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
        out[far] = np.sort(self.decode(near)[0], axis=1)[:, ::4]
        return out


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each fuzzy key of the fingerprints (uint64)."""
    index = [golay.keys((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, keys = [], []
    for k, (a, b) in enumerate(PAIRS):
        x, y = index[a][:, :, None], index[b][:, None, :]
        key = (k << 24 | x << 12 | y).reshape(len(fp), -1)
        ok = ((x >= 0) & (y >= 0)).reshape(len(fp), -1)
        r, c = np.nonzero(ok)
        rows.append(r)
        keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _verify(key: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Links (pairs of rows) that connect what is within the distance under each key; keys come sorted."""
    n, short = len(key), 16
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    found = []
    small = np.repeat(size <= short, size)
    for s in range(1, min(short, int(size.max(initial=1)))):
        i = np.flatnonzero((key[s:] == key[:-s]) & small[s:])
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= distance]
        found.append(np.stack((i, i + s), 1))
    for a, k in zip(first[size > short], size[size > short]):
        own = fp[a : a + k]
        found.append(a + Forest(lambda i, rest, own=own: np.bitwise_count(own[rest] ^ own[i]) <= distance)(k))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints fps(fp) within the distance."""

    def spread(batches):
        golay = Golay()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 20_000):
                part = fp[i : i + 20_000]
                row, key = fuzzy_keys(part.view(np.uint64), golay)
                yield batch({"key": key, "fp": part[row]})

    def verify(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k, f):
            e = _verify(k, f.view(np.uint64), distance)
            a, b = f[e[:, 0]], f[e[:, 1]]
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            return batch({"a": pairs[:, 0], "b": pairs[:, 1]})

        for b in batches:
            key = np.concatenate((key, b.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, b.column(1).to_numpy(zero_copy_only=False)))
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if end:
                yield out(key[:end], fp[:end])
                key, fp = key[end:], fp[end:]
        if len(key):
            yield out(key, fp)

    keys = fps.select("fp").mapInArrow(spread, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    marks = cut(fingerprint(docs, id, text), "simhash")
    fps = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(links(fps.where("rep is not null"), distance), "simhash-links")
    of = cut(fps.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = of.join(least, "root").select("fp", "component_id")
    return (
        marks.join(label, "fp", "left")
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    )
