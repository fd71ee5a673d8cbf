"""Alignment of the tokens of two tokenizers, and how often their ids are linked.

All documents of an Arrow batch are put end to end as bytes.  The ends of all A
tokens and of all B tokens are counted once over these bytes (bincount); where
both occur, documents are cut into groups, and running sums of the marks, read at
the documents' bounds, give each document's results.  Every byte position where a
token of A or B ends closes one stretch that lies in one token of each, so these
stretches are the links, once each, with nothing to compare.

Links become counts in three steps: each batch adds up its id pairs, a shuffle
adds up the batches, and each document looks its pairs up.  The most frequent
pairs, ``HOT`` at most, are held by every task; the others are joined by pair.
What grows with the corpus is shuffled, never broadcast: sent whole are the hot
pairs and the highest count of each B id, both bounded by parameters or by the
vocabulary.

Defined results: a text that is null, empty, or not given back byte for byte by
either tokenizer has no tokens, zeros and an empty groups_sha256; rows that
repeat an id or a text count each; null ids stay; an empty table gives no row;
columns beyond id and text are not read.  Memory is bounded by a block of
``BLOCK`` bytes of text or the longest single text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, drop, flat_string, trim
from .tokens import ASCII_SPACE, Encoder, chunks_of, text_blocks
from .words import Text, codes, strings, take_spans, text_of

#: Pairs that every task holds, chunks that a worker remembers, bytes of text aligned at once.
HOT, MEMORY, BLOCK = 200_000, 60_000, 1_500_000
RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
PLACED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>, total boolean"
SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<int>, times array<int>"
COMMA, BAR, SEMICOLON = b",|;"


class Vocabulary:
    """The bytes of each token, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return spans(self.data, self.start[ids], self.size[ids])


def spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start:start + size] of all spans, end to end."""
    at = np.repeat((start - (np.cumsum(size) - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return data[at]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bytewise(Encoder):
    """Tokenizer A: byte-level BPE; special tokens in a text are ordinary text."""

    def __init__(self, path: str, memory: int):
        super().__init__(path, memory)
        self.tokenizer.encode_special_tokens = True
        table, vocab = byte_level(), self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(map(table.__getitem__, t)) if all(c in table for c in t) else t.encode()
        self.vocabulary = Vocabulary(tokens)


class Pieces:
    """Tokenizer B: sentencepiece with byte fallback, of texts that start with the space which it adds itself.

    No piece runs on over a space after other characters, nor over those controls
    that no piece holds, so ids of chunks, each remembered, are those of the text.
    Texts with other white space controls are encoded whole.
    """

    def __init__(self, path: str, memory: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        held = {c for p in pieces if len(p) > 1 for c in p[1:] if c in ASCII_SPACE and c != " "}
        if any(re.search("[^▁]▁", p) for p in pieces):
            held.add(" ")
        self.whole = "[" + "".join(f"\\x{ord(c):02x}" for c in sorted(held)) + "]" if held else None
        self.space = self.model.piece_to_id("▁")
        self.memory, self.young, self.old = memory, {}, {}
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; the space that the model puts first is the chunk's own or goes again."""
        own = [c[:1] == " " for c in chunks]
        found = self.model.encode([c[1:] if o else c for c, o in zip(chunks, own)], num_threads=1)
        for k, (c, o) in enumerate(zip(chunks, own)):
            if c == " ":
                found[k] = [self.space]
            elif not o:
                assert found[k][:1] == [self.space], c[:20]
                found[k] = found[k][1:]
        return [array("I", ids).tobytes() for ids in found]

    def _known(self, chunks: list[str]) -> list[bytes]:
        out = [self.young.get(c) or self.old.get(c) for c in chunks]
        new = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(new), 5000):
            part = new[k : k + 5000]
            for i, ids in zip(part, self._encode([chunks[i] for i in part])):
                out[i] = ids
        for c, x in zip(chunks, out):
            self.young[c] = x
        if len(self.young) > self.memory:
            self.old, self.young = self.young, {}
        return out

    def __call__(self, t: Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and the number of ids of each text."""
        start, first = chunks_of(t)
        if self.whole:
            import pyarrow.compute as pc

            odd = pc.match_substring_regex(strings(t.data, t.offsets), self.whole).to_numpy(zero_copy_only=False)
            lead = np.zeros(len(start), bool)
            lead[first[:-1][np.diff(first) > 0]] = True
            start = start[~odd[np.repeat(np.arange(len(odd)), np.diff(first))] | lead]
            first = np.searchsorted(start, t.offsets)
        code, chunks = codes(strings(t.data, np.append(start, len(t.data))))
        known = self._known(chunks.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        run = np.concatenate(([0], np.cumsum(size[code])))
        return spans(flat, (np.cumsum(size) - size)[code], size[code]), run[first[1:]] - run[first[:-1]]


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str, memory: int) -> tuple[Bytewise, Pieces]:
    return Bytewise(a, memory), Pieces(b, memory)


def spaced(col: pa.Array) -> Text:
    """Each text with a space before it."""
    t = text_of(col)
    n = len(col)
    data = np.full(len(t.data) + n, 0x20, np.uint8)
    own = np.ones(len(data), bool)
    own[t.offsets[:-1] + np.arange(n)] = False
    data[own] = t.data
    return Text(data, t.offsets + np.arange(n + 1))


def whole(t: Text, ids: np.ndarray, n: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Which texts their tokens give back byte for byte."""
    run = np.concatenate(([0], np.cumsum(v.size[ids])))
    ends = np.concatenate(([0], np.cumsum(n)))
    good = run[ends[1:]] - run[ends[:-1]] == np.diff(t.offsets)
    if good.all():
        differ = np.concatenate(([0], np.cumsum(v.joined(ids) != t.data)))
        return differ[t.offsets[1:]] == differ[t.offsets[:-1]]
    keep = np.repeat(good, n)
    byte = np.repeat(good, np.diff(t.offsets))
    differ = np.zeros(len(t.data) + 1, np.int64)
    differ[1:][byte] = v.joined(ids[keep]) != t.data[byte]
    differ = np.cumsum(differ)
    return good & (differ[t.offsets[1:]] == differ[t.offsets[:-1]])


def decimals(size: int) -> Vocabulary:
    """The decimal digits of each id and one byte after them."""
    return Vocabulary([b"%d," % i for i in range(size)])


def align(t: Text, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, va: Vocabulary, vb: Vocabulary, digits: Vocabulary) -> dict:
    """Results of texts that their A ids and B ids give back: counts, digests, and the links as (doc, a id, b id)."""
    total = len(t.data)
    end_a, end_b = np.cumsum(va.size[a]), np.cumsum(vb.size[b])
    mark_a, mark_b = np.bincount(end_a, minlength=total + 1)[: total + 1], np.bincount(end_b, minlength=total + 1)[: total + 1]
    run = np.cumsum((mark_a > 0) & (mark_b > 0), dtype=np.int32)  # groups that have ended up to a byte
    n_groups = run[t.offsets[1:]] - run[t.offsets[:-1]]
    at = np.flatnonzero(mark_a | mark_b)  # where a stretch ends
    before_a, before_b = np.cumsum(mark_a, dtype=np.int32)[at - 1], np.cumsum(mark_b, dtype=np.int32)[at - 1]
    link_a, link_b, doc = a[before_a], b[before_b], np.searchsorted(t.offsets, at, "left") - 1

    # each group's A ids, then its B ids, with the byte that follows each id
    group_a, group_b = run[end_a - 1], run[end_b - 1]
    per_a, per_b = np.bincount(group_a, minlength=run[-1]), np.bincount(group_b, minlength=run[-1])
    place = np.concatenate((np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a], np.arange(len(b)) + np.cumsum(per_a)[group_b]))
    ids = np.empty(len(place), np.int64)
    ids[place] = np.concatenate((a, b))
    stop = np.full(len(place), COMMA, np.uint8)
    last_a, last_b = run[end_a] > group_a, run[end_b] > group_b
    stop[place[: len(a)][last_a]] = BAR
    stop[place[len(a) :][last_b]] = SEMICOLON
    said = digits.joined(ids)
    ends = np.cumsum(digits.size[ids])
    said[ends - 1] = stop
    bounds = np.concatenate(([0], ends[np.cumsum(na + nb) - 1]))
    view = memoryview(said)
    sha = [hashlib.sha256(view[i : j - 1]).hexdigest() for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
    return {"n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(na)), "sha": sha, "doc": doc, "pair": link_a.astype(np.int64) * len(vb.size) + link_b}


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def place(docs: DataFrame, a: str, b: str, memory: int = MEMORY, block: int = BLOCK) -> DataFrame:
    """A row for each document, with its id pairs and how often it links each, and rows (total) with the same of whole blocks."""

    def run(batches):
        ta, tb = tokenizers(a, b, memory)
        if len(ta.vocabulary.size) * len(tb.vocabulary.size) >= 1 << 31:
            raise ValueError("id pairs of these vocabularies do not fit in 32 bits")
        digits = decimals(max(len(ta.vocabulary.size), len(tb.vocabulary.size)))
        for rows in batches:
            for some, col in text_blocks(rows, 2, block):
                n = len(col)
                t = spaced(col)
                ids_a, na = ta(strings(t.data, t.offsets))
                ids_b, nb = tb(t)
                good = (np.diff(t.offsets) > 1) & whole(t, ids_a, na, ta.vocabulary) & whole(t, ids_b, nb, tb.vocabulary)
                if not good.all():
                    ids_a, ids_b = ids_a[np.repeat(good, na)], ids_b[np.repeat(good, nb)]
                    size = np.diff(t.offsets)
                    t = Text(t.data[np.repeat(good, size)], np.concatenate(([0], np.cumsum(size[good]))))
                    na, nb = na * good, nb * good
                out = {k: np.zeros(n, np.int64) for k in ("n_groups", "n_links")}
                sha = np.full(n, "", object)
                pairs, times, bounds, every, sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if good.any():
                    found = align(t, ids_a, ids_b, na[good], nb[good], ta.vocabulary, tb.vocabulary, digits)
                    for k in out:
                        out[k][good] = found[k]
                    sha[good] = found["sha"]
                    key, times = np.unique(found["doc"] << 31 | found["pair"], return_counts=True)
                    pairs = key & (1 << 31) - 1
                    real = np.flatnonzero(good)
                    bounds = np.searchsorted(real[key >> 31], np.arange(n + 1))
                    every, where = np.unique(pairs, return_inverse=True)
                    sums = np.bincount(where, times, len(every)).astype(np.int64)
                nothing = pa.nulls(1, pa.int64())
                yield batch({"row": pa.concat_arrays([some.column(0), nothing]), "doc_id": pa.concat_arrays([some.column(1), nothing]), "n_a": np.append(na, 0), "n_b": np.append(nb, 0), "n_groups": np.append(out["n_groups"], 0), "n_links": np.append(out["n_links"], 0), "groups_sha256": [*sha.tolist(), ""], "pairs": lists(np.concatenate((pairs, every)), np.append(bounds, len(pairs) + len(every))), "times": lists(np.concatenate((times, sums)), np.append(bounds, len(pairs) + len(every))), "total": [False] * n + [True]})
                t = ids_a = ids_b = found = key = pairs = times = every = where = None  # before the next block
            trim()

    return docs.mapInArrow(run, PLACED)


def pair_counts(placed: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) of all id pairs of the corpus; best: no pair of the same B id (pair modulo width) has a higher count."""
    each = placed.where("total").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = cut(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.times").cast("long")).alias("count")), "pair-counts")
    b = F.col("pair") % width
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row for each B id: bounded by its vocabulary
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def threshold(counts: DataFrame, room: int) -> int:
    """The least count so that at most ``room`` pairs have it or more, by powers of 2 ** 1/8."""
    level = F.ceil(8 * F.log2("count")).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least"))  # some hundreds
    least = 1 << 62
    for r in sorted(levels.collect(), reverse=True):
        room -= r.n
        if room < 0:
            break
        least = r.least
    return least


def score(placed: DataFrame, hot: DataFrame) -> DataFrame:
    """Documents with what the hot pairs give them, and the pairs that are left."""
    table = hot.orderBy("pair").toArrow()
    pair, count, best = (table.column(c).to_numpy() for c in ("pair", "count", "best"))
    sent = placed.sparkSession.sparkContext.broadcast((pair, count, best.astype(np.int64)))

    def run(batches):
        pair, count, best = sent.value
        for b in batches:
            doc = np.repeat(np.arange(b.num_rows), np.diff(b.column("pairs").offsets.to_numpy()))
            key, times = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            known = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            out = {c: b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            d, k, at = doc[known], times[known], at[known]
            for name, value in (("n_best", best), ("count_sum", count)):
                run = np.concatenate(([0], np.cumsum(k * value[at]) if len(pair) else np.zeros(0, np.int64)))
                bounds = np.searchsorted(d, np.arange(b.num_rows + 1))
                out[name] = run[bounds[1:]] - run[bounds[:-1]]
            bounds = np.searchsorted(doc[~known], np.arange(b.num_rows + 1))
            yield batch(out | {"pairs": lists(key[~known], bounds), "times": lists(times[~known], bounds)})
        trim()

    return placed.where("NOT total").drop("total").mapInArrow(run, SCORED)


def cross_align(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text", hot: int = HOT, memory: int = MEMORY, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: a byte-level BPE file of the tokenizers library; b: a sentencepiece model.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b).vocab_size()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = cut(place(rows, a, b, memory, block), "placed")
    counts = cut(pair_counts(placed, width), "pairs")
    least = threshold(counts, hot)
    scored = cut(score(placed, counts.where(F.col("count") >= least)), "scored")
    drop(placed)
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts.where(F.col("count") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_count"))
    out = scored.drop("pairs", "times").join(rest, "row", "left")
    more = {"n_best": "more_best", "count_sum": "more_count"}
    return out.select("doc_id", *(F.col(c) + F.coalesce(F.col(more[c]), F.lit(0)) if c in more else F.col(c) for c in RESULT), "groups_sha256").toDF("doc_id", *RESULT, "groups_sha256")
