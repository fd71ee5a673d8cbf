"""Packing by cutting-stock column generation.

Every document becomes full sequences and one remainder.  The histogram of
piece lengths (in classes of ``GRAIN`` tokens, rounded up: a few hundred counts)
goes to the driver, where a linear program over cutting patterns is solved by
column generation: a knapsack dynamic program over the dual prices finds the
next pattern, a revised simplex takes it in.  Pattern counts are rounded down;
the few pieces left are packed first-fit decreasing.  Pieces are then ranked
inside their class, in salted buckets, and a rank gives the pattern, sequence
and slot by arithmetic; offsets are a running sum inside a sequence.

Defined results: a null or empty text is the end id alone; rows that share an
id are packed as documents of their own; an empty table gives no rows; columns
beyond id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow, trim
from .tokens import BLOCK_BYTES, MEMORY, encoder, text_blocks, with_ends

SIZE, GRAIN, END_ID = 2048, 8, 1
BUCKET_ROWS, MIN_BUCKETS, ROUNDS = 20_000, 16, 4000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SIZE, id: str = "doc_id", text: str = "text", memory: int = MEMORY, block: int = BLOCK_BYTES) -> DataFrame:
    """Tokenize docs, cut them at multiples of size, and return a row a piece."""

    def run(batches):
        for b in batches:
            encode = encoder(tokenizer, memory)
            for rows, col in text_blocks(b, 1, block):
                ids, n = encode(col)
                ids = with_ends(ids, np.cumsum(n), end_id).astype("<u4", copy=False)
                n = n + 1
                count = -(-n // size)
                row = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(size, n[row] - start)
                at = ((np.cumsum(n) - n)[row] + start).tolist()
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at, length.tolist())]
                yield batch({"doc_id": rows.column(0).take(pa.array(row)), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "doc_tokens": n[row]})
            b = rows = col = ids = raw = None  # before the next batch comes
            trim()

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def _price(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern: unbounded knapsack by dynamic programming."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c], pick[c] = best[c - 1], -2
        k = upto[c]
        if k:
            got = value[:k] + best[c - sizes[:k]]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0 and pick[c] != -1:
        if pick[c] == -2:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), pattern


def _fill(left: np.ndarray, sizes: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for the counts left: each takes the largest sizes that fit, as often as it can."""
    out, left = [], left.copy()
    while left.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        for i in range(len(sizes) - 1, -1, -1):
            k = min(int(left[i] - pattern[i]), free // int(sizes[i]))
            pattern[i] += k
            free -= k * int(sizes[i])
            if not free:
                break
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def cutting_stock(counts: dict[int, int], room: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: how many}, times) that hold exactly counts ({size: pieces}) in few bins of ``room``."""
    sizes = np.array(sorted(counts), np.int64)
    need = np.array([counts[s] for s in sizes.tolist()], np.int64)
    m = len(sizes)
    if not m:
        return []
    fits = room // sizes
    columns = np.diag(fits).astype(float)  # the basis, a pattern a column
    inverse, x = np.diag(1.0 / fits), need / fits
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value, pattern = _price(np.maximum(dual, 0), sizes, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        x = np.maximum(x - ratio[r] * step, 0)
        x[r] = ratio[r]
        columns[:, r] = pattern
        row = inverse[r] / step[r]
        inverse = inverse - np.outer(step, row)
        inverse[r] = row
    plan, left = [], need.copy()
    for p in range(m):
        pattern = columns[:, p].astype(np.int64)
        used = pattern > 0
        times = min(int(x[p] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    plan += _fill(left, sizes, room)
    return [({int(s): int(k) for s, k in zip(sizes, p) if k}, t) for p, t in plan]


def slots(plan: list[tuple[dict[int, int], int]], classes: int):
    """Tables that turn (class, rank) into (sequence, slot): per class, ranks from, first sequence, slots a sequence, first slot."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(classes + 1)]
    seen = [0] * (classes + 1)
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for c in sorted(pattern, reverse=True):
            rows[c].append((seen[c], sequence, pattern[c], slot))
            seen[c] += pattern[c] * times
            slot += pattern[c]
        sequence += times
    return [np.array(r, np.int64).reshape(-1, 4) for r in rows]


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SIZE, grain: int = GRAIN, id: str = "doc_id", text: str = "text", memory: int = MEMORY, block: int = BLOCK_BYTES) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  memory: words whose ids a worker remembers; block: bytes of text that it encodes at once."""
    cls = F.ceil(F.col("length") / grain).cast("int")
    cut_up = cut(pieces(docs, tokenizer, end_id, size, id, text, memory, block), "pieces").withColumn("cls", cls)
    counts = {r["cls"]: r["n"] for r in cut_up.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # size / grain rows at most
    table = slots(cutting_stock(counts, size // grain), size // grain)
    buckets = MIN_BUCKETS + sum(counts.values()) // BUCKET_ROWS
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    many = dealt.groupBy("cls", "bucket").agg(F.count("*").alias("n"))
    before = many.select("cls", "bucket", (F.sum("n").over(Window.partitionBy("cls").orderBy("bucket")) - F.col("n")).alias("before"))
    place = Window.partitionBy("cls", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(place) - 1).join(before, ["cls", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", (F.col("rank") + F.col("before")).alias("rank"))

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        c, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
        sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for k in np.unique(c):
            own = np.flatnonzero(c == k)
            t = table[k]
            row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
            at = rank[own] - row[:, 0]
            sequence[own], slot[own] = row[:, 1] + at // row[:, 2], row[:, 3] + at % row[:, 2]
        return batch({**{n: b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": sequence, "slot": slot})

    out = map_arrow(ranked, assign, PIECE + ", sequence_id long, slot long")
    run = Window.partitionBy("sequence_id").orderBy("slot")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(run) - F.col("length")).alias("offset"))
