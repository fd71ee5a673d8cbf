import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing as K
from tessera.llm import token_files as F
from tessera.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "  a", "a  b", "a \n b", "a\n\n\nb", "it's we'll  'S", "é b c", "a  b", "<|endoftext|> x <|endoftext|>", "ｆｕｌｌ Ⅷ é ́x", "12 345 6.7", "Σ ΑΣ", "İi", "\n", "a\x1cb !\x1c!", "a\x00b"]


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "1", "23", "!", "́", "ß", "日本", "\t", "<|startoftext|>", " ", "word", " other"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    e = Encoder(P.path(name), memory=50)
    ts = texts(800, 1)
    at = 0
    for _ in range(2):
        ids, n = e(pa.array(ts, pa.string()))
        at = 0
        for t, k in zip(ts, n):
            assert ids[at : at + k].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t
            at += k


def test_files_round_trip(spark, tmp_path):
    ts = texts(120, 2) + ["long " * 9000]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").selectExpr("*", "1 as part", "'x' as file").repartition(5)
    man = F.write_tokens(df, str(tmp_path / "out"), P.path("byte_bpe_50k.json"), length=64)
    got = sorted(tuple(r) for r in F.digest(man).collect())
    t = Encoder(P.path("byte_bpe_50k.json")).tokenizer
    want, at = [], 0
    for i, x in enumerate(ts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    for r in man.collect():  # equal lengths, masks, and any sequence by its number
        reader = F.open_tokens(r.file)
        assert reader.schema.field("input_ids").type.list_size == 64
        real = sum(reader.get_batch(k).column(1).values.true_count for k in range(reader.num_record_batches))
        assert real == r.n_tokens
    empty = F.write_tokens(df.limit(0), str(tmp_path / "none"), P.path("byte_bpe_50k.json"))
    assert F.digest(empty).count() == 0


def test_cutting_stock_holds_all_and_is_tight():
    rng = random.Random(3)
    counts = {s: rng.randint(1, 400) for s in rng.sample(range(1, 100), 80)}
    plan = K.cutting_stock(counts, 256)
    held = {}
    for p, t in plan:
        assert sum(s * k for s, k in p.items()) <= 256 and t > 0
        for s, k in p.items():
            held[s] = held.get(s, 0) + k * t
    assert held == counts
    assert sum(t for _, t in plan) <= 1.01 * sum(s * n for s, n in counts.items()) / 256 + 3
    assert K.cutting_stock({}, 256) == []
    assert sum(t for _, t in K.cutting_stock({1: 700}, 256)) == 3


def test_packing(spark):
    rng = random.Random(4)
    ts = ODD + [" ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(0.7) * 20) % 5000)) for _ in range(150)]
    rows = list(enumerate(ts)) + [(3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as bucket", "3 as cls")
    got = K.pack(df, P.path("word_bpe_49k.json")).collect()
    t = Encoder(P.path("word_bpe_49k.json")).tokenizer
    want = []
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(by) * 2048 < 1.1 * total + 2 * 2048
    assert K.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_null_ids_beside_large_ones(spark, tmp_path):
    from tessera.llm import token_files as T

    rows = [(None, "a b"), (9007199254740993, "c"), (9007199254740995, "d e f"), (None, None)]
    manifest = T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "out"), P.path("byte_bpe_50k.json"))
    got = sorted(((r.doc_id, r.start) for r in T.digest(manifest).collect()), key=lambda r: r[1])
    assert [i for i, _ in got] == [None, None, 9007199254740993, 9007199254740995]
