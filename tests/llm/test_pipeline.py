import random

import corpus_pipeline
import pytest
from test_lines import brute as brute_lines
from test_quality import brute as brute_quality
from test_simhash import plain, roots

from tessera.llm.tokens import encoder

P = pytest.importorskip("public_tokenizers")


def tables(spark, path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(70):
        text = "\n".join(line(rng.randint(8, 30)) for _ in range(rng.randint(2, 6)))
        if i % 10 == 9:
            text = text + "\n" + "you idiot " + line(20)
        rows.append((i, text))
    rows += [(100, rows[3][1]), (101, rows[4][1].replace(" ", "  ")), (102, rows[5][1].upper()), (103, rows[6][1] + "\n" + rows[7][1].split("\n")[0]), (104, None), (105, "too short"), (106, "again and again " * 60), (107, "\n".join([line(9)] * 8))]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in rows if i < 70], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_run_against_brute_force(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    rows = [(i, t) for i, t in rows if brute_quality(t)[-1]]
    rows = [(i, t) for i, t, _, _ in brute_lines(rows) if t and t.split()]
    fp = {i: plain(t) for i, t in rows}
    first = roots([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], list(fp))
    rows = [(i, t) for i, t in rows if first[i] == i and "idiot" not in t]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = encoder(P.path("word_bpe_49k.json")).tokenizer
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    copies = {i: n / want[i] for i, n in total.items()}
    assert set(copies) == set(want) and all(n in (1, 2, 3, 4) for n in copies.values())


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(9)
    a, b, c = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b + " end"), (5, c), (5, c), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(1, a), (2, b), (5, c)]


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for empty in (docs.limit(0), docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, empty, str(tmp_path))
            assert out.dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), str(tmp_path)).count() == 0
