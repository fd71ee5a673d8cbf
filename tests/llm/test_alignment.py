import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import alignment as L

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def brute(rows):
    """By the libraries on whole texts, every pair of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = {c: k for c, k in zip(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), [*range(33, 127), *range(161, 173), *range(174, 256)])}
    shown |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(shown.values()))}
    docs, corpus = [], Counter()
    for i, t in rows:
        text = " " + (t or "")
        ea, eb = a.encode(text, add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        ba = [bytes(shown[c] for c in a.id_to_token(x)) for x in ea]
        bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in eb]
        if not t or b"".join(ba) != text.encode() or b"".join(bb) != text.encode():
            docs.append((i, 0, 0, 0, [], ""))
            continue
        spans = []
        for parts in (ba, bb):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links = [(x, y) for x, (i0, i1) in zip(ea, spans[0]) for y, (j0, j1) in zip(eb, spans[1]) if i0 < j1 and j0 < i1]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, sp) if low <= s and e <= c) for ids, sp in zip((ea, eb), spans)))
            low = c
        corpus.update(links)
        docs.append((i, len(ea), len(eb), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in corpus.items():
        most[y] = max(most[y], n)
    return Counter((i, na, nb, g, len(ls), sum(corpus[x] == most[x[1]] for x in ls), sum(corpus[x] for x in ls), sha) for i, na, nb, g, ls, sha in docs)


def rows_of(seed):
    rng = random.Random(seed)
    odd = [None, "", " ", "  ", "\n", "\r\n", "a\r\nb  c\r", ";\r\n", "▁", "a▁b", "a ▁", "<|endoftext|> x<|endoftext|>", "<s> </s> <unk> <0x41>", "é ñ 漢字 🙂🙂", "a\x00b", " x y 　z", "x" * 3000, "  lead", "trail   ", "tab\tsep\t\tx", "ﬁ Å Å", "don't can't I'll", "1234567 12 1,000.50", "...!!! ??", "a  b   c    d", "\x0b\x0c", "\x85 \x1c"]
    words = ["the", "The", "analysis", "überall", "naïve", "token", "s", "ization", "(x)", "foo_bar", "http://a.b/c?d=e", "\n", "\t", " ", "мир", "日本", "<|", "é"]
    texts = odd + ["".join(rng.choice(words) + rng.choice([" ", "", " ", "\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    return [(rng.choice([k, k, None]), t) for k, t in enumerate(texts)] + [(1, "same row"), (1, "same row")]


def found(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hot,block", [(200_000, 1_500_000), (40, 300), (0, 5000)])
def test_against_brute_force(spark, hot, block):
    rows = rows_of(hot)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "'x' as n_a", "2 as pairs").repartition(3)
    got = L.cross_align(df, A, B, hot=hot, block=block, memory=50)
    assert got.columns == ["doc_id", *L.RESULT, "groups_sha256"]
    assert found(got) == brute(rows)


def test_empty_table(spark):
    assert L.cross_align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    assert found(L.cross_align(spark.createDataFrame([(1, None), (2, "")], SCHEMA), A, B)) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (2, 0, 0, 0, 0, 0, 0, ""): 1})


def test_threshold(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([100, 90, 50, 3, 3, 3, 1, 1])], "pair long, count long")
    for room in range(10):
        least = L.threshold(counts, room)
        assert counts.where(f"count >= {least}").count() <= room
    assert L.threshold(counts, 8) == 1 and L.threshold(counts, 3) == 50
