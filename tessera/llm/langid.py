"""Language identification by a linear-chain conditional random field over words.

Each word has character n-gram features with word ends marked (so affixes are
among them) and a lexicon feature for frequent words; learned transitions tie
neighbours together, so the words of code-switched text get labels of their
own by forward-backward.  The model is fitted on a bounded sample of labelled
documents (``PER_LANG`` documents of each language by hash of the id; of a text
longer than ``SPANS * SPAN_CHARS`` characters, ``SPANS`` spans on whole words,
each anywhere in the whole text by a hash of its own), spliced into sequences that switch language, and is then half a megabyte for each
language; every text is labelled whole.

Forward-backward runs over all words of a record batch at once: products of
transfer matrices over blocks of ``SPAN`` words, a scan over the blocks of each
text, then all blocks side by side.

Defined results: a null text and a text without a letter are ``und`` with
score 0; with no labelled document at all, every text is ``und``; a null id is
never held out; repeated rows are labelled one by one; of languages with equal
shares the first by name wins; every lang that occurs is learned; other columns
are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, flat_string
from .tokens import blocks
from .words import codes, sums, text_of, word_strings, words_of

FOLDS = 5
PER_LANG, SPANS, SPAN_CHARS = 600, 10, 300
HASH_BITS, LEXICON, NGRAMS = 17, 4_000, (1, 2, 3, 4)
#: Sequences to learn from: so many, or so many for each language.
SEQUENCES, PER_LANG_SEQUENCES, SEQUENCE_WORDS, EPOCHS, SPAN = 1_200, 300, 96, 4, 32
OPEN, CLOSE = 2, 3  # word ends

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    return _letters[0]


class Features:
    """Features of distinct words, as rows of a weight table, in one flat list."""

    def __init__(self, words: pa.Array, lexicon: np.ndarray):
        low = pc.utf8_lower(words)
        raw = flat_string(low)
        t = text_of(raw)
        points = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        size = pc.utf8_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        ok = letters()[points] if len(points) else np.zeros(0, bool)
        bounds = np.concatenate(([0], ends))
        self.n_letters = sums(ok, bounds)
        word = np.repeat(np.arange(len(size)), size)[ok]
        body = points[ok].astype(np.uint64)
        # letters of each word between its marks
        at = np.concatenate(([0], np.cumsum(self.n_letters + 2)))
        text = np.full(at[-1], OPEN, np.uint64)
        text[at[1:] - 1] = CLOSE
        rank = np.arange(len(body)) - np.repeat(np.cumsum(self.n_letters) - self.n_letters, self.n_letters)
        text[at[word] + 1 + rank] = body
        owner = np.repeat(np.arange(len(size)), self.n_letters + 2)
        where, index = [], []
        h = np.zeros(len(text), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            k = len(text) - n + 1
            if k <= 0:
                break
            h = h[:k] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(n)
            inside = owner[:k] == owner[n - 1 :]
            if n in NGRAMS:
                keep = inside & (text[:k] > CLOSE) if n == 1 else inside
                where.append(owner[:k][keep])
                index.append(_fold(h[:k][keep]))
        # a hash of the whole word looks it up in the lexicon
        whole = np.zeros(len(size), np.uint64)
        power = np.uint64(0x9E3779B97F4A7C15) ** (rank.astype(np.uint64) + np.uint64(1))
        np.add.at(whole, word, body * power)
        if len(lexicon):
            spot = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
            known = np.flatnonzero((lexicon[spot] == whole) & (self.n_letters > 0))
            where.append(known)
            index.append((1 << HASH_BITS) + spot[known])
        self.whole = whole
        where = np.concatenate(where) if where else np.zeros(0, np.int64)
        index = np.concatenate(index) if index else np.zeros(0, np.int64)
        live = self.n_letters[where] > 0
        order = np.argsort(where[live], kind="stable")
        self.index, self.where = index[live][order], where[live][order]
        self.first = np.searchsorted(self.where, np.arange(len(size) + 1))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.first) - 1, weights.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            out[full] = np.add.reduceat(weights[self.index], self.first[full], axis=0)
        return out


def _fold(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def words_in(col: pa.Array):
    """(code of each word, distinct words, bounds of each text among the words)."""
    t = text_of(col)
    w = words_of(t)
    code, distinct = codes(word_strings(t, w))
    return code, distinct, w.first


def forward_backward(e: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marginals of each word.  e: exponentiated emissions; transition: exponentiated, rows from; first: bounds of the texts."""
    n, k = e.shape
    if not n:
        return e
    count = np.diff(first)
    spans = -(-count // SPAN)
    of = np.repeat(np.arange(len(count)), spans)
    lead = np.concatenate(([0], np.cumsum(spans)))
    begin = first[of] + (np.arange(lead[-1]) - lead[of]) * SPAN
    size = np.minimum(SPAN, first[of + 1] - begin)
    m = len(begin)
    total = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for s in range(SPAN):
        live = np.flatnonzero(size > s)
        part = (total[live] @ transition) * e[begin[live] + s][:, None, :]
        total[live] = part / part.max(axis=(1, 2), keepdims=True)
    # vectors at the ends of each span: from the left (ahead) and from the right (behind)
    ahead, behind = np.full((m, k), 1.0 / k), np.ones((m, k))
    for j in range(1, int(spans.max())):
        i = lead[:-1][spans > j] + j
        v = (ahead[i - 1][:, None, :] @ total[i - 1])[:, 0]
        ahead[i] = v / v.max(1, keepdims=True)
        i = lead[1:][spans > j] - 1 - j
        v = (total[i + 1] @ behind[i + 1][:, :, None])[:, :, 0]
        behind[i] = v / v.max(1, keepdims=True)
    out = np.empty((n, k))
    for s in range(SPAN):
        i = np.flatnonzero(size > s)
        v = (ahead[i] @ transition) * e[begin[i] + s]
        ahead[i] = v = v / v.max(1, keepdims=True)
        out[begin[i] + s] = v
    for s in range(SPAN - 1, -1, -1):
        i = np.flatnonzero(size > s)
        out[begin[i] + s] *= behind[i]
        v = (e[begin[i] + s] * behind[i]) @ transition.T
        behind[i] = v / v.max(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


class Model:
    def __init__(self, langs, weights, transition, lexicon):
        self.langs, self.weights, self.transition, self.lexicon = langs, weights, transition, lexicon

    def marginals(self, col: pa.Array):
        """(marginals of each word, letters of each word, bounds of each text)."""
        code, distinct, first = words_in(col)
        f = Features(distinct, self.lexicon)
        e = f.emissions(self.weights)
        e = np.exp(e - e.max(1, keepdims=True, initial=-1e30)).astype(np.float64)
        return forward_backward(np.maximum(e, 1e-30)[code], np.exp(self.transition), first), f.n_letters[code], first

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        share, n_letters, first = self.marginals(col)
        run = np.concatenate((np.zeros((1, share.shape[1])), np.cumsum(share * n_letters[:, None], axis=0)))
        mass = run[first[1:]] - run[first[:-1]]
        total = sums(n_letters, first)
        best = mass.argmax(1) if len(mass) else np.zeros(0, int)
        score = np.where(total > 0, mass.max(1, initial=0) / np.maximum(total, 1), 0.0)
        return [self.langs[b] if t > 0 else "und" for b, t in zip(best, total)], np.clip(score, 0, 1)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fit on labelled texts: AdaGrad on the log likelihood of spliced sequences."""
    names = sorted(set(langs))
    k = len(names)
    code, distinct, first = words_in(pa.array(texts, pa.large_string()))
    f = Features(distinct, np.zeros(0, np.uint64))
    seen = np.bincount(code, minlength=len(distinct)) * (f.n_letters > 0)
    top = np.argsort(-seen, kind="stable")[:LEXICON]
    lexicon = np.unique(f.whole[top[seen[top] > 2]])
    f = Features(distinct, lexicon)
    rng = np.random.default_rng(seed)
    by = [[i for i, x in enumerate(langs) if x == name and first[i + 1] > first[i]] for name in names]
    by_ok = [j for j in range(k) if by[j]]
    weights = np.zeros(((1 << HASH_BITS) + max(1, len(lexicon)), k), np.float32)
    transition = np.zeros((k, k))
    if k > 1 and by_ok:
        count = max(SEQUENCES, PER_LANG_SEQUENCES * k)
        wg, tg = np.full_like(weights, 1e-6), np.full((k, k), 1e-6)
        words = np.zeros((count, SEQUENCE_WORDS), np.int64)
        truth = np.zeros((count, SEQUENCE_WORDS), np.int64)
        for s in range(count):
            at, j = 0, int(rng.choice(by_ok))
            while at < SEQUENCE_WORDS:
                i = by[j][rng.integers(len(by[j]))]
                n = int(min(rng.integers(4, 48), SEQUENCE_WORDS - at, first[i + 1] - first[i]))
                a = int(rng.integers(first[i], first[i + 1] - n + 1))
                words[s, at : at + n], truth[s, at : at + n] = code[a : a + n], j
                at, j = at + n, int(rng.choice(by_ok))
        for epoch in range(EPOCHS):
            order = rng.permutation(count)
            for part in np.array_split(order, max(1, count // 60)):
                own, back = np.unique(words[part], return_inverse=True)
                back = back.reshape(len(part), -1)
                rows = np.concatenate([np.arange(f.first[w], f.first[w + 1]) for w in own])
                size = np.diff(f.first)[own]
                index, where = f.index[rows], np.repeat(np.arange(len(own)), size)
                e = np.zeros((len(own), k))
                for j in range(k):
                    e[:, j] = np.bincount(where, weights[index, j], len(own))
                grad_e, grad_t = _gradient(e, transition, back, truth[part])
                step = np.zeros((len(own), k))
                for j in range(k):
                    step[:, j] = np.bincount(back.ravel(), grad_e[:, :, j].ravel(), len(own))
                used, fold = np.unique(index, return_inverse=True)
                g = np.stack([np.bincount(fold, step[where, j], len(used)) for j in range(k)], 1) / len(part) - 1e-4 * weights[used]
                wg[used] += g * g
                weights[used] += (0.15 * g / np.sqrt(wg[used])).astype(np.float32)
                g = grad_t / len(part) - 1e-3 * transition
                tg += g * g
                transition += 0.15 * g / np.sqrt(tg)
    return Model(names, weights, transition, lexicon)


def _gradient(e, transition, word, truth):
    """Gradient of the mean log likelihood, for a block of sequences of one length."""
    b, n = word.shape
    k = e.shape[1]
    x = np.exp(e - e.max(1, keepdims=True))[word]
    t = np.exp(transition)
    a = np.empty((b, n, k))
    v = np.full((b, k), 1.0 / k)
    for i in range(n):
        v = (v @ t) * x[:, i]
        v /= v.sum(1, keepdims=True)
        a[:, i] = v
    back, gt = np.ones((b, k)), np.zeros((k, k))
    ge = np.zeros((b, n, k))
    for i in range(n - 1, -1, -1):
        m = a[:, i] * back
        ge[:, i] = -m / m.sum(1, keepdims=True)
        before = a[:, i - 1] if i else np.full((b, k), 1.0 / k)
        pair = before[:, :, None] * t * (x[:, i] * back)[:, None, :]
        gt -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        back = (x[:, i] * back) @ t.T
        back /= back.sum(1, keepdims=True)
    rows = np.arange(b)[:, None]
    ge[rows, np.arange(n), truth] += 1
    np.add.at(gt, (truth[:, :-1], truth[:, 1:]), 1)
    first = np.zeros((k, k))  # the uniform start: its expected share of each row is left as it is
    np.add.at(first, (slice(None), truth[:, 0]), 1.0 / k)
    return ge, gt + first


def held_out(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def spans(id: Column, text: Column) -> Column:
    """A short text as it is; of a longer one, spans anywhere in it, cut to whole words where it has white space."""
    room = F.length(text) - SPAN_CHARS + 1

    def piece(k: Column) -> Column:
        at = F.pmod(F.xxhash64(id, k), F.greatest(F.lit(1), room)).cast("int") + 1
        cut = F.substring(text, at, F.lit(SPAN_CHARS))
        return F.coalesce(F.nullif(F.regexp_replace(cut, r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[\x20\x09-\x0D]+[^\x20\x09-\x0D]*$", ""), F.lit("")), cut)

    pieces = F.transform(F.sequence(F.lit(0), F.lit(SPANS - 1)), piece)
    return F.when(F.length(text) <= SPANS * SPAN_CHARS, text).otherwise(F.array_join(pieces, " "))


def sample(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """The bounded sample of labelled documents outside the held-out fold."""
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"), held_out(id).alias("out")).where("l is not null and t is not null and not out")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    grain = 1_000_000
    share = {x: min(grain, 1 + 2 * PER_LANG * grain // n) for x, n in counts.items()}
    limit = F.element_at(F.create_map(*[v for x, s in share.items() for v in (F.lit(x), F.lit(s))]), F.col("l"))
    draw = F.xxhash64(F.col("i"), F.lit("draw"))
    drawn = rows.where(F.pmod(draw, F.lit(grain)) < limit).select("i", spans(F.col("i"), F.col("t")).alias("t"), "l")
    got = drawn.orderBy(draw, "t").limit(3 * PER_LANG * len(counts)).select("t", "l").collect()
    taken: dict[str, int] = {}
    texts, langs = [], []
    for r in got:
        if taken.get(r.l, 0) < PER_LANG:
            taken[r.l] = taken.get(r.l, 0) + 1
            texts.append(r.t)
            langs.append(r.l)
    return texts, langs


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    texts, langs = sample(docs, id, text, lang)
    return train(texts, langs) if texts else None


def identify(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs."""
    rows = docs.select(F.col(id).alias("doc_id"), held_out(id).alias("held_out"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte a language

    def run(batches):
        for b in batches:
            col = flat_string(b.column(2))
            for i, j in blocks(col, 6_000_000):
                lang, score = shared.value.predict(col.slice(i, j - i))
                yield batch({"doc_id": b.column(0).slice(i, j - i), "held_out": b.column(1).slice(i, j - i), "lang_pred": pa.array(lang, pa.string()), "score": score})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
