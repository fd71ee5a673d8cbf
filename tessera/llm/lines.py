"""Fuzzy line deduplication by MinHash, in DataFrame operations alone.

A line is what stands between newlines; its shingles are all runs of
``SHINGLE`` code points, and a shorter line is one shingle.  Every shingle is
hashed; each of ``BANDS * ROWS`` minima under a random mask (the hash nearest to
it in the xor metric) agrees between two lines with the probability of their
Jaccard similarity, and ``BANDS`` keys of ``ROWS`` minima find a pair at
similarity 0.8 with probability 0.997.  Equal lines meet in one row when minima
are merged.  Long lines are sampled by levels: at level k only hashes with 2k
zero bits at the end count, a uniform sample of the union of two lines, and a
line takes the level that leaves it 50 shingles or more; on the border between
levels it takes both.  Levels follow the number of shingles by place; a line
whose sample shows fewer distinct ones (a line that repeats itself) is signed
once more by its distinct shingles.

Candidates are verified in two passes.  First every line of a key meets the
key's hub alone, the line that shares most keys with others, so a group of
copies costs one pair a line.  What those links leave in different components is
then compared inside the keys, each pair under the first key that it shares.  A
sketch goes before the texts: ``WORDS * 64`` bits, each the parity of the shingle
hashes that fall on it.  Where two sketches differ, the shingle sets do, at least
as often; similarity 0.8 allows a ninth of both sizes, so no pair that has it is
lost.  Exact Jaccard similarity decides each link, a distributed union-find joins
them, and the first line of each component (by document id, then place) is kept.

Lines are known by a 64-bit hash, as are documents by id and text: two of a
billion share one with probability 0.03.

Defined results: a null text stays null and has no line; a line without a word
always stays; rows with the same id and text count as one document and keep the
same lines; null ids come first in order; extra columns pass through, and one
with the name of a result column is replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, cut, drop, free
from .components import components

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 8, 3, 0.8
#: Shingles from which level 1 is taken, and below which level 0 is; four times as many for each level more.
LONG, SHORT = 200, 250
#: A line that has a smaller share of distinct shingles in its sample is signed again, if it may belong to a lower level.
REPEATS = 0.8
WORDS = 16
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
_draw = random.Random(1)
MASKS = [_draw.getrandbits(64) - (1 << 63) for _ in range(BANDS * ROWS)]


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of the distinct shingles of a line."""
    one = F.array(F.encode(line, "UTF-32"))  # four bytes a code point; in an array, so that it is encoded once
    # the sequence is of places in bytes: nothing is reckoned for each shingle but its hash
    last = lambda wide: F.greatest(F.lit(1), F.length(wide) - (4 * size - 1))
    hashes = F.transform(one, lambda wide: F.transform(F.sequence(F.lit(1), last(wide), F.lit(4)), lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * size)))))
    return F.array_distinct(hashes[0])


def worded(line: Column) -> Column:
    """Whether a line holds a word: it ends at the first one, where a pattern would have the whole line decoded."""
    return F.ltrim(line, F.lit(BLANK)) != ""


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(line, id) of the lines that hold a word."""
    return docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where(worded(F.col("line"))).withColumn("id", F.xxhash64("line"))


def levels(n: Column) -> Column:
    """The levels of a line of n shingles."""

    def level(least: int) -> Column:
        return F.when(n < least, 0).otherwise(F.floor(F.log(n / least) / math.log(4)).cast("int") + 1)

    return F.array_distinct(F.array(level(LONG), level(SHORT)))


def sampled(hashed: DataFrame) -> DataFrame:
    """(id, level, i, h) of the shingles in the samples, from (id, level, zeros, i, h); zeros: the bits that must be zero.

    The first shingle always has a row, without a hash where it is not in the sample.
    """
    # the task's number keeps the filter above the hash, which would else be taken twice for what passes
    some = hashed.withColumn("task", F.spark_partition_id()).where("((h & zeros) = 0 or i = 0) and task >= 0")
    return some.select("id", "level", "i", F.expr("if((h & zeros) = 0, h, null)").alias("h"))


def minima(hashed: DataFrame, masks: list[int]) -> DataFrame:
    """From (id, level, i, h), as sampled gives it: the minima of each line's sample, a bitmap of it (above level 0), how many shingles it took and from how many lines.
    """
    # told once a shingle, and only where a line may be signed again
    taken = hashed.select("id", "level", "i", "h", F.expr("if(level > 0, shiftrightunsigned(h, 40) & 3, null)").alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 42) & 63 as int))").alias("bit"))
    bits = [F.expr(f"bit_or(if(word = {j}, bit, 0L))").alias(f"b{j}") for j in range(4)]
    return taken.groupBy("id", "level").agg(F.count("h").alias("taken"), F.sum((F.col("i") == 0).cast("long")).alias("lines"), *[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(masks)], *bits)


def band_keys(marks: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, keys, again): a key for each band; again: whether the line repeats itself and may belong to a lower level.

    The distinct shingles of the sample are told by the bits that they set.
    """
    keys = F.array(*[F.xxhash64(F.lit(b), "level", *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)])
    full = F.bit_count("b0") + F.bit_count("b1") + F.bit_count("b2") + F.bit_count("b3")
    distinct = -256 * F.log1p(-F.least(full, F.lit(255)) / 256.0)
    again = (F.col("level") > 0) & (distinct < F.least(F.col("taken") / F.col("lines") * REPEATS, F.lit(SHORT / 4)))
    return marks.select("id", F.when(F.col("m0").isNotNull(), keys).alias("keys"), (F.col("m0").isNull() | again).alias("again"))


def signatures(lines: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, keys) of each distinct line, a row for each of its levels; a scratch table."""
    masks = MASKS[: bands * rows]
    zeros = F.expr("shiftleft(1L, 2 * level) - 1").alias("zeros")
    n = F.greatest(F.lit(1), F.length("line") - (size - 1))
    wide = lines.select("id", "line", n.alias("n")).select("id", "line", "n", F.explode(levels(F.col("n"))).alias("level"))
    # encoded before the shingles are dealt out: once a line
    wide = wide.select("id", "level", zeros, "n", F.encode("line", "UTF-32").alias("w")).select("id", "level", "zeros", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    hashed = wide.withColumn("h", F.expr(f"xxhash64(substring(w, 4 * i + 1, {4 * size}))"))
    first = cut(band_keys(minima(sampled(hashed), masks), bands, rows), "line-signatures")
    free(first)
    again = first.where("again").select("id").distinct()
    if again.isEmpty():
        return first
    # the texts are written first: else their shingles would be taken before the join
    texts = cut(texts_of(lines, again), "line-again")
    sets = texts.select("id", shingles(F.col("line"), size).alias("hs")).select("id", "hs", F.explode(levels(F.size("hs"))).alias("level"))
    sets = sets.select("id", "level", zeros, F.posexplode_outer("hs").alias("i", "h"))
    more = band_keys(minima(sampled(sets), masks), bands, rows)
    out = append(more, first)
    drop(texts)
    return out


def texts_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the lines with those distinct ids.

    A bitmap of the ids, of 2**20 words at most, goes to every task and holds
    back most other lines; equal lines are combined before they are shuffled.
    """
    words = min(1 << 20, max(1 << 10, 1 << (ids.count() // 8).bit_length()))
    word = F.shiftrightunsigned("id", 6).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    held = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    some = lines.select("id", "line", word.alias("word")).join(F.broadcast(held), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return some.select("id", "line").distinct().join(ids.select("id"), "id")


def sketches(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, n, x0, x1, ...): the number of distinct shingles of each line, and the parities of their hashes."""
    # sets first: else what stands above is not compiled with the explosion; outer: else each set is taken twice, to see whether it is empty
    h = texts.select("id", shingles(F.col("line"), size).alias("hs")).select("id", F.explode_outer("hs").alias("h"))
    h = h.select("id", F.expr(f"shiftrightunsigned(h, 30) & {WORDS - 1}").alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 50) & 63 as int))").alias("bit"))
    word = [F.expr(f"bit_xor(if(word = {j}, bit, 0L))").alias(f"x{j}") for j in range(WORDS)]
    return h.groupBy("id").agg(F.count("*").alias("n"), *word)


def near(similarity: float) -> Column:
    """Whether the sketches of a pair (a_n, a_x0, ..., b_n, b_x0, ...) leave room for that similarity."""
    differ = sum((F.bit_count(F.col(f"a_x{j}").bitwiseXOR(F.col(f"b_x{j}"))) for j in range(WORDS)), F.lit(0))
    return differ <= (F.col("a_n") + F.col("b_n")) * ((1 - similarity) / (1 + similarity) + 1e-9)


def sided(known: DataFrame, side: str, *more: str) -> DataFrame:
    return known.select(*more, F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *[f"x{j}" for j in range(WORDS)])])


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, size: int = SHINGLE) -> DataFrame:
    """The pairs whose lines have that Jaccard similarity."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    sets = both.select(*pairs.columns, shingles(F.col("x"), size).alias("hx"), shingles(F.col("y"), size).alias("hy"))
    common = F.size(F.array_intersect("hx", "hy"))
    return sets.where(common >= similarity * (F.size("hx") + F.size("hy") - common)).select(*pairs.columns)


def line_components(lines: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, root) of the lines that are similar to others."""
    marks = signatures(lines, size, bands, rows)
    # both sides are one shuffle; a line that is signed again may have a key twice
    keys = marks.where("keys is not null").select("id", F.explode("keys").alias("key"))
    alike = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id"))
    found = cut(keys.alias("x").join(keys.alias("y").hint("shuffle_hash"), alike, "left_semi"), "line-alike")
    shared = cut(found.join(found.groupBy("key").agg(F.count("*").alias("size")), "key"), "line-keys")
    of = cut(shared.groupBy("id").agg(F.sum("size").alias("weight"), F.collect_set("key").alias("keys")), "line-shared")
    free(shared)
    texts = cut(texts_of(lines, of), "line-texts")
    known = cut(sketches(texts, size).join(of, "id"), "line-sketches")
    drop(marks, found, of)
    hub = shared.select("key", "id").join(known.select("id", "weight"), "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("hub"))
    stars = shared.join(hub, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    stars = cut(stars.join(sided(known, "a"), "a").join(sided(known, "b"), "b").where(near(similarity)).select("a", "b"), "line-stars")
    links = cut(verify(stars, texts, similarity, size), "line-links")
    roots = cut(components(links, "line-roots"), "line-roots")
    # keys whose lines are not all in one component yet
    member = shared.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_ = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = cut(member.join(open_, "key").join(known.drop("weight"), "id"), "line-open")
    x, y = sided(left, "a", "key", F.col("root").alias("p"), F.col("keys").alias("a_keys")), sided(left, "b", "key", F.col("root").alias("q"), F.col("keys").alias("b_keys"))
    both = (x["key"] == y["key"]) & (F.col("p") < F.col("q")) & near(similarity) & (F.get(F.array_intersect("a_keys", "b_keys"), F.lit(0)) == x["key"])
    pairs = x.join(y, both).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "p", "q")
    pairs = cut(pairs.join(stars, ["a", "b"], "left_anti"), "line-pairs")
    more = cut(verify(pairs, texts, similarity, size).select(F.col("p").alias("a"), F.col("q").alias("b")), "line-links")
    drop(shared, texts, known, stars, links, left, pairs)
    free(more)
    if more.isEmpty():
        return roots
    # components of components; a line without a link so far is one of its own
    merged = cut(components(more, "line-roots"), "line-roots")
    drop(more)
    out = roots.join(merged.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return out.unionAll(merged.join(roots, "id", "left_anti").select("id", "root"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the lines kept as text, and n_lines and n_kept."""
    rows = docs.withColumn("_doc", F.xxhash64(F.col(id), F.col(text)))
    roots = line_components(split_lines(rows, text), similarity)
    place = rows.select("_doc", F.col(id).alias("_id"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).where(worded(F.col("line")))
    place = place.select(F.xxhash64("line").alias("id"), F.struct("_id", "_doc", "at").alias("place"))
    # equal lines first, and of each component one place alone: no join meets a common line's places
    first = place.groupBy("id").agg(F.min("place").alias("place")).join(roots, "id", "left").groupBy(F.coalesce("root", "id")).agg(F.min("place").alias("place"))
    kept = first.groupBy(F.col("place._doc").alias("_doc")).agg(F.collect_set("place.at").alias("_at"))
    # texts are split before the join: each once
    out = rows.withColumn("_parts", F.split(F.col(text), "\n")).drop(text).join(kept.hint("shuffle_hash"), "_doc", "left")
    blank = F.filter(F.sequence(F.lit(0), F.size("_parts") - 1), lambda i: ~worded(F.get("_parts", i)))
    out = out.withColumn("_at", F.when(F.col("_parts").isNotNull(), F.sort_array(F.concat(F.coalesce("_at", F.array().cast("array<int>")), blank))))
    counts = {"n_lines": F.size("_parts"), "n_kept": F.size("_at")}
    out = out.withColumns({c: F.when(F.col("_parts").isNull(), 0).otherwise(n).cast("long") for c, n in counts.items()})
    out = out.withColumn(text, F.array_join(F.transform("_at", lambda i: F.get("_parts", i)), "\n"))
    return out.select(*[c for c in docs.columns if c not in counts], *counts)
