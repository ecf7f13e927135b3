"""Near-duplicate lines by an exact set-similarity join (operator 6): DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_row, discard, materialize, sized

# Generators here are the outer ones: for the others the optimizer infers a filter on the array and pushes it
# down, where the array is computed once more for every mention.  No line has an empty array.
#: Bits of a token that are hash; its rarity is above them.
HASH_BITS = 57
_ORDER = ("doc", "no", "th")
#: Words of 64 bits in the sketch that candidates are compared by before their words; a power of two.
SKETCH = 8


def _lines(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(doc, th, no, line)``; ``th`` tells apart different texts under one doc_id; a null doc_id is the smallest."""
    t = F.col(text).cast("string")
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("th"), t.alias("t"))  # hashed once a text, not once a line
    return texts.select("doc", "th", F.posexplode_outer(F.split("t", "\n")).alias("no", "line"))


def _spaced(text: Column) -> Column:
    """``text`` with spaces in place of other white space, but for line ends: it is split by one character then, which takes no regex for each word."""
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\r"))
    return F.when(other, F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)


def _hashes(line: Column) -> Column:
    """64-bit hashes of the words of a line, repeats included."""
    words = F.transform(F.split(_spaced(line), " "), lambda w: F.xxhash64(w))
    return F.array_remove(words, F.xxhash64(F.lit("")))  # what stands between, before or after white space


def _overlap(nx: Column, ny: Column, percent: int) -> Column:
    """Least number of common tokens of two sets whose Jaccard similarity is at least ``percent`` / 100."""
    return F.ceil(percent * (nx + ny) / F.lit(100.0 + percent) - 1e-9).cast("long")


def _enough(common: Column, nx: Column, ny: Column, percent: int) -> Column:
    """Whether two sets with ``common`` tokens in common have a Jaccard similarity of ``percent`` / 100: whole numbers only, as it is asked for every pair that meets."""
    return (100 + percent) * common >= percent * (nx + ny)


def _possible(nx: Column, ny: Column, bx: tuple[Column, Column], by: tuple[Column, Column], percent: int) -> Column:
    """Length filter and bitmap filter: neither drops a pair that is similar enough.  The cheaper one comes first."""
    nx, ny = nx.cast("long"), ny.cast("long")
    differ = F.bit_count(bx[0].bitwiseXOR(by[0])) + F.bit_count(bx[1].bitwiseXOR(by[1]))
    return (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & _enough(F.call_function("shiftright", nx + ny - differ, F.lit(1)), nx, ny, percent)


def rarity_levels(df: DataFrame, text: str, bits: int) -> list[int]:
    """A level, twice the binary logarithm of the count, for each of 2 ** ``bits`` hash buckets of words.

    All words of all texts are counted, combined on the map side; the result has a fixed size.
    Any order of tokens gives the same matches: a word that shares a bucket only costs time.
    """
    words = df.select(F.explode_outer(F.split(F.replace(_spaced(F.col(text).cast("string")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("b")).count()
    levels = [0] * (1 << bits)
    for b, x in counts.select("b", F.least(F.floor(2 * F.log2("count")), F.lit(62)).cast("int")).collect():
        levels[b] = x
    return levels


def _measured(lines: DataFrame, levels: list[int], percent: int) -> DataFrame:
    """``(h1, h2, doc, no, th, words, n, b0, b1, prefix)`` of each line: its distinct tokens, rarest first, as far as the prefix goes.

    ``b0`` and ``b1`` are a bitmap of 128 bits, the parity of the tokens per bit: the bits in which two bitmaps differ are at most the tokens in which two sets differ.
    """
    held = F.from_json(F.lit(str(levels)), "array<int>")  # a constant; looked up by position

    def token(h):
        level = F.coalesce(F.get(held, h.bitwiseAND(F.lit(len(levels) - 1)).cast("int")), F.lit(0)).cast("long")  # never null: such arrays sort as plain numbers
        return F.call_function("shiftleft", level, F.lit(HASH_BITS)).bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(64 - HASH_BITS)))

    step = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"), *_ORDER, _hashes(F.col("line")).alias("h"))
    step = step.select("h1", "h2", *_ORDER, F.size("h").alias("words"), F.array_distinct("h").alias("h"))
    step = step.select("h1", "h2", *_ORDER, "words", F.size("h").alias("n"), F.sort_array(F.transform("h", token)).alias("tokens"))
    n = F.col("n")

    def half(k: int) -> Column:
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate("tokens", F.lit(0).cast("long"), lambda a, h: F.when(h.bitwiseAND(F.lit(64)) == 64 * k, a.bitwiseXOR(bit(h))).otherwise(a))

    return step.select("h1", "h2", *_ORDER, "words", "n", half(0).alias("b0"), half(1).alias("b1"), F.slice("tokens", 1, n - F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("int") + 1).alias("prefix"))


def _classes(lines: DataFrame, levels: list[int], percent: int, min_words: int) -> DataFrame:
    """One row per different line (128 bits of hash) of enough words: its first place, what is measured of it, a ``cid`` in no order, and its copies."""
    found = _measured(lines, levels, percent).groupBy("h1", "h2").agg(F.min(F.struct(*_ORDER, "words", "n", "b0", "b1", "prefix")).alias("m"), F.count("*").alias("copies")).filter(F.col("m.words") >= max(1, min_words))
    return found.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "m.*", "copies")


def _through_pivots(classes: DataFrame, percent: int, keys: int) -> DataFrame:
    """``(a, b)``: each line with the first line of about its size that shares one of its ``keys`` chosen prefix tokens, where both can be similar.

    That is one row per line and token, whatever the size of a group of near copies, and settles almost all of its members.
    The choice goes by hash, not by rarity: words that only one copy has are the rarest.
    """
    chosen = F.slice(F.sort_array(F.transform("prefix", lambda x: x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))), 1, keys)
    rows = classes.select("cid", "doc", "n", "b0", "b1", F.explode_outer(chosen).alias("token")).withColumn("token", F.xxhash64("token", F.floor(F.log("n") / math.log(100 / percent))))
    pivots = rows.groupBy("token").agg(F.count("*").alias("k"), *(F.min_by(c, "doc").alias(f"p_{c}") for c in ("cid", "n", "b0", "b1"))).filter("k > 1").drop("k")
    met = rows.join(pivots, "token").filter((F.col("cid") != F.col("p_cid")) & _possible(F.col("n"), F.col("p_n"), (F.col("b0"), F.col("b1")), (F.col("p_b0"), F.col("p_b1")), percent))
    return met.select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b")).distinct()


def _by_prefix(classes: DataFrame, percent: int, part: int, parts: int) -> DataFrame:
    """``(a, b)``: the pairs of ``classes`` with ``settled`` that share a prefix token and pass all filters, but those of two settled lines.

    The longer line (by cid, if they are as long) takes part with its whole prefix, the shorter one with the shorter prefix that is enough
    for partners at least as long.  Rows are kept narrow: size, position and whether the line is settled share one long.  Only tokens
    of ``part`` of ``parts`` take part: one part after the other needs that much less disk.
    """
    long_, n = "long", F.col("n").cast("long")
    rows = classes.select("cid", (n * (1 << 32) + F.col("settled").cast(long_)).alias("size"), "b0", "b1", F.posexplode_outer("prefix").alias("pos", "token")).select("token", "cid", (F.col("size") + 2 * F.col("pos")).alias("packed"), "b0", "b1")
    rows = rows.filter(F.pmod("token", F.lit(parts)) == part)
    nx, ny = (F.call_function("shiftright", F.col(f"{k}_packed"), F.lit(32)) for k in "xy")
    px, py = (F.call_function("shiftright", F.col(f"{k}_packed").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(1)) for k in "xy")
    x, y = (rows.select("token", *(F.col(c).alias(f"{k}_{c}") for c in ("cid", "packed", "b0", "b1"))) for k in "xy")
    y = y.filter(py <= ny - _overlap(ny, ny, percent))
    open_ = F.col("x_packed").bitwiseAND(F.col("y_packed")).bitwiseAND(F.lit(1)) == 0
    longer = (nx > ny) | ((nx == ny) & (F.col("x_cid") > F.col("y_cid")))
    left = F.least(nx - px, ny - py)  # positions from 0: the token itself counts
    joined = x.join(y, "token").filter(longer & open_ & (100 * ny >= percent * nx) & _enough(left, nx, ny, percent) & _possible(nx, ny, (F.col("x_b0"), F.col("x_b1")), (F.col("y_b0"), F.col("y_b1")), percent))
    return joined.select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b")).distinct()


def _by_sketch(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose sketches do not rule them out: parities of the words in ``SKETCH`` times 64 bits, which are much narrower than the words.

    As with the bitmap, the bits that differ are at most the words that differ.
    """
    words = lines.select("cid", F.size("words").alias("n"), F.explode_outer("words").alias("h"))
    part, bit = F.call_function("shiftrightunsigned", F.col("h"), F.lit(6)).bitwiseAND(F.lit(SKETCH - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    sketch = words.groupBy("cid", "n").agg(*(F.bit_xor(F.when(part == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(SKETCH)))
    side = lambda c: sketch.select(F.col("cid").alias(c), F.struct("n", *(f"s{k}" for k in range(SKETCH))).alias(f"{c}_"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = sum((F.bit_count(F.col(f"a_.s{k}").bitwiseXOR(F.col(f"b_.s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("a_.s0").bitwiseXOR(F.col("b_.s0"))))
    nx, ny = F.col("a_.n"), F.col("b_.n")
    return met.filter(differ <= nx + ny - 2 * _overlap(nx, ny, percent)).select("a", "b")


def _later(pairs: DataFrame, classes: DataFrame, df: DataFrame, text: str, id_col: str, percent: int) -> DataFrame:
    """``(cid)``: the later line of each of the ``pairs(a, b)`` whose whole lines are similar enough, compared by their words' 64-bit hashes."""
    pairs, pairs_path = materialize(pairs, "line-pairs")
    asked = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    asked, asked_path = materialize(asked, "lines-asked")
    where = classes.select("cid", *_ORDER).join(sized(asked), "cid").groupBy("doc", "th").agg(F.collect_list(F.struct("no", "cid")).alias("want"))
    where, where_path = materialize(where, "lines-where")
    t = F.col(text).cast("string")
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("th"), t.alias("t"))
    met = texts.join(sized(where), ["doc", "th"]).select("doc", "th", F.split("t", "\n").alias("lines"), F.explode_outer("want").alias("w"))
    lines = met.select(F.col("w.cid").alias("cid"), F.struct("doc", F.col("w.no").alias("no"), "th").alias("at"), F.array_distinct(_hashes(F.get("lines", F.col("w.no")))).alias("words"))
    lines, lines_path = materialize(lines, "lines-words")
    paths = [pairs_path, asked_path, where_path, lines_path]
    if lines.count() != asked.count():  # rows that repeat a document
        lines, once = materialize(lines.dropDuplicates(["cid"]), "lines-once")
        paths.append(once)
    near, near_path = materialize(_by_sketch(pairs, lines, percent), "lines-near")
    both = near.join(lines.select(F.col("cid").alias("a"), F.struct("at", "words").alias("x")), "a").join(lines.select(F.col("cid").alias("b"), F.struct("at", "words").alias("y")), "b")
    common = F.size(F.array_intersect("x.words", "y.words"))
    same = both.filter((100 + percent) * common >= percent * (F.size("x.words") + F.size("y.words")))
    found, _ = materialize(same.select(F.when(F.col("x.at") > F.col("y.at"), F.col("a")).otherwise(F.col("b")).alias("cid")).distinct(), "lines-later")
    for path in [*paths, near_path]:
        discard(df.sparkSession, path)
    return found


def dedup_lines(df: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 80, min_words: int = 1, sketch_bits: int = 17, keys: int = 4, parts: int = 2) -> DataFrame:
    """``(row, text, n_lines, removed)`` for every row of ``df``: its text without lines that came before.

    Lines are parts between \\n; a line's tokens are its distinct words.  A line of at least
    ``min_words`` words goes if an earlier line, by (doc_id, line number), is equal to it or has a Jaccard
    similarity of ``percent`` / 100 or more with it; whether that earlier line stays does not
    matter.  ``removed`` are the numbers of the lines that went, from 0; shorter lines always stay, and lines without words.

    Equal lines are one class: its first line counts, whatever the number of copies, and equality is
    that of 128 bits of hash.  Each class is first compared with the first ones that share a token with it; that settles
    almost all of a large group of near copies by one row each.  Then all classes are joined on prefix tokens, but pairs in which
    both lines are settled; candidates of either step are verified on their words.  Tables that
    are measured to be small are broadcast, others meet by key.

    A null text stays null, with no lines; an empty text has one line, which stays; a very long text or line is one row, whole.
    A null doc_id comes first in order.  Rows that repeat a document get the same
    decision; different texts under one doc_id are told apart; where they tie in doc_id and line number, a hash of the text decides.
    An empty table gives an empty result.  The input row is kept whole in ``row``, so no column can clash.
    """
    spark = df.sparkSession
    lines = _lines(df, text, id_col)
    classes, classes_path = materialize(_classes(lines, rarity_levels(df, text, sketch_bits), percent, min_words), "lines")
    settled = _later(_through_pivots(classes, percent, keys), classes, df, text, id_col, percent)
    marked = classes.select("cid", "n", "b0", "b1", "prefix").join(sized(settled).withColumn("s", F.lit(True)), "cid", "left").select("cid", "n", "b0", "b1", "prefix", F.coalesce("s", F.lit(False)).alias("settled"))
    pairs, held = None, []
    for part in range(parts):
        some, path = materialize(_by_prefix(marked, percent, part, parts), "line-candidates")
        pairs = some if pairs is None else pairs.unionByName(some)
        held.append(path)
    found = _later(pairs.distinct(), classes, df, text, id_col, percent)
    for path in held:
        discard(spark, path)
    later, _ = materialize(settled.unionByName(found).distinct(), "lines-all-later")
    heads = classes.select("cid", "h1", "h2", "copies", F.struct(*_ORDER).alias("first")).join(sized(later).withColumn("later", F.lit(True)), "cid", "left")
    heads, heads_path = materialize(heads.filter("later or copies > 1").select("h1", "h2", "first", F.coalesce("later", F.lit(False)).alias("later")), "line-heads")
    discard(spark, classes_path)
    here = lines.select("doc", "th", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))
    gone = here.join(sized(heads), ["h1", "h2"]).filter(F.col("later") | (F.struct(*_ORDER) != F.col("first"))).groupBy("doc", "th").agg(F.array_sort(F.collect_set("no")).alias("removed"))
    gone, _ = materialize(gone, "lines-gone")
    discard(spark, heads_path)
    t = F.col("row").getField(text).cast("string")
    rows = as_row(df).select("row", F.coalesce(F.col("row").getField(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("th"))
    met = rows.join(sized(gone), ["doc", "th"], "left").select("row", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    met = met.withColumn("lines", F.split(t, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    left = F.when(F.size("removed") == 0, t).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return met.select("row", left.alias("text"), F.when(t.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), "removed")
