"""Toxicity by class-conditional Kneser-Ney models (operator 9)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold_of, materialize, texts_of, written_bytes
from marlstone.llm.tables import labelled_sample

#: Letters from a word's start that are nodes of their own; the whole word is the last node.
DEPTH = 8
#: Taken off every class count: beginnings seen no more often are left to the shared distribution.
DISCOUNT = 2.0
#: Taken off every continuation count of a class, and of all texts.
LOWER_DISCOUNT, SHARED_DISCOUNT = 1.0, 0.75
#: Letters of the contexts tried after a word's whole beginning.
SHORTER = (4, 3)
#: Different parts of words that a task counts in memory, at most, before it sends them on.
HELD_PARTS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def _path(word: str) -> list[tuple[str, str]]:
    """``(beginning, what follows it)`` along a word: each of its first letters, then its end or all the rest of it."""
    head = word[:DEPTH]
    return [(head[:k], head[k]) for k in range(len(head))] + [(head, "$" + word[DEPTH:])]


def _counted(rows: DataFrame, by: list[str], parts_of, names: list[str]) -> DataFrame:
    """``(*by, *names, n)``: how often each of ``parts_of(word)`` comes in the texts of ``rows(text, *by)``, exactly.

    Tasks send on their own sums, ``HELD_PARTS`` of them at a time; these meet by key, so the table grows with the words of the
    corpus and no task or driver holds it whole.
    """
    most_words = HELD_PARTS // len(parts_of("x" * (DEPTH - 1)))

    def sums(counts: dict[tuple, Counter]):
        found: Counter = Counter()
        for key, words in counts.items():
            for word, n in words.items():
                for part in parts_of(word):
                    found[(*key, *part)] += n
        items = list(found)
        for i in range(0, len(items), 1 << 16):
            part = items[i : i + (1 << 16)]
            cols = [pa.array(c, pa.int32() if k < len(by) else pa.string()) for k, c in enumerate(zip(*part, strict=True))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([found[x] for x in part], pa.int64())], names=[*by, *names, "n"])

    def run(batches):
        counts: dict[tuple, Counter] = {}
        for b in batches:
            texts, keys = texts_of(b.column(0)), list(zip(*(b.column(i + 1).to_pylist() for i in range(len(by))), strict=True)) or [()] * b.num_rows
            for t, key in zip(texts, keys, strict=True):
                counts.setdefault(key, Counter()).update(_WORD.findall(t.lower()))
                if sum(map(len, counts.values())) > most_words:
                    yield from sums(counts)
                    counts = {}
        yield from sums(counts)

    parts = rows.select("text", *by).mapInArrow(run, "".join(f"{c} int, " for c in by) + "".join(f"{c} string, " for c in names) + "n long")
    return parts.groupBy(*by, *names).agg(F.sum("n").alias("n"))


def _step_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, h, a, n)``: how often ``a`` follows the word beginning ``h``."""
    return _counted(rows, by, _path, ["h", "a"])


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of all texts: what both models back off to is counted from it."""
    return materialize(_counted(docs.select(F.col(text).cast("string").alias("text")), [], lambda w: [(w,)], ["word"]), "toxicity-words")[0]


def _contexts(h: str) -> list[str]:
    """The contexts of a letter after the word beginning ``h``: that beginning, then its last letters alone, four and three."""
    return [f"^{h}", *(h[-n:] for n in SHORTER if len(h) >= n)]


def continuations(words: DataFrame) -> DataFrame:
    """``(g, a, n)``: after how many different contexts of one letter more ``a`` follows ``g``, in all ``words(word)``, for ``g`` of 0 to 3 letters.

    A word's beginning is a context of its own: ``^`` stands before the first letter.  Words meet
    as pairs of a context of four letters and what follows it, so little travels.
    """
    length = F.least(F.length("word"), F.lit(DEPTH))
    at = F.transform(F.sequence(F.lit(0), length), lambda k: F.struct(F.when(k < 4, F.concat(F.lit("^"), F.substring("word", F.lit(1), k))).otherwise(F.substring("word", k - 3, F.lit(4))).alias("c"), F.when(k < length, F.substring("word", k + 1, F.lit(1))).otherwise(F.concat(F.lit("$"), F.substring("word", F.lit(DEPTH + 1), F.length("word")))).alias("a")))
    level, _ = materialize(words.select(F.explode_outer(at).alias("x")).select("x.*").distinct(), "toxicity-pairs")
    found = None
    for n in range(3, -1, -1):
        whole = F.length("c") == n + 1  # a context of one letter more, or a word's beginning of n letters
        counts, _ = materialize(level.filter(whole).groupBy(F.expr(f"right(c, {n})").alias("g"), "a").agg(F.count("*").alias("n")), "toxicity-continuations")
        found = counts if found is None else found.unionByName(counts)
        level = level.filter(~whole).unionByName(counts.select(F.col("g").alias("c"), "a"))
    return found


_CLASSES = {"a0": "y = 0", "a1": "y = 1", "b0": "y = 0 and last = 0", "b1": "y = 1 and last = 0"}


def class_tables(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(context, a, *counts)`` and ``(context, *t_counts, *g_counts)``: what the labelled texts of ``sample(text, y, fold)`` tell.

    ``a0`` and ``a1`` count in ordinary and toxic texts, ``b0`` and ``b1`` the same outside fold 1: words' steps by their
    beginning, and for the shorter contexts the different longer ones.  ``t_`` sums a context's counts, ``g_`` what they give
    up.  A step that no class has met more often than it gives up is as good as not met, and a context with no
    other step leaves all to the shorter one: neither is in the tables, and the models do not need them.
    """
    names = list(_CLASSES)
    rows = sample.select("text", F.col("y").cast("int").alias("y"), (F.col("fold") == 1).cast("int").alias("last"))
    met = _step_counts(rows, ["y", "last"]).groupBy("h", "a").agg(*(F.sum(F.expr(f"if({c}, n, 0)")).alias(k) for k, c in _CLASSES.items()))
    met, _ = materialize(met, "toxicity-met")
    once = [F.sum((F.col(k) > 0).cast("long")).alias(k) for k in names]
    levels = [met.select(F.concat(F.lit("^"), "h").alias("context"), "a", *names, F.lit(DISCOUNT).alias("d"))]
    longer = None
    for size in SHORTER:
        starts = met.filter(F.length("h") == size if longer else F.length("h") >= size).select(F.col("h").alias("context"), "a", *names)
        longer = (longer.unionByName(starts) if longer else starts).groupBy(F.expr(f"right(context, {size})").alias("context"), "a").agg(*once)
        levels.append(longer.withColumn("d", F.lit(LOWER_DISCOUNT)))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every, _ = materialize(every, "toxicity-classes")
    tells = F.greatest(*names) > F.col("d")
    sums = [F.sum(k).alias(f"t_{k}") for k in names] + [F.sum(F.least(F.col(k), F.col("d"))).alias(f"g_{k}") for k in names]
    contexts = every.groupBy("context").agg(*sums, F.bool_or(tells).alias("tells")).filter("tells").drop("tells")
    return every.filter(tells).drop("d"), contexts


def shared_model(counts: DataFrame) -> DataFrame:
    """``(g, a, p)``: P(a | g) of all texts for ``g`` of 0 to 3 letters: interpolated Kneser-Ney over the counts of ``continuations``."""
    sums = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    counts, _ = materialize(counts.join(sums, "g"), "toxicity-counts")
    p = lambda lower: ((F.col("n") - SHARED_DISCOUNT + SHARED_DISCOUNT * F.col("kinds") * lower) / F.col("total")).alias("p")
    level = counts.filter("g = ''").select("g", "a", p(1 / (F.col("kinds") + 1)))
    found = level
    for n in range(1, 4):
        here = counts.filter(F.length("g") == n).withColumn("below", F.expr(f"right(g, {n - 1})"))
        level, _ = materialize(here.join(level.select(F.col("g").alias("below"), "a", F.col("p").alias("lower")), ["below", "a"]).select("g", "a", p(F.col("lower"))), "toxicity-shared")
        found = found.unionByName(level)
    return found


def class_models(steps_: DataFrame, contexts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(context, a, *P)`` and ``(context, *left)`` per class count: P(a | context), and what a context leaves to the next shorter one.

    Interpolated Kneser-Ney: each count gives up ``DISCOUNT`` (a continuation count ``LOWER_DISCOUNT``), and what a
    context's followers give up goes to them by the next shorter context; the last one goes to all texts.  A step that the tables
    do not hold has no count left: its P is what its context leaves times P by the next shorter one.
    """
    names = list(_CLASSES)
    lefts, _ = materialize(contexts.select("context", *(f"t_{c}" for c in names), *(F.when(F.col(f"t_{c}") > 0, F.col(f"g_{c}") / F.col(f"t_{c}")).otherwise(1.0).alias(f"l_{c}") for c in names)), "toxicity-lefts")
    plain = F.expr("replace(context, '^', '')")
    rows = steps_.join(lefts, "context").withColumn("plain", plain).withColumn("g", F.expr("right(plain, 3)")).join(shared, ["g", "a"], "left")
    rows = rows.select("context", "a", "plain", *names, *lefts.columns[1:], *(F.coalesce("p", F.lit(1e-12)).alias(f"p_{c}") for c in names))
    rows, _ = materialize(rows, "toxicity-rows")
    found, done = None, []
    for n in [*sorted(SHORTER), 0]:
        first = F.col("context").startswith("^")
        here = rows.filter(~first & (F.length("context") == n)) if n else rows.filter(first)
        for size, known in done:  # P by ever longer contexts, as far as the letters before ``a`` go
            here = here.withColumn("k", F.when(F.length("plain") >= size, F.expr(f"right(plain, {size})")))
            here = here.join(known.select(F.col("context").alias("k"), "a", *(F.col(f"p_{c}").alias(f"q_{c}") for c in names)), ["k", "a"], "left")
            here = here.join(lefts.select(F.col("context").alias("k"), *(F.col(f"l_{c}").alias(f"m_{c}") for c in names)), "k", "left")
            lower = [F.coalesce(f"q_{c}", F.coalesce(f"m_{c}", F.lit(1.0)) * F.col(f"p_{c}")).alias(f"p_{c}") for c in names]
            here = here.select("context", "a", "plain", *names, *lefts.columns[1:], *lower)
        kept = lambda c: F.when(F.col(f"t_{c}") > 0, F.greatest(F.col(c) - (LOWER_DISCOUNT if n else DISCOUNT), F.lit(0.0)) / F.col(f"t_{c}")).otherwise(0.0)  # noqa: B023, E731
        here, _ = materialize(here.select("context", "a", *((kept(c) + F.col(f"l_{c}") * F.col(f"p_{c}")).alias(f"p_{c}") for c in names)), "toxicity-class")
        found = here if found is None else found.unionByName(here)
        done.append((n, here))
    return found, lefts


def log_ratios(words: DataFrame, sample: DataFrame) -> dict[str, tuple[pa.Table, pa.Table]]:
    """Per pair of classes (``a``: all labelled texts, ``b``: those outside fold 1) the two tables that give a word's ratio.

    ``(key, r)``: log P(a | context, toxic) - log P(a | context, ordinary) by ``context + a`` where a class has met it, and what is added on
    the way from a context to a shorter one.  Both have the size of the bounded sample; all else was counted and joined by key.
    """
    steps_, contexts = class_tables(sample)
    steps_, _ = materialize(steps_, "toxicity-steps-kept")
    p, lefts = class_models(steps_, contexts, shared_model(continuations(words)))
    ratio = lambda one, two: F.log(F.greatest(F.col(one), F.lit(1e-300)) / F.greatest(F.col(two), F.lit(1e-300)))
    told = p.select(F.concat("context", "a").alias("key"), *(ratio(f"p_{c}1", f"p_{c}0").alias(c) for c in "ab")).toArrow()
    passed = lefts.select(F.col("context").alias("key"), *(ratio(f"l_{c}1", f"l_{c}0").alias(c) for c in "ab")).toArrow()
    return {c: tuple(t.select(["key", c]).rename_columns(["key", "r"]) for t in (told, passed)) for c in "ab"}


def looked_up(model: tuple[pa.Table, pa.Table]) -> tuple[dict[str, float], dict[str, float]]:
    return tuple(dict(zip(t.column("key").to_pylist(), t.column("r").to_pylist(), strict=True)) for t in model)


def _word_ratio(word: str, known: dict[str, float], passing: dict[str, float]) -> float:
    """log P(word | toxic) - log P(word | ordinary)."""
    total = 0.0
    for h, a in _path(word):
        for context in _contexts(h):
            r = known.get(context + a)
            if r is not None:
                total += r
                break
            total += passing.get(context, 0.0)
    return total


def telling(words: DataFrame, model: tuple[pa.Table, pa.Table], margin: float) -> DataFrame:
    """``(word, excess)`` of those ``words(word)`` whose log ratio exceeds ``margin``: each different word is rated once, however often it comes."""
    held = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ratios = looked_up(held.value)
        for b in batches:
            every = b.column(0).to_pylist()
            excess = [_word_ratio(w, *ratios) - margin for w in every]
            kept = [(w, x) for w, x in zip(every, excess, strict=True) if x > 0]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([x for _, x in kept], pa.float64())], names=["word", "excess"])

    return materialize(words.select("word").mapInArrow(run, "word string, excess double"), "toxicity-telling")[0]


def normalised(rows: DataFrame, words: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """``(key, x)`` for every row of ``rows(key, text)``: the excess of its words, which ``words(word, excess)`` hold where it is not 0, by the number of its words.

    That table grows with the corpus.  If it is measured to be small it is broadcast; beyond that a text's different words meet it by key.
    """
    if written_bytes(words) <= most_bytes:
        held = rows.sparkSession.sparkContext.broadcast(words.toArrow())

        def run(batches):
            excess = dict(zip(held.value.column("word").to_pylist(), held.value.column("excess").to_pylist(), strict=True))
            for b in batches:
                out = np.zeros(b.num_rows)
                for i, t in enumerate(texts_of(b.column(1))):
                    found = _WORD.findall(t.lower())
                    if found:
                        out[i] = sum(excess[w] for w in found if w in excess) / len(found)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["key", "x"])

        return rows.mapInArrow(run, "key long, x double")

    def split(batches):
        for b in batches:
            for at, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                found = Counter(_WORD.findall(t.lower()))
                size = max(1, found.total())
                share = [("", 0.0), *((w, n / size) for w, n in found.items())]  # the empty word keeps texts without words
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(share), pa.int64()), pa.array([key] * len(share), pa.int64()), pa.array([w for w, _ in share]), pa.array([x for _, x in share])], names=["at", "key", "word", "share"])

    marked, _ = materialize(rows.select(F.monotonically_increasing_id().alias("at"), "key", "text"), "toxicity-texts")
    shares = marked.mapInArrow(split, "at long, key long, word string, share double")
    met = shares.join(words, "word", "left").groupBy("at", "key").agg(F.sum(F.col("share") * F.coalesce("excess", F.lit(0.0))).alias("x"))
    return met.select("key", "x")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and a constant by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w * np.r_[np.ones(len(w) - 1), 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * 1e-2 + np.diag(np.r_[np.full(len(w) - 1, ridge), 1e-6])
        w -= np.linalg.solve(hess, grad)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", most_rows: int = 20_000, threshold: float = 0.5, margin: float = 4.0) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Two Kneser-Ney models of words by their letters, of toxic and of ordinary texts, are fitted on
    at most ``most_rows`` labelled rows outside fold 0, up to half of them toxic.  A letter's context is
    the word so far, then its last four and three letters, by continuation counts, so rare
    forms of an expression share what their beginning or their middle tells; below these both models back
    off to one distribution, the continuation counts of *all* texts, which grow with the corpus.

    A whole text's score comes from one number, its length-normalised log-likelihood ratio: the words' ratios over the number of words.
    A word's ratio counts as far as it exceeds ``margin``: ratios below are what class counts of ordinary words, and
    the shares of the languages, differ by chance.  That number's logarithm becomes a probability by logistic regression,
    fitted on the rows of fold 1 with models of the other rows, at the labels' own class shares.

    Words are letters, lower-cased.  Null and empty texts have ratio 0 and a score all the same; a very long text is read whole.  Without labels of
    both classes every score is 0.  Repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, text, id_col, most_rows, balanced=True)
    words = corpus_words(docs, text)
    models = log_ratios(words, sample)
    unseen = sample.filter("fold = 1").select(F.col("y").cast("long").alias("key"), "text")
    own, _ = materialize(_counted(unseen, [], lambda w: [(w,)], ["word"]), "toxicity-unseen")
    seen = normalised(unseen, telling(own, models["b"], margin)).toPandas()
    x, y = np.log(seen[["x"]].to_numpy() + 1e-3), seen["key"].to_numpy().astype(float)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    scores = normalised(rows, telling(words, models["a"], margin))
    if len(set(y)) < 2:
        z = F.lit(-30.0)
    else:
        slope, level = _logistic(x, y)
        share = labels.filter(F.col(label).isin(0, 1) & (fold_of(F.col(id_col)) != 0)).agg(F.avg(F.col(label))).first()[0]
        level += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
        z = float(level) + float(slope) * F.log(F.col("x") + 1e-3)
    score = 1 / (1 + F.exp(-z))
    return scores.select(F.col("key").alias("doc_id"), (fold_of(F.col("key")) == 0).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
