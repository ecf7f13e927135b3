"""Quality rules as weak supervision (operator 1): DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_row, materialize, words_of

#: Fixed: characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Accuracies stay within these bounds, so that no rule decides alone and none is turned round.
ACCURACY = (0.55, 0.98)
#: Share of good documents before any vote.
PRIOR = 0.8


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` and the counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marked, n_short, n_bare.

    Words: runs of anything but ASCII white space.  n_dup_lines: lines with a word that equal an
    earlier line.  n_repeat_words: words in 3-word windows found twice or more.  n_marked: words
    that end in an exclamation mark.  n_short: words of at most 3 characters.
    n_bare: words of one to three symbols and nothing else.  Null has no words.
    """
    t = F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    step = as_row(df).withColumn("t", t).withColumn("w", words_of(F.col("t")))
    step = step.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\r\x0b\f", "")) > 0))
    n = F.size("w")
    window = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    step = step.withColumn("h", F.when(n >= 3, window).otherwise(F.array().cast("array<long>")))
    step = step.withColumn("distinct", F.size(F.array_distinct("h")))
    # only texts with a repeated window need the positions: sorted by hash, equal windows are neighbours
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    step = step.withColumn("s", F.when(F.col("distinct") < F.size("h"), pairs).otherwise(F.array().cast("array<struct<h:long,p:int>>")))
    k = F.size("s")
    same = lambda e, i: ((i > 0) & (F.get("s", i - 1)["h"] == e["h"])) | ((i < k - 1) & (F.get("s", i + 1)["h"] == e["h"]))
    step = step.withColumn("q", F.sort_array(F.transform(F.filter("s", same), lambda e: e["p"])))
    gaps = F.aggregate("q", F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("at")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["at"])).alias("sum"), p.alias("at")))
    repeat = F.when(F.size("q") > 0, gaps["sum"]).otherwise(0)
    return step.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("!(?=[ \t\n\x0b\f\r]|$)")).cast("long").alias("n_marked"),
        F.size(F.filter("w", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        F.regexp_count("t", F.lit(f"(?<![^ \t\n\x0b\f\r]){SYMBOLS}{{1,3}}(?![^ \t\n\x0b\f\r])")).cast("long").alias("n_bare"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote on the measured counts: 1 for good, -1 for junk, 0 to abstain."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.col(c) / n

    def vote(junk: Column, good: Column) -> Column:
        return F.when(junk, -1).when(good, 1).otherwise(0)

    return {
        "symbols": vote(rate("n_symbols") > 0.2, rate("n_symbols") < 0.05),
        "word_length": vote((rate("word_chars") > 8) | (rate("word_chars") < 3), (rate("word_chars") >= 3.5) & (rate("word_chars") <= 7)),
        "repeats": vote(rate("n_repeat_words") > 0.3, rate("n_repeat_words") < 0.15),
        "lines": vote((F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")), F.col("n_dup_lines") == 0),
        "shouting": vote(rate("n_marked") > 0.2, rate("n_marked") < 0.03),
        "bare_symbols": vote(rate("n_bare") > 0.15, rate("n_bare") < 0.02),
        "short_words": vote(F.col("n_short") - F.col("n_bare") < 0.1 * n, (F.col("n_short") - F.col("n_bare") > 0.2 * n) & (rate("n_short") < 0.7)),
        "length": vote(F.col("n_words") < 20, F.col("n_words") >= 50),
    }


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list[float], float]:
    """Expectation-maximisation over vote patterns and their counts: each rule's accuracy on good and on junk, and the prior.

    The latent class is good or junk; given it, rules vote independently, and whether a rule
    abstains says nothing.  At most 3 ** rules patterns come here, whatever the corpus.
    """
    m = len(patterns[0][0]) if patterns else 0
    good, junk, prior = [0.8] * m, [0.8] * m, PRIOR
    for _ in range(rounds):
        hit_g, all_g, hit_j, all_j, mass = [1.0] * m, [1.5] * m, [1.0] * m, [1.5] * m, [PRIOR, 1.0]
        for v, count in patterns:
            p = posterior(v, good, junk, prior)
            mass[0] += count * p
            mass[1] += count
            for i, x in enumerate(v):
                if x:
                    all_g[i] += count * p
                    all_j[i] += count * (1 - p)
                    hit_g[i] += count * p * (x > 0)
                    hit_j[i] += count * (1 - p) * (x < 0)
        lo, hi = ACCURACY
        good = [min(hi, max(lo, a / b)) for a, b in zip(hit_g, all_g, strict=True)]
        junk = [min(hi, max(lo, a / b)) for a, b in zip(hit_j, all_j, strict=True)]
        prior = min(0.98, max(0.5, mass[0] / mass[1]))
    return good, junk, prior


def weights(good: list[float], junk: list[float]) -> list[tuple[float, float]]:
    """What a vote for good, and one for junk, adds to the log odds."""
    return [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(good, junk, strict=True)]


def posterior(v: tuple[int, ...], good: list[float], junk: list[float], prior: float) -> float:
    z = math.log(prior / (1 - prior)) + sum(w[0] if x > 0 else w[1] for x, w in zip(v, weights(good, junk), strict=True) if x)
    return 1 / (1 + math.exp(-z))


def judge(df: DataFrame, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``row``, the counts, ``base_failed``, ``quality`` (posterior probability of good) and ``kept`` for every row of ``df``.

    ``base_failed``: n_words < 50, or 100 * n_repeat_words > 50 * n_words.  ``kept``: not base_failed
    and quality >= ``threshold``.  The rules' accuracies are estimated over all rows: their
    vote patterns are counted (at most 3 ** 8 groups, combined on the map side), and only these
    counts come to the driver.  Each text is measured once: counts and votes are written and read twice.

    Null and empty texts have no words, so the base rule fails them; a very long text is measured whole; repeated rows are
    judged alike and each is returned; an empty table gives an empty result.  The input row is kept in ``row``, so
    no column can clash: whole, or the columns ``keep`` of it.
    """
    counted = measured(df, text)
    if keep is not None:
        counted = counted.withColumn("row", F.struct(*(F.col("row").getField(c).alias(c) for c in keep)))
    rules = votes()
    voted, _ = materialize(counted.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items())), "quality-votes")
    names = [f"vote_{k}" for k in rules]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]
    good, junk, prior = fit_accuracies(sorted(patterns))
    z = F.lit(math.log(prior / (1 - prior)))
    for name, (up, down) in zip(names, weights(good, junk) or [(0.0, 0.0)] * len(names), strict=True):
        z = z + F.when(F.col(name) > 0, up).when(F.col(name) < 0, down).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-z))
    return voted.select("row", *(c for c in counted.columns if c != "row"), failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept"), *names)
