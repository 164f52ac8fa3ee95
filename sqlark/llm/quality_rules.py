"""Quality rules whose cutoffs carry a bound on false rejections.

Method: risk-controlled thresholds. A rule rejects a text whose *badness* is
above a cutoff; each rule has a fixed list of cutoffs from lenient to strict, so
every labelled document is a holdout. In each stratum (texts by length) a cutoff
is certified if the exact binomial bound says that at most ``RISK / rules`` of
the good documents are rejected: P(Bin(n, RISK / rules) <= k) <= level for k
rejected ones of n, which is the same as a Clopper-Pearson upper bound of at most
that share. Stricter cutoffs reject more, so the cutoffs of a rule are tested in
order at one level and the first failure ends the list; over rules and strata the
level is ``DELTA / (rules * strata)``. With probability 1 - DELTA, no stratum
loses more than ``RISK`` of its good documents to all rules together.

Of the certified cutoffs the one is taken that rejects most bad documents, the
most lenient of equal ones, and none if it hits good ones as often as bad ones.
A stratum without enough labels has no rules: nothing is certified, nothing goes.

Only DataFrame functions. Texts are read once; their counts, one narrow row a
document, are a written table. Labels are joined to it, counted by stratum, rule
and position in the list (combined before the shuffle), and the certified cutoffs,
one row for each of the three strata, are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlark.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50
WINDOW = 3
#: Largest share of a stratum's good documents that all rules together may reject, and the probability to be wrong.
RISK, DELTA = 0.02, 0.05
#: Strata: texts of up to so many words, and all longer ones.
STRATA = (200, 1000)
#: Cutoffs from lenient to strict. Shares are per mille, mean word lengths are hundredths of a code point.
CUTOFFS = {
    "symbols": (900, 700, 500, 300, 200, 150, 100, 70, 50, 30, 20, 10),
    "repeated_lines": (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100),
    "repeated_words": (900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 50),
    "long_words": (5000, 3000, 2000, 1500, 1200, 1100, 1000, 950, 900, 850, 800),
    "short_words": (-100, -150, -200, -250, -275, -300, -325, -350, -375, -400),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def neighbours(ordered: Column, key: str) -> Column:
    """``i`` of the elements ``(key, i)`` of an ordered array whose key stands there twice or more."""
    same = lambda x, y: x[key].eqNullSafe(y[key])
    found = F.transform(
        ordered, lambda x, j: F.when(same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)), x["i"])
    )
    return F.filter(found, lambda i: i.isNotNull())


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more.

    Windows are compared by hash; only those whose hash occurs twice are written out and compared as text.
    """
    last = F.size(words) - WINDOW
    none = F.lit(0).cast("long")
    at = lambda i: [F.get(words, i + j) for j in range(WINDOW)]

    def covered(hashes: Column) -> Column:
        hashed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        likely = let(hashed, lambda s: neighbours(s, "h"))
        written = F.sort_array(F.transform(likely, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("w"), i.alias("i"))))
        starts = let(written, lambda s: F.sort_array(neighbours(s, "w")))
        new = lambda r: F.transform(r, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(r, j + 1) - x, F.lit(WINDOW))))
        return let(starts, lambda r: F.aggregate(new(r), none, lambda a, x: a + x))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*at(i)))
    unique = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return F.when(last < 1, none).otherwise(let(hashes, lambda h: F.when(unique(h), none).otherwise(covered(h))))


def counted(text: Column) -> Column:
    """A struct of ``COUNTS``: words, their code points, symbols, lines equal to an
    earlier line, words in repeated windows, and lines with a word."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    long = lambda x: x.cast("long")
    return let(
        F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines")),
        lambda v: F.struct(
            long(F.size(v["words"])).alias("n_words"),
            F.aggregate(v["words"], F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOL))).alias("n_symbols"),
            long(F.size(v["lines"]) - F.size(F.array_distinct(v["lines"]))).alias("n_dup_lines"),
            let(v["words"], repeated_words).alias("n_repeat_words"),
            long(F.size(v["lines"])).alias("n_lines"),
        ),
    )


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    found = F.lit(len(STRATA))
    for i, most in reversed(list(enumerate(STRATA))):
        found = F.when(F.col("n_words") <= most, i).otherwise(found)
    return found


def badness() -> dict[str, Column]:
    """What each rule compares with its cutoff; null where there is nothing to divide by."""
    per = lambda factor, count, of: F.expr(f"({factor} * {count}) div nullif({of}, 0)")
    return {
        "symbols": per(1000, "n_symbols", "n_words"),
        "repeated_lines": per(1000, "n_dup_lines", "n_lines"),
        "repeated_words": per(1000, "n_repeat_words", "n_words"),
        "long_words": per(100, "word_chars", "n_words"),
        "short_words": -per(100, "word_chars", "n_words"),
    }


def log_gamma(x: Column) -> Column:
    """ln(Gamma(x)) for x >= 1 by Stirling's series, moved up by eight for its error to vanish."""
    up = x + 8.0
    below = F.lit(0.0)
    for i in range(8):
        below = below + F.log(x + float(i))
    series = 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * F.pow(up, F.lit(5.0)))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - below


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). Terms 40 standard deviations below the mean are zero in a double."""
    n = n.cast("double")
    low = F.greatest(F.lit(0), F.floor(n * p - 40 * F.sqrt(n * p * (1 - p)) - 40)).cast("long")
    term = lambda i: F.exp(
        log_gamma(n + 1) - log_gamma(i + 1) - log_gamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    )
    summed = F.aggregate(F.sequence(low, k), F.lit(0.0), lambda a, i: a + term(i.cast("double")))
    return F.when(k < low, 0.0).otherwise(summed)


def certify(assessed: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The test of every cutoff: ``stratum``, ``rule``, ``step`` (its place in the
    list), ``cutoff``, ``n`` good and ``n_bad`` bad labelled documents, ``k`` and
    ``k_bad`` of them rejected, ``p_value``, ``certified``.

    ``assessed`` has ``doc_id`` and ``COUNTS``. A document is good if all its
    labels have quality 1; documents without a label, with a null one, or that
    fail the base rules take no part.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    unbroken = lambda bad, cutoffs: F.size(F.filter(F.lit(list(cutoffs)), lambda c: ~F.coalesce(bad > c, F.lit(False))))
    rules = F.array(
        *[F.struct(F.lit(rule).alias("rule"), unbroken(bad, CUTOFFS[rule]).alias("first")) for rule, bad in badness().items()]
    )
    held = (
        assessed.where(~base_failed())
        .join(known, "doc_id")
        .select(stratum().alias("stratum"), (F.col("quality") == 1).alias("good"), F.explode(rules).alias("r"))
        .groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.first").alias("first"))
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    # three strata, five rules and a dozen cutoffs from here on
    steps = F.create_map(*[x for rule, c in CUTOFFS.items() for x in (F.lit(rule), F.lit(list(c)))])
    rows = (
        held.groupBy("stratum", "rule")
        .agg(F.collect_list(F.struct("first", "good", "bad")).alias("hits"), F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
        .select("*", F.posexplode(steps[F.col("rule")]).alias("step", "cutoff"))
    )
    total = lambda part: F.aggregate(
        "hits", F.lit(0).cast("long"), lambda a, h: a + F.when(h["first"] <= F.col("step"), h[part]).otherwise(0)
    )
    tested = rows.select("stratum", "rule", "step", "cutoff", "n", "n_bad", total("good").alias("k"), total("bad").alias("k_bad"))
    level = delta / (len(CUTOFFS) * (len(STRATA) + 1))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    return tested.withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), risk / len(CUTOFFS))).withColumn(
        "certified", F.max("p_value").over(order) <= level
    )


def chosen(tests: DataFrame) -> DataFrame:
    """``stratum`` and ``cutoffs``, a map from rule to cutoff, of the certified cutoffs that reject most bad documents."""
    useful = tests.where(F.col("certified") & (F.col("k_bad") * F.col("n") > F.col("k") * F.col("n_bad")))
    best = useful.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("k_bad", -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def assess(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``doc_id``, ``COUNTS``, ``stratum``, ``base_failed``, ``broken`` (names of the
    rules that reject the text) and ``kept`` for every row of ``docs``.

    A null text has no words and fails the base rules, as does an empty one. Rows
    that repeat an id or have a null one are judged each by their own text; a null
    id has no label. Without documents or labels the result has its rows and no
    rule but the base ones. Other columns are not read.
    """
    # a generator, as a projection of the struct's fields would count once for each of them
    counts = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.inline(F.array(counted(F.col(text))))), "quality-counts")
    cutoffs = chosen(certify(counts, labels, risk, delta))
    broken = F.array_compact(
        F.array(*[F.when(b > F.col("cutoffs")[rule], F.lit(rule)) for rule, b in badness().items()])
    )
    # at most one row for each stratum, of which there are three
    joined = counts.withColumn("stratum", stratum()).join(F.broadcast(cutoffs), "stratum", "left")
    return joined.select("doc_id", *COUNTS, "stratum", base_failed().alias("base_failed"), broken.alias("broken")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0)
    )


def digest(assessed: DataFrame) -> DataFrame:
    return assessed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
