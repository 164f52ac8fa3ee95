"""Quality rules and ranked search against plain loops, on awkward rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sqlark.llm import lexical, quality_rules

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    "", None, " \n\t", "one two three", "a b c a b c a b c", "x\x1cy z", "#tag a|b <c> 100% $5 *&", "same line\nsame line\n\n \nSame line",
    "tab\tand\x0bvt\x0cff\rcr", "über straße 😀 größe", "a a a a a", "a b a b c a b", LONG, "\n".join(["the same line again"] * 40),
]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def test_counts_of_texts(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "b", " ", " ", "\n", "#"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: tuple(r.c) for r in df.select("doc_id", quality_rules.counted(F.col("text")).alias("c")).collect()}
    assert found == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 10, 300, 5000) for k in (0, 1, n // 50, n // 10, n) for p in (0.004, 0.05)]
    for p in (0.004, 0.05):
        df = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("tail")).collect():
            exact = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1))
            assert r.tail == pytest.approx(exact, rel=1e-9)


def labelled(spark, n=4000):
    """Good texts of 60 plain words, bad ones with many symbols; one good text in a thousand has some, too."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        good = i % 4 != 0
        symbols = 1 if good and i % 1001 == 1 else 0 if good else rng.randrange(2, 30)
        words = [f"w{rng.randrange(10**6)}" for _ in range(60 - symbols)] + ["|"] * symbols
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")


def test_cutoffs_limit_false_rejections(spark):
    docs, labels = labelled(spark)
    found = quality_rules.assess(docs, labels).join(labels, "doc_id").collect()
    lost = [r for r in found if r.quality == 1 and not r.kept]
    assert len(lost) <= quality_rules.RISK * 3000 and sum(r.quality == 0 and not r.kept for r in found) > 900
    tests = quality_rules.certify(quality_rules.assess(docs, labels), labels).collect()
    level = quality_rules.DELTA / (len(quality_rules.CUTOFFS) * (len(quality_rules.STRATA) + 1))
    share = quality_rules.RISK / len(quality_rules.CUTOFFS)
    for r in tests:
        tail = sum(math.comb(r.n, i) * share**i * (1 - share) ** (r.n - i) for i in range(min(r.k, 200) + 1))
        earlier = [t for t in tests if (t.stratum, t.rule) == (r.stratum, r.rule) and t.step <= r.step]
        assert r.certified == all(t.p_value <= level for t in earlier) and (r.k > 200 or r.p_value == pytest.approx(tail, rel=1e-6, abs=1e-12))
        assert r.n == 3000 and r.n_bad == 1000


def test_without_labels_nothing_goes(spark):
    docs, labels = labelled(spark, 200)
    assert quality_rules.assess(docs, labels.limit(0)).where(~F.col("kept")).count() == 0
    assert quality_rules.assess(docs, labels).where(~F.col("kept")).count() == 0  # 150 good texts certify no cutoff
    assert quality_rules.assess(docs.limit(0), labels).count() == 0


def test_quality_of_awkward_rows(spark):
    rows = [(i if i else None, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (3, LONG, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").withColumns({c: F.lit("x") for c in ("kept", "stratum", "cutoffs", "quality")})
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (99, 1), (4, None)], "doc_id long, quality int")
    found = quality_rules.digest(quality_rules.assess(docs, labels)).collect()
    assert len(found) == len(rows) and all(not r.base_failed or not r.kept for r in found)
    assert sorted(str(r.n_words) for r in found) == sorted(str(plain_counts(t)[0]) for _, t, _ in rows)


def plain_ranking(docs, items, best=20):
    terms = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, size = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, c, length in held:
            m = 100 - 25 + 25 * length * n // size
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, x[2], -x[0]) for rank, x in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "score", "item", "length")})
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    return sorted((tuple(r) for r in lexical.rank(docs.repartition(3), items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("bucket,block", [(7, 1 << 22), (2048, 60)])
def test_search_against_every_document(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = random.Random(bucket)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(5, docs[5][1]), (None, "w1 w2 w3"), (7000, None), (7001, ""), (7002, "!!"), (7003, "W1 É " * 3000)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(12)] + [(50, docs[5][1]), (51, "nowhere"), (52, None), (53, ""), (54, "W1, w1; É"), (None, "w2 w9"), (54, "w4")]
    assert ranked(spark, docs, items) == plain_ranking(docs, items)


def test_search_without_rows(spark):
    assert ranked(spark, [], [(1, "a")]) == ranked(spark, [(1, "a b")], []) == ranked(spark, [(1, None)], [(1, "a")]) == []
    assert ranked(spark, [(1, "a b"), (2, "c")], [(9, "a")], best=3) == plain_ranking([(1, "a b"), (2, "c")], [(9, "a")])
