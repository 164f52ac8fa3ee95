"""Each operator on awkward rows, and against brute force on small ones."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare
from sqlark.llm import ann, bpe, brown, decontaminate, language, line_dedup, near_dedup, secret_scan, token_files, toxicity
from sqlark.llm.oracles import ORACLES
from sqlark.llm.queries import QUERIES, word_tokenizer
from tests.conftest import SMALL_DATA

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "Alpha beta, gamma delta epsilon zeta eta THETA", None, None),
    (3, None, "en", "b"),
    (4, "", "de", "b"),
    (5, "!!! ???", "de", None),
    (6, "!!! ???", None, "c"),
    (None, "der die das und nicht", "de", "c"),
    (7, LONG, "en", "c"),
    (8, "über straße größe <|endoftext|> 'sΣ x\x1cy 12½", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, start string"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with nulls, repeats, long and empty texts, and columns whose names operators use themselves."""
    plain = spark.createDataFrame(ROWS, SCHEMA)
    return plain.select("*", *[F.lit(1).alias(c) for c in ("n", "word", "n_lines", "score", "point", "ids", "node", "kept")])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, SMALL_DATA).toPandas()
    assert compare.differences(found, compare.duck(SMALL_DATA).execute(ORACLES[name]).df()) is None


def test_near_duplicates_of_awkward_rows(docs, none):
    found = near_dedup.duplicate_classes(docs).collect()
    classes = {r.doc_id: r.class_id for r in found}
    assert len(found) == len(ROWS)
    assert classes[1] == classes[2] == 1 and classes[5] == classes[6] == 5
    assert classes[3] == 3 and classes[4] == 4 and classes[7] == 7
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "7", "8", "None"]
    assert near_dedup.duplicate_classes(none).count() == near_dedup.keep_one(none).count() == 0


def test_near_duplicates_against_every_pair(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    shingles = [Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]

    def similarity(x, y):
        keys = set(x) | set(y)
        return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y))

    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if set(shingles[i]) & set(shingles[j]) and similarity(shingles[i], shingles[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.duplicate_classes(df).collect()} == {i: root(i) for i in range(len(texts))}


def test_registers_agree_with_the_similarity():
    rng = np.random.default_rng(1)
    a = [f"w{i}" for i in rng.integers(0, 400, 600)]
    texts = [" ".join(a), " ".join(a[:540])]
    owner, shingles, weights, _ = near_dedup.shingle_sets(texts)
    held = near_dedup.registers(owner, shingles, weights, 2)
    cut = np.searchsorted(owner, 1)
    exact = near_dedup.probability_jaccard(shingles[:cut], weights[:cut], shingles[cut:], weights[cut:])
    assert abs((held[0] == held[1]).mean() - exact) < 0.15
    assert near_dedup.probability_jaccard(np.array([1, 2]), np.array([2, 1]), np.array([1, 3]), np.array([1, 1])) == pytest.approx(2 / 5)


def test_a_large_group_of_different_copies_is_one_class(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(80):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in near_dedup.duplicate_classes(df).collect()} == {0}


def test_pairs_within_a_boilerplate_family_below_the_threshold(spark):
    """Texts have a similarity of 0.73 to every other one, planted pairs of 0.81."""
    rng = random.Random(7)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    shared = [f"b{i}" for i in range(174)]
    texts = []
    for i in range(120):
        common = fresh(10)
        texts += [" ".join(shared + common + fresh(21)) for _ in range(2)] if i < 60 else [" ".join(shared + fresh(31))]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    wanted = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                wanted[i] = wanted[j]
    assert sum(i != c for i, c in enumerate(wanted)) == 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.duplicate_classes(df).collect()} == dict(enumerate(wanted))


def test_bound_of_the_similarity():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(2))
        x, y = (rng.integers(1, rng.integers(2, 9), len(v)).astype(np.int32) for v in (a, b))
        p, q = near_dedup.common_shares([(a, x), (b, y)], np.array([0]), np.array([1]))
        bound, exact = near_dedup.at_most(p, q)[0, 0], near_dedup.probability_jaccard(a, x, b, y)
        assert exact <= bound + 1e-6
        if x.max() == y.max() == 1:
            assert exact == pytest.approx(bound, abs=1e-6)


@pytest.mark.parametrize("size", [200, 800])
def test_a_large_family_makes_rows_in_proportion(spark, size, monkeypatch):
    """Texts of 0.7 to every other one: tiles take each text a few times and hand on no pair of different classes."""
    rng = random.Random(size)
    shared = [f"b{i}" for i in range(170)]
    texts = [" ".join(shared + [f"x{rng.randrange(10**9)}" for _ in range(30)]) for _ in range(size)]
    texts[-1] = texts[0] + " one more"
    made = {}
    written = near_dedup.materialize

    def counted(df, name):
        out = written(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(near_dedup, "TILE", 128)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in near_dedup.duplicate_classes(df).collect()}
    assert classes == {i: 0 if i == size - 1 else i for i in range(size)}
    assert made["candidates"] <= near_dedup.BANDS * size and made["open-buckets"] <= near_dedup.BANDS * size
    assert made["links"] <= 1


def test_languages(spark, docs, none):
    german, english = "der die das und nicht ist ein schön", "the and that with this from they have"
    rows = [(i, german if i % 2 else english, "de" if i % 2 else "en") for i in range(20)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.names == ["de", "en"]
    mixed = " ".join([german] * 6 + [english] * 3)
    table = spark.createDataFrame([(1, german), (2, english), (3, mixed), (4, "12 !"), (5, None), (6, "")], "doc_id long, text string")
    found = by_id(language.identify(table, learned))
    assert [found[i].lang_pred for i in range(1, 7)] == ["de", "en", "de", "und", "und", "und"]
    assert found[3].langs == ["de", "en"] and found[3].score == pytest.approx(2 / 3, abs=0.05)
    assert language.identify(docs, language.learn(docs)).count() == len(ROWS)
    assert {r.lang_pred for r in language.identify(docs, language.learn(none)).collect()} == {"und"}


def reference_secrets(text):
    kinds = {
        "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    order = list(kinds)
    spans = [(m.start(), order.index(k), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m)]
    return sorted(spans)


def test_secrets(spark, docs, none):
    rng = random.Random(2)
    pieces = ["password=", "token: ", "api_key", "APIKEY", ' = "', "secret:", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "é😀", " ", "\n", "abc", "=", "x-y/z"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts += ["secret:token: abcdefgh", "", "key Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1 end", "id 123e4567-e89b-12d3-a456-426614174000"]
    found = by_id(secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        assert [tuple(s) for s in found[i].found if s.kind_no < 3] == reference_secrets(text), text
    assert [tuple(s) for s in found[len(texts) - 2].found] == [(4, 3, 31)]
    assert found[len(texts) - 1].found == []
    assert secret_scan.digest(secret_scan.find_secrets(docs)).count() == len(ROWS)
    assert secret_scan.find_secrets(none).count() == 0


def test_entropy_of_windows_is_that_of_their_counts(spark):
    def bits(text, window):
        parts = [Counter(text[i : i + window]) for i in range(len(text) - window + 1)]
        return max(-sum(c / window * np.log2(c / window) for c in p.values()) for p in parts)

    rng = random.Random(4)
    texts = ["".join(rng.choice("abAB01xyZ9"[: rng.randrange(3, 11)]) for _ in range(rng.randrange(24, 60))) for _ in range(60)]
    limits = {"hex": 2.111, "alnum": 2.777, "base64": 9.0}
    found = by_id(secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), entropy=limits))
    for i, t in enumerate(texts):
        mixed = re.search("[0-9]", t) and re.search("[A-Za-z]", t)
        kind = "hex" if re.fullmatch("[0-9a-fA-F]+", t) else "alnum"
        assert any(s.kind_no == 3 for s in found[i].found) == bool(mixed and bits(t, 20) >= limits[kind])


def test_long_candidates_and_many_matches_take_linear_time(spark):
    """A megabyte of base64 and a hundred thousand matches in one text, and the windows at the borders of pieces."""
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    dull = lambda n: "xy1" * (n // 3) + "xy1"[: n % 3]
    secret = "Zx9Qw8Er7Ty6Ui5Op4As"
    texts = [dull(1_000_000), "password=abcdef " * 100_000, "".join(rng.choice(letters) for _ in range(300_000)), secret, secret[:19]]
    texts += [dull(at) + secret + dull(500) for at in (235, 236, 237, 240, 256, 257, 512)]
    texts += ["".join(rng.choice(letters[:52]) for _ in range(40)), "Donaudampfschifffahrtsgesellschaft"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    start = time.time()
    found = by_id(secret_scan.find_secrets(df))
    assert time.time() - start < 120
    assert not found[0].found and len(found[1].found) == 100_000 and found[1].found[-1].end == 16 * 100_000 - 1
    assert [tuple(s) for s in found[2].found if s.kind_no == 3] and [tuple(s) for s in found[3].found] == [(0, 3, 20)]
    assert not found[4].found and all([tuple(s) for s in found[i].found] == [(0, 3, len(texts[i]))] for i in range(5, 12))
    assert found[12].found and not found[13].found


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(10, "alpha beta gamma"), (11, "nowhere at all"), (12, None), (13, " . "), (None, "alpha beta"), (14, "Epsilon, ZETA")],
        "item_id long, text string",
    )
    found = by_id(decontaminate.contamination(docs, items))
    assert (found[1].n_words, found[1].n_hit, found[1].item_ids, found[1].contaminated) == (8, 5, ["10", "14"], True)
    assert found[3].n_words == found[5].n_words == 0 and not found[7].contaminated
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())
    assert decontaminate.contamination(none, items).count() == 0
    near = decontaminate.proximity_matches(docs, spark.createDataFrame([(1, "alpha gamma epsilon")], "item_id long, text string"), 2)
    assert {(r.doc_id, r.item_id) for r in near.collect()} == {(1, 1), (2, 1)}


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network({b"a": 1}, rng.normal(size=(2, toxicity.WORD_SIZE)))
    inputs = rng.normal(size=(2, 3, 5, 3 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 1, 1, 1, 0]], float)
    grad, d_inputs = net.backward(np.ones(3), net.forward(inputs, mask)[1])
    loss = lambda: net.forward(inputs, mask)[0].sum()

    def slope(array, at):
        old = array[at]
        array[at] = old + 1e-6
        up = loss()
        array[at] = old - 1e-6
        down = loss()
        array[at] = old
        return (up - down) / 2e-6

    for name in ("u", "aw", "ab", "av", "ow"):
        at = tuple(rng.integers(n) for n in net.p[name].shape)
        assert grad[name][at] == pytest.approx(slope(net.p[name], at), abs=1e-6)
    for at in ((0, 0, 1, 3), (1, 2, 0, 10), (0, 1, 1, 20)):
        assert d_inputs[at] == pytest.approx(slope(inputs, at), abs=1e-6)


def test_toxicity(spark, docs, none):
    rng = random.Random(1)
    plain = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        text = plain(rng.randrange(20, 150))
        if i % 3 == 0:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "rotten"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    network = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.digest(toxicity.score(table, network)).collect()
    unseen = [r for r in found if r.held_out]
    assert unseen and all(r.predicted == int(r.doc_id % 3 == 0) for r in unseen)
    scored = toxicity.score(docs, network)
    assert scored.count() == len(ROWS) and all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score(none, network).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, no_labels) is None
    left = toxicity.drop_toxic(docs, no_labels)
    assert left.columns == docs.columns and left.count() == len(ROWS)


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 56, 57, 200):
        windows, counts = toxicity._windows([np.arange(n)])
        assert set(range(n)) == set(windows[windows >= 0].tolist()) and counts[0] == len(windows)


def test_class_model_counts(spark, docs, none):
    model, counts = brown.fit(docs)
    found = brown.score(docs, model, counts).collect()
    total = Counter(w for _, t, *_ in ROWS for w in brown.tokens_of(t))
    n, v = sum(total.values()) + len(ROWS), len(total) + 1
    for r in found:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id)
        tokens = brown.tokens_of(text)
        base = sum(np.log10((total[w] + 1) / (n + v + 1)) for w in tokens) + np.log10((len(ROWS) + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens) + 1, len(tokens) + 1, n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    model, counts = brown.fit(none)
    assert {r.n_known for r in brown.score(docs, model, counts).collect()} == {0}


def test_words_of_many_texts_equal_those_of_each():
    generator = np.random.default_rng(5)
    letters = list("aAbBzZ \n\t\v\f\r\x00\x1c\x85\xa0é漢😀.,1")
    texts = [None, "", " ", "a", "b", *("".join(generator.choice(letters, n)) for n in generator.integers(0, 30, 500)), "x", None, ""]
    for array in (pa.array(texts), pa.array(texts)[3:400], pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        words, expected = brown.Words(array), [brown.tokens_of(t) for t in array.to_pylist()]
        flat = [w for tokens in expected for w in tokens]
        assert words.array.to_pylist() == flat
        assert words.sizes.tolist() == [len(tokens) for tokens in expected]
        assert words.shapes(np.arange(len(flat))).tolist() == [brown.shape_of(w) for w in flat]
        keys = pa.array([b"a", b"b", b"zz"], pa.large_binary())
        assert words.places(keys).tolist() == [{b"a": 0, b"b": 1, b"zz": 2}.get(w, -1) for w in flat]


def test_texts_are_scored_as_one_by_one(spark, monkeypatch):
    """Words of the lexicon, words beyond it, and words never seen, repeated in a text and across texts."""
    monkeypatch.setattr(brown, "most_frequent", partial(brown.most_frequent, most=40))
    generator = np.random.default_rng(6)
    word = lambda: "w" + str(min(int(generator.pareto(0.6) * 3), 4000))
    rows = [(i, " ".join(word() for _ in range(int(generator.integers(0, 60))))) for i in range(120)]
    asked = [*rows, (500, "w0 new new w0 other new"), (501, None), (502, " \n")]
    model, counts = brown.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    total = {bytes(r.word): r.n for r in counts.collect()}
    assert total == Counter(w for _, t in rows for w in brown.tokens_of(t))
    lexicon = brown.Lexicon(brown.most_frequent(counts))
    assert 0 < len(lexicon.counts) < len(total)
    for r in brown.score(spark.createDataFrame(asked, "doc_id long, text string"), model, counts).collect():
        tokens = brown.tokens_of(dict(asked)[r.doc_id])
        path = [0, *(int(model.of_unit[lexicon.unit(w)]) for w in tokens), 0]
        steps = sum(model.transitions[a, b] - model.mass[b] for a, b in zip(path, path[1:]))
        own = sum(np.log10(total.get(w, 0) + brown.SMOOTHING) for w in tokens) + np.log10(len(rows) + brown.SMOOTHING)
        assert r.score == pytest.approx(steps + own)
        assert (r.n_tokens, r.n_known) == (len(tokens) + 1, 1 + sum(w in total for w in tokens))


def test_exchange_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(3)
    units, old = 12, brown.CLASSES
    pairs = rng.integers(0, 9, (units, units)).astype(float)
    of_unit = rng.integers(1, 5, units)
    of_unit[0] = 0

    def likelihood(of):
        t = np.zeros((old, old))
        np.add.at(t, (of[:, None], of[None, :]), pairs)
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(axis=0)).sum() - brown._xlogx(t.sum(axis=1)).sum(), t

    before, table = likelihood(of_unit)
    for unit in range(1, units):
        sides = [brown._by_class(of_unit, np.arange(units), n, unit) for n in (pairs[unit], pairs[:, unit])]
        to, gain = brown.best_moves(brown.Classes(of_unit, table), unit, sides[0][0], sides[1][0], sides[0][1])
        moved = of_unit.copy()
        moved[unit] = to
        assert likelihood(moved)[0] - before == pytest.approx(gain, abs=1e-6)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[3].tolist(), "x") for i in range(60)] + [(3, vectors[3].tolist(), "x")]
    odd = [(400, None, "x"), (420, [0.0] * 8, "x"), (440, [float("nan")] * 8, "x"), (460, [None] + [1.0] * 7, "x"), (None, [1.0] * 8, "x"), (480, [1.0] * 3, "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    found = ann.nearest(table, every=20).collect()
    kept = {i: np.array(v, float) for i, v, _ in rows}
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(kept[r.query_id] @ kept[r.vec_id]), rel=1e-12)
    assert set(got) == {i for i in kept if i % 20 == 0}
    for q, hits in got.items():
        exact = sorted((-round(float(kept[q] @ v), 12), i) for i, v in kept.items() if i != q)[:20]
        assert [h["rank"] for h in hits] == list(range(1, 21)) and [h.vec_id for h in hits] == [i for _, i in exact]
    assert ann.nearest(table.limit(0), every=20).count() == 0


def test_nearest_of_many_ties(spark):
    """400 different vectors of one product with the query: the smallest ids win."""
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(int(i), [4.0, *map(float, v)]) for i, v in zip(1 + rng.permutation(400), rng.integers(-9, 9, (400, 3)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    kept = {}
    for i, v in sorted(rows):
        kept.setdefault(tuple(v), []).append(i)
    found = ann.nearest(table, every=1000, share=100.0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(n, n, 4.0) for n in range(1, 21)]


def test_nearest_of_two_lengths(spark):
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=3 if i % 3 else 5) for i in range(120)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    found = ann.nearest(table, every=20, k=5, share=100.0).collect()
    for q in range(0, 120, 20):
        others = [i for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        wanted = sorted(others, key=lambda i: (-(vectors[i] @ vectors[q]), i))[:5]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == wanted


def test_second_half_of_a_line_key_is_not_decided_by_the_first(spark):
    """A salt that comes last is hashed with the line's hash as seed, so the first half would decide the second."""
    lines = spark.range(2000).select(F.concat(F.lit("a line of some length "), "id").alias("__line"))
    first, second = F.xxhash64("__line"), line_dedup.second_half(F.col("__line"))
    assert lines.where((second == F.xxhash64("__line", F.lit(1))) | (second == first)).isEmpty()
    assert lines.select(second).distinct().count() == 2000


def test_recall_of_the_forest(spark):
    found = QUERIES["op7_nearest"](spark, "/root/testdata/sf0.01").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    near = {q: set(g.vec_id) for q, g in found.groupby("query_id")}
    shares = []
    for at in np.flatnonzero(ids % 20 == 0):
        order = [i for i in ids[np.lexsort((ids, -(v @ v[at])))] if i != ids[at]][:20]
        shares.append(len(near[ids[at]] & set(order)) / 20)
    assert np.mean(shares) >= 0.9


def test_shared_lines(spark, docs, none):
    shared = "This line is in several documents"
    rows = [(1, f"a\n {shared} \nb"), (2, shared.upper()), (3, f"{shared}\n{shared}"), (4, None), (5, "short\nshort"), (None, shared), (2, shared.upper())]
    found = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in found) == sorted(
        [("1", "a\nb", 3, 1), ("2", "", 1, 1), ("2", "", 1, 1), ("3", f"{shared}\n{shared}", 2, 0), ("4", "", 1, 0), ("5", "short\nshort", 2, 0), ("None", "", 1, 1)]
    )
    again = line_dedup.drop_shared_lines(docs)
    assert again.count() == len(ROWS) and set(docs.columns) <= set(again.columns)
    assert line_dedup.drop_shared_lines(none).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def test_bpe_equals_the_library(library):
    coder = bpe.WordBPE(word_tokenizer())
    memory = bpe.ChunkMemory(coder, coder.encode_chunk, limit=50)
    rng = random.Random(1)
    letters = "aaabbé'sStTdD mMlLΣσςİıßẞ \n\t\r\x0b\x1c\x85​0123½²Ⅷ漢字😀é<|endoftext|>.,;!$%ﬁ𝔸ǅ\x00"
    texts = ["", " ", "<|startoftext|>", "it's. we're,"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += [t + rng.choice(["<|endoftext|>", "<|startoftext|>"]) + t for t in texts[:100]] + ["ab" * 3000]
    ids, ends = memory.encode_all(texts)
    for i, text in enumerate(texts):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == wanted, text
        assert np.frombuffer(memory.encode(text), np.int32).tolist() == wanted
        assert coder.decode(wanted) == library.decode(wanted, skip_special_tokens=False)


def test_bpe_of_tables(docs, none, library):
    found = bpe.encode(docs, word_tokenizer(), decoded=True)
    for (i, text, *_), r in zip(ROWS, found.collect()):
        assert r.doc_id == i and list(r.ids) == library.encode(text or "", add_special_tokens=False).ids
    back = bpe.decode(found.select("doc_id", "ids"), word_tokenizer()).collect()
    assert [b.text for b in back] == [r.decoded for r in found.collect()]
    digest = by_id(bpe.digest(found))
    ids = library.encode(ROWS[0][1], add_special_tokens=False).ids
    assert digest[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(none, word_tokenizer()).count() == 0


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 150_000) % 40_000).astype(np.uint32)
    coder = token_files.Coder(*np.unique(ids, return_counts=True))
    block = coder.encode(ids)
    assert np.array_equal(coder.decode(block), ids)
    assert np.array_equal(coder.decode(block, range(1, 2)), ids[token_files.SEGMENT : 2 * token_files.SEGMENT])
    for n in (0, 1, token_files.SEGMENT, token_files.SEGMENT + 1):
        assert np.array_equal(coder.decode(coder.encode(ids[:n])), ids[:n])
    one = token_files.Coder(np.array([7]), np.array([3]))
    assert one.decode(one.encode(np.full(100, 7))).tolist() == [7] * 100
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(block[:500] + bytes([block[500] ^ 1]) + block[501:])
    with pytest.raises(ValueError, match="not in the frequency table"):
        coder.encode(np.array([4_000_000]))


def test_a_task_of_token_files_holds_little(library):
    # ids of four bytes that are sorted, written and read at once, and no second vocabulary beside the library's
    assert 4 * token_files.FILE_IDS <= 16 << 20
    encoder = token_files.LibraryEncoder(word_tokenizer())
    assert not hasattr(encoder.memory.file, "spec")
    texts = ["plain words, words. über 12 it's", "", "a <|endoftext|> b", "straße"]
    assert [ids.tolist() for ids in encoder(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("by_piece", [True, False])
def test_token_files(docs, none, library, by_piece):
    found = token_files.token_files(docs, word_tokenizer(), by_piece=by_piece).collect()
    assert len(found) == len(ROWS)
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    at = 0
    for r in ordered:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id)
        wanted = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(wanted), wanted.tobytes())
        at += r.n_tokens
    assert token_files.token_files(none, word_tokenizer(), by_piece=by_piece).count() == 0


def test_blocks_and_files_follow_each_other(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_IDS", 200)
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue."]) for _ in range(rng.randrange(40)))) for i in range(60)]
    rng.shuffle(rows)
    found = token_files.digest(token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string"), word_tokenizer()))
    at, got = 0, by_id(found)
    for i, text in sorted(rows):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SMALL_DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL_DATA)
        assert after.columns == docs.columns
    result = corpus_pipeline.run(spark, SMALL_DATA)
    assert 0 < result.count() <= docs.count()
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
