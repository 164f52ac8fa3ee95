"""Class-based n-grams: words in classes by exchange, smoothed perplexity.

A word's probability is that of its class after the class before, times that of
the word in its class. Every token of every training text counts.

*   Word counts are a table. The most frequent words (LEXICON) go to every task,
    which bounds what is sent; all other words are looked up by a join.
*   Classes are of *units*: each of the UNITS most frequent words is one, the
    others form SHAPES groups by their last letters and length. Any word's unit,
    and so its class, is known without a look-up.
*   Exchange: counts of neighbouring units are a table with one row for each
    unit. In every round each unit is tried in every class against all counts of
    class pairs, and moves where the likelihood rises most. So that units do not
    all move on the strength of the same counts, a round moves one part of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlark.llm.common import held_out, map_texts, share_object, slices, utf8
from sqlark.session import materialize

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = b" \t\n\v\f\r"
LEXICON = 65_536
UNITS = 6_144
SHAPES = 1_024
CLASSES = 64
ROUNDS = 6
#: Share of the probability of a class that goes to its words by their counts; the rest is for words never seen.
SMOOTHING = 0.5
FOLDS, HELD_OUT = 7, 2
#: Tokens that a task sums up before it hands their words or pairs on.
HELD = 3_200_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; the end of the text is not in the list."""
    return utf8(text or "").translate(LOWER).split()


def shape_of(word: bytes) -> int:
    """Group of a word by its last three bytes and its length."""
    return zlib.crc32(word[-3:] + bytes([min(len(word), 12)])) % SHAPES


_LOWER = np.frombuffer(LOWER, np.uint8)
_IN_WORD = np.array([b not in SPACES for b in range(256)])
#: Table of crc32 by its last 8 bits and the next byte.
_CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)


class Words:
    """The tokens of many texts, as ``tokens_of`` has them, in one array."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[borders[0] : borders[-1]]
        borders = borders - borders[0]
        inside = _IN_WORD[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        # a word at a text's first place is one of its own, whatever ends the text before
        at = borders[:-1][borders[:-1] < len(raw)]
        first[at] = inside[at]
        #: how many tokens there are up to the end of each text, and in it
        self.ends = np.searchsorted(np.flatnonzero(first), borders[1:])
        self.sizes = np.diff(self.ends, prepend=0)
        self.bytes = _LOWER[raw[inside]]
        self.offsets = np.append(np.flatnonzero(first[inside]), len(self.bytes))
        self.array = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.bytes)]
        )

    def texts(self) -> np.ndarray:
        """The place of each token's text."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def places(self, keys: pa.Array) -> np.ndarray:
        """The place of each token among ``keys``, -1 if it is none of them."""
        return pc.fill_null(pc.index_in(self.array, keys), -1).to_numpy().astype(np.int64)

    def shapes(self, chosen: np.ndarray) -> np.ndarray:
        """``shape_of`` the chosen tokens."""
        end, length = self.offsets[chosen + 1], self.offsets[chosen + 1] - self.offsets[chosen]
        crc = np.full(len(chosen), 0xFFFFFFFF, np.uint32)
        step = lambda crc, byte: _CRC[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8))
        for back in (3, 2, 1):
            crc = np.where(length >= back, step(crc, self.bytes[np.maximum(end - back, 0)]), crc)
        return ((step(crc, np.minimum(length, 12).astype(np.uint32)) ^ np.uint32(0xFFFFFFFF)) % SHAPES).astype(np.int64)


class Lexicon:
    """Counts of the most frequent words. Unit 0 is the end of a text (and what
    stands before its first word), then come single words, then shapes."""

    def __init__(self, words: list[tuple[bytes, int]]):
        self.counts = dict(words)
        self.singles = min(UNITS, len(words))
        self.single = {w: i for i, (w, _) in enumerate(words[: self.singles], 1)}
        self.units = 1 + self.singles + SHAPES

    def unit(self, word: bytes) -> int:
        found = self.single.get(word)
        return found if found is not None else 1 + self.singles + shape_of(word)

    def keys(self, most: int | None = None) -> pa.Array:
        """The words, most frequent first."""
        return pa.array(list(self.counts)[:most], pa.large_binary())


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``n`` of all words of all texts, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            found = pa.concat_arrays([pa.array([], pa.large_binary()), *held]).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["word", "n"])

        for batch in slices(batches, "text"):
            held.append(Words(batch.column("text")).array)
            if sum(map(len, held)) > HELD:
                yield out()
        yield out()

    counted = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted, "word-counts")


def neighbours(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each unit with the units after it and before it and how often,
    as a stored table: ``unit``, ``after``, ``after_n``, ``before``, ``before_n``.
    A unit has no more neighbours than there are units."""
    shared = share_object(docs.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared()
        singles = lexicon.keys(lexicon.singles)
        # as narrow as numbers of pairs allow
        kind = np.int32 if lexicon.units**2 < 1 << 31 else np.int64
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate([np.zeros(0, kind), *held]), return_counts=True)
            held.clear()
            left, right = pairs // lexicon.units, pairs % lexicon.units
            return pa.RecordBatch.from_arrays(
                [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(n.astype(np.int32))], ["a", "b", "n"]
            )

        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            units = 1 + words.places(singles)
            others = np.flatnonzero(units == 0)
            units[others] = 1 + lexicon.singles + words.shapes(others)
            # unit 0 before the first text and after each one
            at = np.zeros(len(units) + batch.num_rows + 1, kind)
            at[1 + np.arange(len(units)) + words.texts()] = units
            held.append(at[:-1] * kind(lexicon.units) + at[1:])
            if sum(map(len, held)) > HELD:
                yield out()
        yield out()

    pairs = materialize(
        docs.select("text").mapInArrow(run, "a int, b int, n int").groupBy("a", "b").agg(F.sum("n").alias("n")), "unit-pairs"
    )
    side = lambda unit, other, name: pairs.groupBy(F.col(unit).alias("unit")).agg(
        F.collect_list(other).alias(name), F.collect_list("n").alias(f"{name}_n")
    )
    joined = side("a", "b", "after").join(side("b", "a", "before"), "unit", "full_outer")
    return materialize(joined, "neighbours")


class Classes:
    """A class for each unit and the counts of class pairs."""

    def __init__(self, of_unit: np.ndarray, pairs: np.ndarray):
        self.of_unit, self.pairs = of_unit, pairs


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_moves(classes: Classes, unit: int, after: np.ndarray, before: np.ndarray, twice: float) -> tuple[int, float]:
    """The class that raises the likelihood most if the unit alone moves there, and by how much.

    ``after`` and ``before`` count the unit's neighbours by their present class
    (without the unit itself), ``twice`` how often the unit follows itself.
    """
    pairs, own = classes.pairs, int(classes.of_unit[unit])
    row, column = pairs.sum(axis=1), pairs.sum(axis=0)
    left = pairs.copy()
    left[own] -= after
    left[:, own] -= before
    left[own, own] -= twice
    out, into = after.sum() + twice, before.sum() + twice
    row, column = row.copy(), column.copy()
    row[own] -= out
    column[own] -= into
    # the terms that change when the unit joins class k; all others are the same for every k
    gain = (_xlogx(left + after) - _xlogx(left)).sum(axis=1) + (_xlogx(left + before[:, None]) - _xlogx(left)).sum(axis=0)
    same = np.diagonal(left)
    gain += _xlogx(same + after + before + twice) - _xlogx(same + after) - _xlogx(same + before) + _xlogx(same)
    gain -= _xlogx(row + out) - _xlogx(row) + _xlogx(column + into) - _xlogx(column)
    gain[0] = -np.inf  # the end of a text stays alone
    best = int(np.argmax(gain))
    return (best, float(gain[best] - gain[own])) if gain[best] > gain[own] + 1e-9 else (own, 0.0)


def _by_class(of_unit: np.ndarray, others: np.ndarray, n: np.ndarray, unit: int) -> tuple[np.ndarray, float]:
    own = others == unit
    return np.bincount(of_unit[others[~own]], n[~own], CLASSES), float(n[own].sum())


def exchange(table: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> Classes:
    """Classes by exchange; the end of a text has class 0 for itself."""
    spark = table.sparkSession
    of_unit = np.zeros(lexicon.units, np.int64)
    of_unit[1:] = 1 + np.arange(lexicon.units - 1) % (CLASSES - 1)
    for turn in range(rounds + 1):
        # counts of class pairs: CLASSES ** 2 numbers from each task
        shared = spark.sparkContext.broadcast(of_unit)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((CLASSES, CLASSES))
            for batch in batches:
                for unit, after, n in zip(*(batch.column(c) for c in ("unit", "after", "after_n"))):
                    if after.is_valid:
                        total[shared.value[unit.as_py()]] += np.bincount(shared.value[after.values.to_numpy()], n.values.to_numpy(), CLASSES)
            seen = np.flatnonzero(total.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total.reshape(-1)[seen])], ["at", "n"])

        counted = table.select("unit", "after", "after_n").mapInArrow(count, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n"))
        pairs = np.zeros(CLASSES * CLASSES)
        for row in counted.collect():
            pairs[row["at"]] = row["n"]
        classes = Classes(of_unit, pairs.reshape(CLASSES, CLASSES))
        if turn == rounds:
            return classes
        state = share_object(spark, classes)

        def move(batches: Iterator[pa.RecordBatch], state=state, turn=turn) -> Iterator[pa.RecordBatch]:
            classes = state()
            for batch in batches:
                units, best = [], []
                for row in range(batch.num_rows):
                    unit, after, after_n, before, before_n = (batch.column(c)[row] for c in range(5))
                    unit = unit.as_py()
                    if not unit or (turn and (unit * 2654435761 >> 7) % 2 != turn % 2):
                        continue
                    sides = [
                        _by_class(classes.of_unit, o.values.to_numpy(), n.values.to_numpy(), unit) if o.is_valid else (np.zeros(CLASSES), 0.0)
                        for o, n in ((after, after_n), (before, before_n))
                    ]
                    to, gain = best_moves(classes, unit, sides[0][0], sides[1][0], max(sides[0][1], sides[1][1]))
                    if gain > 0:
                        units.append(unit)
                        best.append(to)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(best, pa.int64())], ["unit", "to"])

        moves = table.select("unit", "after", "after_n", "before", "before_n").mapInArrow(move, "unit bigint, to bigint")
        of_unit = of_unit.copy()
        # one row for each unit at most
        for row in moves.collect():
            of_unit[row["unit"]] = row["to"]


class Model:
    """What scoring needs: unit and class of any word, class transitions, sizes of classes, totals."""

    def __init__(self, lexicon: Lexicon, classes: Classes, tokens: np.ndarray, distinct: np.ndarray, texts: int):
        self.lexicon = vars(lexicon)
        self.of_unit = classes.of_unit
        smooth = classes.pairs + SMOOTHING
        self.transitions = np.log10(smooth / smooth.sum(axis=1, keepdims=True))
        self.texts = texts
        #: log10 of the mass of a class over which its words' smoothed counts are divided; one word more stands for all unseen
        self.mass = np.log10(tokens + SMOOTHING * (distinct + 1))
        self.train_tokens = int(tokens.sum())
        self.distinct = int(distinct.sum())
        self.base_mass = float(np.log10(self.train_tokens + self.distinct + 1))


def most_frequent(counts: DataFrame, most: int = LEXICON) -> list[tuple[bytes, int]]:
    """The most frequent words, ``most`` at the utmost: all of the classes of
    counts (32 to a doubling) that fit whole. Only they come to the driver."""
    kind = F.floor(F.log2("n") * 32)
    sizes = sorted(counts.groupBy(kind.alias("kind")).count().collect(), reverse=True)
    held, least = 0, None
    for size in sizes:
        held += size["count"]
        if held > most:
            break
        least = size["kind"]
    if least is None:
        return []
    rows = counts.where(kind >= least).collect()
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the table of word counts."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    texts = docs.count()
    lexicon = Lexicon(most_frequent(counts))
    classes = exchange(neighbours(docs, lexicon), lexicon, rounds)
    shared, of_unit = share_object(spark, lexicon), classes.of_unit

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tokens, distinct = shared(), np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            at = of_unit[np.array([words.unit(w) for w in batch.column("word").to_pylist()], np.int64)]
            tokens += np.bincount(at, batch.column("n").to_numpy(), CLASSES).astype(np.int64)
            distinct += np.bincount(at, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(distinct)], ["class", "n", "v"])

    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    summed = counts.mapInArrow(sizes, "class bigint, n bigint, v bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    for r in summed.collect():
        tokens[r["class"]], distinct[r["class"]] = r.n, r.v
    if texts:
        tokens[0], distinct[0] = texts, 1
    return Model(lexicon, classes, tokens, distinct, texts), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` and ``perplexity`` of every whole text.

    A null text is empty: its end is its one token. Words that no training text
    has are unknown and share one probability in each class. Without training
    texts every token is unknown. Repeated rows give equal results; other
    columns are not read.
    """
    spark = docs.sparkSession
    shared = share_object(spark, model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run_with(
        lexicon: Lexicon, keys: pa.Array, units: np.ndarray, counts: np.ndarray, state: Model, batch: pa.RecordBatch
    ) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        place = words.places(keys)
        known = place >= 0
        others = np.flatnonzero(~known)
        at = np.empty(len(place), np.int64)
        at[known] = state.of_unit[units[place[known]]]
        at[others] = state.of_unit[1 + lexicon.singles + words.shapes(others)]
        n = counts[place[known]]
        base, own = np.log10(n + 1), np.log10(n + SMOOTHING)
        ends, last = words.ends, np.cumsum(known)
        columns: list[list] = [[] for _ in range(4)]
        for begin, end in zip((ends - words.sizes).tolist(), ends.tolist()):
            path = np.concatenate([[0], at[begin:end], [0]])
            fixed = state.transitions[path[:-1], path[1:]].sum() - state.mass[path[1:]].sum()
            some = slice(int(last[begin - 1]) if begin else 0, int(last[end - 1]) if end else 0)
            columns[0].append(end - begin + 1)
            columns[1].append(some.stop - some.start + (1 if state.texts else 0))
            columns[2].append(float(base[some].sum() + (np.log10(state.texts + 1) if state.texts else 0)))
            columns[3].append(float(fixed + own[some].sum() + np.log10(state.texts + SMOOTHING if state.texts else SMOOTHING)))
        # the different other words of each text
        rest = words.array.take(pa.array(others)).cast(pa.binary()).dictionary_encode()
        size = max(1, len(rest.dictionary))
        pairs, times = np.unique(words.texts()[others] * size + rest.indices.to_numpy(), return_counts=True)
        borders = np.append(0, np.cumsum(np.bincount(pairs // size, minlength=batch.num_rows)))
        entries = pa.StructArray.from_arrays([rest.dictionary.take(pa.array(pairs % size)), pa.array(times)], ["word", "times"])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.float64()])],
                pa.ListArray.from_arrays(pa.array(borders, pa.int32()), entries),
            ],
            ["doc_id", "n_tokens", "known", "base", "own", "rest"],
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared()
        lexicon = Lexicon.__new__(Lexicon)
        lexicon.__dict__.update(state.lexicon)
        keys = lexicon.keys()
        units = np.array([lexicon.unit(w) for w in lexicon.counts], np.int64)
        counts = np.array(list(lexicon.counts.values()), np.float64)
        for piece in slices(batches, "text"):
            yield run_with(lexicon, keys, units, counts, state, piece)

    schema = f"doc_id {kind}, n_tokens bigint, known bigint, base double, own double, rest array<struct<word:binary,times:bigint>>"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = materialize(source.mapInArrow(step, schema).withColumn("row", F.monotonically_increasing_id()), "scored-texts")
    asked = parts.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    looked_up = (
        asked.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more_base"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("more_own"),
        )
        .withColumnRenamed("row", "of")
    )
    joined = parts.drop("rest").join(looked_up, F.col("row") == F.col("of"), "left")
    zero = F.lit(0.0)
    total = F.col("own") + F.coalesce("more_own", zero)
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * F.lit(model.base_mass)).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", FOLDS, HELD_OUT))


def digest(scored: DataFrame) -> DataFrame:
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )
