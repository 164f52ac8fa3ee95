"""Languages of a text as a mixture.

Each language has a distribution of byte trigrams (in words with their borders,
lower case), counted over all training documents. A word's likelihood under a
language is the product over its trigrams. A text's words are taken to be drawn
from languages in unknown proportions; expectation-maximisation estimates them.
Which languages a text holds is chosen by penalised likelihood: languages are
added in order of their proportions as long as that raises the log-likelihood
by more than PENALTY times the logarithm of the number of words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlark.llm.common import WORD_BYTES, held_out, map_texts, share_object, slices, trigrams, utf8, worker_memory

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 3.0
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: Different words held at once by a Python worker; no result depends on it.
REMEMBERED = 150_000


def words_of(text: str | None) -> list[bytes]:
    return utf8((text or "").lower()).translate(WORD_BYTES).split()


class Languages:
    """Logarithms of smoothed trigram probabilities, (bucket, language)."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.names = sorted(counts)
        table = np.full((BUCKETS, len(self.names)), SMOOTHING)
        for k, name in enumerate(self.names):
            for bucket, n in counts[name].items():
                table[bucket, k] += n
        self.logs = np.log(table / table.sum(axis=0)).astype(np.float32)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """(word, language): log-likelihoods."""
        buckets, sizes = trigrams(words, BUCKETS)
        if not words:
            return np.zeros((0, len(self.names)), np.float32)
        return np.add.reduceat(self.logs[buckets], np.cumsum(sizes) - sizes, axis=0)


def mixtures(logs: np.ndarray, counts: np.ndarray) -> list[tuple[list[int], list[float]]]:
    """For each text (``counts`` words each, at least one) the languages chosen
    and their proportions, largest first, from the log-likelihoods of its words."""
    texts, size = len(counts), logs.shape[1]
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(texts), counts)
    most = logs.max(axis=1, keepdims=True)
    likely = np.exp(logs - most)
    base = np.add.reduceat(most[:, 0].astype(np.float64), starts)
    alone = np.add.reduceat(logs.astype(np.float64), starts, axis=0)

    def estimate(likely, owner, starts, counts, share, rounds):
        for _ in range(rounds):
            part = likely * share[owner]
            total = part.sum(axis=1, keepdims=True)
            share = np.add.reduceat(part / total, starts, axis=0) / counts[:, None]
        total = (likely * share[owner]).sum(axis=1)
        return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), starts)

    share, _ = estimate(likely, owner, starts, counts, np.full((texts, size), 1 / size, np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    first = alone.argmax(axis=1)
    chosen = [[int(f)] for f in first]
    parts = [[1.0] for _ in first]
    best = alone[np.arange(texts), first]
    # texts that have taken every language so far try the next one
    open_ = np.arange(texts)
    for n in range(2, size + 1):
        if not len(open_):
            break
        rows = np.isin(owner, open_)
        within = counts[open_]
        begin = np.cumsum(within) - within
        number = np.repeat(np.arange(len(open_)), within)
        tried = order[open_, :n]
        start = np.take_along_axis(share[open_], tried, axis=1) + 1e-6
        start = (start / start.sum(axis=1, keepdims=True)).astype(np.float32)
        found, gain = estimate(np.take_along_axis(likely[rows], tried[number], axis=1), number, begin, within, start, 4)
        value = base[open_] + gain - PENALTY * (n - 1) * np.log(within + 1)
        better = value > best[open_] - PENALTY * (np.array([len(chosen[i]) for i in open_]) - 1) * np.log(within + 1)
        for i in np.flatnonzero(better):
            rank = np.argsort(-found[i], kind="stable")
            chosen[open_[i]] = tried[i][rank].tolist()
            parts[open_[i]] = found[i][rank].astype(float).tolist()
            best[open_[i]] = base[open_[i]] + gain[i]
        open_ = open_[better]
    return list(zip(chosen, parts))


class Guesser:
    def __init__(self, languages: Languages):
        self.languages = languages
        self.number: dict[bytes, int] = {}
        self.logs = languages.of_words([])

    def __call__(self, texts: list[str | None]) -> list[tuple[list[str], list[float]]]:
        """Languages and proportions of each text; none for a text without a letter."""
        worded = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        counts = np.array([len(w) for w in worded], np.int64)
        if len(self.number) > REMEMBERED:
            self.number, self.logs = {}, self.logs[:0]
        new = list(set().union(*worded).difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.logs = np.concatenate([self.logs, self.languages.of_words(new)])
        result: list[tuple[list[str], list[float]]] = [([], [])] * len(texts)
        if counts.any() and self.languages.names:
            rows = np.fromiter((self.number[w] for words in worded for w in words), np.int64, int(counts.sum()))
            some = np.flatnonzero(counts)
            for i, (chosen, shares) in zip(some, mixtures(self.logs[rows], counts[some])):
                result[i] = ([self.languages.names[k] for k in chosen], shares)
        return result


def learn(docs: DataFrame) -> Languages:
    """From ``text`` and ``lang`` of all rows; null languages are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        held: dict[str, Counter] = {}

        def flush() -> None:
            for lang, words in held.items():
                buckets, sizes = trigrams(list(words), BUCKETS)
                weights = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
                total[lang] = total.get(lang, 0) + np.bincount(buckets, weights, BUCKETS).astype(np.int64)
            held.clear()

        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > REMEMBERED:
                flush()
        flush()
        for lang, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["lang", "bucket", "n"]
            )

    counted = (
        docs.where(F.col("lang").isNotNull())
        .select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(run, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    # BUCKETS rows for each language at most
    counts: dict[str, dict[int, int]] = {}
    for row in counted.toLocalIterator():
        counts.setdefault(row.lang, {})[row.bucket] = row.n
    return Languages(counts)


def identify(docs: DataFrame, languages: Languages, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (its proportion of the words), and
    ``langs`` and ``shares`` of all languages chosen, for every whole text.

    Null texts and texts without a letter, and all texts if no language was
    learned, are ``und`` with score 0. Repeated rows give equal results; other
    columns are not read.
    """
    shared = share_object(docs.sparkSession, languages)
    token = uuid.uuid4().hex
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = worker_memory("languages")
        if token not in kept:
            kept.clear()
            kept[token] = Guesser(shared())
        found = kept[token](batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([langs[0] if langs else UNKNOWN for langs, _ in found], pa.string()),
                pa.array([min(1.0, shares[0]) if shares else 0.0 for _, shares in found], pa.float64()),
                pa.array([langs for langs, _ in found], pa.list_(pa.string())),
                pa.array([shares for _, shares in found], pa.list_(pa.float64())),
            ],
            ["doc_id", "lang_pred", "score", "langs", "shares"],
        )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(
        source, "text", f"doc_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>", run, operator="languages"
    )


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", FOLDS, HELD_OUT))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "langs", "shares"
    )
