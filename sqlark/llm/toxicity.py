"""Toxicity by a bidirectional gated recurrent network with attention pooling.

The inputs of a word are an embedding of the word and the mean embedding of its
character trigrams, so that words never seen still have one. A window of words
goes through the network in both directions, attention weighs the states, and
a logistic unit gives the window's probability. A text scores as its worst
window; windows overlap and cover the whole text.

The network is trained in numpy on a bounded sample of labelled rows (SAMPLE_ROWS
of each label, texts of up to SAMPLE_CHARS characters). A label belongs to a
text, not to a window, so each epoch takes the windows that the network so far
finds worst: of toxic texts the worst one, of others that and a random one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlark.llm.common import held_out, map_texts, share_object, trigrams, words_of, worker_memory

#: Neighbouring windows share half of their words, so a passage of up to 16 words is whole in one of them.
WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORD_SIZE, CHAR_SIZE = 8, 8
CHAR_BUCKETS = 4096
#: Words with an embedding of their own occur in so many sampled texts at least.
LEAST_TEXTS = 5
MAX_WORDS = 32_768
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 20_000
#: Least numbers of passes over the sample and of steps, windows of a step, and step size, which halves four times.
EPOCHS, STEPS, BATCH, RATE = 4, 240, 128, 0.02
#: Words whose network inputs a Python worker keeps; no result depends on it.
REMEMBERED = 60_000
FOLDS, HELD_OUT = 5, 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.asarray(0.5, x.dtype)


def window_starts(n: int) -> range:
    """Starts of the windows over n words; the last one reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


class Network:
    """Parameters, forward and backward pass. Directions are stacked on the first axis of recurrent arrays."""

    def __init__(self, vocabulary: dict[bytes, int], word: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else 4), shape)
        self.vocabulary = vocabulary
        self.p = {
            "word": word,
            "char": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR_SIZE)),
            "w": normal(2, size, 3 * h),
            "u": normal(2, h, 3 * h),
            "b": np.zeros((2, 1, 3 * h)),
            "aw": normal(2 * h, h),
            "ab": np.zeros(h),
            "av": normal(h),
            "ow": normal(2 * h),
            "ob": np.zeros(1) - 1.0,
        }

    def forward(self, inputs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of windows from gate inputs (direction, window, place, gates) and a mask of places."""
        p, h = self.p, HIDDEN
        _, n, length, _ = inputs.shape
        states = np.zeros((2, n, length + 1, h), inputs.dtype)
        kept = []
        state = states[:, :, 0]
        for t in range(length):
            m = np.stack([mask[:, t], mask[:, length - 1 - t]])[:, :, None]
            x = np.stack([inputs[0, :, t], inputs[1, :, length - 1 - t]])
            r = state @ p["u"]
            zr = sigmoid(x[..., : 2 * h] + r[..., : 2 * h])
            z, g = zr[..., :h], zr[..., h:]
            new = np.tanh(x[..., 2 * h :] + g * r[..., 2 * h :])
            kept.append((state, z, g, new, r[..., 2 * h :], m))
            state = state + m * (1 - z) * (new - state)
            states[:, :, t + 1] = state
        both = np.concatenate([states[0, :, 1:], states[1, :, :0:-1]], axis=-1)
        inner = np.tanh(both @ p["aw"] + p["ab"])
        score = np.where(mask > 0, inner @ p["av"], -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * both).sum(axis=1)
        return pooled @ p["ow"] + p["ob"][0], (kept, both, inner, weight, pooled)

    def backward(self, d_logit: np.ndarray, kept_all: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the recurrent and output parameters, and of the gate inputs."""
        p, h = self.p, HIDDEN
        kept, both, inner, weight, pooled = kept_all
        n, length, _ = both.shape
        grad = {"ow": pooled.T @ d_logit, "ob": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * p["ow"]
        d_weight = (both * d_pooled[:, None]).sum(axis=-1)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d_inner = d_score[:, :, None] * p["av"] * (1 - inner**2)
        grad["av"] = np.einsum("nt,nth->h", d_score, inner)
        grad["aw"] = np.einsum("nts,nth->sh", both, d_inner)
        grad["ab"] = d_inner.sum(axis=(0, 1))
        d_both = weight[:, :, None] * d_pooled[:, None] + d_inner @ p["aw"].T
        d_inputs = np.zeros((2, n, length, 3 * h))
        grad["u"] = np.zeros_like(p["u"])
        d_state = np.zeros((2, n, h))
        for t in range(length - 1, -1, -1):
            state, z, g, new, r, m = kept[t]
            d_state = d_state + np.stack([d_both[:, t, :h], d_both[:, length - 1 - t, h:]])
            d_new = d_state * m * (1 - z) * (1 - new**2)
            d_z = -d_state * m * (new - state) * z * (1 - z)
            d_g = d_new * r * g * (1 - g)
            d_x = np.concatenate([d_z, d_g, d_new], axis=-1)
            d_r = np.concatenate([d_z, d_g, d_new * g], axis=-1)
            d_inputs[0, :, t], d_inputs[1, :, length - 1 - t] = d_x[0], d_x[1]
            grad["u"] += state.transpose(0, 2, 1) @ d_r
            d_state = d_state * (1 - m * (1 - z)) + d_r @ p["u"].transpose(0, 2, 1)
        return grad, d_inputs

    def embed(self, words: list[bytes]) -> np.ndarray:
        """Inputs of words: their own embedding (that of row 0 for others) and the mean of their trigrams'."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        buckets, sizes = trigrams(words, CHAR_BUCKETS)
        sums = np.add.reduceat(self.p["char"][buckets], np.cumsum(sizes) - sizes)
        return np.concatenate([self.p["word"][rows], sums / sizes[:, None]], axis=1)

    def gates(self, words: list[bytes]) -> np.ndarray:
        """(direction, word, gates)"""
        return self.embed(words) @ self.p["w"] + self.p["b"]


def _windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows, -1 where a window reaches over the end, and the window count of each text."""
    counts = np.array([len(window_starts(len(t))) if len(t) else 0 for t in texts], np.int64)
    flat = np.concatenate([*texts, np.full(WINDOW, -1)]).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(sizes) - sizes, counts) + turn * STRIDE
    left = np.repeat(sizes, counts) - turn * STRIDE
    place = np.arange(WINDOW)
    return np.where(place < left[:, None], flat[np.minimum(first[:, None] + place, len(flat) - 1)], -1), counts


def _logits(network: Network, gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for start in range(0, len(windows), 2048):
        part = windows[start : start + 2048]
        out.append(network.forward(gates[:, part], (part >= 0).astype(gates.dtype))[0])
    return np.concatenate(out)


def _of_words(network: Network, distinct: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Logits of windows, with inputs made for the words in them only."""
    used, back = np.unique(np.maximum(windows, 0), return_inverse=True)
    back = np.where(windows >= 0, back.reshape(windows.shape), -1)
    return _logits(network, network.gates([distinct[i] for i in used]), back)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """A network for these texts; None if one of the labels is missing."""
    labels_of = np.array(labels, bool)
    if not labels_of.any() or labels_of.all():
        return None
    number: dict[bytes, int] = {}
    worded = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    distinct = list(number)
    found = np.zeros((len(distinct), 2), np.int64)
    for words, label in zip(worded, labels):
        found[np.unique(words), int(label)] += 1
    occurring = found.sum(axis=1)
    often = [i for i in range(len(distinct)) if occurring[i] >= LEAST_TEXTS]
    often = sorted(often, key=lambda i: (-occurring[i], distinct[i]))[:MAX_WORDS]
    common = [distinct[i] for i in often]
    rng = np.random.default_rng(seed)
    word = rng.normal(0, 0.1, (len(common) + 1, WORD_SIZE))
    word[0] = 0
    # the first entry starts as the log-odds of the label given the word
    counts = found[often].astype(float).reshape(-1, 2) + 0.5
    odds = np.log(counts[:, 1] / (labels_of.sum() + 1)) - np.log(counts[:, 0] / ((~labels_of).sum() + 1))
    word[1:, 0] = np.clip(odds, -3, 3) / 3
    network = Network({w: i for i, w in enumerate(common, 1)}, word, seed)

    windows, per_text = _windows(worded)
    ends = np.cumsum(per_text)
    spans = [(e - n, e) for e, n in zip(ends, per_text)]
    rows = np.array([network.vocabulary.get(w, 0) for w in distinct], np.int64)
    buckets, sizes = trigrams(distinct, CHAR_BUCKETS)
    bucket_at = np.cumsum(sizes) - sizes
    value = np.concatenate([word[rows, 0], [0.0]])
    worst = np.maximum(value[windows], 0).sum(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    steps = 0
    epochs = max(EPOCHS, -(-STEPS // max(1, -(-int((2 - labels_of).sum()) // BATCH))))
    for epoch in range(epochs):
        if epoch:
            worst = np.concatenate([np.zeros(0), *(_of_words(network, distinct, windows[i : i + 2048]) for i in range(0, len(windows), 2048))])
        chosen, target = [], []
        for (a, b), label in zip(spans, labels):
            if a == b:
                continue
            top = a + int(np.argmax(worst[a:b]))
            chosen.append(top)
            target.append(label)
            if not label:
                chosen.append(a + int(rng.integers(b - a)))
                target.append(0)
        order = rng.permutation(len(chosen))
        chosen, target = np.array(chosen, np.int64)[order], np.array(target, float)[order]
        for start in range(0, len(chosen), BATCH):
            part = windows[chosen[start : start + BATCH]]
            mask = (part >= 0).astype(float)
            used, back = np.unique(np.maximum(part, 0), return_inverse=True)
            back = back.reshape(part.shape)
            embedded = network.embed([distinct[i] for i in used])
            x = embedded[back] * mask[:, :, None]
            inputs = np.einsum("nts,dsg->dntg", x, network.p["w"]) + network.p["b"][:, :, None]
            logit, kept = network.forward(inputs, mask)
            grad, d_inputs = network.backward((sigmoid(logit) - target[start : start + BATCH]) / len(part), kept)
            grad["w"] = np.einsum("nts,dntg->dsg", x, d_inputs)
            grad["b"] = d_inputs.sum(axis=(1, 2))[:, None]
            d_embedded = np.zeros_like(embedded)
            np.add.at(d_embedded, back.reshape(-1), (np.einsum("dntg,dsg->nts", d_inputs, network.p["w"]) * mask[:, :, None]).reshape(-1, x.shape[-1]))
            grad["word"] = np.zeros_like(network.p["word"])
            np.add.at(grad["word"], rows[used], d_embedded[:, :WORD_SIZE])
            grad["word"][0] = 0
            grad["char"] = np.zeros_like(network.p["char"])
            of = np.concatenate([np.arange(bucket_at[i], bucket_at[i] + sizes[i]) for i in used])
            share = np.repeat(d_embedded[:, WORD_SIZE:] / sizes[used, None], sizes[used], axis=0)
            np.add.at(grad["char"], buckets[of], share)
            steps += 1
            rate = RATE * 0.5 ** (4 * epoch / epochs)
            for k, g in grad.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                network.p[k] -= rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-6)
    network.p = {k: v.astype(np.float32) for k, v in network.p.items()}
    return network


class Scorer:
    """Scores of texts; keeps the gate inputs of the last words."""

    def __init__(self, network: Network):
        self.network = network
        self.number: dict[bytes, int] = {}
        self.gates = np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        worded = [words_of(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.number, self.gates = {}, self.gates[:, :0]
        new = list(set().union(*worded).difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.gates = np.concatenate([self.gates, self.network.gates(new).astype(np.float32)], axis=1)
        get = self.number.__getitem__
        windows, per_text = _windows([np.fromiter(map(get, w), np.int64, len(w)) for w in worded])
        logits = _logits(self.network, self.gates, windows)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, np.repeat(np.arange(len(texts)), per_text), logits)
        return sigmoid(np.maximum(worst, -700))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of
    rows that are not held out. The sample is the same at every run: of each label
    the documents with the smallest hash of their id among those that have a text
    of 1 to SAMPLE_CHARS characters. A label without such a document is passed
    over; of rows that repeat an id the text with the least hash is taken."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", FOLDS, HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    fitting = docs.where(F.char_length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # a document that rows repeat is one of its texts
    usable = fitting.groupBy("doc_id").agg(F.min("text_hash").alias("text_hash")).join(known, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(*order).limit(sample_rows)
        sample = part if sample is None else sample.union(part)
    # at most sample_rows rows of each label, of at most SAMPLE_CHARS characters
    rows = (
        fitting.join(F.broadcast(sample), ["doc_id", "text_hash"])
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label").alias("label"))
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.label for r in rows])


def score(docs: DataFrame, network: Network | None, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the probability that the text is toxic. Null
    texts and texts without words score 0, as does everything without a network
    (a label was missing). Repeated rows score alike."""
    shared = share_object(docs.sparkSession, network)
    own = [c for c in docs.columns if c != column]
    schema = T.StructType([*docs.select(*own).schema, T.StructField(column, T.DoubleType())])
    token = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorers = worker_memory("toxicity")
        if token not in scorers:
            scorers.clear()
            found = shared()
            scorers[token] = Scorer(found) if found else lambda texts: np.zeros(len(texts))
        scores = scorers[token](batch.column(text).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema=pa.schema([*batch.schema, pa.field(column, pa.float64())]))

    return map_texts(docs.select(*own), text, schema, run, operator="toxicity")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that a network trained on them rejects."""
    network = fit(docs.select("doc_id", F.col(text).alias("text")), labels)
    kept = score(docs, network, text, "__toxic_score").where(F.col("__toxic_score") < 0.5)
    return kept.select(*docs.columns)
