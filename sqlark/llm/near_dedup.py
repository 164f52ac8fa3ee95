"""Near duplicates by probability MinHash.

A document is the weighted set of its five-word shingles (weight: how often one
occurs). Each shingle is a Poisson process whose rate is its weight; its
arrivals fall on random registers, and a register keeps the shingle of its
earliest arrival. A shingle stops as soon as its next arrival comes after every
register of the document is taken by an earlier one. Two documents agree in a
register with the probability of their probability Jaccard similarity.

1.  Documents of equal words are one *text*; all later steps are between texts.
2.  Registers form bands; texts that agree in a band meet in a bucket. In small
    buckets every two texts are a candidate, in large ones every text with a hub.
3.  Candidates whose registers agree too seldom go; for the rest the similarity
    is computed from whole shingle sets. What reaches the threshold is a link.
4.  Connected components are the classes.
5.  Large buckets that still hold several classes are open: there, every text is
    compared with every text of another class, in tiles of bounded size. A tile is
    one task's group; registers, then whole shingle sets are compared as matrices,
    and no more links leave it than join its classes. So every two texts that
    agree in a band are compared or known to be of one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlark.llm.common import WORD_BYTES, map_texts, mix, utf8
from sqlark.llm.components import components
from sqlark.session import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Least share of equal registers of a candidate; six standard deviations below SIMILARITY.
LEAST_AGREEMENT = 0.55
#: Buckets of up to so many texts compare every two of them.
SMALL_BUCKET = 16
#: Texts of an open bucket are dealt into tiles of about so many; every two tiles meet once.
TILE = 1024
#: Columns of a matrix of shingles that is held at once.
COLUMNS = 4096
#: Bytes of text that a task works on at once; an array of it has eight times as many.
PIECE = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
PLACE_VALUES = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Document number, hash and weight of every shingle (by document, then
    hash), and a fingerprint of each document's words.

    Words are runs of letters and digits, A-Z in lower case. Fewer than
    ``words`` words are one shingle. A text without words has none; its
    fingerprint is of the text itself, and null for a null or empty text.
    """
    plain = [utf8(t or "").translate(WORD_BYTES).split() for t in texts]
    prints = [
        hashlib.blake2b(b" ".join(w), digest_size=16).digest()
        if w
        else hashlib.blake2b(utf8(t), digest_size=16, person=b"no words").digest() if t else None
        for t, w in zip(texts, plain)
    ]
    counts = np.array([len(w) for w in plain], np.int64)
    if not counts.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), prints
    joined = np.frombuffer(b" ".join([b" ".join(w) for w in plain if w]), np.uint8)
    gaps = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], gaps + 1])
    lengths = np.diff(np.concatenate([starts, [len(joined) + 1]]))
    place = np.arange(len(joined) + 1) - np.repeat(starts, lengths)
    powers = np.cumprod(np.concatenate([[1], np.full(int(lengths.max()), GOLDEN)]).astype(np.uint64))
    values = BYTE_VALUES[np.append(joined, 32)] * powers[place]
    hashes = mix(np.add.reduceat(values, starts))
    # room after each document, so that a short one has its own window
    owner = np.repeat(np.arange(len(texts)), counts)
    room = words - 1
    at = np.arange(len(hashes)) + owner * room
    padded = np.zeros(len(hashes) + len(texts) * room, np.uint64)
    padded[at] = hashes
    weights = PLACE_VALUES if words == WORDS else mix(np.arange(1, words + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    in_document = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = at[in_document < np.repeat(np.maximum(1, counts - room), counts)]
    shingles = np.zeros(len(first), np.uint64)
    for j in range(words):
        shingles += padded[first + j] * weights[j]
    shingles = mix(shingles)
    owner = np.repeat(np.arange(len(texts)), np.minimum(counts, np.maximum(1, counts - room)))
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], shingles[heads], np.diff(np.append(heads, len(owner))), prints


def registers(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, documents: int) -> np.ndarray:
    """For each document the shingle that holds each register (0 where there are no shingles)."""
    time = np.full((documents, REGISTERS), np.inf)
    holder = np.zeros(documents * REGISTERS, np.uint64)
    flat = time.reshape(-1)
    state, clock = shingles.copy(), np.zeros(len(shingles))
    active = np.arange(len(shingles))
    while len(active):
        state[active] = draw = mix(state[active] + GOLDEN)
        clock[active] += -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weights[active]
        register = (mix(draw ^ GOLDEN) >> np.uint64(33)) % np.uint64(REGISTERS)
        slot = owner[active] * REGISTERS + register.astype(np.int64)
        np.minimum.at(flat, slot, clock[active])
        won = flat[slot] == clock[active]
        holder[slot[won]] = shingles[active[won]]
        live = np.unique(owner[active])
        last = np.zeros(documents)
        last[live] = time[live].max(axis=1)
        active = active[clock[active] < last[owner[active]]]
    return holder.reshape(documents, REGISTERS)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets, given as sorted elements and their weights: the sum
    over common elements of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    common, left, right = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return len(common) / (len(a) + len(b) - len(common))
    both_x, both_y = x[left].astype(float), y[right].astype(float)
    ratio = both_x / both_y
    only_x, only_y = float(x.sum() - both_x.sum()), float(y.sum() - both_y.sum())
    total = 0.0
    for r in np.unique(ratio):
        here, above = ratio == r, ratio >= r
        total += (1 / ((only_x + both_x[above].sum()) / both_x[here] + (only_y + both_y[~above].sum()) / both_y[here])).sum()
    return float(total)


def _signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, shingles, weights, prints = shingle_sets(batch.column("text").to_pylist())
        held = registers(owner, shingles, weights, batch.num_rows)
        filled = np.bincount(owner, minlength=batch.num_rows) > 0
        bands = np.zeros((batch.num_rows, BANDS), np.uint64)
        grouped = held.reshape(batch.num_rows, BANDS, ROWS)
        for j in range(ROWS):
            bands = mix(bands + grouped[:, :, j] + GOLDEN)
        bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * GOLDEN).view(np.int64)
        low = (held & np.uint64(255)).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(prints, pa.binary()),
                pa.array([b if f else [] for b, f in zip(bands.tolist(), filled)], pa.list_(pa.int64())),
                pa.array([r.tobytes() if f else b"" for r, f in zip(low, filled)], pa.binary()),
            ],
            ["doc_id", "text_hash", "print", "bands", "registers"],
        )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_texts(
        source, "text", f"doc_id {kind}, text_hash bigint, print binary, bands array<bigint>, registers binary", run, PIECE
    )


def _agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of which enough registers agree."""
    held = texts.select("node", "registers")
    joined = pairs.join(held.withColumnsRenamed({"node": "a", "registers": "ra"}), "a").join(
        held.withColumnsRenamed({"node": "b", "registers": "rb"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, REGISTERS)
                for c in ("ra", "rb")
            ]
            close = (sides[0] == sides[1]).mean(axis=1) >= LEAST_AGREEMENT
            yield batch.select(["a", "b"]).filter(pa.array(close))

    return joined.select("a", "b", "ra", "rb").mapInArrow(run, "a bigint, b bigint")


def _shingles_of(nodes: DataFrame, texts: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The whole shingle sets of the ``nodes``, as a stored table: ``node``, ``shingles``, ``weights``."""
    wanted = texts.join(nodes, "node").select("node", "print", F.col("first_id").alias("__first"), F.col("text_hash").alias("__hash"))
    source = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"), F.xxhash64(text).alias("__text_hash"))
    found = source.join(
        wanted, source["__id"].eqNullSafe(wanted["__first"]) & (source["__text_hash"] == wanted["__hash"])
    ).select("node", "print", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, shingles, weights, prints = shingle_sets(batch.column("text").to_pylist())
        right = [a == b for a, b in zip(prints, batch.column("print").to_pylist())]
        ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        cut = lambda v: [v[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        out = pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(cut(shingles), pa.binary()), pa.array(cut(weights.astype(np.int32)), pa.binary())],
            ["node", "shingles", "weights"],
        )
        return out.filter(pa.array(right))

    known = map_texts(found, "text", "node bigint, shingles binary, weights binary", sets, PIECE)
    # rows of equal id and text give their set once
    return materialize(known.dropDuplicates(["node"]), "shingle-sets")


def _similar(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose probability Jaccard similarity reaches the threshold."""
    joined = pairs.join(known.withColumnsRenamed({"node": "a", "shingles": "sa", "weights": "wa"}), "a").join(
        known.withColumnsRenamed({"node": "b", "shingles": "sb", "weights": "wb"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [
                probability_jaccard(
                    np.frombuffer(sa.as_py(), np.uint64),
                    np.frombuffer(wa.as_py(), np.int32),
                    np.frombuffer(sb.as_py(), np.uint64),
                    np.frombuffer(wb.as_py(), np.int32),
                )
                >= similarity
                for sa, wa, sb, wb in zip(*(batch.column(c) for c in ("sa", "wa", "sb", "wb")))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return joined.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(run, "a bigint, b bigint")


def duplicate_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id of its class) and ``kept`` (one row
    of each class) for every row; ``text_hash`` tells rows of equal id apart.

    Documents of equal words are in one class, as are those linked by a
    similarity of at least ``similarity``, directly or over others. A null or
    empty text has no duplicates: it is a class of its own and kept; texts
    without a word are duplicates if they are equal. Rows that repeat id and
    text are duplicates, too. Rows with a null id take part; a class of nothing
    else has a null ``class_id``. Other columns are not read.
    """
    signed = materialize(_signatures(docs, doc_id, text), "signatures")
    texts = materialize(
        signed.where(F.col("print").isNotNull())
        .groupBy("print")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least"),
            F.first("bands").alias("bands"),
            F.first("registers").alias("registers"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"),
            "print",
            F.col("least.doc_id").alias("first_id"),
            F.col("least.text_hash").alias("text_hash"),
            "bands",
            "registers",
        ),
        "texts",
    )
    members = materialize(_buckets(texts.select("node", F.explode("bands").alias("bucket"))), "bucket-members")
    candidates = materialize(_agreeing(_meetings(members, SMALL_BUCKET), texts), "candidates")
    crowded = members.where(F.col("size") > SMALL_BUCKET)
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("node")).union(crowded.select("node")).distinct()
    known = _shingles_of(nodes, texts, docs, doc_id, text)
    links = materialize(_similar(candidates, known, similarity), "links")
    labels = components(links)
    open_ = materialize(_open(crowded, labels), "open-buckets")
    if not open_.isEmpty():
        links = links.union(materialize(_links_in_tiles(open_, texts, known, similarity), "links"))
        labels = components(links)
    of_text = texts.join(labels, "node", "left").select(
        "print", "first_id", "text_hash", F.coalesce("label", "node").alias("label")
    )
    first = of_text.groupBy("label").agg(
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "text_hash")).alias("first")
    )
    classes = of_text.join(first, "label").select(
        F.col("print").alias("__print"), F.col("first.first_id").alias("__class"), F.col("first.text_hash").alias("__hash")
    )
    joined = signed.select("doc_id", "text_hash", "print").join(classes, F.col("print") == F.col("__print"), "left")
    alone = F.col("print").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__class")).alias("class_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("__class")) & (F.col("text_hash") == F.col("__hash")))).alias("kept"),
        "text_hash",
    )


def _buckets(placed: DataFrame) -> DataFrame:
    """``(bucket, node)`` with the size of the bucket and its hub, for buckets of two texts or more.

    The hub is the first in an order of all texts, so that neighbouring buckets
    mostly have the same one and few candidates arise twice.
    """
    sizes = (
        placed.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node"), "node")).alias("hub"))
        .where(F.col("size") > 1)
        .select("bucket", "size", F.col("hub.node").alias("hub"))
    )
    return placed.join(sizes, "bucket")


def _meetings(members: DataFrame, small: int) -> DataFrame:
    """Candidates ``(a, b)``: every two texts of a small bucket, every text of a large one with its hub."""
    paired = (
        members.where(F.col("size") <= small)
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        .select(F.posexplode("nodes").alias("i", "a"), "nodes")
        .select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("b"))
    )
    starred = members.where((F.col("size") > small) & (F.col("node") != F.col("hub"))).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    )
    return paired.union(starred).distinct()


def _open(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket``, ``size``, ``node`` and ``label`` of the texts of large buckets that hold several labels."""
    placed = crowded.join(labels, "node", "left").select("bucket", "size", "node", F.coalesce("label", "node").alias("label"))
    several = (
        placed.groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select("bucket")
    )
    return placed.join(several, "bucket")


def _links_in_tiles(open_: DataFrame, texts: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that join all labels of an open bucket that any two of its texts link.

    A bucket's texts are dealt into tiles by hash, and every two tiles meet in one
    group of at most about twice ``TILE`` rows. A text is in up to 24 open buckets.
    """
    tiles = F.ceil(F.col("size") / TILE)
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), tiles)).select(
        "bucket", "node", "label", "own", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other")
    )
    placed = dealt.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label"
    )
    held = placed.join(texts.select("node", "registers"), "node").join(known, "node")

    def run(group: pa.Table) -> pa.Table:
        return pa.table(links_between(group.combine_chunks(), similarity), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return held.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many registers agree, for every two rows."""
    found = np.zeros((len(left), len(right)), np.uint8)
    for j in range(left.shape[1]):
        found += left[:, j, None] == right[None, :, j]
    return found


def common_shares(sets: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every text of ``rows`` and of ``columns``: the share of the weight of either that lies in common shingles."""
    wanted = np.union1d(rows, columns)
    owner = np.repeat(wanted, [len(sets[k][0]) for k in wanted])
    shingles = np.concatenate([sets[k][0] for k in wanted])
    shares = np.concatenate([sets[k][1] / sets[k][1].sum() for k in wanted])
    _, at, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    owner, shares, at = owner[keep], shares[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, shares, at = owner[order], shares[order], at[order]
    place_row, place_column = np.full(len(sets), -1), np.full(len(sets), -1)
    place_row[rows], place_column[columns] = np.arange(len(rows)), np.arange(len(columns))
    of_rows = np.zeros((len(rows), len(columns)), np.float32)
    of_columns = np.zeros_like(of_rows)
    for first in range(0, int(shared.sum()), COLUMNS):
        here = slice(*np.searchsorted(at, [first, first + COLUMNS]))
        x, y = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(columns), COLUMNS), np.float32)
        for matrix, place in ((x, place_row), (y, place_column)):
            inside = place[owner[here]] >= 0
            matrix[place[owner[here]][inside], at[here][inside] - first] = shares[here][inside]
        of_rows += x @ (y > 0).astype(np.float32).T
        of_columns += (x > 0).astype(np.float32) @ y.T
    return of_rows, of_columns


def at_most(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A bound of the probability Jaccard similarity of sets with these shares of
    their weight in common shingles. The sum over common elements is at most its
    value for their total, as the summand is concave and homogeneous in (p, q)."""
    both = (p > 0) & (q > 0)
    safe = lambda x: np.where(both, x, 1)
    return np.where(both, 1 / (1 / safe(p) + 1 / safe(q) - 1), 0)


def links_between(group: pa.Table, similarity: float) -> dict[str, list[int]]:
    """Links between texts of different labels in one group: of those that reach
    the similarity, as many as join the labels (a spanning forest).

    With shares p and q of their weights in common shingles, the similarity of two
    sets is at most 1 / (1 / p + 1 / q - 1), and exactly that if no shingle of
    theirs occurs twice; where this bound reaches the threshold, all is computed.
    """
    node, label = group["node"].to_numpy(), group["label"].to_numpy()
    own = group["own"].to_numpy()
    held = np.frombuffer(b"".join(group["registers"].to_pylist()), np.uint8).reshape(len(node), REGISTERS)
    first = np.flatnonzero(own == own.min())
    second = np.flatnonzero(own == own.max())
    close = (agreeing(held[first], held[second]) >= LEAST_AGREEMENT * REGISTERS) & (label[first][:, None] != label[second][None, :])
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    found: dict[str, list[int]] = {"a": [], "b": []}
    if not len(rows):
        return found
    close = close[np.ix_(rows, columns)]
    left, right = first[rows], second[columns]
    sets = [
        (np.frombuffer(s, np.uint64), np.frombuffer(w, np.int32))
        for s, w in zip(group["shingles"].to_pylist(), group["weights"].to_pylist())
    ]
    of_rows, of_columns = common_shares(sets, left, right)
    bound = at_most(of_rows, of_columns)
    likely = np.argwhere(close & (bound >= similarity - 1e-4))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    # the closest first: what they join needs no further comparison
    for r, c in likely[np.argsort(-bound[likely[:, 0], likely[:, 1]], kind="stable")].tolist():
        x, y = left[r], right[c]
        a, b = find(int(label[x])), find(int(label[y]))
        if a != b and probability_jaccard(sets[x][0], sets[x][1], sets[y][0], sets[y][1]) >= similarity:
            root[a] = b
            found["a"].append(min(int(node[x]), int(node[y])))
            found["b"].append(max(int(node[x]), int(node[y])))
    return found


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id.
    Rows that repeat id and text count as one, except for null and empty texts, which all stay."""
    classes = duplicate_classes(docs, doc_id, text, similarity)
    kept = classes.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__text_hash", F.xxhash64(text))
    found = hashed.join(kept, hashed[doc_id].eqNullSafe(kept["__id"]) & (F.col("__text_hash") == F.col("__hash")))
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    turn = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(0)))
    return found.withColumn("__turn", turn).where(empty | (F.col("__turn") == 1)).select(*docs.columns)
