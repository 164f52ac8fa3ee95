"""Token ids of a corpus in compressed files, in ascending document order.

Ids are coded by a static range asymmetric numeral system with one frequency
table for all files. A file is a Parquet file of blocks; a block holds whole
documents and can be read without any other block. Inside it, segments of
SEGMENT ids are coded apart: their table of places and coder states are the
checkpoints from which any of them can be decoded alone, and all at once as
lanes of one array. Ids and payload carry checksums.

Block layout, little-endian: magic, ids, segments, crc32 of the ids as 32-bit
integers, crc32 of the frequency table; per segment the number of 32-bit words;
per segment LANES 64-bit states; the words; crc32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlark.llm.bpe import ChunkMemory, TokenizerFile
from sqlark.llm.common import map_texts, worker_memory
from sqlark.session import materialize, shared_path, staging

END_ID = 1
LANES, STEPS = 256, 256
SEGMENT = LANES * STEPS
BLOCK_IDS = 8 * SEGMENT
#: What a task sorts, writes and reads at once, some 10 MB: it passes through the JVM's heap, Arrow and Parquet buffers.
FILE_IDS = 8 * BLOCK_IDS
#: Frequencies add up to 2 ** SCALE_BITS. States stay from 2 ** SCALE_BITS to below 2 ** (SCALE_BITS + 32), where
#: quotients in double precision are exact.
SCALE_BITS = 20
MAGIC = b"RNS1"
HEAD = "<4sIIII"
#: Pieces of text whose ids a Python worker remembers (once or twice as many); no result depends on it.
REMEMBERED = 600_000


# --- ids of texts, by the tokenizer's library


class LibraryEncoder:
    """Ids of texts by the tokenizers library.

    With ``by_piece`` the texts are cut into words as the file says, and the
    library's model encodes each distinct word; the last ones are remembered.
    That is for files of the kind of ``bpe.TokenizerFile``. Otherwise the
    library gets the texts whole.
    """

    def __init__(self, path: str, by_piece: bool = True):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memory = None
        if by_piece:
            file, tokenize = TokenizerFile(path), self.library.model.tokenize
            del file.spec  # the library has its own vocabulary

            def encode_piece(piece: str) -> list[int]:
                if file.letters and piece.isascii() and piece.isalpha():
                    return [t.id for t in tokenize(piece)]
                return [t.id for w in file.words(piece) for t in tokenize(file.characters(w))]

            self.memory = ChunkMemory(file, encode_piece, REMEMBERED)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.memory:
            ids, ends = self.memory.encode_all(texts)
            return np.split(ids, ends[1:-1])
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def encode_ids(
    docs: DataFrame, path: str, end_id: int = END_ID, by_piece: bool = True, id_type: str = "<u4"
) -> DataFrame:
    """``doc_id``, ``ids`` (as bytes of ``id_type``, ``end_id`` last), ``n`` and
    ``crc`` of every whole text; a null text is empty and has the end id alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoders = worker_memory("library_encoders")
        if (path, by_piece) not in encoders:
            encoders[path, by_piece] = LibraryEncoder(path, by_piece)
        end = np.array([end_id], id_type).tobytes()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        coded = [ids.astype(id_type).tobytes() + end for ids in encoders[path, by_piece](texts)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(coded, pa.binary()),
                pa.array([len(c) // len(end) for c in coded], pa.int64()),
                pa.array([zlib.crc32(c) for c in coded], pa.int64()),
            ],
            ["doc_id", "ids", "n", "crc"],
        )

    return map_texts(docs.select("doc_id", "text"), "text", f"doc_id {kind}, ids binary, n bigint, crc bigint", run, operator="library_encoders")


def id_type_of(path: str, end_id: int) -> str:
    """The narrowest type that holds all ids of the tokenizer."""
    import tokenizers

    return "<u2" if max(tokenizers.Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


# --- the coder


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols = symbols[order].astype(np.uint32)
        self.freq = scaled(counts[order].astype(np.float64))
        self.start = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(len(self.freq)), self.freq)
        self.place_of = np.zeros(int(self.symbols.max(initial=0)) + 1, np.int64)
        self.place_of[self.symbols] = np.arange(len(self.symbols))
        self.crc = zlib.crc32(self.symbols.tobytes() + self.freq.tobytes())

    def encode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.uint32)
        segments = -(-len(ids) // SEGMENT)
        places = self.place_of[np.minimum(ids, len(self.place_of) - 1)]
        if len(ids) and not np.array_equal(self.symbols[places], ids):
            raise ValueError("an id is not in the frequency table")
        padded = np.full(segments * SEGMENT, int(np.argmax(self.freq)), np.int64)
        padded[: len(ids)] = places
        steps = padded.reshape(segments, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, segments * LANES)
        freqs, starts = self.freq[steps], self.start[steps]
        limits, divisors = freqs << 32, freqs.astype(np.float64)
        state = np.full(segments * LANES, 1 << SCALE_BITS, np.int64)
        words: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        owner = (np.arange(segments * LANES) // LANES).astype(np.uint16 if segments < 1 << 16 else np.int64)
        for t in range(STEPS - 1, -1, -1):
            full = np.flatnonzero(state >= limits[t])
            out = state[full]
            words.append(out.astype(np.uint32))
            owners.append(owner[full])
            state[full] = out >> 32
            quotient = (state / divisors[t]).astype(np.int64)
            state += quotient * ((1 << SCALE_BITS) - freqs[t]) + starts[t]
        none = np.empty(0, np.uint32)
        stream = np.concatenate([none, *words[::-1]])
        of = np.concatenate([none.astype(owner.dtype), *owners[::-1]])
        sizes = np.bincount(of, minlength=segments).astype(np.uint32)
        body = (
            struct.pack(HEAD, MAGIC, len(ids), segments, zlib.crc32(ids.tobytes()), self.crc)
            + sizes.tobytes()
            + state.tobytes()
            + stream[np.argsort(of, kind="stable")].tobytes()
        )
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, block: bytes, only: range | None = None) -> np.ndarray:
        """The ids; with ``only`` those of these segments alone."""
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("block is damaged")
        magic, n, segments, crc, table = struct.unpack_from(HEAD, block)
        if magic != MAGIC or table != self.crc:
            raise ValueError("block is of another format or frequency table")
        sizes = np.frombuffer(block, np.uint32, segments, struct.calcsize(HEAD)).astype(np.int64)
        at = struct.calcsize(HEAD) + 4 * segments
        states = np.frombuffer(block, np.int64, segments * LANES, at).reshape(segments, LANES)
        stream = np.frombuffer(block[at + 8 * LANES * segments : -4], np.uint32).astype(np.int64)
        chosen = np.arange(segments)[only.start : only.stop] if only is not None else np.arange(segments)
        cursor = (np.cumsum(sizes) - sizes)[chosen][:, None]
        state = states[chosen].copy()
        out = np.empty((len(chosen), STEPS, LANES), np.uint32)
        for step in range(STEPS):
            low = state & ((1 << SCALE_BITS) - 1)
            place = self.slots[low]
            out[:, step] = place
            state = self.freq[place] * (state >> SCALE_BITS) + low - self.start[place]
            empty = state < 1 << SCALE_BITS
            taken = np.cumsum(empty, axis=1)
            state[empty] = (state[empty] << 32) | stream[(cursor + taken - 1)[empty]]
            cursor = cursor + taken[:, -1:]
        ids = self.symbols[out.reshape(-1)]
        if only is not None:
            return ids[: max(0, min(n, chosen[-1] * SEGMENT + SEGMENT) - chosen[0] * SEGMENT)] if len(chosen) else ids
        if zlib.crc32(ids[:n].tobytes()) != crc:
            raise ValueError("ids differ from their checksum")
        return ids[:n]


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as whole numbers of at least 1 with the sum 2 ** SCALE_BITS."""
    if len(counts) > 1 << (SCALE_BITS - 1):
        raise ValueError("too many symbols for the frequency table")
    freq = np.maximum(1, np.floor(counts * ((1 << SCALE_BITS) - len(counts)) / counts.sum())).astype(np.int64)
    excess = int(freq.sum()) - (1 << SCALE_BITS)
    by_size = np.argsort(-freq, kind="stable")
    for i in by_size if excess > 0 else by_size[:1]:
        change = min(excess, int(freq[i]) - 1)
        freq[i] -= change
        excess -= change
        if not excess:
            break
    return freq


# --- files


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, by_piece: bool = True
) -> None:
    """Writes ``path/blocks`` and ``path/table`` from ``doc_id`` and ``text``.

    Documents come in ascending ``doc_id`` (null first), rows of equal id in an
    order that depends on their ids of tokens. No documents give no blocks.
    The files are ranges of documents of about FILE_IDS ids.
    """
    with staging(docs.sparkSession):
        _write(docs, path, tokenizer_path, end_id, by_piece)


def _write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, by_piece: bool) -> None:
    spark = docs.sparkSession
    id_type = id_type_of(tokenizer_path, end_id)
    staged = materialize(encode_ids(docs, tokenizer_path, end_id, by_piece, id_type), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("none")
        total = np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                ids = np.frombuffer(b"".join(batch.column("ids").slice(start, 1000).to_pylist()), id_type)
                part = np.bincount(ids.astype(np.int64))
                small, large = sorted((part, total), key=len)
                total = large.astype(np.int64)
                total[: len(small)] += small
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    # bounded by the vocabulary
    table = staged.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    table.coalesce(1).write.parquet(f"{path}/table")
    symbols, counts = _table(spark, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("none")
        coder, part, start = Coder(symbols, counts), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush(start: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), id_type)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([rows["doc_id"].to_pylist()], pa.list_(rows.schema.field("doc_id").type)),
                    pa.array([rows["n"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([coder.encode(ids)], pa.binary()),
                ],
                ["part", "start", "doc_ids", "counts", "block"],
            )

        size = 0
        for batch in batches:
            first = 0
            for i, n in enumerate(batch.column("n").to_pylist()):
                size += n
                if size >= BLOCK_IDS:
                    held.append(batch.slice(first, i + 1 - first))
                    yield flush(start)
                    start, size, first, held = start + size, 0, i + 1, []
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield flush(start)

    files = max(1, -(-int(counts.sum()) // FILE_IDS))
    ordered = staged.repartitionByRange(files, "doc_id", "n", "crc").sortWithinPartitions("doc_id", "n", "crc", "ids")
    ordered.select("doc_id", "ids", "n").mapInArrow(
        blocks, f"part int, start bigint, doc_ids array<{kind}>, counts array<bigint>, block binary"
    ).write.parquet(f"{path}/blocks")


def _table(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/table").toArrow()
    return rows["id"].to_numpy(), rows["n"].to_numpy()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (32-bit integers as bytes) of every document."""
    symbols, counts = _table(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(symbols, counts)
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, ids_of, sizes, block = (batch.column(c)[row] for c in range(5))
                ids = coder.decode(block.as_py()).astype("<u4").tobytes()
                n = sizes.values.to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * len(n), pa.int32()),
                        ids_of.values,
                        pa.array(start.as_py() + ends - n, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary()),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )

    schema = f"part int, doc_id {kind}, start bigint, n_tokens bigint, ids binary"
    read = blocks.select("part", "start", "doc_ids", "counts", "block").mapInArrow(run, schema)
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    # one row of 16 bytes for each file of about FILE_IDS ids
    before = sizes.select(
        F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("__before")
    )
    return read.join(F.broadcast(before), F.col("part") == F.col("__part")).select(
        "doc_id", (F.col("start") + F.col("__before")).alias("start"), "n_tokens", "ids"
    )


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, by_piece: bool = True) -> DataFrame:
    """Writes files to a new folder of the shared place and reads them back."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, by_piece)
    return read_token_files(docs.sparkSession, path)


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
