"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are no letter or digit become spaces, A-Z becomes a-z; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Rows that one Python step handles at once; bounds memory, changes no result.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any non-ASCII characters, A-Z in lower case."""
    return [] if text is None else utf8(text).translate(WORD_BYTES).split()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


#: What a Python worker remembers; modules are imported by reference, so all tasks of a worker see this one.
_kept: dict[str, dict] = {}


def worker_memory(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for look-ups that
    later tasks of the worker can use again. Never part of a result.

    A worker serves one operator after the other, so what another one has left
    goes; names that are equal up to a slash belong together.
    """
    for other in [k for k in _kept if k.split("/")[0] != name.split("/")[0]]:
        del _kept[other]
    return _kept.setdefault(name, {})


#: Texts longer than this are computed anew each time, so a memory of them is bounded in bytes, too.
LONGEST_REMEMBERED = 64


class Remembered(dict):
    """Values of ``compute``, of which about the last ``limit`` to ``2 * limit``
    used keys are kept, but no text of more than ``LONGEST_REMEMBERED`` characters.
    ``d[key]`` is always right, whether kept or not."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > LONGEST_REMEMBERED:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)


def map_texts(
    df: DataFrame,
    text: str,
    schema: str,
    run: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    limit: int = SLICE_BYTES,
    operator: str = "none",
) -> DataFrame:
    """``run`` on bounded pieces of the rows, in workers that hold memory of ``operator`` only."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(operator)
        for piece in slices(batches, text, limit):
            out = run(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(step, schema)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def trigrams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word with its borders, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = np.frombuffer(b"".join([b"  " + w + b" " for w in words]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 3 for w in words], np.int64)
    code = mix(marked[:-2] | marked[1:-1] << np.uint64(8) | marked[2:] << np.uint64(16))
    ends = np.cumsum(sizes)
    inside = np.ones(len(marked), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return (code[inside[: len(code)]] % np.uint64(buckets)).astype(np.int64), sizes - 2


def share_object(spark: SparkSession, thing) -> Callable:
    """Sends an object's attributes (plain data) to every task; the result gives
    a task the object again. The object may be None."""
    kind, shared = type(thing), spark.sparkContext.broadcast(None if thing is None else vars(thing))

    def get():
        if shared.value is None:
            return None
        made = kind.__new__(kind)
        made.__dict__.update(shared.value)
        return made

    return get
