"""Document sources: stored files or tables of page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SCHEMA = "doc_id string, page_no bigint, text string"
PageExtractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

_PAGES = pa.schema([("doc_id", pa.string()), ("page_no", pa.int64()), ("text", pa.string())])
#: Bytes of a file that an extractor of pieces gets at once.
PIECE_BYTES = 1 << 20
#: Names of files that Spark's reader of records would unpack.
PACKED_FILES = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd|passthrough)$"
#: What Spark's reader of records leaves out at the beginning of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def read_document_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: path, length and bytes."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def extract_pages(files: DataFrame, extractor: PageExtractor, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Decode files with a user function: batches of ``path, length, content``
    in, batches of ``doc_id, page_no, text`` out.

    A batch has one file. An extractor with a true attribute ``takes_pieces`` gets
    files in pieces of at most ``piece_bytes`` instead, one after the other, with their
    number from 0 on as ``piece``, and never holds a file.

    Of ``files`` without ``content`` the contents are read here. If the extractor names
    the one-byte ``separator`` that its pages end with, nobody holds a file, and a large
    one is read by many tasks: each calls the extractor with pieces of its split.
    """
    if "content" not in files.columns:
        return _stored_pages(files, extractor, piece_bytes)
    files = files.select("path", "length", "content")
    if getattr(extractor, "takes_pieces", False):
        last = F.greatest(F.ceil(F.octet_length("content") / piece_bytes) - 1, F.lit(0)).cast("int")
        numbered = files.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        begin = F.col("piece") * piece_bytes + 1
        files = numbered.withColumn("content", F.substring("content", begin, F.lit(piece_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = (batch.slice(i, 1).to_pandas() for batch in batches for i in range(batch.num_rows))
        for pages in extractor(single):
            yield pa.RecordBatch.from_pandas(pages, _PAGES, preserve_index=False)

    return files.mapInArrow(run, PAGE_SCHEMA)


def _load(spark: SparkSession, kind: str, paths: list[str], **options: str) -> DataFrame:
    """Files by their names, in which no character is a pattern and no folder a column."""
    escaped = ["".join(f"\\{c}" if c in "\\{}[]*?," else c for c in path) for path in paths]
    return spark.read.format(kind).options(recursiveFileLookup="true", **options).load(escaped)


def _stored_pages(files: DataFrame, extractor: PageExtractor, piece_bytes: int) -> DataFrame:
    """Pages of stored files, which are read in splits where the extractor allows it.

    A first pass counts the records of each split, so that the second knows the number
    of a split's first page.
    """
    spark, separator = files.sparkSession, getattr(extractor, "separator", None)
    packed = F.col("path").rlike(PACKED_FILES)
    # the names of the files, which the driver has listed before
    names = files.select("path", packed.alias("packed")).distinct().collect()
    whole = [r.path for r in names if separator is None or r.packed]
    split = [r.path for r in names if separator is not None and not r.packed]
    pages = []
    if split:
        # in a URL a plus sign is one; url_decode() takes it for a blank
        path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
        records = _load(spark, "text", split, lineSep=separator.decode()).select(
            path.alias("path"),
            F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("content"),
        )
        counted = records.groupBy("path", "start").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content") + F.lit(1).cast("bigint")).alias("read"), F.first("length").alias("length")
        )
        of_file = Window.partitionBy("path")
        before = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        # one row for each split
        places = counted.select(
            "path",
            "start",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
            ((F.sum("read").over(of_file) + 1 < F.col("length")) & (F.row_number().over(of_file.orderBy("start")) == 1)).alias("marked"),
        ).collect()
        found = {r.path for r in places}
        # a byte order mark alone is no record
        whole += [p for p in split if p not in found]
        if found:
            shared = spark.sparkContext.broadcast({(r.path, r.start): (r.first, r.marked) for r in places})
            pages.append(records.mapInArrow(_pages_of_splits(extractor, separator, piece_bytes, shared), PAGE_SCHEMA))
    if whole:
        pages.append(extract_pages(_load(spark, "binaryFile", whole).select("path", "length", "content"), extractor, piece_bytes))
    if not pages:
        return spark.createDataFrame([], PAGE_SCHEMA)
    return pages[0] if len(pages) == 1 else pages[0].unionByName(pages[1])


def _pages_of_splits(extractor: PageExtractor, separator: bytes, piece_bytes: int, places) -> Callable:
    """The extractor over the records of one split after the other."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], list[bytes]]]:
        for batch in batches:
            path, start = batch.column("path").dictionary_encode(), np.asarray(batch.column("start"))
            code = np.asarray(path.indices)
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a < b:
                    key = path.dictionary[int(code[a])].as_py(), int(start[a]), batch.column("length")[a].as_py()
                    yield key, batch.column("content").slice(a, b - a).to_numpy(zero_copy_only=False).tolist()

    def pieces(key: tuple[str, int, int], parts: Iterator[list[bytes]], marked: bool) -> Iterator[pd.DataFrame]:
        path, _, length = key
        piece, held, size = 0, [BYTE_ORDER_MARK] if marked else [], 0
        frame = lambda: pd.DataFrame({"path": [path], "length": [length], "content": [b"".join(held)], "piece": [piece]})
        for part in parts:
            for content in part:
                held += [content, separator]
                size += len(content) + 1
                if size >= piece_bytes:
                    yield frame()
                    piece, held, size = piece + 1, [], 0
        if held:
            yield frame()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in groupby(records(batches), key=lambda part: part[0]):
            first, marked = places.value[key[:2]]
            for pages in extractor(pieces(key, (content for _, content in parts), marked)):
                pages["page_no"] += first
                yield pa.RecordBatch.from_pandas(pages, _PAGES, preserve_index=False)

    return run


def form_feed_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Extractor for plain text files whose pages end with a form feed; files may come in pieces."""
    path, number, open_page = None, 0, []

    def page_rows(pages: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": path, "page_no": range(number, number + len(pages)), "text": [p.decode("utf-8") for p in pages]})

    for batch in batches:
        pieces = batch["piece"] if "piece" in batch else [0] * len(batch)
        for name, content, piece in zip(batch["path"], batch["content"], pieces):
            if piece == 0:
                if any(open_page):
                    yield page_rows([b"".join(open_page)])
                path, number, open_page = name, 0, []
            first, *others = bytes(content).split(b"\f")
            open_page.append(first)
            if others:
                pages = [b"".join(open_page), *others[:-1]]
                yield page_rows(pages)
                number, open_page = number + len(pages), [others[-1]]
    if any(open_page):
        yield page_rows([b"".join(open_page)])


form_feed_pages.takes_pieces = True
form_feed_pages.separator = b"\f"


def read_page_table(spark: SparkSession, path: str, doc: str, page: str, text: str) -> DataFrame:
    """Pages that are already rows of a Parquet table."""
    return spark.read.parquet(path).select(
        F.col(doc).alias("doc_id"), F.col(page).alias("page_no"), F.col(text).alias("text")
    )
