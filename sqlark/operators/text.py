"""Documents to chunks.

A document is a table of page texts ``(doc_id, page_no, text)`` or one row of
text. Pages are joined in blocks, so a document of any length comes as one or
more consecutive parts and never has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlark.functions.ordered import with_running_offset
from sqlark.session import materialize

PAGES_PER_PART = 1024
SENTENCE_GAP = r"(?<=[.!?])[ \t\r\n\f]+"
LINE_OR_SENTENCE_GAP = r"\n+|(?<=[.!?])[ \t\r\n\f]+"
WHITESPACE = " \t\r\n\f"


def concat_pages(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page_no",
    text: str = "text",
    separator: str = "\n",
    trailing: bool = True,
    pages_per_part: int = PAGES_PER_PART,
) -> DataFrame:
    """Page texts joined in page order → ``doc, part_no, text, n_chars``.

    ``trailing`` puts the separator after every page, otherwise it stands only
    between pages. The parts of a document, put one after the other, are its
    whole text; up to ``pages_per_part`` pages make a single part 0, whatever
    their numbers. Pages without a text add nothing. A null document is one as
    any other; pages without a number come first, by a hash of their texts, and
    pages of one number stand in that order.

    Texts are shuffled once, by ranges of page numbers; only where a range is not
    a part (numbers with gaps) its pieces go on to their parts. What is counted
    across a document is one narrow row for each range, and a plan that needs
    only ``n_chars`` shuffles no text.
    """
    unnumbered = F.col("_page").isNull()
    rows = pages.where(F.col(text).isNotNull()).select(
        F.struct(F.col(doc).alias("id")).alias("_doc"), F.col(page).alias("_page"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash")
    )
    spans = rows.withColumn(
        "_span",
        F.struct(
            F.when(~unnumbered, F.floor(F.col("_page") / pages_per_part)).alias("numbers"),
            F.when(unnumbered, F.shiftrightunsigned("_hash", 52)).alias("hashes"),
        ),
    )
    key = ["_doc", "_span"]
    in_order = lambda value: F.transform(F.sort_array(F.collect_list(F.struct("_page", "_hash", value.alias("v")))), lambda x: x["v"])
    texts, sizes = in_order(F.col("_text")).alias("_texts"), in_order(F.length("_text").cast("bigint")).alias("_sizes")
    if _in_one_range(pages, page, pages_per_part):
        parts = rows.groupBy("_doc").agg(texts, sizes).withColumn("_part", F.lit(0).cast("bigint"))
        return _joined(parts, doc, text, separator, trailing)
    counts = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_doc")
    before = whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(
        *key, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all")
    )
    gathered = spans.groupBy(*key).agg(texts, sizes)
    first, last = F.floor(F.col("_before") / pages_per_part), F.floor((F.col("_before") + F.col("_n") - 1) / pages_per_part)
    begin = F.greatest(F.col("_before"), F.col("_part") * pages_per_part)
    end = F.least(F.col("_before") + F.col("_n"), (F.col("_part") + 1) * pages_per_part)
    cut = lambda c: F.slice(c, (begin - F.col("_before") + 1).cast("int"), (end - begin).cast("int"))
    pieces = (
        gathered.join(places, key)
        .withColumn("_part", F.explode(F.sequence(first, last)))
        .select(
            "_doc",
            "_part",
            begin.alias("_begin"),
            (end - begin == F.least(F.lit(pages_per_part), F.col("_all") - F.col("_part") * pages_per_part)).alias("_whole"),
            cut("_texts").alias("_texts"),
            cut("_sizes").alias("_sizes"),
        )
    )
    mended = (
        pieces.where(~F.col("_whole"))
        .groupBy("_doc", "_part")
        .agg(
            *[
                F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_begin", F.col(c).alias("v")))), lambda x: x["v"])).alias(c)
                for c in ("_texts", "_sizes")
            ]
        )
    )
    parts = pieces.where("_whole").select("_doc", "_part", "_texts", "_sizes").union(mended)
    return _joined(parts, doc, text, separator, trailing)


def _in_one_range(pages: DataFrame, page: str, pages_per_part: int) -> bool:
    """Whether all page numbers lie in one range, so that every document is one part: one look at the least and the highest."""
    if pages.isStreaming:
        return False
    found = pages.agg(F.min(page).alias("least"), F.max(page).alias("most"), F.count_if(F.col(page).isNull()).alias("none")).first()
    return not found["none"] and (found["least"] is None or found["least"] // pages_per_part == found["most"] // pages_per_part)


def _joined(parts: DataFrame, doc: str, text: str, separator: str, trailing: bool) -> DataFrame:
    """Parts as text, from the texts of their pages."""
    # A later part starts with the separator that follows the part before.
    lead = F.when(F.col("_part") > 0, F.lit("" if trailing else separator)).otherwise(F.lit(""))
    tail = F.lit(separator if trailing else "")
    size = F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda a, n: a + n) + len(separator) * (F.size("_sizes") - 1)
    return parts.select(
        F.col("_doc.id").alias(doc),
        F.col("_part").alias("part_no"),
        F.concat(lead, F.array_join("_texts", separator), tail).alias(text),
        (size + F.length(lead) + F.length(tail)).alias("n_chars"),
    )


def fixed_windows(text: Column | str, chunk_size: int) -> Column:
    """Consecutive windows of ``chunk_size`` characters, the last one shorter.

    One linear pass over the text; the pattern's dot is a code point. Empty
    text gives no window.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk_size}}}"), F.lit(0))


def whole_sentences(pieces: Column) -> Column:
    return F.filter(pieces, lambda s: s != "")


def trimmed_sentences(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, lambda s: F.trim(s, F.lit(WHITESPACE))), lambda s: s != "")


def sentences(text: Column | str) -> Column:
    """Sentences end at ``. ! ?`` followed by whitespace."""
    return whole_sentences(F.split(text, SENTENCE_GAP, -1))


def line_sentences(text: Column | str) -> Column:
    """Sentences that also end at line breaks, trimmed, without empty ones."""
    return trimmed_sentences(F.split(text, LINE_OR_SENTENCE_GAP, -1))


def explode_chunks(df: DataFrame, chunks: Column, keep: Sequence[str], text: str = "text") -> DataFrame:
    """One row per chunk, numbered from 0 within its document as ``entity_id``."""
    return df.select(*keep, F.posexplode(chunks).alias("entity_id", text))


def chunk_fixed(df: DataFrame, chunk_size: int, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    return explode_chunks(df, fixed_windows(text, chunk_size), keep, text)


def chunk_sentences(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    return explode_chunks(df, sentences(text), keep, text)


def chunk_line_sentences(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    return explode_chunks(df, line_sentences(text), keep, text)


ChunkStrategy = Callable[[DataFrame, int, Sequence[str]], DataFrame]

STRATEGIES: dict[str, ChunkStrategy] = {
    "fixed": lambda df, chunk_size, keep: chunk_fixed(df, chunk_size, keep),
    "nltk": lambda df, chunk_size, keep: chunk_sentences(df, keep),
    "spacy": lambda df, chunk_size, keep: chunk_line_sentences(df, keep),
}


def chunk(df: DataFrame, strategy: str, chunk_size: int, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chunks by strategy name; the sentence strategies ignore ``chunk_size``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}, expected one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](df, chunk_size, keep)


#: Sentence strategies: where a text is cut, and what of the pieces is kept.
SENTENCE_RULES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "nltk": (SENTENCE_GAP, whole_sentences),
    "spacy": (LINE_OR_SENTENCE_GAP, trimmed_sentences),
}


def chunk_pages_sentences(parts: DataFrame, strategy: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of documents that come in parts, as from ``concat_pages``, equal to
    those of the whole text. Returns ``doc, entity_id, text``.

    Each part is cut alone. What stands before its first gap (its head) and after
    its last one (its tail) may go on across the border, so a tail, the heads that
    follow it and parts without a gap form a *run*, which is cut again. A tail takes
    its gap along with the character before it, as a gap may go on, too; that
    character is not of the run. Only runs are shuffled as text, and a run is as
    long as the sentence at the border; runs and parts are numbered over a narrow
    table of one row for each part. Parts, cut, are staged.
    """
    if strategy not in SENTENCE_RULES:
        raise ValueError(f"unknown sentence strategy {strategy!r}, expected one of {sorted(SENTENCE_RULES)}")
    gap, kept = SENTENCE_RULES[strategy]
    count = F.size("_pieces")
    closes = count > 1
    before_last = F.get("_pieces", count - 2)
    # a part that begins with its only gap has no character before it and goes on whole
    cut = (
        parts.select(F.struct(F.col(doc).alias("id")).alias("_doc"), F.col("part_no").alias("block"), F.col(text).alias("_text"))
        .withColumn("_pieces", F.split("_text", gap, -1))
        .withColumn("_closes", closes & (F.length(before_last) > 0))
        .select(
            "_doc",
            "block",
            "_closes",
            F.when(F.col("_closes"), F.get("_pieces", F.lit(0))).otherwise(F.col("_text")).alias("_head"),
            F.when(
                F.col("_closes"),
                F.concat(
                    F.substring(before_last, -1, 1),
                    F.element_at(F.regexp_extract_all("_text", F.lit(f"({gap})"), F.lit(0)), -1),
                    F.element_at("_pieces", -1),
                ),
            ).alias("_tail"),
            F.when(F.col("_closes"), kept(F.slice("_pieces", 2, F.greatest(count - 2, F.lit(0))))).alias("_inner"),
        )
    )
    cut = materialize(cut.withColumn("_n", F.size("_inner")), "cut-parts")
    numbered = with_running_offset(cut, ["_doc"], F.col("_closes").cast("bigint"), "_run", "_runs")
    heads = numbered.select("_doc", "_run", (2 * F.col("block")).alias("at"), F.lit(False).alias("opens"), F.col("_head").alias("t"))
    tails = numbered.where("_closes").select(
        "_doc", (F.col("_run") + 1).alias("_run"), (2 * F.col("block") + 1).alias("at"), F.lit(True).alias("opens"), F.col("_tail").alias("t")
    )
    runs = (
        heads.union(tails)
        .groupBy("_doc", "_run")
        .agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("run"), F.max("opens").alias("opened"))
        .withColumn("pieces", F.split(F.array_join(F.transform("run", lambda x: x["t"]), ""), gap, -1))
        .withColumn("pieces", F.when(F.col("opened"), F.slice("pieces", 2, F.size("pieces"))).otherwise(F.col("pieces")))
        .select("_doc", (2 * F.col("_run")).alias("block"), kept(F.col("pieces")).alias("sentences"))
        .withColumn("_n", F.size("sentences"))
    )
    inner = numbered.where("_closes").select("_doc", (2 * F.col("_run") + 1).alias("block"), F.col("_inner").alias("sentences"), "_n")
    placed = with_running_offset(runs.union(inner), ["_doc"], F.col("_n"), "_first", "_total")
    found = placed.select(F.col("_doc.id").alias(doc), "_first", F.posexplode("sentences").alias("_at", text))
    return found.select(doc, (F.col("_first") + F.col("_at")).cast("int").alias("entity_id"), text)


def chunk_pages(parts: DataFrame, strategy: str, chunk_size: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of documents in parts by strategy name, equal to those of the whole text."""
    if strategy == "fixed":
        return chunk_pages_fixed(parts, chunk_size, doc, text)
    return chunk_pages_sentences(parts, strategy, doc, text)


def chunk_pages_fixed(parts: DataFrame, chunk_size: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fixed chunks of documents that come in parts, as from ``concat_pages``.

    Windows run across part borders. Each part is cut where the document's
    windows fall; only the incomplete pieces at inner borders are shuffled
    again and joined. Returns ``doc, entity_id, text``.
    """
    located = with_running_offset(
        parts.withColumnRenamed("part_no", "block"), [doc], F.col("n_chars"), "_start", "_total"
    ).where(F.col("n_chars") > 0)
    into = F.col("_start") % chunk_size
    # Pieces of the part: first the rest of the window the part starts in, then whole windows.
    head_length = F.least(F.when(into > 0, chunk_size - into).otherwise(F.lit(0)), F.length(text))
    head = F.when(head_length > 0, F.array(F.substring(F.col(text), F.lit(1), head_length.cast("int"))))
    rest = fixed_windows(F.substring(F.col(text), (head_length + 1).cast("int"), F.length(text)), chunk_size)
    pieces = located.select(
        doc,
        "block",
        "_total",
        F.floor(F.col("_start") / chunk_size).alias("_first"),
        F.posexplode(F.concat(F.coalesce(head, F.array().cast("array<string>")), rest)).alias("_pos", text),
    ).select(doc, "block", (F.col("_first") + F.col("_pos")).cast("int").alias("entity_id"), "_total", text)
    due = F.least(F.lit(chunk_size), F.col("_total") - F.col("entity_id") * chunk_size)
    whole = pieces.where(F.length(text) == due).select(doc, "entity_id", text)
    broken = pieces.where(F.length(text) < due)
    # At most chunk_size pieces, each of at least one character, meet in one window.
    mended = broken.groupBy(doc, "entity_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), F.col(text).alias("t")))),
                lambda piece: piece["t"],
            ),
            "",
        ).alias(text)
    )
    return whole.unionByName(mended)
