"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

In a merge list where every merge makes a new token, a sequence of tokens is
the encoding of its text exactly if every token encodes to itself and every two
neighbours do. So each prefix of a word has one last token: of the tokens that
end there, the one that is compatible with the last token of the prefix before it.
The tokens that end at a place are those that are a suffix of the prefix; an
Aho-Corasick automaton over all tokens yields them (a trie whose suffix links it
follows, instead of a suffix automaton of each word: the same matches). Back-pointers from the whole word
give its ids. Nothing is merged step by step, and a word takes time in
proportion to its length times the tokens that end at a place.

Words repeat, so each worker keeps a bounded memory of words already encoded;
long pieces, as of text without spaces, are encoded anew each time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from string import ascii_lowercase

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlark.llm.common import Remembered, map_texts, worker_memory

#: Words, pieces of text and pairs remembered by a Python worker at once; no result depends on it.
REMEMBERED = 200_000
WORD_END = "</w>"
#: Code points for symbols that end a word; those of other symbols stay below.
ENDING = 0x1000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it has
    one, the next unused code point from 256 on elsewhere."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class TokenizerFile:
    """What a tokenizer file of kind BPE with word ends says about texts.

    Understood is what such files need: text is cut at added tokens, then
    normalised (NFC, white space to one space, lower case), split into words by
    the file's pattern, and each word's bytes are symbols of which the last
    carries the word end. Other settings are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = spec = json.load(file)
        model = spec["model"]
        steps = [(n["type"], n.get("content")) for n in spec["normalizer"]["normalizers"]]
        split, by_bytes = spec["pre_tokenizer"]["pretokenizers"]
        understood = (
            model["type"] == "BPE"
            and model["end_of_word_suffix"] == WORD_END
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
            and by_bytes["type"] == "ByteLevel"
            and not by_bytes["add_prefix_space"]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not understood:
            raise ValueError(f"{path}: settings that this encoder does not know")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        #: whether a run of ASCII letters is always one word
        self.letters = self.pattern.findall(ascii_lowercase) == [ascii_lowercase]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_byte = byte_characters()

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # lower() would look at a sigma's place
        return text.lower()

    def words(self, piece: str) -> list[str]:
        if self.letters and piece.isascii() and piece.isalpha():
            return [piece]
        return self.pattern.findall(piece)

    def characters(self, word: str) -> str:
        """The printable characters of a word's bytes."""
        if word.isascii() and word.isalnum():
            return word
        return "".join([self.of_byte[b] for b in word.encode("utf-8")])


class WordBPE(TokenizerFile):
    """Such a file made ready for encoding and decoding."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        self.texts = {i: t for t, i in [*model["vocab"].items(), *self.added.items()]}
        self._build(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def _build(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        #: rank of the merge of two tokens; a token that is never taken into another one has rank ``never``
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(merges)}
        parts = {vocab[a + b]: (vocab[a], vocab[b], n) for n, (a, b) in enumerate(merges)}
        if len(parts) < len(merges):
            raise ValueError("two merges make the same token")
        never = len(merges)
        #: The tokens at a token's right and left edge while it is being made, the token itself first,
        #: each with the rank of the merge that takes it in.
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        self.fits = Remembered(lambda pair: not self._merges_across(*pair, never), REMEMBERED)
        self.automaton = ahocorasick.Automaton()
        reachable: set[int] = set()
        for text, token in sorted(vocab.items(), key=lambda x: parts[x[1]][2] if x[1] in parts else -1):
            self.right_edge[token] = self.left_edge[token] = [(token, never)]
            if token in parts:
                a, b, n = parts[token]
                self.right_edge[token] = [(token, never), (b, n), *self.right_edge[b][1:]]
                self.left_edge[token] = [(token, never), (a, n), *self.left_edge[a][1:]]
                if a not in reachable or b not in reachable or self._merges_across(a, b, n):
                    continue
            reachable.add(token)
            symbols = self._symbols(text.removesuffix(WORD_END), text.endswith(WORD_END) and text != WORD_END)
            self.automaton.add_word(symbols, (token, len(symbols)))
        self.automaton.make_automaton()

    @staticmethod
    def _symbols(characters: str, ends: bool) -> str:
        return characters[:-1] + chr(ord(characters[-1]) + ENDING) if ends else characters

    def _merges_across(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of lower rank than ``before`` joins an end of a with a
        start of b. Both must still stand then; of equal merges the left one
        comes first."""
        return any(
            (rank := self.rank.get((x, y), before)) < before and rank < x_until and rank <= y_until
            for x, x_until in self.right_edge[a]
            for y, y_until in self.left_edge[b]
        )

    def encode_word(self, word: str) -> list[int]:
        symbols = self._symbols(self.characters(word), True)
        last: list[int | None] = [None] * (len(symbols) + 1)
        back = [0] * (len(symbols) + 1)
        fits = self.fits
        for at, (token, length) in self.automaton.iter(symbols):
            end = at + 1
            if last[end] is None:
                start = end - length
                before = last[start]
                if not start or (before is not None and fits[before, token]):
                    last[end], back[end] = token, start
        ids, end = [], len(symbols)
        while end:
            ids.append(last[end])
            end = back[end]
        return ids[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a normalised text without added tokens."""
        return [i for word in self.words(chunk) for i in self.encode_word(word)]

    def decode(self, ids) -> str:
        """Texts of the ids, joined by spaces as a file without a decoder has it; unknown ids give nothing."""
        return " ".join([self.texts[i] for i in ids if i in self.texts])


class ChunkMemory:
    """Encodes whole texts piece by piece and remembers the last pieces.

    Spaces and line ends always part words, so a text's ids are those of the
    pieces between them; in a piece of letters with one mark at the end, letters
    and mark are words of their own. ``encode_chunk`` gives the ids of a piece.
    """

    def __init__(self, file: TokenizerFile, encode_chunk, limit: int = REMEMBERED):
        self.file = file
        self.encode_chunk = encode_chunk
        self.known = Remembered(self._compute, limit)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(file.added, key=len, reverse=True)) + ")")

    def _compute(self, piece: str) -> bytes:
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return self.known[piece[:-1]] + self.known[piece[-1]]
        return array("i", self.encode_chunk(piece)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        added = self.file.added
        if not any(t in text for t in added):
            return self._encode(text)
        return b"".join(
            np.int32(added[part]).tobytes() if part in added else self._encode(part) for part in self.cut.split(text)
        )

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.file.normalise(text).replace("\n", " ").split(" ")))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin and end."""
        coded = [self.encode(t) for t in texts]
        return np.frombuffer(b"".join(coded), np.int32), np.cumsum([0, *[len(c) // 4 for c in coded]])


def tokenizer(path: str) -> WordBPE:
    """The tokenizer, built once in each Python worker."""
    built = worker_memory("bpe/files")
    if path not in built:
        built[path] = WordBPE(path)
    return built[path]


def _memory(path: str) -> ChunkMemory:
    kept = worker_memory("bpe/pieces")
    if path not in kept:
        bpe = tokenizer(path)
        kept[path] = ChunkMemory(bpe, bpe.encode_chunk)
    return kept[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text, and with ``decoded`` also the
    text that these ids give back, made in the same pass.

    A null text is empty, an empty text has no ids. Strings of added tokens in a
    text get their ids, as in the tokenizer's library. Repeated rows give
    repeated results; other columns are not read. ``path`` must be readable on
    every executor.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = _memory(path).encode_all([t or "" for t in batch.column("text").to_pylist()])
        columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
        if decoded:
            columns.append(pa.array(decode_lists(columns[1], path), pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded
    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", schema, run, operator="bpe")


def decode_lists(ids: pa.ListArray, path: str) -> list[str]:
    bpe = tokenizer(path)
    texts = worker_memory("bpe/texts").get(path)
    if texts is None:
        texts = np.empty(max(bpe.texts) + 1, object)
        for i, t in bpe.texts.items():
            texts[i] = t
        worker_memory("bpe/texts")[path] = texts
    values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    if len(values) and not (0 <= values.min() and values.max() < len(texts) and len(bpe.texts) == len(texts)):
        return [bpe.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    return [" ".join(texts[values[a:b]].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of ``(doc_id, ids)``; null ids give an empty text, unknown ids nothing."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def step(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [tokenizer(path).decode(i or []) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(step, f"doc_id {kind}, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """Number of ids and hashes of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
