"""Secrets in texts: known forms, and strings of high entropy.

Only DataFrame functions. Known forms are three patterns. Beyond them, a
window slides over every candidate string (a long run of letters, digits and
``+/_-``); its Shannon entropy is kept up to date by the counts of the
character that leaves and the one that enters. Limits depend on the character
class of the string. An allow list suppresses strings known to be harmless.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three known forms.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of [0-9a-f]+ has no second match in it, so its least length can stand here
MIN_SECRET, MIN_ACCESS = 6, 20

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Least entropy in bits a character of a window, by class of the candidate.
#: 20 characters hold at most 4.32 bits. Strings without a digit are a class of their own, as words are among them
#: (those of the test tables have 3.58 bits at most). Classes without an entry, and numbers, are not reported.
ENTROPY = {"alpha": 4.0, "hex": 3.05, "alnum": 3.55, "base64": 3.65}
#: Matches whose places are summed up in one go, and characters of a candidate that one go slides over.
MATCHES, PIECE = 256, 256
#: Whole candidates that are no secrets: UUIDs, file paths and words joined by - or _ (at most two digits in a row).
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([A-Za-z_-]+[0-9]{0,2}/)+[A-Za-z_-]*[0-9]{0,2}$",
    r"^[A-Za-z]+([_-]+[A-Za-z]*[0-9]{0,2})+$",
)

PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)
KINDS = ("assign", "access", "hex", "entropy")


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    entropy: dict[str, float] = ENTROPY,
    window: int = WINDOW,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """``doc_id`` and ``found``: an array of ``(start, kind_no, end)``, ordered.

    Positions count code points, ends are exclusive, ``kind_no`` counts KINDS
    from 0. Matches of one kind never overlap; those of different kinds may. A
    null text is empty. Repeated rows give repeated results; other columns of
    ``docs`` are not read.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    keep = (
        lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_SECRET,
        lambda m: F.char_length(m) >= MIN_ACCESS,
        lambda m: F.lit(True),
        lambda m: _is_random(m, entropy, window, allow),
    )
    found = found.select("*", *[_matches(p).alias(f"__m{i}") for i, p in enumerate(PATTERNS)])
    spans = [_spans(f"__m{i}", p, i, keep[i]) for i, p in enumerate(PATTERNS)]
    return found.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def _matches(pattern: str) -> Column:
    return F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(matches: str, pattern: str, kind: int, keep) -> Column:
    """Places of the matches, from the lengths of matches and of the gaps between them.

    An array that grows by one copies itself each time, so sums run over parts of
    bounded size, and over the parts' totals.
    """
    gaps = F.transform(F.split("__t", pattern, -1), lambda g: F.char_length(g))
    span = "struct<start:int,kind_no:int,end:int>"
    empty = F.array().cast(f"array<{span}>")
    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(matches)), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))
    )
    in_parts = lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(p) - 1) / MATCHES).cast("int")), lambda i: F.slice(p, i * MATCHES + 1, MATCHES)
    )
    total = lambda part: F.aggregate(part, F.lit(0), lambda at, x: at + x["gap"] + F.char_length(x["m"]))
    starts = lambda parts: F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, part: F.struct((s["at"] + total(part)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
        lambda s: s["all"],
    )

    def walked(part: Column, start: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            end = begin + F.char_length(x["m"])
            found = F.when(keep(x["m"]), F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind_no"), end.alias("end"))))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.coalesce(found, empty)).alias("spans"))

        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])

    found = let(let(pairs, in_parts), lambda parts: F.flatten(F.zip_with(parts, starts(parts), walked)))
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def _is_random(m: Column, entropy: dict[str, float], window: int, allow: tuple[str, ...]) -> Column:
    """Whether any window of the candidate reaches the limit of the candidate's class."""
    kind = (
        F.when(~m.rlike("[A-Za-z]"), F.lit(None))
        .when(~m.rlike("[0-9]"), F.lit("alpha"))
        .when(m.rlike("^[0-9a-fA-F]+$"), F.lit("hex"))
        .when(m.rlike("^[0-9A-Za-z]+$"), F.lit("alnum"))
        .otherwise(F.lit("base64"))
    )
    limit = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in entropy.items()])
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | m.rlike(pattern)
    # a place in a string is found from its start, so a long candidate is slid over in pieces that share a window less one
    cut = lambda parts: F.transform(
        parts, lambda part, i: F.concat(part, F.coalesce(F.substring(F.get(parts, i + 1), 1, window - 1), F.lit("")))
    )
    pieces = let(F.regexp_extract_all(m, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), cut)
    pieces = F.filter(pieces, lambda piece: F.char_length(piece) >= window)
    least = F.array_min(F.transform(pieces, lambda piece: _least(piece, window)))
    return F.when(limit.isNull() | allowed, F.lit(False)).otherwise(
        F.coalesce(F.lit(math.log2(window)) - least / window >= limit, F.lit(False))
    )


def _least(m: Column, window: int) -> Column:
    """The least sum of c * log2(c) over the counts c of a window's characters, for all windows:
    a window's entropy is log2(window) less that sum / window."""
    share = F.array(*[F.lit(0.0), *[F.lit(c * math.log2(c)) for c in range(1, window + 1)]])
    count = lambda part, c: F.char_length(part) - F.char_length(F.replace(part, c, F.lit("")))
    first = F.substring(m, F.lit(1), F.lit(window))
    start = F.aggregate(
        F.array_distinct(F.split(first, "")), F.lit(0.0), lambda total, c: total + F.get(share, count(first, c))
    )

    def slide(state: Column, i: Column) -> Column:
        """From the window that starts at i to the next one: one character leaves, one enters."""
        moved = lambda both: F.struct(
            count(F.substring(both, 2, window - 1), F.substring(both, 1, 1)).alias("left"),
            count(F.substring(both, 2, window - 1), F.substring(both, -1, 1)).alias("come"),
        )
        change = lambda n: (
            F.get(share, n["left"]) - F.get(share, n["left"] + 1) + F.get(share, n["come"] + 1) - F.get(share, n["come"])
        )
        both = F.substring(m, i, F.lit(window + 1))
        total = let(let(both, moved), lambda n: state["total"] + change(n))
        return let(total, lambda t: F.struct(t.alias("total"), F.least(state["least"], t).alias("least")))

    moves = F.char_length(m) - window
    steps = F.when(moves > 0, F.sequence(F.lit(1), F.greatest(moves, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(start.alias("total"), start.alias("least")), slide, lambda state: state["least"])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the known forms, the hash of their spans, and all spans as text."""
    named = lambda spans: F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind_no"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
    of_kind = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("long")
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(named(F.filter("found", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"),
        named(F.col("found")).alias("spans"),
        of_kind(3).alias("n_entropy"),
    )
