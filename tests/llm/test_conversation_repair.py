"""Cheapest repairs against every script of edits, and whole conversations against a plain loop."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sqlark.llm import conversation_repair as repair
from sqlark.llm.queries import QUERIES
from tests.conftest import SMALL_DATA


def every_script(rows):
    """(cost, audit, roles) of all edits of ``rows`` = [(initial, truncated, gone)] with few inserts."""

    def extend(i, cost, audit, out):
        if i == len(rows):
            for n in range(4):
                for more in itertools.product("ua", repeat=n):
                    yield cost + 2 * n, audit + "I" * n, out + "".join(more)
            return
        initial, truncated, gone = rows[i]
        for n in range(4):
            for more in itertools.product("ua", repeat=n):
                c, a, o = cost + 2 * n, audit + "I" * n, out + "".join(more)
                if not re.fullmatch("s?(ua)*u?", o):
                    continue
                yield from extend(i + 1, c + 3, a + "D", o)
                if not gone:
                    yield from extend(i + 1, c + truncated, a + "K", o + initial)
                    for role in "ua":
                        yield from extend(i + 1, c + 2 + truncated, a + "R", o + role)

    return extend(0, 0, "", "")


def brute(rows):
    return min((c, a) for c, a, o in every_script(rows) if re.fullmatch("(s?(ua)+)?", o))


def codes(rows):
    return bytes(repair.GONE if gone else repair.row_code(initial, bool(truncated)) for initial, truncated, gone in rows)


def test_cheapest_of_every_script():
    kinds = [(i, t, 0) for i in "suax" for t in (0, 1)] + [("u", 0, 1)]
    for rows in itertools.chain(*(itertools.product(kinds, repeat=n) for n in range(3))):
        assert repair.cheapest(codes(rows)) == brute(rows)
    rng = random.Random(3)
    for _ in range(150):
        rows = [rng.choice(kinds) for _ in range(rng.randrange(3, 5))]
        assert repair.cheapest(codes(rows)) == brute(rows)


def test_letters_cut_off_on_the_way_change_nothing(monkeypatch):
    rng = random.Random(9)
    for _ in range(60):
        rows = bytes(rng.choice([0, 1, 2, 3, 4, 9, 10, 11, 12]) for _ in range(rng.randrange(1, 120)))
        monkeypatch.setattr(repair, "STEP", 1000)
        whole = repair.cheapest(rows)
        for step in (1, 7):
            monkeypatch.setattr(repair, "STEP", step)
            assert repair.cheapest(rows) == whole


@pytest.mark.parametrize("rows", [bytes([2, 3] * 100_000), bytes([0] * 100_000), bytes([2] * 100_000), bytes([4, 1, 11] * 40_000)])
def test_long_conversations(rows):
    cost, audit = repair.cheapest(rows)
    assert len(audit) >= len(rows)


def plain(rows):
    """The contract by a loop; rows are (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        found.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv, members in found.items():
        tie = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], tie(m[1], m[2])))
        seen, marks = set(), []
        for _, role, text in members:
            shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            marks.append(fault)
        turns = [t for t, _, _ in members if t is not None]
        initials = [r[:1] for _, r, _ in members]
        rules = [(i, f == "truncated", f in ("blank", "duplicate")) for i, f in zip(initials, marks)]
        cost, audit = repair.cheapest(codes(rules))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[marks.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256("\n".join(written(members, audit)).encode()).hexdigest(),
        )
    return out


def written(members, audit):
    stay = audit.replace("D", "")
    roles = (["system"] if len(stay) % 2 else []) + ["user", "assistant"] * (len(stay) // 2)
    rows, lines = iter(members), []
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else next(rows)
        if letter != "D":
            lines.append(f"{role if letter == 'K' else roles[len(lines)]}:{text}")
    return lines


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def figures(df):
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_query_against_a_plain_loop(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL_DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert figures(QUERIES["op12_conversation_repair"](spark, SMALL_DATA)) == plain(rows)


def awkward():
    rng = random.Random(1)
    texts = ["Yes.", "No", "", None, " \n", "What?\t", "Same.", "x" * 50_000 + ".", "ü!"]
    rows = [
        (rng.choice([None, *range(30)]), rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts))
        for _ in range(900)
    ]
    return rows + [(77, t % 3, "user", "again and again.") for t in range(3000)]


def test_awkward_rows(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("part", "message", "audit", "copies", "blank")])
    damaged = repair.damaged(df.repartition(3))
    audits = repair.audits(damaged)
    assert figures(repair.digest(damaged, audits)) == plain(rows)
    messages = repair.repaired(damaged, audits).collect()
    joined = {}
    for m in sorted(messages, key=lambda m: m.place):
        joined.setdefault(m.conv_id, []).append(f"{m.role}:{m.text}")
    for conv, values in plain(rows).items():
        assert hashlib.sha256("\n".join(joined.get(conv, [])).encode()).hexdigest() == values[-1]


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    damaged = repair.damaged(none)
    assert repair.digest(damaged, repair.audits(damaged)).count() == 0
