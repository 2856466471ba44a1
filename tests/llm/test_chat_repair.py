"""Conversation repair against every possible edit, a forward program over strings, and a row-by-row reading."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from array import array

import pytest

from lanternlog.llm import chat_repair

CLASSES = "?sua"
SYMBOLS = [*range(8), chat_repair.GONE]
LAW = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256().hexdigest()


def runs(symbols):
    groups = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
    return array("B", [s for s, _ in groups]), array("q", [n for _, n in groups])


def every_edit(symbols):
    """Cost and audit by trying all edits, with up to two insertions between turns."""
    gaps = [("", "", 0), ("u", "I", 2), ("a", "I", 2), ("ua", "II", 4), ("au", "II", 4)]
    steps = [gaps]
    for s in symbols:
        edits = [("", "D", 3)]
        if s != chat_repair.GONE:
            edits += [(CLASSES[s // 2], "K", s % 2), ("u", "R", 2 + s % 2), ("a", "R", 2 + s % 2)]
        steps += [edits, gaps]
    best = None
    for way in itertools.product(*steps):
        if LAW.fullmatch("".join(w[0] for w in way)):
            found = sum(w[2] for w in way), "".join(w[1] for w in way)
            best = min(best or found, found)
    return best


def forwards(symbols):
    """Best (cost, audit) by the last role, turn by turn."""
    grow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(4):
            for last, (cost, audit) in list(best.items()):
                to = (cost + 2, audit + "I")
                best[grow[last]] = min(best.get(grow[last], to), to)
        return best

    best = inserted({"": (0, "")})
    for s in symbols:
        new = {}
        for last, (cost, audit) in best.items():
            ways = [(last, cost + 3, audit + "D")]
            if s != chat_repair.GONE:
                ways.append((grow[last], cost + 2 + s % 2, audit + "R"))
                role = CLASSES[s // 2]
                if (last + role) in ("s", "u", "su", "ua", "au"):
                    ways.append((role, cost + s % 2, audit + "K"))
            for role, *way in ways:
                new[role] = min(new.get(role, tuple(way)), tuple(way))
        best = inserted(new)
    return min(best[last] for last in ("", "a") if last in best)


def test_every_edit():
    rng = random.Random(5)
    cases = [()] + [(s,) for s in SYMBOLS] + [tuple(rng.choice(SYMBOLS) for _ in range(n)) for n in (2, 2, 2, 2, 3, 3, 3, 3)]
    for symbols in cases:
        assert chat_repair.cheapest(*runs(symbols)) == every_edit(symbols)


@pytest.mark.parametrize("seed", range(5))
def test_forwards(seed):
    rng = random.Random(seed)
    for _ in range(60):
        symbols = [s for _ in range(rng.randrange(9)) for s in [rng.choice(SYMBOLS)] * rng.choice((1, 1, 2, 5, 9))]
        assert chat_repair.cheapest(*runs(symbols)) == forwards(symbols)


def test_marks_and_pieces(monkeypatch):
    """Runs beyond a stride and beyond a piece give the same edits."""
    monkeypatch.setattr(chat_repair, "STRIDE", 3)
    monkeypatch.setattr(chat_repair, "PIECE", 4)
    test_forwards(11)


def test_long_run():
    n = 300_000
    cost, audit = chat_repair.cheapest(array("B", [4]), array("q", [n]))
    assert cost == 2 * (n // 2) and len(audit) == n


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        place = ":".join(" " if v is None else str(v) for v in (conv, turn))
        code = zlib.crc32(place.encode()) % 20
        if code:
            row = (conv, turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
            yield from [row] * (2 if code == 3 else 1)


def plain_report(rows):
    convs = collections.defaultdict(list)
    for row in damage(rows):
        convs[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, symbols, faults = set(), [], collections.Counter()
        for _, _, role, text in own:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            state = "sua".find(role[:1]) + 1 if role else 0
            symbols.append(chat_repair.GONE if fault in ("blank", "duplicate") else 2 * state + (fault == "truncated"))
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = forwards(symbols)
        text, left, last = [], iter(own), ""
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter == "D":
                continue
            due = "assistant" if last == "u" else "user"
            role = row[2] if letter == "K" else due
            text.append(f"{role}:{row[3] if row else ''}")
            last = role[0]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults[f] for f in ("blank", "duplicate", "truncated")],
            illegal,
            cost,
            audit,
            hashlib.sha256("\n".join(text).encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind int, audit string, state string, edit int"


def odd_rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "Done.", "Not done", "Why?  \n", "日本語。", "long text " * 9000 + "end!", "a\x1c", "Yes!", "." * 50]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "ü"]
    rows = []
    for conv in [None, -8, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice((None, turn, turn, turn, turn * 3, -turn)), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:20]


def test_report(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.report(table, chat_repair.damaged(table)).collect()}
    assert got == plain_report(rows)


def test_all_rows_dropped(spark):
    turn = next(t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(1, turn, "user", "Gone.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in chat_repair.report(table, chat_repair.damaged(table)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert chat_repair.report(table, chat_repair.damaged(table)).count() == 0


def test_given_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.report(table, chat_repair.damaged(table)).collect()}
    assert got == plain_report(rows)
