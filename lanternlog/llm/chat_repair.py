r"""Conversation structure repair by a run-length dynamic program.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. A turn may be kept (cost 0), given the role that
is due (2), deleted (3), and turns without text may be inserted (2); blank and repeated turns must be deleted, and a
truncated one that stays costs 1 more. The cheapest edits are wanted, of equally cheap ones the ASCII-least audit
string of their initials (D, I, K, R).

What a turn does to the costs of the four states (nothing yet, after s, u, a) is a min-plus matrix that depends on a
symbol alone: role initial and fault. Equal consecutive symbols form a run, and a run takes the costs from its end to its
start by cached binary powers of its matrix. The costs to go are computed from the last run to the first; then the edits
are unrolled forwards, the least letter that still reaches the cheapest end at each step. Costs to go are kept for
every 256th run and inside a run for 1,024 turns at a time, so a conversation needs memory for its runs' symbols and for
its audit string, a byte a turn, which is part of the result.

Texts are not read by the program: faults come from column expressions, repeated turns from a window over equal turns of
a conversation, and the first pass deals 60 bytes a turn. The second pass deals the texts with the audits and streams a
conversation's turns past its audit. A conversation is one stream in one task, as its digest and audit are one value; its
texts are never held.

Defined results: a null role or text is one space, so that the turn is blank or its role none of the three. Turns are
ordered by turn (null first), then by the SHA-256 of role and text, which also stands for them when repeated turns are
sought. A null conversation is a conversation. Repeated rows are turns, of which all but one are duplicates. Very long
texts are streamed. An empty table gives an empty table. Columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are not
read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame, Window, functions as F

from .chat import by_batches, rows_of
from .common import SEPARATORS, arrow_schema, cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a role given or inserted leads to.
DUE = (USER, USER, ASSISTANT, USER)
LAWFUL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RELABEL, DELETE, INSERT, CUT = 2, 3, 2, 1
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The symbol of turns that must go; others are twice the role's state, plus one if truncated.
GONE = 8
NEVER = 1 << 60
STRIDE, PIECE = 256, 1024

AUDITS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
TURNS = "conv_id bigint, position bigint, role string, text string, edit string, turn bigint"
DIGESTS = "conv_id bigint, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


Costs = tuple[int, ...]
Matrix = tuple[Costs, ...]


def times(left: Matrix, right: Matrix) -> Matrix:
    return tuple(tuple(min(a + right[k][t] for k, a in enumerate(row)) for t in range(4)) for row in left)


def applied(matrix: Matrix, costs: Costs) -> Costs:
    return tuple(min(a + c for a, c in zip(row, costs)) for row in matrix)


def inserts() -> Matrix:
    """Costs of going from state to state by insertions alone."""
    rows = []
    for state in range(4):
        row, cost = [NEVER] * 4, 0
        while cost < row[state]:
            row[state] = cost
            state, cost = DUE[state], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def kept_state(state: int, role: int) -> int | None:
    """Where a kept turn leads, or None if its role is not lawful there."""
    if role == START or (state != START and (state, role) not in LAWFUL) or (state == START and role == ASSISTANT):
        return None
    return role


@lru_cache(maxsize=None)
def power(symbol: int, exponent: int) -> Matrix:
    """The matrix of ``2 ** exponent`` turns of one symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    edits = [[NEVER] * 4 for _ in range(4)]
    for state, row in enumerate(edits):
        row[state] = DELETE
        if symbol != GONE:
            role, cut = divmod(symbol, 2)
            row[DUE[state]] = min(row[DUE[state]], RELABEL + cut * CUT)
            to = kept_state(state, role)
            if to is not None:
                row[to] = min(row[to], cut * CUT)
    return times(inserts(), tuple(map(tuple, edits)))


ENDINGS = tuple(min(row[START], row[ASSISTANT]) for row in inserts())


def before_run(symbol: int, length: int, costs: Costs) -> Costs:
    """Costs to go before a run, from those after it."""
    exponent = 0
    while length:
        if length & 1:
            costs = applied(power(symbol, exponent), costs)
        length >>= 1
        exponent += 1
    return costs


def unrolled(symbol: int, length: int, state: int, after: Costs) -> tuple[str, int]:
    """The edits of a run from a state on, and the state behind it."""
    letters, role, cut = [], symbol // 2, symbol % 2
    while length:
        piece = min(length, PIECE)
        length -= piece
        costs = [before_run(symbol, length, after)]
        for _ in range(piece):
            costs.append(applied(power(symbol, 0), costs[-1]))
        for now, later in zip(costs[:0:-1], costs[-2::-1]):
            while True:
                want = now[state]
                if DELETE + later[state] == want:
                    letters.append("D")
                    break
                if INSERT + now[DUE[state]] == want:
                    letters.append("I")
                    state = DUE[state]
                    continue
                to = kept_state(state, role) if symbol != GONE else None
                if to is not None and cut * CUT + later[to] == want:
                    letters.append("K")
                    state = to
                else:
                    letters.append("R")
                    state = DUE[state]
                break
    return "".join(letters), state


def cheapest(symbols: array, lengths: array) -> tuple[int, str]:
    """Cost and audit of a conversation given as runs."""
    marks = {len(symbols): ENDINGS}
    costs = ENDINGS
    for run in range(len(symbols) - 1, -1, -1):
        costs = before_run(symbols[run], lengths[run], costs)
        if run % STRIDE == 0:
            marks[run] = costs
    state, audit = START, []
    for low in range(0, len(symbols), STRIDE):
        high = min(low + STRIDE, len(symbols))
        after = [marks[high]]
        for run in range(high - 1, low, -1):
            after.append(before_run(symbols[run], lengths[run], after[-1]))
        for run, later in zip(range(low, high), reversed(after)):
            letters, state = unrolled(symbols[run], lengths[run], state, later)
            audit.append(letters)
    while state not in (START, ASSISTANT):
        audit.append("I")
        state = DUE[state]
    return costs[START], "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, as the CRC of conversation and turn says."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).filter("code <> 0")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def identified(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    identity = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"), identity.alias("identity"))


def judged(turns: DataFrame) -> DataFrame:
    """Role state and first fault of every turn, without its text."""
    first = F.substring("role", 1, 1)
    state = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(START)
    end = F.right(F.rtrim(F.col("text"), F.lit(SEPARATORS)), F.lit(1))
    rows = identified(turns).select("conv_id", "turn", "identity", state.alias("state"), end.alias("end"))
    seen = Window.partitionBy("conv_id", "identity").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(F.col("end") == "", BLANK)
        .when(F.row_number().over(seen) > 1, DUPLICATE)
        .when(~F.col("end").isin(".", "!", "?"), TRUNCATED)
        .otherwise(NO_FAULT)
    )
    rows = rows.select("conv_id", "turn", "identity", "state", fault.alias("fault"))
    return rows.withColumn("again", F.col("fault") == DUPLICATE)  # of equal rows of a turn, the first one comes first


def audited(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, own in groupby(rows, key=lambda row: row["conv_id"]):
        symbols, lengths = array("B"), array("q")
        faults, illegal, distinct, least, last, before = [0] * 4, 0, 0, None, None, None
        for row in own:
            turn, state, fault = row["turn"], row["state"], row["fault"]
            if turn is not None and turn != last:
                least, last, distinct = turn if least is None else least, turn, distinct + 1
            illegal += before is not None and (before, state) not in LAWFUL
            before = state
            faults[fault] += 1
            symbol = GONE if fault in (BLANK, DUPLICATE) else 2 * state + (fault == TRUNCATED)
            if symbols and symbols[-1] == symbol:
                lengths[-1] += 1
            else:
                symbols.append(symbol)
                lengths.append(1)
        cost, audit = cheapest(symbols, lengths)
        gaps = last - least + 1 - distinct if distinct else 0
        yield dict(zip(names(AUDITS), (conv, gaps, *faults[BLANK:], illegal, cost, audit)))


def in_order(rows: DataFrame, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    order = ["conv_id", *first, F.col("turn").asc_nulls_first(), "identity", *last]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def audits(turns: DataFrame) -> DataFrame:
    """Faults, cost and edits of every conversation; written, as the edits and the counts are read apart."""
    fields = arrow_schema(AUDITS)
    rows = in_order(judged(turns), last=["again"]).select("conv_id", "turn", "state", "fault")
    return cut_lineage(rows.mapInArrow(lambda b: by_batches(audited(rows_of(b)), fields), AUDITS), "audits")


def edited(rows: Iterator[dict]) -> Iterator[dict]:
    """The repaired turns; a conversation's audit comes before its turns."""
    for conv, own in groupby(rows, key=lambda row: row["conv_id"]):
        state, position = START, 0
        for letter in next(own)["audit"]:
            row = {"role": None, "text": "", "turn": None} if letter == "I" else next(own)
            if letter == "D":
                continue
            state = 1 + INITIALS.index(row["role"][0]) if letter == "K" else DUE[state]
            role = row["role"] if letter == "K" else ROLES[state]
            yield dict(zip(names(TURNS), (conv, position, role, row["text"], letter, row["turn"])))
            position += 1


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after the edits of ``audits``, in order within partitions."""
    fields = arrow_schema(TURNS)
    rows = identified(turns).withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")})
    heads = found.select("conv_id", "audit").withColumn("kind", F.lit(0))
    rows = in_order(rows.unionByName(heads, allowMissingColumns=True), ["kind"])
    return rows.select("conv_id", "turn", "role", "text", "audit").mapInArrow(lambda b: by_batches(edited(rows_of(b)), fields), TURNS)


def digested(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, own in groupby(rows, key=lambda row: row["conv_id"]):
        sha, between = hashlib.sha256(), ""
        for row in own:
            sha.update(f"{between}{row['role']}:{row['text']}".encode("utf-8", "surrogatepass"))
            between = "\n"
        yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of every conversation that has turns, read from rows in the order of ``repaired``."""
    fields = arrow_schema(DIGESTS)
    return turns.mapInArrow(lambda b: by_batches(digested(rows_of(b)), fields), DIGESTS)


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Faults, edits and digest for every conversation, also for those of which ``turns`` holds nothing."""
    found = audits(turns)
    sums = found.join(digests(repaired(turns, found)).withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    rows = ids.join(sums, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    nothing = hashlib.sha256().hexdigest()
    return rows.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
