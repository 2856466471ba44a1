r"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are the context, and only its text is under the
loss mask. Turns after the last assistant turn close the conversation as a last example without a mask, so that the
output holds every turn.

The template writes ``<|im_start|>role\ntext<|im_end|>\n`` per turn. Inside roles and texts, a control string gets a
backslash after its first character; one that has backslashes there gets one more, so that reading back takes exactly
one away.

Rows are dealt by conversation and sorted by turn, and a task formats its conversations as a stream of rows: it holds
the text of one conversation, never all of a partition.

Defined results: a null text or role is empty. Rows with equal turns are ordered by role and text; a null turn comes
first. Rows with a null conversation form one conversation. Repeated rows are turns of their own. An empty table gives
an empty table. Columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema

START, END, TARGET = "<|im_start|>", "<|im_end|>\n", "assistant"
#: What may follow the first character of a control string.
CONTROL_ENDS = r"\||/?s>|/?INST\]|</?SYS>>"
PLAIN = re.compile(rf"([<\[])(\\*)({CONTROL_ENDS})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)({CONTROL_ENDS})")
EXAMPLES = "conv_id bigint, example bigint, text string, loss_start bigint, loss_end bigint, closes boolean"
EXAMPLE = [f.split()[0] for f in EXAMPLES.split(", ")]
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    return PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition("\n")
        yield unescape_role(role), unescape(body.removesuffix(END))


def by_batches(rows: Iterator[dict], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row.get("text") or "")
        if size > BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, fields)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, fields)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield from batch.slice(low, 256).to_pylist()


def expanded(turns: Iterator[dict]) -> Iterator[dict]:
    """Examples of conversations whose turns follow one another."""
    for conv, own in groupby(turns, key=lambda turn: turn["conv_id"]):
        prefix, later, number, held = "", [], 0, None
        for turn in own:
            if held:
                yield held
                held = None
            head, text = f"{START}{escape_role(turn['role'] or '')}\n", escape(turn["text"] or "")
            later.append(f"{head}{text}{END}")
            if turn["role"] == TARGET:
                prefix, later = prefix + "".join(later), []
                end = len(prefix) - len(END)
                held = dict(zip(EXAMPLE, (conv, number, prefix, end - len(text), end, False)))
                number += 1
        if later:
            held = dict(zip(EXAMPLE, (conv, number, prefix + "".join(later), -1, -1, False)))
        yield held | {"closes": True}


def expand(conversations: DataFrame) -> DataFrame:
    """One example per assistant turn, and one for turns that no assistant follows; sorted within partitions."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    fields = arrow_schema(EXAMPLES)
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda b: by_batches(expanded(rows_of(b)), fields), EXAMPLES)


def digested(examples: Iterator[dict]) -> Iterator[dict]:
    turns_sha, loss_sha, loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
    for row in examples:
        chars += len(row["text"])
        if row["loss_start"] >= 0:
            target = unescape(row["text"][row["loss_start"] : row["loss_end"]])
            loss += len(target)
            loss_sha.update(target.encode("utf-8", "surrogatepass"))
        if row["closes"]:
            n = 0
            for role, text in parse(row["text"]):
                n += 1
                turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            yield dict(zip([f.split()[0] for f in DIGESTS.split(", ")], (row["conv_id"], n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars)))
            turns_sha, loss_sha, loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of the conversations, read from the rows that ``expand`` returned, in their order."""
    fields = arrow_schema(DIGESTS)
    return examples.mapInArrow(lambda b: by_batches(digested(rows_of(b)), fields), DIGESTS)
