"""Greedy windows of a stream whose rows come late, shuffled or twice.

A window opens at a key's first event and then at each first event ``length`` seconds or more after the last opening. A
late event can open a window before others, which moves every opening after it. The keyed state therefore holds a key's
seconds, not only its last opening: a map from block of seconds to the block's seconds, counts and openings. An event
changes its own block; the openings are laid anew from there on and only until they meet the old ones again. What
changed leaves as a changelog: a row with ``op`` -1 takes an earlier row back, a row with 1 puts another in its place.

A block's event-time timer runs out when the watermark has passed its end and a window's length: no row of it can be
accepted any more, so it is folded into one value, the reach of its last window. State is bounded by the seconds between
watermark and newest event, however many rows a second has.

Rows are dropped as repeats by their id within the watermark, then rows of one key and second are combined inside
each partition, so a hot key sends one row per second and partition to its task.

Defined results: the sum of the changes is what the batch form gives for the distinct rows that came before their
watermark. A null key column is a key of its own. Rows older than the watermark are not applied (see ``late``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from lanternlog.functions.signals import with_signals
from lanternlog.operators import composite as cp, incidents as inc
from lanternlog.params import DEFAULTS, Params
from lanternlog.streaming.pipelines import start
from lanternlog.streaming.state import write_batch

BLOCK_SECONDS = 3600
SECONDS = "secs array<bigint>, counts array<bigint>, us array<bigint>, seqs array<bigint>, ids array<string>, opens array<bigint>"
#: What a second holds: number of rows and its first row by (us, seq, id).
CHANGE = [
    StructField("sec", LongType()),
    StructField("open_sec", LongType()),
    StructField("n", LongType()),
    StructField("first_us", LongType()),
    StructField("first_seq", LongType()),
    StructField("first_id", StringType()),
    StructField("op", IntegerType()),
]
DELAY = "spark.watermarkDelayMs"
UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(delay: str) -> int:
    number, unit = re.fullmatch(r"(\d+) (\w+?)s?", delay).groups()
    return int(number) * UNITS[unit]


class GreedyWindows(StatefulProcessor):
    """Keeps the openings of one key right while its rows come in any order."""

    def __init__(self, keys: list[str], length: int, block_seconds: int = BLOCK_SECONDS):
        self.keys, self.length, self.block = keys, length, block_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block bigint", SECONDS)
        #: Blocks before ``before`` are closed; their last window opened at ``last_open``.
        self.closed = handle.getValueState("closed", "before bigint, last_open bigint")

    def _closed(self) -> tuple[int | None, int | None]:
        return self.closed.get() if self.closed.exists() else (None, None)

    def _load(self, block: int) -> dict[int, list]:
        if not self.blocks.containsKey((block,)):
            return {}
        secs, *columns = self.blocks.getValue((block,))
        return {int(s): list(row) for s, *row in zip(secs, *columns)}

    def _store(self, block: int, seconds: dict[int, list]) -> None:
        secs = sorted(seconds)
        columns = [list(c) for c in zip(*(seconds[s] for s in secs))]
        self.blocks.updateValue((block,), (secs, *columns))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, list] = {}
        for part in rows:
            for sec, n, us, seq, id_ in part[["sec", "n", "first_us", "first_seq", "first_id"]].itertuples(index=False):
                self._add(arrived, int(sec), [int(n), int(us), int(seq), id_, None])
        before, last_open = self._closed()
        arrived = {s: row for s, row in arrived.items() if before is None or s // self.block >= before}
        if not arrived:
            return
        touched = sorted({s // self.block for s in arrived})
        known = {int(k[0]) for k in self.blocks.keys()}
        for block in set(touched) - known:
            self.handle.registerTimer(((block + 1) * self.block + self.length) * 1000)
        earlier = [b for b in known if b < touched[0]]
        if earlier:
            last_open = max((s, row[4]) for s, row in self._load(max(earlier)).items())[1]
        changes = []
        for block in sorted(known.union(touched)):
            if block < touched[0]:
                continue
            seconds, old = self._load(block), {}
            for sec, row in seconds.items():
                old[sec] = tuple(row)
            for sec in [s for s in arrived if s // self.block == block]:
                self._add(seconds, sec, arrived[sec])
            for sec in sorted(seconds):
                if last_open is None or sec >= last_open + self.length:
                    last_open = sec
                seconds[sec][4] = last_open
            new = {s: tuple(row) for s, row in seconds.items()}
            if new == old:
                if block > touched[-1]:
                    break
                continue
            for sec in sorted(seconds):
                if old.get(sec) != new[sec]:
                    changes += [self._change(sec, old[sec], -1)] if sec in old else []
                    changes.append(self._change(sec, new[sec], 1))
            self._store(block, seconds)
        if changes:
            yield pd.DataFrame([(*key, *c) for c in changes], columns=[*self.keys, *[f.name for f in CHANGE]])

    @staticmethod
    def _add(seconds: dict[int, list], sec: int, row: list) -> None:
        held = seconds.get(sec)
        if held is None:
            seconds[sec] = list(row)
            return
        first = min(held[1:4], row[1:4], key=lambda r: (r[0], r[1], r[2] or ""))
        seconds[sec] = [held[0] + row[0], *first, held[4]]

    @staticmethod
    def _change(sec: int, row: tuple, op: int) -> tuple:
        return sec, row[4], *row[:4], op

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.length
        ended = sorted(int(k[0]) for k in self.blocks.keys() if (int(k[0]) + 1) * self.block <= limit)
        if ended:
            last_open = max((s, row[4]) for s, row in self._load(ended[-1]).items())[1]
            self.closed.update((ended[-1] + 1, last_open))
            for block in ended:
                self.blocks.removeKey((block,))
        return iter([])

    def close(self) -> None:
        pass


def combined(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """One row per key and second of each Arrow batch; the event time keeps its watermark."""
    named = {f.name: f for f in rows.schema.fields}
    ts = StructField("ts", TimestampType(), True, {DELAY: milliseconds(delay)})
    out = StructType([*[named[k] for k in keys], ts, *[f for f in CHANGE if f.name not in ("open_sec", "op")]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.sort_values(["first_us", "first_seq", "first_id"], na_position="first")
            groups = part.groupby([*keys, "sec"], dropna=False, sort=False)
            first = groups[["ts", "first_us", "first_seq", "first_id"]].first()
            first["n"] = groups.size()
            yield first.reset_index()[[f.name for f in out.fields]]

    return rows.mapInPandas(run, out)


def window_changes(
    rows: DataFrame, keys: list[str], length: int, id_: str, seq: str | None = None, delay: str = "1 hour", block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Changelog of the windows of a stream with ``ts``, the keys and an id that tells repeats."""
    seen = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_])
    sequence = F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint")
    marks = seen.select(
        *keys, "ts", F.unix_seconds("ts").alias("sec"), F.unix_micros("ts").alias("first_us"), sequence.alias("first_seq"),
        F.col(id_).cast("string").alias("first_id"),
    )
    named = {f.name: f for f in marks.schema.fields}
    return combined(marks, keys, delay).groupBy(*keys).transformWithStateInPandas(
        GreedyWindows(keys, length, block_seconds),
        outputStructType=StructType([*[StructField(k, named[k].dataType) for k in keys], *CHANGE]),
        outputMode="append",
        timeMode="EventTime",
    )


def emission_changes(logs: DataFrame, p: Params = DEFAULTS, delay: str = "1 hour", block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Changelog of the suppression windows of immediate events; a row with ``sec = open_sec`` is an emission."""
    rows = with_signals(logs.select(*cp._needed(logs), "log_id")).where("immediate")
    rows = rows.select("tenant_id", "service", F.col("sig_pattern").alias("pattern"), "ts", "log_seq", "log_id")
    return window_changes(rows, cp.SUPPRESS_KEYS, p.immediate_dedup_seconds, "log_id", "log_seq", delay, block_seconds)


def ticket_changes(events: DataFrame, p: Params = DEFAULTS, delay: str = "1 hour", block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Changelog of the ticket windows of a stream of events."""
    rows = inc.keyed_events(events, p).select(*inc.KEYS, "ts", "event_id")
    return window_changes(rows, inc.KEYS, p.ticket_dedup_seconds, "event_id", None, delay, block_seconds)


def store_changes(changes: DataFrame, path: str, checkpoint: str, interval: str | None = None, name: str | None = None):
    """Write the changelog, one folder per micro-batch, so that a batch that runs again replaces itself."""
    return start(changes, lambda batch, batch_id: write_batch(batch, path, batch_id), checkpoint, interval, name)


def standing(changes: DataFrame) -> DataFrame:
    """The rows of a changelog that were not taken back."""
    columns = [c for c in changes.columns if c not in ("op", "batch")]
    return changes.groupBy(*columns).agg(F.sum("op").alias("op")).where("op > 0").drop("op")


def emissions(changes: DataFrame) -> DataFrame:
    """Standing immediate emissions, in the form of ``composite.immediate_rows``."""
    rows = standing(changes).where("sec = open_sec")
    return rows.select(F.col("first_seq").alias("log_seq"), *cp.SUPPRESS_KEYS, "sec")


def tickets(changes: DataFrame) -> DataFrame:
    """Standing ticket windows, in the form of ``incidents.ticket_windows``."""
    return standing(changes).select(*inc.KEYS, "sec", F.col("n").alias("n_events"), "open_sec")
