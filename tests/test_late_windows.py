"""Greedy windows of streams whose files come shuffled, late and twice."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import composite as cp, incidents as inc, rule_score as rs
from lanternlog.params import Params
from lanternlog.sources import readers
from lanternlog.sources.logview import log_view
from lanternlog.streaming import windows as wn

P = Params(immediate_dedup_seconds=20, ticket_dedup_seconds=45)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def written(parts, path):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        if i + 1 < len(parts):
            time.sleep(1.1)  # the file source takes files in the order of their times


@pytest.fixture(scope="module")
def logs(spark, sf):
    return log_view(spark, sf)


@pytest.fixture(scope="module")
def shuffled(logs, tmp_path_factory):
    """The log view dealt at random over four files, a third of it in two of them, the newest rows first."""
    path = str(tmp_path_factory.mktemp("shuffled") / "logs")
    part = F.pmod(F.xxhash64("log_seq"), F.lit(4))
    again = F.when(F.col("log_seq") % 3 == 0, F.pmod(F.xxhash64("log_seq", F.lit(1)), F.lit(4)))
    newest = F.when(F.col("log_seq") > 900, 0)
    dealt = logs.withColumns({"to": F.coalesce(newest, part), "again": again})
    written([dealt.where((F.col("to") == i) | (F.col("again") == i)).drop("to", "again") for i in range(4)], path)
    return path


def run(spark, stream, tmp_path):
    wn.store_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("block_seconds", [7, 3600])
def test_emissions(spark, logs, shuffled, tmp_path, block_seconds):
    source = readers.read_table_stream(spark, shuffled, logs.schema, files_per_batch=1)
    got = run(spark, wn.emission_changes(source, P, "1 hour", block_seconds), tmp_path)
    want = cp.immediate_rows(logs, P)
    assert rows(wn.emissions(got), *want.columns) == rows(want, *want.columns)
    assert got.where("op = -1").count() > 0
    assert got.select("batch").distinct().count() >= 4


@pytest.mark.parametrize("block_seconds", [7, 3600])
def test_tickets(spark, logs, shuffled, tmp_path, block_seconds):
    source = readers.read_table_stream(spark, shuffled, logs.schema, files_per_batch=1)
    events = rs.rule_score(logs)
    got = run(spark, wn.ticket_changes(rs.rule_score(source), P, "1 hour", block_seconds), tmp_path)
    keyed = inc.keyed_events(events, P)
    want = inc.ticket_windows(keyed, P)
    assert rows(wn.tickets(got), *want.columns) == rows(want, *want.columns)
    columns = [*inc.KEYS, "open_sec", "rank", "event_id"]
    assert rows(inc.ticket_members(keyed, wn.tickets(got), P), *columns) == rows(inc.ticket_members(keyed, want, P), *columns)


def test_restart(spark, logs, shuffled, tmp_path):
    """A second start with nothing new changes nothing."""
    source = readers.read_table_stream(spark, shuffled, logs.schema, files_per_batch=2)
    once = rows(run(spark, wn.emission_changes(source, P), tmp_path), "sec", "open_sec", "n", "op")
    assert rows(run(spark, wn.emission_changes(source, P), tmp_path), "sec", "open_sec", "n", "op") == once


def greedy(seconds, length):
    out, reach = {}, None
    for s in sorted(seconds):
        if reach is None or s >= reach:
            opened, reach = s, s + length
        out[s] = opened
    return out


def test_blocks_close(spark, tmp_path):
    """With a short watermark, old blocks leave the state, and windows across closed blocks stay right."""
    rng = random.Random(4)
    base = 1_700_000_000
    times = {k: sorted(rng.sample(range(2000), 400)) for k in ("a", "b", None)}
    made = [(f"{k}{t}", k, base + t) for k, ts in times.items() for t in ts]
    table = spark.createDataFrame(made, "id string, k string, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    edges = [0, 350, 700, 1200, 1600, 2100]
    written([table.where((F.unix_seconds("ts") >= base + a) & (F.unix_seconds("ts") < base + b)) for a, b in zip(edges, edges[1:])], f"{tmp_path}/in")
    source = readers.read_table_stream(spark, f"{tmp_path}/in", table.schema, files_per_batch=1)
    changes = wn.window_changes(source, ["k"], 90, "id", delay="10 seconds", block_seconds=60)
    query = wn.store_changes(changes, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    got = {(r.k, r.sec): r.open_sec for r in wn.standing(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {(k, base + s): base + o for k, ts in times.items() for s, o in greedy(ts, 90).items()}
    state = [o for p in query.recentProgress for o in p.stateOperators if o.operatorName.startswith("transformWithState")]
    most = max(o.numRowsTotal for o in state)
    assert 0 < state[-1].numRowsTotal < most


def test_random_orders():
    """The processor against the plain rule, for many arrival orders, without Spark."""

    class Map(dict):
        containsKey = dict.__contains__
        getValue, removeKey = dict.__getitem__, dict.pop
        updateValue = dict.__setitem__

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        def getMapState(self, *_):
            return Map()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, _):
            pass

    for seed in range(60):
        rng = random.Random(seed)
        length, block = rng.choice((1, 5, 30)), rng.choice((3, 10, 100))
        marks = [(rng.randrange(120), i) for i in range(rng.randrange(1, 60))]
        rng.shuffle(marks)
        machine = wn.GreedyWindows(["k"], length, block)
        machine.init(Handle())
        total = {}
        while marks:
            batch = [marks.pop() for _ in range(min(len(marks), rng.randrange(1, 9)))]
            frame = wn.pd.DataFrame([(s, 1, s * 10 + i % 3, i, str(i)) for s, i in batch], columns=["sec", "n", "first_us", "first_seq", "first_id"])
            for out in machine.handleInputRows(("x",), iter([frame]), None):
                for row in out.itertuples(index=False):
                    total[tuple(row)[:-1]] = total.get(tuple(row)[:-1], 0) + row.op
        standing = [row for row, n in total.items() if n]
        assert set(total.values()) <= {0, 1}
        assert {row[1]: row[2] for row in standing} == greedy({row[1] for row in standing}, length)
        assert len(standing) == len({row[1] for row in standing})
