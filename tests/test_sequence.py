import random

from pyspark.sql import functions as F

from lanternlog.operators import sequence as sq

T0 = 1704067200


def test_greedy_windows_equal_a_loop(spark):
    random.seed(3)
    rows = []
    for k, (n, span) in enumerate([(5, 200000), (400, 400000), (4000, 3 * 86400), (1, 10)]):
        rows += [(f"k{k}", T0 + random.randrange(span)) for _ in range(n)]
    df = spark.createDataFrame(rows, "key string, sec bigint")
    for length in (300, 86400):
        got = {(r.key, r.sec): r.open_sec for r in sq.greedy_windows(df, ["key"], length).collect()}
        expected = {}
        for key in {k for k, _ in rows}:
            opened = None
            for sec in sorted({s for k, s in rows if k == key}):
                if opened is None or sec >= opened + length:
                    opened = sec
                expected[(key, sec)] = opened
        assert got == expected


def test_running_counts_equal_a_loop(spark):
    random.seed(4)
    # one key holds most rows, over two days; arrival numbers span several blocks
    rows = [
        ("hot" if random.random() < 0.8 else "cold", T0 + random.randrange(90000), i * 30000, random.random() < 0.3)
        for i in range(600)
    ]
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    df = spark.createDataFrame(rows, "key string, sec bigint, log_seq bigint, hit boolean").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.log_seq: (r.n, r.h) for r in sq.running_counts(df, ["key"], {"n": F.lit(1), "h": F.col("hit")}).collect()}
    count = {}
    for key, _, seq, hit in rows:
        n, h = count.get(key, (0, 0))
        count[key] = (n + 1, h + int(hit))
        assert got[seq] == count[key]


def test_running_number(spark):
    random.seed(5)
    rows = [(T0 + random.randrange(20000), f"{random.getrandbits(64):016x}") for _ in range(500)]
    df = spark.createDataFrame(rows, "sec bigint, id string").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.id: r.n for r in sq.running_number(df, ["ts", "id"], "n", start=10).collect()}
    assert got == {id_: i + 11 for i, (_, id_) in enumerate(sorted(rows))}


def test_exact_ranks(spark):
    random.seed(6)
    rows = [(random.choice("ab"), random.randrange(5_000_000)) for _ in range(999)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = sq.exact_ranks(df, ["k"], "v", {"mid": F.expr("n div 2 + 1"), "p99": F.ceil(F.col("n") * 0.99), "top": F.col("n")})
    for r in got.collect():
        values = sorted(v for k, v in rows if k == r.k)
        n = len(values)
        assert (r.n, r.mid, r.top) == (n, values[n // 2], values[-1])
        assert r.p99 == values[-(-n * 99 // 100) - 1]
