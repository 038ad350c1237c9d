import random

from pyspark.sql import functions as F

from marketgrade.operators.asof import asof_join
from marketgrade.operators.dedup import ascending_only
from marketgrade.operators.recurrence import Average, ema
from marketgrade.operators.timeline import Timeline, blocks, fill_columns, number, previous

LINE = Timeline(("k",), ("t", "i"), 10)


def series(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows, t = [], -40
    for i in range(n):
        t += rng.choice([0, 1, 2, 45])
        rows.append((rng.choice("XXXY"), t, i, rng.choice([None, float(i)])))
    return rows, spark.createDataFrame(rows, "k string, t bigint, i bigint, v double")


def groups(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_fill_previous_and_number(spark):
    rows, df = series(spark)
    df = fill_columns(df, LINE, {"fwd": F.col("v")})
    df = fill_columns(df, LINE, {"bwd": F.col("v")}, reverse=True)
    df = number(previous(df, LINE, F.col("v"), "prev"), LINE, "n")
    got = {r.i: r for r in df.collect()}
    for group in groups(rows).values():
        for place, (_, _, i, v) in enumerate(group):
            earlier = [x[3] for x in group[: place + 1] if x[3] is not None]
            later = [x[3] for x in group[place:] if x[3] is not None]
            assert got[i].fwd == (earlier[-1] if earlier else None)
            assert got[i].bwd == (later[0] if later else None)
            assert got[i].prev == (group[place - 1][3] if place else None)
            assert got[i].n == place


def test_blocks_give_exact_frames(spark):
    rows, df = series(spark)
    numbered = number(df, LINE, "n")
    cut = blocks(numbered, ["k"], "n", before=7, after=3, rows=10)
    rolled = cut.finish(
        cut.rows.withColumn("s", F.sum("i").over(cut.window.rowsBetween(-7, 0))).withColumn(
            "a", F.lead("i", 3).over(cut.window)
        )
    )
    got = {r.i: r for r in rolled.collect()}
    assert len(got) == len(rows)
    for group in groups(rows).values():
        ids = [x[2] for x in group]
        for place, i in enumerate(ids):
            assert got[i].s == sum(ids[max(0, place - 7) : place + 1])
            assert got[i].a == (ids[place + 3] if place + 3 < len(ids) else None)


def test_asof_in_both_directions(spark):
    rng = random.Random(5)
    right = [(rng.choice("XXXY"), rng.randrange(0, 400), i) for i in range(120)]
    left = [(rng.choice("XXYZ"), rng.randrange(-20, 420), i) for i in range(150)]
    ldf = spark.createDataFrame(left, "k string, t bigint, id bigint")
    rdf = spark.createDataFrame(right, "k string, t bigint, id bigint")
    for direction in ("backward", "forward"):
        joined = asof_join(
            ldf, rdf, ["k"], "t", "t", direction=direction, tie="id",
            take={"id": "rid", "t": "rt"}, width=25,
        )
        got = {r.id: r.rid for r in joined.collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            if direction == "backward":
                match = max(((rt, rid) for rk, rt, rid in right if rk == k and rt <= t), default=None)
            else:
                match = min(((rt, rid) for rk, rt, rid in right if rk == k and rt >= t), default=None)
            assert got[i] == (match[1] if match else None), (direction, k, t)


def test_ema_over_signed_values_and_late_start(spark):
    rng = random.Random(9)
    values = [None] + [rng.uniform(-5, 5) for _ in range(2500)]
    df = spark.createDataFrame([("X", i, v) for i, v in enumerate(values)], "k string, n bigint, x double")
    got = {
        r.n: r
        for r in ema(
            df, ["k"], "n",
            {"fast": Average("x", 0.6, 1), "slow": Average("x", 0.02, 1), "same": Average("x", 1.0, 1)},
        ).collect()
    }
    fast = slow = None
    for i, x in enumerate(values):
        if x is None:
            assert got[i].fast is None
            continue
        fast = x if fast is None else 0.6 * x + 0.4 * fast
        slow = x if slow is None else 0.02 * x + 0.98 * slow
        assert abs(got[i].fast - fast) < 1e-11 and abs(got[i].slow - slow) < 1e-11
        assert got[i].same == x


def test_ascending_trades(spark):
    rows = [("A", 1, 1, 100), ("A", 2, 1, 100), ("A", 3, 2, 101), ("B", 4, 0, 5), ("A", 5, 1, 9), ("A", 99, 3, 7)]
    df = spark.createDataFrame(rows, "symbol string, arrival bigint, trade_id bigint, price long")
    assert [r.price for r in ascending_only(df, width=2).orderBy("arrival").collect()] == [100, 101, 5, 7]
    assert [r.price for r in ascending_only(df, floor=0, width=2).orderBy("arrival").collect()] == [100, 101, 7]
