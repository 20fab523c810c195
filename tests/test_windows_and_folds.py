"""Prefix windows, purged folds, masks of designs, polled pages and streams with state, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import folds, joins, panel, prefix
from tideline.sources import cursor, files
from tideline.streaming import live, stateful

STEP, WIDTHS, DELAY = 10, {"a": 10, "b": 40}, 3


@pytest.fixture(scope="module")
def trades(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        executed = rnd.randrange(0, 300)
        rows.append((rnd.choice("xy"), i, executed, executed + rnd.choice([0, 1, 5, 9, 25, 60]), rnd.randint(-50, 50), rnd.randint(0, 6)))
    rows.append(("x", 400, 90, 90, 7, 1))
    return rows, spark.createDataFrame(rows, "k string, i int, executed long, created long, v long, item int").repartition(3)


def inside(row, origin, width):
    return row[3] <= origin - DELAY and row[2] >= origin - DELAY - width


def test_windows_are_differences_of_prefixes(spark, trades):
    rows, df = trades
    spanned = prefix.spans(df, "executed", "created", STEP, WIDTHS, DELAY)
    at = [(k, w, o) for k in "xyz" for w in WIDTHS for o in range(0, 420, 10)]
    origins = spark.createDataFrame(at, "k string, width string, origin long")
    sums = {(r.k, r.width, r.origin): r.v for r in prefix.window_sums(spanned, origins, ["k"], ["v"]).collect()}
    kinds = {(r.k, r.width, r.origin): r.items for r in prefix.window_distinct(spanned, origins, ["k"], ["item"], "items").collect()}
    cells = prefix.at_origins(prefix.cells(spanned, ["k"], [], F.min("executed").alias("a"), F.max("executed").alias("b")), STEP)
    ends = {(r.k, r.width, r.origin): (r.a, r.b) for r in cells.groupBy("k", "width", "origin").agg(F.min("a").alias("a"), F.max("b").alias("b")).collect()}
    lags = prefix.at_origins(prefix.cells(spanned.withColumn("lag", F.col("created") - F.col("executed")), ["k"], ["lag"], F.count("*").alias("n")), STEP).groupBy("k", "width", "origin", "lag").agg(F.sum("n").alias("n"))
    tails = {(r.k, r.width, r.origin): r.q for r in prefix.weighted_quantile(lags, ["k", "width", "origin"], "lag", "n", 0.9, "q").collect()}
    assert set(sums) == set(at) == set(kinds)
    import numpy as np

    for k, w, o in at:
        own = [r for r in rows if r[0] == k and inside(r, o, WIDTHS[w])]
        assert sums[k, w, o] == sum(r[4] for r in own) and kinds[k, w, o] == len({r[5] for r in own})
        assert ends.get((k, w, o)) == ((min(r[2] for r in own), max(r[2] for r in own)) if own else None)
        if own:
            assert abs(tails[k, w, o] - np.quantile([r[3] - r[2] for r in own], 0.9)) < 1e-9


def test_decayed_activity(spark, trades):
    import math

    rows, df = trades
    df = df.withColumn("start", F.lit(0).cast("long"))
    origins = spark.createDataFrame([(k, 0, o) for k in "xy" for o in range(0, 400, 30)], "k string, start long, origin long")
    got = {(r.k, r.origin): r.w for r in prefix.decayed(df, origins, ["k"], "executed", "created", "start", 10, DELAY, 50, "w").collect()}
    for (k, o), w in got.items():
        want = sum(math.exp(-(o - DELAY - r[2]) / 50) for r in rows if r[0] == k and r[3] <= o - DELAY)
        assert math.isclose(w, want, rel_tol=1e-9, abs_tol=1e-12)


def test_purge_bands(spark):
    rnd = random.Random(2)
    rows = [(i, s, s + rnd.randint(0, 60)) for i, s in enumerate(rnd.randrange(0, 1_000) for _ in range(200))]
    df = spark.createDataFrame(rows, "i int, s long, e long")
    bands = [("p", 100, 180), ("q", 170, 400), ("r", 990, 1_500), ("t", 500, 500)]
    table = spark.createDataFrame([(f, a, b, a, b) for f, a, b in bands], "fold string, low long, high long, test_low long, test_high long")
    for width in (7, 64, 5_000):
        got = {r.i: r.purged for r in folds.purged(df, table, ["i"], "s", "e", width).collect()}
        assert got == {i: [f for f, a, b in bands if s <= b and e >= a] for i, s, e in rows}
    limits = spark.createDataFrame([(j, v) for j, v in enumerate([None, -1, 0, 55, 500, 10_000])], "j int, at long")
    known = {r.j: (r.n, r["last"]) for r in folds.known_by(df, limits, "e", "at").collect()}
    ends = sorted(e for _, _, e in rows)
    for j, v in enumerate([None, -1, 0, 55, 500, 10_000]):
        low = [e for e in ends if v is not None and e <= v]
        assert known[j] == (len(low), low[-1] if low else None)


def test_masks_of_designs(spark):
    rnd = random.Random(9)
    pick = lambda: rnd.choice([None, float("nan"), float("inf"), 1.0, 2.0])
    rows = [(i, pick(), pick(), pick(), pick()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, y double, a double, b double, c double")
    designs = {"one": ["a"], "two": ["a", "b"], "three": ["c"]}
    masked = panel.design_masks(df, designs, "y", ["i"])
    got = {r.combination: r for r in panel.combinations(panel.mask_counts(masked, ["i"]), list(designs)).collect()}
    ok = lambda v: v in (1.0, 2.0)
    usable = {d: {r[0] for r in rows if ok(r[1]) and all(ok(r["iyabc".index(c)]) for c in cols)} for d, cols in designs.items()}
    for c in range(8):
        named = [d for j, d in enumerate(designs) if c >> j & 1]
        own = set.intersection(set(range(300)), *(usable[d] for d in named))
        assert got[c].usable == len(own) and got[c].designs == "+".join(named)
    base = df.where("i % 2 = 0")
    lifted = {r.i: (r.in_base, r.selected) for r in panel.lifted(df, base, base.where("i % 6 = 0"), ["i"]).collect()}
    assert lifted == {i: (i % 2 == 0, i % 6 == 0) for i in range(300)}
    with pytest.raises(ValueError, match="MASK_LIFT_OUTSIDE_BASE"):
        panel.lifted(df, base, df.where("i = 1"), ["i"])


def test_checked_and_bound_joins(spark, tmp_path):
    left = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, x double")
    right = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, y double")
    assert {(r.k, r.status) for r in joins.bound(left, right, ["k"], ["x"], ["y"]).collect()} == {(1, "bound"), (2, "incomplete"), (3, "without_target")}
    assert joins.one_to_one(left.where("k < 3"), right, ["k"]).count() == 2
    with pytest.raises(ValueError, match="JOIN_NOT_ONE_TO_ONE"):
        joins.one_to_one(left, right, ["k"])
    with pytest.raises(ValueError, match="JOIN_RIGHT_KEY_DUPLICATED"):
        joins.one_to_one(left, right.union(right), ["k"])
    outcome = left.withColumns({"Target_rv": F.lit(1), "future_x": F.lit(2)})
    assert joins.stripped(outcome).columns == ["k", "x"]
    with pytest.raises(ValueError, match="TARGET_COLUMN_IN_PREDICTORS"):
        joins.without_targets(outcome)
    path = files.write_addressed(right, str(tmp_path))
    assert files.read_addressed(spark, path).count() == 2
    left.write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="CONTENT_CHANGED"):
        files.read_addressed(spark, path)


def test_a_cursor_goes_on_behind_its_pages(spark, tmp_path):
    pages = str(tmp_path / "pages")
    rows = lambda asset, page, n: [(asset, page, 100 * page + i, i) for i in range(n)]
    write = lambda data: cursor.write_pages(spark.createDataFrame(data, "asset string, page int, id int, second long"), pages)
    schema = spark.createDataFrame([], "asset string, id int, second long").schema
    seen = []

    def run():
        stream = cursor.poll(spark, pages, schema, "second", 2, 8)
        out = live.run_to_end(stream, str(tmp_path / "out"), "append", str(tmp_path / "progress"))
        seen.append(sorted((r.asset, r.id) for r in out.collect()))

    write(rows("a", 0, 10) + rows("b", 0, 3))
    run()
    run()  # nothing new
    write(rows("a", 1, 5) + rows("a", 3, 5) + rows("c", 0, 4))  # page 2 is not there yet: page 3 waits
    run()
    write(rows("a", 2, 3))
    run()
    want = lambda *parts: sorted((a, 100 * p + i) for a, p, n in parts for i in range(n) if 2 <= i < 8)
    assert seen[0] == seen[1] == want(("a", 0, 10), ("b", 0, 3))
    assert seen[2] == want(("a", 0, 10), ("b", 0, 3), ("a", 1, 5), ("c", 0, 4))
    assert seen[3] == want(("a", 0, 10), ("b", 0, 3), ("a", 1, 5), ("c", 0, 4), ("a", 2, 3), ("a", 3, 5))


def test_state_outlives_restarts_and_timers_let_go(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = spark.createDataFrame([], "k string, received_us long, seq long, at timestamp").schema
    parts = [[("a", 50, 1, "2024-01-01"), ("b", 70, 2, "2024-01-01")], [("a", 40, 3, "2024-01-02"), ("b", 90, 4, "2024-01-02")], [("c", 1, 5, "2024-03-01")], [("a", 45, 6, "2024-03-02")]]
    counts = []
    for part in parts:
        spark.createDataFrame(part, "k string, received_us long, seq long, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(source)
        frame = stateful.first_receipts(live.source(spark, source, schema), ["k"], "at", "1 day", 10 * 86_400_000)
        query = stateful.run_updates(frame, str(tmp_path / "out"), str(tmp_path / "progress"))
        counts.append(sum(p["numInputRows"] for p in query.recentProgress))
    changes = spark.read.parquet(str(tmp_path / "out/of=*")).orderBy("batch", "k").collect()
    told = [(r.k, r.received_us) for r in changes]
    # b's later receipt changes nothing; a is forgotten once the clock is far past it, and begins anew
    assert told == [("a", 50), ("b", 70), ("a", 40), ("c", 1), ("a", 45)]
    assert counts == [2, 2, 1, 1]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider") or "Rocks" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_first_receipts_are_held_by_buckets(spark, tmp_path):
    source, rnd = str(tmp_path / "in"), random.Random(5)
    schema = spark.createDataFrame([], "k long, a string, received_us long, seq long, at timestamp").schema
    rows = [(rnd.choice([None, *range(2**60, 2**60 + 40)]), rnd.choice([None, "x", "y"]), rnd.randrange(50), seq, "2024-01-01") for seq in range(600)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "k long, a string, received_us long, seq long, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(source)
        frame = stateful.first_receipts(live.source(spark, source, schema), ["k", "a"], "at", "1 day", 10 * 86_400_000, buckets=2)
        query = stateful.run_updates(frame, str(tmp_path / "out"), str(tmp_path / "progress"))
    want = {}
    for k, a, received, seq, _ in rows:
        want[k, a] = min(want.get((k, a), (received, seq)), (received, seq))
    got = stateful.latest(spark, str(tmp_path / "out"), frame, ["k", "a"]).collect()
    assert len(got) == len(want) and {(r.k, r.a): (r.received_us, r.seq) for r in got} == want
    # each bucket has one value and one timer, which is kept under two orders
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert state and max(state) <= 3 * 2
