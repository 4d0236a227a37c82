import numpy as np
from pyspark.sql import functions as F

from cairnflow.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge long, src long, dst long, edge_time long")


def at(df, **where):
    return [r for r in df.collect() if all(r[k] == v for k, v in where.items())]


def test_bins(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 99)], "n int").select(G.bin_of(F.col("n"))).collect()]
    assert got == [None, 2, 4, 4, 8, 8, 16, 16, 32, 32]


def test_fan_is_counterparties_and_value_is_edges(spark):
    e = edges(spark, [(1, 0, 1), (1, 0, 1), (2, 0, 1), (2, 0, 1)])
    r = G.edge_features(e, 1, ["edge"]).first()
    assert r["fan_in_bin2"] == 4 and r["degree_in_bin4"] == 4 and r["vs_dst_in_fan"] == 2 and r["vs_dst_in_ratio"] == .5


def test_stars_and_cycle_light_their_own_blocks(spark):
    star = G.edge_features(edges(spark, [(1, 0, 1), (2, 0, 1), (3, 0, 1)]), 1, ["edge"]).first()
    assert star["fan_in_bin4"] == 3 and sum(star[c] for c in star.asDict() if c.startswith(("fan_out", "degree_out"))) == 0
    assert star["vs_dst_in_fan"] == 3 and star["vs_src_out_degree"] == 1
    ring = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1)])
    assert [r["lc_cycle_bin4"] for r in G.cycles(ring, 1).collect()] == [1, 1, 1] and G.scatter_gather(ring, 1).count() == 0


def test_long_cycles(spark):
    ring = edges(spark, [(i, (i + 1) % 6, 1) for i in range(6)] + [(3, 1, 1)])
    got = {(r["src"], r["dst"]): (r["lc_cycle_bin4"], r["lc_cycle_bin8"]) for r in G.cycles(ring, 1, 6).collect()}
    assert got[0, 1] == (0, 1) and got[1, 2] == (1, 1) and got[3, 1] == (1, 0)
    assert {r["src"]: r["closes_6"] for r in G.cycle_lengths(ring, 1, 6).collect()}[0] == 1


def brute_cycles(rows, w, longest):
    """{(src, dst, edge_time): {length: simple cycles through the edge}} by walking every path."""
    e = {r for r in rows if r[0] != r[1]}
    out = {}

    def walk(a, t, path, hops, got):
        for x in hops.get(path[-1], ()):
            if x == a:
                got[len(path) + 1] = got.get(len(path) + 1, 0) + 1
            elif x not in path and len(path) + 1 < longest:
                walk(a, t, [*path, x], hops, got)

    for a, b, t in e:
        hops = {}
        for x, y, t1 in e:
            if t - w < t1 <= t:
                hops.setdefault(x, set()).add(y)
        got = {}
        walk(a, t, [b], hops, got)
        if got:
            out[a, b, t] = got
    return out


def test_cycles_to_ten_by_brute_force(spark):
    import random

    from cairnflow.config import Features

    rnd = random.Random(3)
    rows = [(i, (i + 1) % 10, i) for i in range(10)] + [(10 + i, 10 + (i + 1) % 11, 20) for i in range(11)]  # a ring of 10, and one of 11 that is too long
    rows += [(rnd.randrange(12), rnd.randrange(12), 40 + rnd.randrange(12)) for _ in range(40)]
    want = brute_cycles(rows, 10, 10)
    assert {n for got in want.values() for n in got} >= {2, 3, 4, 5, 6, 10}
    longest = Features().cycle_len
    bins = {r: tuple(sum(k for n, k in got.items() if lo < n <= hi) for lo, hi in ((1, 2), (2, 4), (4, 8), (8, 16))) for r, got in want.items()}
    got = G.cycles(edges(spark, rows), 10, longest).collect()
    assert {(r["src"], r["dst"], r["edge_time"]): tuple(r[f"lc_cycle_bin{b}"] for b in (2, 4, 8, 16)) for r in got} == bins
    flags = {(r["src"], r["dst"], r["edge_time"]): {n for n in range(2, 11) if r[f"closes_{n}"]} for r in G.cycle_lengths(edges(spark, rows), 10, 10).collect()}
    assert flags == {r: set(k) for r, k in want.items()}


def test_cycle_queries_to_ten_on_tables(spark, sf_dir):
    import __spark_entry__ as entry
    from cairnflow.plans.txn import txn

    want = brute_cycles([tuple(r) for r in txn(spark, sf_dir).where("edge_time < 60").select("src", "dst", "edge_time").collect()], 7, 10)
    got = {(r["src"], r["dst"], r["edge_time"]): sum(r[f"lc_cycle_bin{b}"] for b in (2, 4, 8, 16)) for r in entry.queries()["cycle_counts_w7_to10"](spark, sf_dir).where("edge_time < 60").collect()}
    assert got == {r: sum(k.values()) for r, k in want.items()}


def test_cycles_shuffle_edges_and_not_paths(spark):
    import random
    import re

    from cairnflow.operators.cycles import count_cycles

    rnd = random.Random(4)
    rows = [(rnd.randrange(9), rnd.randrange(9), rnd.randrange(30)) for _ in range(120)]
    e = edges(spark, rows + rows[:20])  # edges that stand there twice count once
    plan = G.cycles(e, 7, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall("Exchange ", plan)) == 1, plan
    want = brute_cycles(rows, 7, 10)
    got = {(r["src"], r["dst"], r["edge_time"]): sum(r[f"lc_cycle_bin{b}"] for b in (2, 4, 8, 16)) for r in G.cycles(e, 7, 10).collect()}
    assert got == {r: sum(k.values()) for r, k in want.items()}
    distinct = sorted({r for r in rows if r[0] != r[1]})
    src, dst, time = (np.array(c) for c in zip(*distinct))
    for block in (8, 1 << 18):  # blocks that are split, times finer than slices of a window, windows of fractions
        for w, scale in ((7, 1), (40, 1), (2, .25)):
            want = brute_cycles([(a, b, t * scale) for a, b, t in distinct], w, 6)
            got = count_cycles(src, dst, time * scale, np.ones(len(src), dtype=bool), w, 6, block)
            assert {r: {n + 2: k for n, k in enumerate(c) if k} for r, c in zip(zip(src, dst, time * scale), got.tolist()) if any(c)} == want


def test_cycle_lengths_shuffle_edges_and_not_paths(spark):
    import re

    rows = [(i, (i + 1) % 10, i) for i in range(10)] + [(i, (i + 3) % 10, i) for i in range(10)]
    got = G.cycle_lengths(edges(spark, rows), 10, 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall("Exchange ", plan)) == 1, plan
    want = brute_cycles(rows, 10, 10)
    assert {(r["src"], r["dst"], r["edge_time"]): {n for n in range(2, 11) if r[f"closes_{n}"]} for r in got.collect()} == {r: set(k) for r, k in want.items()}


def test_model_rows_are_written_once(spark, sf_dir):
    from cairnflow.plans import catalog
    from cairnflow.plans.txn import KEY, txn

    t = txn(spark, sf_dir)
    a, b = (G.cumulative_counts(t, v, o).toDF(v, "edge_time", f"{v}_fan", f"{v}_degree", "_ratio").drop("_ratio") for v, o in (("src", "dst"), ("dst", "src")))
    want = t.where("y >= 0").join(a, ["src", "edge_time"]).join(b, ["dst", "edge_time"])
    want = want.select(*(F.when(F.col("batch_id") >= 38, F.col(k)).alias(k) if k in ("l_orderkey", "l_linenumber", "l_partkey") else F.col(k) for k in KEY), "batch_id", "y", *catalog.MODEL_FEATURES)
    got = catalog.model_rows(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Window")), plan  # else every pass of a model makes and shuffles them again
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_cumulative_by_windows_with_nulls(spark):
    import random

    rnd = random.Random(6)
    some = lambda n: rnd.choice([None, *range(n)])
    e = edges(spark, [(rnd.randrange(5), some(4), some(6)) for _ in range(150)])
    want = e.join(G.cumulative_counts(e, "src", "dst").toDF("src", "edge_time", "s_fan", "s_degree", "_ratio").drop("_ratio"), ["src", "edge_time"])
    got = G.with_cumulative(e, "src", "dst", "s").where("edge_time is not null")
    assert {r["edge"]: (r["s_fan"], r["s_degree"]) for r in got.collect()} == {r["edge"]: (r["s_fan"], r["s_degree"]) for r in want.collect()}


def test_window_and_cumulative(spark):
    e = edges(spark, [(1, 0, 1), (2, 0, 1), (3, 0, 2), (4, 0, 2)])
    assert at(G.windowed_counts(e, "dst", "src", 1), edge_time=2)[0]["fan"] == 2
    assert at(G.windowed_counts(e, "dst", "src", 2), edge_time=2)[0]["fan"] == 4
    assert at(G.cumulative_counts(e, "dst", "src"), edge_time=2)[0]["degree"] == 4


def test_features_do_not_see_the_future(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.randrange(12), rnd.randrange(12), rnd.randrange(12)) for _ in range(160)]
    e = edges(spark, rows)
    whole = {r["edge"]: r for r in G.edge_features(e, 3, ["edge"]).collect()}
    for cut in (4, 7, 10):
        part = G.edge_features(e.where(f"edge_time <= {cut}"), 3, ["edge"]).collect()
        assert part and all(r == whole[r["edge"]] for r in part)
    later = {r["edge"]: r for r in G.edge_features(e.where("edge_time > 4"), 3, ["edge"]).collect()}
    assert any(later[k] != whole[k] for k in later)  # the past does matter


def test_fold_guard(spark):
    e = edges(spark, [(1, 0, 1), (2, 0, 1), (0, 4, 3)]).withColumn("x", F.col("edge") + 1).withColumn("s", F.lit(1))
    nodes = spark.createDataFrame([(0, 2), (1, 2), (4, 3), (5, 9)], "node long, node_time long")
    got = {r["node"]: r for r in G.node_fold(nodes, e, {"src": [], "dst": ["x"]}, ["s"]).collect()}
    assert got[0]["x"] == 2 and got[0]["s"] == 2  # its edge at 3 is later than its own time
    assert got[4]["x"] == 3 and got[5]["x"] == 0 and got[1]["s"] == 1


def test_self_edge_counts_twice_in_sums(spark):
    e = edges(spark, [(1, 1, 1)]).withColumn("s", F.lit(1))
    nodes = spark.createDataFrame([(1, 1)], "node long, node_time long")
    assert G.node_fold(nodes, e, {}, ["s"]).first()["s"] == 2


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 3), (50, 50)], "u long, v long")
    got = {r["node"]: r["component"] for r in G.components(pairs).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 21 for i in range(21, 41)) and got[50] == 50


def test_components_of_all_illicit_edges(spark, sf_dir):
    import __spark_entry__ as entry
    from cairnflow.plans.txn import txn

    rows = txn(spark, sf_dir).where("y = 1").select("src", "dst", "batch_id").collect()
    assert len({r["batch_id"] for r in rows}) > 1
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        a, b = sorted((find(r["src"]), find(r["dst"])))
        root[b] = a  # the least node stays on top
    got = {r["node"]: r["component"] for r in entry.queries()["components_illicit_all"](spark, sf_dir).collect()}
    assert got == {x: find(x) for x in root}


def test_temporal_neighbours(spark):
    e = edges(spark, [(1, 0, 1), (2, 0, 2), (3, 0, 2), (4, 0, 5)])
    got = [(r["edge_time"], r["k"], r["neighbour"]) for r in G.temporal_neighbours(e, 2, ["edge"]).orderBy("edge_time", "k").collect()]
    assert got == [(1, 1, 1), (2, 1, 2), (2, 2, 3), (5, 1, 4), (5, 2, 2)]


def test_checks_against_plain_python(spark):
    import random

    from cairnflow.operators import checks as C
    from cairnflow.operators import reporting as R

    rnd = random.Random(8)
    rows = [(i, rnd.randrange(5), rnd.choice([None, rnd.randrange(50)])) for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, t int, v int")
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["i"]: r["position"] for r in C.positions(df, ["t", "i"]).collect()} == want
    vs = [r[2] for r in sorted(rows) if r[2] is not None]
    got = C.order_breaks(df, "i", F.col("v")).first()
    assert (got["rows"], got["breaks"]) == (len(vs), sum(b < a for a, b in zip(vs, vs[1:])))
    assert C.repeated(df, ["t"]).count() == 5 and C.repeated(df, ["i"]).count() == 0
    empty = df.where("i < 0")
    assert C.positions(empty, ["t"]).count() == 0 and tuple(C.order_breaks(empty, "i", F.col("v")).first()) == (0, 0)
    # components {1,2,3}, {4,5,6} and one too large; of the two equal ones the earlier
    e = spark.createDataFrame([(1, 2, 9), (2, 3, 9), (4, 5, 3), (5, 6, 9), *((10, 10 + k, 1) for k in range(1, 9))], "src int, dst int, edge_time int")
    c = G.components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    assert {tuple(r) for r in R.largest_component(e, c, 5).collect()} == {(4, 3, 3), (5, 3, 3), (6, 3, 3)}
