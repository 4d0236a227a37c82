import random

from cairnflow.operators import orphans as O
from pyspark.sql import functions as F

P = "txid long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, edge_id int"


def brute(parents, refs):
    out = {}
    for i, k, t in refs:
        rows = [p for p in parents if p[0] == k]
        alive = [p[1] for p in rows if p[2] is None and p[1] is not None]
        out[i] = 1 if not rows else 2 if not alive else 3 if t is not None and min(alive) > t else 0
    return out


def test_against_brute_force(spark):
    import datetime as dt

    rnd = random.Random(3)
    t = lambda: dt.datetime(2023, 1, 1) + dt.timedelta(hours=rnd.randrange(500))
    parents = [(rnd.randrange(200), rnd.choice([None, t(), t(), t()]), rnd.choice([None, None, t()]), 1) for _ in range(300)] + [(None, t(), None, 1)]
    parents += parents[:5]
    refs = [(i, rnd.choice([7, rnd.randrange(250)]), rnd.choice([None, t(), t()])) for i in range(1500)]
    ps = O.standing_parents(spark.createDataFrame(parents, P), "txid", "loaded_at", "deleted_at")
    rs = spark.createDataFrame(refs, "i int, key long, at timestamp_ntz").select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "i")
    got = {r["i"]: r["state"] for r in O.probe(ps, rs, ranges=6).collect()}
    assert got == brute(parents, refs)


def test_empty_sides(spark):
    ps = O.standing_parents(spark.createDataFrame([], P), "txid", "loaded_at", "deleted_at")
    rs = spark.createDataFrame([(5, 1, 0)], "key long, at long, i int")
    assert [r["state"] for r in O.probe(ps, rs).collect()] == [1]
    assert O.probe(ps, rs.where("key < 0")).count() == 0


def test_many_ranges_search(spark):
    ps = spark.createDataFrame([(k, 0) for k in range(0, 400, 2)], "key long, since long")
    rs = spark.createDataFrame([(k, 1, k) for k in range(400)], "key long, at long, i int")
    got = {r["i"]: r["state"] for r in O.probe(ps, rs, ranges=100).collect()}
    assert all((s == 0) == (k % 2 == 0) for k, s in got.items())
