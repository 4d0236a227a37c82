import random
from collections import defaultdict

import pytest

from cairnflow.operators import feature_table as T

SCHEMA = "bank string, account string, role int, type string, at long, x double, n int"
KEYS = ["bank", "account"]


def vectors(spark, rows, now=1000):
    df = spark.createDataFrame(rows, SCHEMA).drop("n")
    types, places, _ = T.vocabulary(T.spellings(df, "type", "at"))
    s = T.sums_by_type(T.numbered(df, places, len(types)), KEYS, ["slot"])
    return T.feature_vectors(s, KEYS, T.ROLES, len(types), now), types


def made(seed=4, n=900):
    rnd = random.Random(seed)
    return [("1", f"A{rnd.randrange(40)}", rnd.randrange(2), rnd.choice(["Card / Web", "card/web", " CASH/app", None]), rnd.choice([None, rnd.randrange(1000)]), rnd.choice([None, float("nan"), round(rnd.random() * 50, 2)]), 1) for _ in range(n)]


def expected(rows):
    want = defaultdict(lambda: [0, None, 0.0])
    for _b, a, r, t, at, x, _ in rows:
        if t:
            w = want[a, T.ROLES[r], "card/web" if "ard" in t else "cash/app"]
            w[0] += 1
            w[1] = at if w[1] is None else w[1] if at is None else max(w[1], at)
            w[2] += x if x is not None and x == x else 0
    return want


def test_against_brute_force(spark):
    rows = made()
    got, types = vectors(spark, rows)
    want = expected(rows)
    assert types == ["card/web", "cash/app"]
    got = got.collect()
    assert {r["account"] for r in got} == {r[1] for r in rows} and len(got) == 40
    for r in got:
        for role in T.ROLES:
            for i, t in enumerate(types):
                n, last, total = want.get((r["account"], role, t), (0, None, 0.0))
                assert r[f"{role}_n"][i] == n and abs(r[f"{role}_total"][i] - total) < 1e-6
                assert r[f"{role}_recency"][i] == (None if last is None else 1000 - last)


def test_laid_out_in_columns_and_rows(spark):
    rows = made(5)
    v, types = vectors(spark, rows)
    want = expected(rows)
    wide = T.feature_columns(v, KEYS, T.ROLES, types)
    assert len(wide.columns) == 2 + 2 * 2 * 3 and not wide.schema["sent_card_web_total"].nullable
    for r in wide.collect():
        n, last, total = want.get((r["account"], "got", "cash/app"), (0, None, 0.0))
        assert r["got_cash_app_n"] == n and abs(r["got_cash_app_total"] - total) < 1e-6 and r["got_cash_app_recency"] == (None if last is None else 1000 - last)
    df = spark.createDataFrame(rows, SCHEMA).drop("n")
    long = {(r["account"], T.ROLES[r["role"]], r["type"]): r for r in T.feature_rows(df, T.spellings(df, "type", "at"), KEYS).collect()}
    assert set(long) == set(want)
    assert all(r["n"] == want[k][0] and abs(r["w"] + r["f"] / 1e8 + r["h"] - want[k][2]) < 1e-6 and r["last"] == want[k][1] for k, r in long.items())


def test_empty_and_untyped(spark):
    assert vectors(spark, [])[0].collect() == []
    got, types = vectors(spark, [("1", "A", 0, None, 5, 1.0, 1)])
    assert types == [] and [r["account"] for r in got.collect()] == ["A"] and got.first()["sent_n"] == []


def test_large_and_infinite_amounts_count_whole(spark):
    rows = [("1", "A", 0, "t", 1, x, 1) for x in (2.5, 3e16, 4e300, -4e300)] + [("1", "B", 0, "t", 1, float("inf"), 1), ("1", "B", 0, "t", -7, 1.0, 1)]
    got = {r["account"]: r for r in vectors(spark, rows)[0].collect()}
    assert got["A"]["sent_n"] == [4] and got["A"]["sent_total"][0] in (3e16 + 2.5, 0.0 + 2.5)  # doubles from 1e12 on: order of addition shows
    assert got["B"]["sent_total"] == [float("inf")] and got["B"]["sent_recency"] == [999]
    got = vectors(spark, rows[:2])[0].first()
    assert got["sent_total"] == [3e16 + 2.5]


def test_clashing_columns_and_many_types(spark, monkeypatch):
    df = spark.createDataFrame([("1", "A", 0, f"k{i}", i, 1.0, 1) for i in range(50)], SCHEMA).withColumnRenamed("n", "slot").drop("slot")
    monkeypatch.setattr(T, "MAX_TYPES", 3)
    with pytest.raises(ValueError):
        T.vocabulary(T.spellings(df, "type", "at"))
    monkeypatch.setattr(T, "MAX_SPELLINGS", 3)
    assert T.feature_rows(df, T.spellings(df, "type", "at"), KEYS).count() == 50
