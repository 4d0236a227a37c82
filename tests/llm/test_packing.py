import random

import pytest

from cairnflow.llm import packing as P


def brute(items, capacity):
    """Fewest containers, by trying every assignment."""
    best = [len(items)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                put(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best[0]


def check(items, packed, capacity):
    assert sorted(i for c in packed for i in c) == list(range(len(items)))
    assert all(sum(items[i] for i in c) <= capacity for c in packed)


@pytest.mark.parametrize("seed", range(40))
def test_as_few_as_brute_force(seed):
    rnd = random.Random(seed)
    items = sorted((rnd.randrange(1, 60) for _ in range(9)), reverse=True)
    got = P.complete(items, 100)
    check(items, got, 100)
    assert len(got) == brute(items, 100)


def test_never_worse_than_best_fit_and_close_to_the_bound():
    rnd = random.Random(1)
    for n in (0, 1, 500, 3000):
        items = sorted((rnd.choice([0, 3, 20, 70, 300, 1100, 2048]) + rnd.randrange(0, 1) for _ in range(n)), reverse=True)
        got = P.complete(items, 2048)
        check(items, got, 2048)
        assert len(got) <= len(P.best_fit(items, 2048))


def test_fillings_are_all_undominated_ones_in_order_of_waste():
    have = {50: 1, 30: 2, 20: 1, 10: 1}
    assert list(P.fillings(60, have, [50, 30, 20, 10], 60)) == [(0, (50, 10)), (0, (30, 30))]  # 30 + 20 + 10: 50 could stand for the first two
    rnd = random.Random(3)
    for _ in range(60):
        items = [rnd.randrange(1, 30) for _ in range(8)]
        have = {n: items.count(n) for n in items}
        room = rnd.randrange(10, 60)
        every = set()
        for mask in range(1 << len(items)):
            f = tuple(sorted((items[i] for i in range(len(items)) if mask >> i & 1), reverse=True))
            if sum(f) <= room:
                every.add(f)

        def beaten(f):
            unused = [n for n in have if have[n] > f.count(n)]
            w = room - sum(f)
            sums = {sum(f[i] for i in range(len(f)) if m >> i & 1) for m in range(1, 1 << len(f)) if bin(m).count("1") > 1}
            return any(u <= w or any(x < u <= x + w for x in f) or any(x <= u <= x + w for x in sums) for u in unused)

        got = list(P.fillings(room, have, sorted(have, reverse=True), room))
        assert [w for w, _ in got] == sorted(w for w, _ in got) and len(got) == len(set(got))
        assert {f for _, f in got} == {f for f in every if not beaten(f)}


def test_bound_never_exceeds_the_fewest():
    rnd = random.Random(5)
    for _ in range(40):
        items = sorted((rnd.randrange(1, 70) for _ in range(8)), reverse=True)
        assert -(-sum(items) // 100) <= P.lower_bound(items, 100) <= brute(items, 100)
    assert P.lower_bound([60, 60, 45, 45, 41], 100) == 4  # by sums alone it is 3


def planted(seed, bins, per, capacity=P.CAPACITY):
    rnd = random.Random(seed)
    items = []
    for _ in range(bins):
        cuts = [0, *sorted(rnd.sample(range(1, capacity), per - 1)), capacity]
        items += [b - a for a, b in zip(cuts, cuts[1:])]
    return sorted(items, reverse=True)


@pytest.mark.parametrize("per", (3, 4))
@pytest.mark.parametrize("seed", range(10))
def test_planted_perfect_packings_are_found(seed, per):
    items = planted(seed, 15 if per == 3 else 30, per)
    got, proved = P.solve(items, P.CAPACITY)
    check(items, got, P.CAPACITY)
    assert proved and len(got) == (15 if per == 3 else 30) and len(P.best_fit(items, P.CAPACITY)) > len(got)


def test_the_budget_ends_a_search_and_says_so():
    items = planted(0, 60, 3)
    got, proved = P.solve(items, P.CAPACITY, steps=500)
    check(items, got, P.CAPACITY)
    assert not proved and len(got) == len(P.best_fit(items, P.CAPACITY))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tokens string")


def test_whole_texts_pieces_nulls_and_repeats(spark):
    long = "word " * 5000
    d = docs(spark, ["a b c", "", None, long, "a b c", "ünïcödé 漢字"]).unionByName(docs(spark, ["a b c"]))
    got = P.pack(P.sizes(d, "doc_id", "text"), "doc_id").collect()
    per = {}
    for r in got:
        per.setdefault(r["container"], []).append(r["tokens"])
    assert all(sum(v) <= P.CAPACITY for v in per.values())
    count = {r["doc_id"]: [x for x in got if x["doc_id"] == r["doc_id"]] for r in got}
    assert set(count) == {0, 1, 3, 4, 5} and len(count[0]) == 2  # the row stands twice
    pieces = sorted((r["piece"], r["start"], r["tokens"]) for r in count[3])
    whole = P.tokenizer(P.TOKENIZER)([long])[0]
    assert sum(p[2] for p in pieces) == whole and pieces[0][2] == P.CAPACITY and all(p[1] == p[0] * P.CAPACITY for p in pieces)
    assert all(len(v) == 1 for k, v in count.items() if k not in (0, 3))


def test_many_groups_and_empty(spark):
    d = docs(spark, ["some words here"] * 50)
    got = P.pack(P.sizes(d, "doc_id", "text"), "doc_id", group_items=10)
    assert got.count() == 50 and got.select("container").distinct().count() >= 2
    assert P.pack(P.sizes(docs(spark, []), "doc_id", "text"), "doc_id").count() == 0


def test_exact_capacity_is_not_cut(spark):
    d = docs(spark, ["a"])
    s = P.sizes(d, "doc_id", "text").selectExpr("doc_id", "2048 as tokens").unionByName(P.sizes(d, "doc_id", "text").selectExpr("doc_id + 1 as doc_id", "4096 as tokens"))
    got = {(r["doc_id"], r["piece"]): (r["tokens"], r["pieces"]) for r in P.pack(s, "doc_id").collect()}
    assert got == {(0, 0): (2048, 1), (1, 0): (2048, 2), (1, 1): (2048, 2)}
