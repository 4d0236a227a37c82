"""Causal graph features over time-stamped edges (src, dst, edge_time).

Every row sees only edges at or before its own time; edges at the same time all see each other. A window of w covers
t - w < t' <= t. Windowed counts are kept as differences: an edge adds one at its time and takes one away w later, so a
vertex's series is a running sum over its distinct times, however many edges it has, and distinct counterparties need no
sets: a pair counts from each of its times until it lapses or recurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .cycles import in_stretch

BINS = (2, 4, 8, 16, 32)
FAMILIES = ("fan", "degree", "scatter_gather", "lc_cycle")


def bin_of(size: Column, bins: tuple[int, ...] = BINS) -> Column:
    """The upper-inclusive bin of a pattern size; the last is open; null below two."""
    c = F.when(size < 2, F.lit(None))
    for b in bins[:-1]:
        c = c.when(size <= b, b)
    return c.otherwise(bins[-1]).cast("int")


def hist(size: Column, value: Column, prefix: str, bins: tuple[int, ...] = BINS) -> list[Column]:
    """One column per bin, holding the value in the bin of the size and 0 elsewhere."""
    return [F.when(bin_of(size, bins) == b, value).otherwise(0).cast("long").alias(f"{prefix}_bin{b}") for b in bins]


def windowed_counts(edges: DataFrame, vertex: str, other: str, w: int) -> DataFrame:
    """(vertex, edge_time, fan, degree): distinct counterparties and edges within the window, at each time the vertex acts."""
    days = edges.groupBy(F.col(vertex).alias("vertex"), F.col(other).alias("other"), "edge_time").agg(F.count("*").alias("n"))
    nxt = F.lead("edge_time").over(Window.partitionBy("vertex", "other").orderBy("edge_time"))
    end = F.col("edge_time") + w
    steps = F.array(
        F.struct(F.col("edge_time").alias("t"), F.lit(1).alias("fan"), F.col("n").alias("degree"), F.col("n").alias("here")),
        F.struct(F.least(end, F.coalesce("_next", end)).alias("t"), F.lit(-1).alias("fan"), F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("here")),
        F.struct(end.alias("t"), F.lit(0).alias("fan"), (-F.col("n")).alias("degree"), F.lit(0).cast("long").alias("here")),
    )
    deltas = days.withColumn("_next", nxt).select("vertex", F.inline(steps)).groupBy("vertex", "t").agg(*(F.sum(c).alias(c) for c in ("fan", "degree", "here")))
    run = Window.partitionBy("vertex").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        deltas.select("vertex", F.col("t").alias("edge_time"), F.sum("fan").over(run).alias("fan"), F.sum("degree").over(run).alias("degree"), "here")
        .where("here > 0").drop("here")
    )


def cumulative_counts(edges: DataFrame, vertex: str, other: str) -> DataFrame:
    """(vertex, edge_time, fan, degree, ratio) over all edges so far; never evicted."""
    firsts = edges.groupBy(F.col(vertex).alias("vertex"), F.col(other).alias("other"), "edge_time").agg(F.count("*").alias("n"))
    first = F.min("edge_time").over(Window.partitionBy("vertex", "other"))
    per = firsts.withColumn("_first", first).groupBy("vertex", "edge_time").agg(F.sum("n").alias("n"), F.count_if(F.col("_first") == F.col("edge_time")).alias("new"))
    run = Window.partitionBy("vertex").orderBy("edge_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = per.select("vertex", "edge_time", F.sum("new").over(run).alias("fan"), F.sum("n").over(run).alias("degree"))
    return out.withColumn("ratio", F.when(F.col("degree") > 0, F.col("fan") / F.col("degree")).otherwise(0.0))


def with_cumulative(edges: DataFrame, vertex: str, other: str, prefix: str) -> DataFrame:
    """edges with {prefix}_fan and {prefix}_degree, what cumulative_counts has of the vertex at the edge's time.

    Edges are placed by the vertex once, for both windows, and nothing is joined: what is shuffled is the edges. All edges of
    one vertex are ordered in one task, which sorts on disk where they do not fit.
    """
    pair = Window.partitionBy(vertex, other).orderBy(F.asc_nulls_last("edge_time"))
    run = Window.partitionBy(vertex).orderBy("edge_time")  # with the edges of the same time
    new = ((F.row_number().over(pair) == 1) & F.col("edge_time").isNotNull()).cast("long")
    placed = edges.repartition(vertex).withColumn("_new", new)
    return placed.withColumns({f"{prefix}_fan": F.sum("_new").over(run), f"{prefix}_degree": F.count("*").over(run)}).drop("_new")


WAYS = ("out", "in")


def vertex_statistics(edges: DataFrame, w: int) -> DataFrame:
    """All counts of a vertex at each time it acts, as sender or receiver: (vertex, edge_time) and, for "out" and "in",
    {way}_fan and {way}_degree within the window and {way}_all_fan, {way}_all_degree, {way}_all_ratio over all time.

    One series per vertex carries them all, so each edge meets its ends' counts by one join an end, and what a vertex has
    sent is known where it only receives. Pairs of one time are added up before anything is ordered.
    """
    ends = F.array(F.struct(F.col("src").alias("vertex"), F.col("dst").alias("other"), F.lit(0).alias("way")), F.struct(F.col("dst").alias("vertex"), F.col("src").alias("other"), F.lit(1).alias("way")))
    return pair_statistics(edges.select("edge_time", F.inline(ends)).groupBy("vertex", "way", "other", "edge_time").agg(F.count("*").alias("n")), w)


def pair_statistics(days: DataFrame, w: int) -> DataFrame:
    """vertex_statistics of edges that are added up already: days(vertex, way, other, edge_time, n), way 0 for out and 1 for in."""
    pair = Window.partitionBy("vertex", "way", "other").orderBy("edge_time")
    days = days.select("*", F.lead("edge_time").over(pair).alias("_next"), (F.row_number().over(pair) == 1).cast("long").alias("_new"))
    end, none, n = F.col("edge_time") + w, F.lit(0).cast("long"), F.col("n")
    step = lambda t, fan, degree, new, total: F.struct(t.alias("t"), fan.alias("fan"), degree.alias("degree"), new.alias("all_fan"), total.alias("all_degree"))
    steps = F.array(
        step(F.col("edge_time"), none + 1, n, F.col("_new"), n),
        step(F.least(end, F.coalesce("_next", end)), none - 1, none, none, none),
        step(end, none, -n, none, none),
    )
    kinds = ("fan", "degree", "all_fan", "all_degree")
    sums = [F.sum(F.when(F.col("way") == i, F.col(k)).otherwise(0)).alias(f"{way}_{k}") for i, way in enumerate(WAYS) for k in kinds]
    deltas = days.select("vertex", "way", F.inline(steps)).groupBy("vertex", "t").agg(*sums)
    run = Window.partitionBy("vertex").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acts = (F.col("out_all_degree") + F.col("in_all_degree") > 0).alias("_acts")
    got = deltas.select("vertex", F.col("t").alias("edge_time"), acts, *(F.sum(f"{way}_{k}").over(run).alias(f"{way}_{k}") for way in WAYS for k in kinds)).where("_acts").drop("_acts")
    return got.withColumns({f"{way}_all_ratio": F.when(F.col(f"{way}_all_degree") > 0, F.col(f"{way}_all_fan") / F.col(f"{way}_all_degree")).otherwise(0.0) for way in WAYS})


def end_columns(end: str, prefix: str = "", families: tuple[str, ...] = ("fan", "degree"), bins: tuple[int, ...] = BINS, stats: bool = True) -> list[Column]:
    """The columns of vertex_statistics as an edge has them from one of its ends: bins of the end's own way, cumulative statistics of both."""
    way = "in" if end == "dst" else "out"
    out = [c for k in ("fan", "degree") if k in families for c in hist(F.col(f"{way}_{k}"), F.col(f"{way}_degree"), f"{prefix}{k}_{way}", bins)]
    return out + ([F.col(f"{w}_all_{x}").alias(f"{prefix}vs_{end}_{w}_{x}") for w in WAYS for x in ("fan", "degree", "ratio")] if stats else [])


def with_ends(edges: DataFrame, statistics: DataFrame, **kw) -> DataFrame:
    """edges with end_columns of both ends."""
    for end in ("dst", "src"):
        edges = edges.join(statistics.select(F.col("vertex").alias(end), "edge_time", *end_columns(end, **kw)), [end, "edge_time"])
    return edges


def edge_features(edges: DataFrame, w: int, key: list[str]) -> DataFrame:
    """Per edge: fan and degree bins of both ends within the window, and cumulative statistics of both ends."""
    e = cut(edges.select(*key, "src", "dst", "edge_time"))  # read three times
    return with_ends(e, vertex_statistics(e, w))


def _near(edges: DataFrame, w: int, names: dict[str, str]) -> DataFrame:
    """Distinct edges ready to be joined by vertex and time bucket: each stands in its bucket and the next."""
    b = F.floor(F.col("edge_time") / w)
    return edges.select(*(F.col(k).alias(v) for k, v in names.items()), F.explode(F.array(b, b + 1)).alias("_b"))


def _within(late: Column, early: Column, w: int) -> Column:
    return (early > late - w) & (early <= late)


def scatter_gather(edges: DataFrame, w: int) -> DataFrame:
    """Per distinct edge: patterns u -> m -> v with two or more middles in the window that it is part of, by size bin."""
    e = cut(edges.where("src <> dst").select("src", "dst", "edge_time").distinct())

    def role(u: str, v: str) -> DataFrame:
        # u is the end whose edge (u, m) at t is scored; its partners (m, v) may stand anywhere in the window
        ends = e.select(F.col(u).alias("u"), F.col("edge_time").alias("t")).distinct().withColumn("_b", F.floor(F.col("t") / w))
        first = _near(e, w, {u: "u", v: "m", "edge_time": "t1"})
        mids = ends.join(first, ["u", "_b"]).where(_within(F.col("t"), F.col("t1"), w)).groupBy("u", "t", "m", "_b").agg(F.max(F.col("t1") == F.col("t")).alias("now"))
        second = _near(e, w, {u: "m", v: "v", "edge_time": "t2"})
        paths = mids.join(second, ["m", "_b"]).where(_within(F.col("t"), F.col("t2"), w) & (F.col("v") != F.col("u"))).select("u", "t", "m", "v", "now").distinct()
        sized = paths.select("u", "t", "m", "now", F.count("*").over(Window.partitionBy("u", "t", "v")).alias("size"))
        return sized.where("now and size >= 2").select(F.col("u").alias(u), F.col("m").alias(v), F.col("t").alias("edge_time"), bin_of(F.col("size")).alias("bin"))

    both = role("src", "dst").unionByName(role("dst", "src"))
    return both.groupBy("src", "dst", "edge_time").agg(*(F.count_if(F.col("bin") == k).alias(f"scatter_gather_bin{k}") for k in BINS))


def _cycle_rows(edges: DataFrame, w: int, longest: int) -> DataFrame:
    """(src, dst, edge_time, n_2, n_3, ...): for each distinct edge on a cycle, the simple cycles through it by how many accounts they have.

    Edges are placed by stretches of two windows, each beside those of the window before it, and paths are walked inside a
    stretch; so what is shuffled grows with the edges and not with the paths. A task holds the edges of one stretch; the
    work still grows with the density to the power of the length, so long bounds are for sparse graphs.
    """
    if not 2 <= longest <= 10:
        raise ValueError("cycles have 2 to 10 accounts")
    at, after = F.floor(F.col("edge_time") / (2 * w)), F.floor((F.col("edge_time") + w) / (2 * w))
    here = F.array(F.struct(at.alias("_b"), F.lit(True).alias("_own")), F.struct(after.alias("_b"), F.lit(False).alias("_own")))
    e = edges.where("src <> dst and edge_time is not null").select("src", "dst", "edge_time", F.inline(F.when(at == after, F.slice(here, 1, 1)).otherwise(here)))
    e = e.repartition("_b").dropDuplicates()  # placed once, for both
    schema = ", ".join(f"`{c}` {k}" for c, k in e.select("src", "dst", "edge_time").dtypes) + "".join(f", n_{k} long" for k in range(2, longest + 1))
    return e.groupBy("_b").applyInArrow(in_stretch(w, longest), schema)


def cycles(edges: DataFrame, w: int, longest: int = 4) -> DataFrame:
    """Per distinct edge: simple cycles of 2..longest accounts through it, all edges in the window, by length bin."""
    bins = [b for i, b in enumerate(BINS) if i == 0 or BINS[i - 1] < longest]
    sizes = {b: [n for n in range(2, longest + 1) if (i == 0 or n > BINS[i - 1]) and n <= b] for i, b in enumerate(bins)}
    return _cycle_rows(edges, w, longest).select("src", "dst", "edge_time", *(sum((F.col(f"n_{n}") for n in ns), F.lit(0).cast("long")).alias(f"lc_cycle_bin{b}") for b, ns in sizes.items()))


def cycle_lengths(edges: DataFrame, w: int, longest: int = 4) -> DataFrame:
    """Per distinct edge on a cycle: whether it closes one of each length (1 or 0)."""
    return _cycle_rows(edges, w, longest).select("src", "dst", "edge_time", *((F.col(f"n_{n}") > 0).cast("long").alias(f"closes_{n}") for n in range(2, longest + 1)))


def node_fold(nodes: DataFrame, per_edge: DataFrame, maxed: dict[str, dict[str, str] | list[str]], summed: list[str]) -> DataFrame:
    """nodes(node, node_time) with columns folded from per_edge(src, dst, edge_time, ...).

    maxed: for "src" and "dst" the columns taken by maximum onto that end, by the name they get; both ends may give to one
    name. summed: columns summed onto both ends (a self-edge adds twice). Only edges at or before an end's own time count. Nodes without evidence keep 0.
    """
    parts = []
    onto = {end: cols if isinstance(cols := maxed.get(end, {}), dict) else {c: c for c in cols} for end in ("src", "dst")}
    every = list(dict.fromkeys([*onto["src"], *onto["dst"], *summed]))
    for end in ("src", "dst"):
        cols = [F.col(onto[end][c]) if c in onto[end] else F.col(c) if c in summed else F.lit(0) for c in every]
        parts.append(per_edge.select(F.col(end).alias("node"), "edge_time", *[c.alias(n) for c, n in zip(cols, every)]))
    both = parts[0].unionByName(parts[1]).join(nodes.select("node", "node_time"), "node").where("node_time >= edge_time")
    got = both.groupBy("node").agg(*((F.sum(c) if c in summed else F.max(c)).alias(c) for c in every))
    return nodes.select("node", "node_time").join(got, "node", "left").na.fill(0, every)


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph (u, v); the component is its least node. Alternating star contraction.

    Only minima travel, so a hub is one row per neighbour and never one list; rounds grow with the logarithm of the
    longest path. Each round is cut to the shared checkpoint folder.
    """
    e = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut(e.where("u <> v"))
    for _ in range(rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        new = cut(small)
        same = new.count() == e.count() and new.exceptAll(e).isEmpty()
        e = new
        if same:
            break
    root = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def neighbour_mean(edges: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """(node, cols): the mean over in-edges of the sender's values."""
    return edges.select("src", F.col("dst").alias("node")).join(values.withColumnRenamed("node", "src"), "src").groupBy("node").agg(*(F.avg(c).alias(c) for c in cols))


def temporal_neighbours(edges: DataFrame, fanout: int, key: list[str]) -> DataFrame:
    """(dst, edge_time, k, neighbour, neighbour_time): at each time a vertex receives, the senders of its latest edges so far.

    Edges at the same time see each other. Per vertex and time at most `fanout` edges (in key order) can be among the
    latest, so each carries its last edges along in an array of that size, and hubs cost no more per edge than others.
    """
    w = Window.partitionBy("dst", "edge_time").orderBy(*key)
    few = edges.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= fanout)
    per = few.groupBy("dst", "edge_time").agg(F.sort_array(F.collect_list(F.struct("_i", "src"))).alias("_now"))
    back = Window.partitionBy("dst").orderBy(F.asc("edge_time")).rowsBetween(-fanout + 1, 0)
    ordered = F.reverse(F.collect_list(F.struct("edge_time", "_now")).over(back))
    flat = F.slice(F.flatten(F.transform(ordered, lambda d: F.transform(d["_now"], lambda x: F.struct(x["src"].alias("neighbour"), d["edge_time"].alias("neighbour_time"))))), 1, fanout)
    got = per.select("dst", "edge_time", flat.alias("_n")).select("dst", "edge_time", F.posexplode("_n"))
    return got.select("dst", "edge_time", (F.col("pos") + 1).alias("k"), "col.neighbour", "col.neighbour_time")
