"""Graph features of a configuration: built once per graph and definition, folded onto nodes, and selected by model."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Features
from .operators import graph as G
from .sources.graphs import GraphTables
from .store import StaleCache, check_rows, kept

VERSION = 1


STATS = ("fan", "degree", "ratio")


def layout(f: Features, task: str = "edge") -> list[str]:
    """The columns in order: pattern bins of the chosen families, then cumulative statistics, of both ends for an edge, of itself for a node."""
    names = []
    for fam, prefixes in (("fan", ("fan_in", "fan_out")), ("degree", ("degree_in", "degree_out")), ("scatter_gather", ("scatter_gather",)), ("lc_cycle", ("lc_cycle",))):
        if fam in f.families:
            names += [f"gfp_{p}_bin{b}" for p in prefixes for b in f.bins]
    if f.vertex_stats:
        names += [f"gfp_vs_{e}_{w}_{x}" for e in ("src", "dst") for w in ("out", "in") for x in STATS] if task == "edge" else [f"gfp_v_{w}_{x}" for w in ("out", "in") for x in STATS]
    return names


def feature_version(g: GraphTables, f: Features) -> str:
    """A hash of the definition and of the edges it is computed over, whatever their order."""
    h = F.xxhash64("edge", "src", "dst", "edge_time").cast("decimal(38,0)")
    r = g.edges.agg(F.sum(h).cast("string").alias("s"), F.count("*").alias("n")).first()
    return hashlib.sha256(json.dumps([VERSION, f.model_dump(), r["s"], r["n"]], sort_keys=True).encode()).hexdigest()[:16]


def edge_features(g: GraphTables, f: Features) -> DataFrame:
    """(edge, src, dst, edge_time, layout columns)"""
    e = out = g.edges.select("edge", "src", "dst", "edge_time")
    if {"fan", "degree"} & set(f.families) or f.vertex_stats:
        out = G.with_ends(e, G.vertex_statistics(e, f.window), prefix="gfp_", families=f.families, bins=f.bins, stats=f.vertex_stats)
    for fam, make in (("scatter_gather", G.scatter_gather), ("lc_cycle", lambda x, w: G.cycles(x, w, f.cycle_len))):
        if fam in f.families:
            p = make(e, f.window)
            have = [c for c in p.columns if "_bin" in c]
            ren = p.select("src", "dst", "edge_time", *(F.col(c).alias(f"gfp_{c}") for c in have))
            out = out.join(ren, ["src", "dst", "edge_time"], "left")
    return out.select("edge", "src", "dst", "edge_time", *((F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0)).cast("double").alias(c) for c in layout(f)))


def unit_features(g: GraphTables, f: Features) -> DataFrame:
    """(unit, gfp columns): per edge, or folded onto nodes with the guard that a node sees nothing after its own time.

    On a node, what its edges say of it as sender and as receiver is one statistic for each direction.
    """
    e = edge_features(g, f)
    names = layout(f, g.meta.task)
    if g.meta.task == "edge":
        out = e.withColumnRenamed("edge", "unit").drop("src", "dst", "edge_time")
    else:
        summed = [c for c in names if "scatter_gather" in c or "lc_cycle" in c]
        onto = {end: {c: c for c in names if f"_{way}_bin" in c} for end, way in (("src", "out"), ("dst", "in"))}
        if f.vertex_stats:
            for end in onto:
                onto[end] |= {f"gfp_v_{w}_{x}": f"gfp_vs_{end}_{w}_{x}" for w in ("out", "in") for x in STATS}
        out = G.node_fold(g.nodes, e, onto, summed).withColumnRenamed("node", "unit").drop("node_time")
    if set(out.columns) != {"unit", *names}:
        raise ValueError(f"the features are not laid out as said: {sorted(set(out.columns) ^ {'unit', *names})[:5]}")
    return out.select("unit", *names)


def kept_features(g: GraphTables, f: Features, root: str) -> DataFrame:
    """unit_features, read from the folder of their version where they are kept, and checked against the graph's units."""
    spark = g.edges.sparkSession
    names = layout(f, g.meta.task)
    units = g.units.select("unit", F.col("unit_time").alias("time"))
    began = time.time()

    def check(rows: DataFrame, note: dict) -> None:
        if note["columns"] != names or note["definition"] != f.model_dump(mode="json"):
            raise StaleCache("the kept features have another definition")
        check_rows(rows, ["unit", "time", *names], units, ["unit", "time"])

    note = lambda: {"columns": names, "definition": f.model_dump(mode="json"), "seconds": round(time.time() - began, 3), "task": g.meta.task, "dataset": g.meta.dataset, "version": g.meta.version}
    got = kept(spark, f"{root}/features/{feature_version(g, f)}", lambda: units.join(unit_features(g, f), "unit").select("unit", "time", *names), note, check)
    return got.drop("time")


def columns(g: GraphTables, kind: str, f: Features) -> list[str]:
    """The columns of a selection: base is the local block, raw all blocks, base_gfp base with the graph features."""
    blocks = g.meta.blocks
    if kind == "base":
        return blocks["local"]
    if kind == "base_gfp":
        return [*blocks["local"], *layout(f, g.meta.task)]
    if kind == "raw":
        if set(blocks) != {"local", "agg1hop"}:
            raise ValueError("raw features need exactly a local and an aggregate block")
        return [*blocks["local"], *blocks["agg1hop"]]
    raise ValueError(f"no features {kind!r}")
