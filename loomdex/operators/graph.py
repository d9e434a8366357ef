"""Typed file graphs: traversal, communities, dependency lookups, cross-repository resolution.

A vertex is (codebase, file). Loops step a frontier: each hop is one equi-join and one anti-join, written to the shared
folder so that lineage stays short and lost executors cost a hop."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.runtime import materialise

CALL_TYPES = ("calls", "import", "static_import", "extends", "implements", "wildcard_import")


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(x, high))


def directed(edges: DataFrame, direction: str = "downstream", edge_types: list[str] | None = None, codebase: str | None = None) -> DataFrame:
    """(codebase, a, b, edge_type): steps from a to b."""
    rows = edges.filter(F.col("target_file").isNotNull())
    if edge_types:
        rows = rows.filter(F.col("edge_type").isin(*edge_types))
    if codebase:
        rows = rows.filter(F.col("codebase") == codebase)
    a, b = ("source_file", "target_file") if direction == "downstream" else ("target_file", "source_file")
    return rows.select("codebase", F.col(a).alias("a"), F.col(b).alias("b"), "edge_type")


def reach(edges: DataFrame, starts: DataFrame, direction: str = "downstream", edge_types: list[str] | None = None, codebase: str | None = None, max_depth: int = 5, max_results: int | None = None) -> DataFrame:
    """(codebase, file, depth): least depth of each file that a start (codebase, file) reaches; starts are left out."""
    steps = materialise(directed(edges, direction, edge_types, codebase).select("codebase", "a", "b").distinct(), "steps")
    seen = frontier = materialise(starts.select("codebase", "file").distinct().withColumn("depth", F.lit(0)), "hop")
    for depth in range(1, clamp(max_depth, 1, 10) + 1):
        nxt = frontier.join(steps, (steps["codebase"] == frontier["codebase"]) & (steps["a"] == frontier["file"])).select(steps["codebase"], F.col("b").alias("file")).distinct()
        frontier = materialise(nxt.join(seen, ["codebase", "file"], "left_anti").withColumn("depth", F.lit(depth)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    got = seen.filter("depth > 0")
    return got.orderBy("depth", "file", "codebase").limit(clamp(max_results, 1, 500)) if max_results else got


def paths(edges: DataFrame, start: str | DataFrame, direction: str = "downstream", edge_types: list[str] | None = None, codebase: str | None = None, max_depth: int = 5) -> DataFrame:
    """(codebase, file, depth, path): a shortest path to each file from any start, the least of equals; no file twice on a path.
    `start`: a file, or any number of starts (codebase, file), which are all the first frontier's seed."""
    steps = materialise(directed(edges, direction, edge_types, codebase).select("codebase", "a", "b").distinct(), "steps")
    starts = steps.filter(F.col("a") == start).select("codebase", F.col("a").alias("file")) if isinstance(start, str) else start.select("codebase", "file")
    level = best = materialise(starts.distinct().withColumn("path", F.array("file")), "paths")
    for _ in range(clamp(max_depth, 1, 10)):
        nxt = level.join(steps, (steps["codebase"] == level["codebase"]) & (steps["a"] == level["file"]) & ~F.array_contains(level["path"], steps["b"]))
        nxt = nxt.select(steps["codebase"], F.col("b").alias("file"), F.array_append("path", F.col("b")).alias("path")).groupBy("codebase", "file").agg(F.min("path").alias("path"))
        level = materialise(nxt.join(best, ["codebase", "file"], "left_anti"), "paths")
        if level.isEmpty():
            break
        best = best.unionByName(level)
    return best.filter(F.size("path") > 1).select("codebase", "file", (F.size("path") - 1).alias("depth"), "path")


def resolve_start(symbols: DataFrame, start: str, codebase: str | None = None) -> DataFrame:
    """(codebase, file): the name itself where it looks like a path, else the files of its symbols."""
    if "/" in start or "." in start.rsplit("/", 1)[-1]:
        spark = symbols.sparkSession
        every = symbols.select("codebase").distinct() if codebase is None else spark.range(1).select(F.lit(codebase).alias("codebase"))
        return every.withColumn("file", F.lit(start))
    rows = symbols.filter(F.col("name") == start)
    if codebase:
        rows = rows.filter(F.col("codebase") == codebase)
    return rows.select("codebase", F.col("file_path").alias("file")).distinct()


def graph_traverse(edges: DataFrame, symbols: DataFrame, start_node: str, codebase: str | None = None, direction: str = "downstream", edge_types: list[str] | None = None, max_depth: int = 3, max_results: int = 50, include_paths: bool = False) -> DataFrame:
    starts = resolve_start(symbols, start_node, codebase)
    got = reach(edges, starts, direction, edge_types, codebase, max_depth)
    if include_paths:
        got = got.join(paths(edges, starts, direction, edge_types, codebase, max_depth).select("codebase", "file", "path"), ["codebase", "file"], "left")
    return got.orderBy("depth", "file", "codebase").limit(clamp(max_results, 1, 500))


def degree(edges: DataFrame) -> DataFrame:
    """(codebase, file, degree): edges that touch a file; a loop counts once."""
    ends = F.array_distinct(F.array_compact(F.array("source_file", "target_file")))
    return edges.select("codebase", F.explode(ends).alias("file")).groupBy("codebase", "file").agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("target_file").isNotNull()).groupBy("codebase", F.col("target_file").alias("file")).agg(F.count("*").alias("in_degree"))


# ---- communities --------------------------------------------------------------------------------


def louvain_labels(pairs: dict[tuple[int, int], float], n: int, least: float = 1e-9) -> list[int]:
    """Greedy modularity moves and aggregation until nothing gains; ties go to the smallest label."""
    member = list(range(n))
    weight = dict(pairs)
    size = n
    while True:
        near: list[dict[int, float]] = [{} for _ in range(size)]
        loops = [0.0] * size
        for (a, b), w in weight.items():
            if a == b:
                loops[a] += w
            else:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        total = sum(weight.values())
        if total <= 0:
            return member
        k = [2 * loops[i] + sum(near[i].values()) for i in range(size)]
        label, inside = list(range(size)), list(k)
        moved_any = False
        for _ in range(50):
            moved = False
            for i in range(size):
                own = label[i]
                links: dict[int, float] = {}
                for j, w in near[i].items():
                    links[label[j]] = links.get(label[j], 0.0) + w
                inside[own] -= k[i]
                gain = lambda c: links.get(c, 0.0) - inside[c] * k[i] / (2 * total)  # noqa: B023, E731
                best = min(sorted({own, *links}), key=lambda c: (-round(gain(c), 12), c))
                if gain(best) <= gain(own) + least:
                    best = own
                inside[best] += k[i]
                if best != own:
                    label[i], moved = best, True
            moved_any |= moved
            if not moved:
                break
        names = {c: x for x, c in enumerate(sorted(set(label)))}
        label = [names[c] for c in label]
        member = [label[m] for m in member]
        if not moved_any:
            return member
        merged: dict[tuple[int, int], float] = {}
        for (a, b), w in weight.items():
            key = (min(label[a], label[b]), max(label[a], label[b]))
            merged[key] = merged.get(key, 0.0) + w
        weight, size = merged, len(names)


def modularity(pairs: dict[tuple[int, int], float], label: list[int]) -> float:
    total = sum(pairs.values())
    inside: dict[int, float] = {}
    ends: dict[int, float] = {}
    for (a, b), w in pairs.items():
        ends[label[a]] = ends.get(label[a], 0.0) + w
        ends[label[b]] = ends.get(label[b], 0.0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0.0) + w
    return sum(inside.get(c, 0.0) / total - (e / (2 * total)) ** 2 for c, e in ends.items()) if total else 0.0


def collapsed(edges: DataFrame, edge_types: tuple[str, ...] = CALL_TYPES) -> DataFrame:
    """(codebase, a <= b, w): the simple undirected graph."""
    rows = edges.filter(F.col("target_file").isNotNull() & F.col("edge_type").isin(*edge_types) & (F.col("source_file") != F.col("target_file")))
    return rows.select("codebase", F.least("source_file", "target_file").alias("a"), F.greatest("source_file", "target_file").alias("b")).distinct().withColumn("w", F.lit(1.0))


def communities(edges: DataFrame, edge_types: tuple[str, ...] = CALL_TYPES, most: int = 1_000_000) -> DataFrame:
    """(codebase, file_path, community_id, modularity). A codebase of up to `most` pairs of files is one task's graph; larger ones, by count,
    are moved in rounds of joins."""
    pairs = materialise(collapsed(edges, edge_types), "pairs")
    sizes = pairs.groupBy("codebase").agg(F.count("*").alias("n"))
    large = materialise(sizes.filter(F.col("n") > most).select("codebase"), "large")

    def one(df: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(df["a"]) | set(df["b"]))
        at = {x: i for i, x in enumerate(names)}
        pairs = {(min(at[a], at[b]), max(at[a], at[b])): w for a, b, w in zip(df["a"], df["b"], df["w"])}
        label = louvain_labels(dict(sorted(pairs.items())), len(names))
        first: dict[int, int] = {}
        for c in label:
            first.setdefault(c, len(first))
        return pd.DataFrame({"codebase": df["codebase"].iloc[0], "file_path": names, "community_id": np.array([first[c] for c in label], "int32"), "modularity": round(modularity(pairs, label), 4)})

    small = pairs.join(large, "codebase", "left_anti").groupBy("codebase").applyInPandas(one, "codebase string, file_path string, community_id int, modularity double")
    if large.isEmpty():
        return small
    return small.unionByName(moved_in_rounds(pairs.join(large, "codebase", "left_semi")))


def moved_in_rounds(pairs: DataFrame, levels: int = 8, rounds: int = 12, least: float = 1e-9) -> DataFrame:
    """Greedy modularity moves over tables: in a round every vertex of one half (by a hash that changes) joins the community around it that
    gains most; a round that does not raise modularity is undone and ends the level. Then communities become vertices.

    Vertices are numbers in the order of their names. A round is one pass over the links: it writes each vertex's best offer, from which come
    the modularity, the next round's moves and, where that round is undone, the other half's. Joins of vertices are sort-merge joins, as a
    table of few bytes on disk may still be one of millions of rows; no vertex, community or graph is gathered or broadcast."""
    met = lambda df: df.hint("merge")
    ends = pairs.select("codebase", F.explode(F.array("a", "b")).alias("file_path")).distinct()
    vertex = materialise(ends.orderBy("codebase", "file_path").withColumn("v", F.monotonically_increasing_id()), "vertices")
    total = F.broadcast(pairs.groupBy("codebase").agg((2 * F.sum("w")).cast("double").alias("m2")))  # a row a codebase beyond `most` pairs
    side = lambda x: met(vertex.select("codebase", F.col("file_path").alias(x), F.col("v").alias(f"v{x}")))
    half = materialise(pairs.join(side("a"), ["codebase", "a"]).join(side("b"), ["codebase", "b"]).select(F.col("va").alias("a"), F.col("vb").alias("b"), F.col("w").cast("double").alias("w")), "half")
    links = half.filter("a <> b")
    graph = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).unionByName(half.filter("a = b").select("a", "b", (2 * F.col("w")).alias("w"))), "graph")
    member = vertex.select("v", F.col("v").alias("a"))
    about = ["k", "m2", "turns", "codebase"]

    def offers(state: DataFrame) -> DataFrame:
        """state (a, c, k, ...) with each vertex's best community `to`, whether it `gains`, and its links to its own community."""
        weight = state.groupBy("c").agg(F.sum("k").alias("t"))
        at = state.select("a", "c", "k").join(met(weight), "c")
        around = graph.filter("a <> b").join(met(at.select(F.col("a").alias("b"), "c", "t")), "b").select("a", "c", "t", F.col("w").alias("links"))
        every = around.unionByName(at.select("a", "c", "t", F.lit(0.0).alias("links"))).repartition("a")
        summed = every.groupBy("a", "c").agg(F.sum("links").alias("links"), F.max("t").alias("t"))
        known = summed.join(met(state.select("a", F.col("c").alias("now"), *about)), "a")
        here = F.col("c") == F.col("now")
        gain = F.col("links") - (F.col("t") - F.when(here, F.col("k")).otherwise(0.0)) * F.col("k") / F.col("m2")
        best = known.withColumn("gain", F.round(gain, 12)).groupBy("a", "now", *about).agg(F.min_by(F.struct("c", "gain"), F.struct(-F.col("gain"), "c")).alias("best"), F.max(F.when(here, F.col("gain"))).alias("stay"), F.max(F.when(here, F.col("links"))).alias("links"))
        return materialise(best.select("a", F.col("now").alias("c"), *about, F.col("best.c").alias("to"), (F.col("best.gain") > F.col("stay") + least).alias("gains"), "links"), "offers")

    def worth(offered: DataFrame, loops: dict) -> dict:
        """Modularity by codebase."""
        by = offered.groupBy("codebase", "c").agg(F.sum("k").alias("t"), F.sum("links").alias("links"), F.max("m2").alias("m2"))
        got = by.groupBy("codebase").agg(F.sum("links").alias("links"), F.sum((F.col("t") / F.col("m2")) ** 2).alias("spread"), F.max("m2").alias("m2")).collect()  # a row a codebase beyond `most` pairs
        return {r["codebase"]: (r["links"] + loops[r["codebase"]]) / r["m2"] - r["spread"] for r in got}

    quality = None
    for level in range(levels):
        bits = (F.when(F.pmod(F.xxhash64("file_path", F.lit(level * rounds + n)), F.lit(2)) == 0, 1 << n).otherwise(0) for n in range(rounds))
        named = vertex.join(total, "codebase").select(F.col("v").alias("a"), "codebase", "m2", reduce(lambda x, y: x + y, bits).alias("turns"))
        ties = graph.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("loop"))
        state = materialise(ties.join(met(named), "a").select("a", F.col("a").alias("c"), *about, "loop"), "labels")
        loops = {r["codebase"]: r["loop"] for r in state.groupBy("codebase").agg(F.sum("loop").alias("loop")).collect()}
        offered = offers(state)
        start = before = worth(offered, loops)
        idle = 0
        for n in range(rounds):
            go = F.col("gains") & (F.col("turns").bitwiseAND(F.lit(1 << n)) != 0)
            fresh = offers(offered.select("a", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"), *about))
            now = worth(fresh, loops)
            better = [c for c in now if now[c] > before[c] + least]
            if len(better) == len(now):
                offered = fresh
            elif better:
                kept = F.col("codebase").isin(better)
                offered = fresh.filter(kept).unionByName(offered.filter(~kept))
            before = {c: max(now[c], before[c]) for c in now}
            idle = 0 if better else idle + 1
            if idle == 2:  # both halves have had their turn
                break
        names = offered.select("a", "c")
        member = materialise(member.join(met(names), "a").select("v", F.col("c").alias("a")), "members")
        quality = before
        if all(before[c] <= start[c] + least for c in before):
            break
        joined = graph.join(met(names), "a").join(met(names.select(F.col("a").alias("b"), F.col("c").alias("d"))), "b")
        graph = materialise(joined.groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum("w").alias("w")), "graph")
    value = F.coalesce(*(F.when(F.col("codebase") == c, F.lit(round(q, 4))) for c, q in quality.items()), F.lit(0.0)) if quality else F.lit(0.0)
    found = materialise(member.join(met(vertex), "v").select("codebase", "file_path", "a"), "found")
    number = found.select("codebase", "a").distinct().withColumn("community_id", F.row_number().over(Window.partitionBy("codebase").orderBy("a")) - 1)
    return found.join(met(number), ["codebase", "a"]).select("codebase", "file_path", "community_id", value.alias("modularity"))


def label_propagation(edges: DataFrame, rounds: int = 10, edge_types: tuple[str, ...] = CALL_TYPES) -> DataFrame:
    """(codebase, file_path, label) for graphs of any size: each round takes the most common label around, ties the smallest."""
    half = collapsed(edges, edge_types)
    both = materialise(half.select("codebase", "a", "b").union(half.select("codebase", F.col("b"), F.col("a"))), "links")
    labels = both.select("codebase", F.col("a").alias("v")).distinct().withColumn("label", F.col("v"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("v", "b"), ["codebase", "b"]).groupBy("codebase", "a", "label").agg(F.count("*").alias("n"))
        own = labels.select("codebase", F.col("v").alias("a"), "label", F.lit(1).alias("n"))
        votes = votes.unionByName(own).groupBy("codebase", "a", "label").agg(F.sum("n").alias("n"))
        labels = materialise(votes.groupBy("codebase", F.col("a").alias("v")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")), "labels")
    return labels.select("codebase", F.col("v").alias("file_path"), "label")


def community_meta(edges: DataFrame, found: DataFrame) -> DataFrame:
    counts = edges.groupBy("codebase").agg(F.count("*").alias("edge_count"))
    return found.groupBy("codebase").agg(F.count_distinct("community_id").alias("community_count")).join(counts, "codebase")


def community_members(edges: DataFrame, found: DataFrame, codebase: str, file_path: str) -> DataFrame:
    """Files of a file's community, by degree."""
    own = found.filter((F.col("codebase") == codebase) & (F.col("file_path") == file_path)).select("codebase", "community_id")
    members = found.join(F.broadcast(own), ["codebase", "community_id"])
    got = members.join(degree(edges).withColumnRenamed("file", "file_path"), ["codebase", "file_path"], "left")
    return got.select("codebase", "community_id", "file_path", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "file_path")


def community_list(edges: DataFrame, found: DataFrame, best: int = 3) -> DataFrame:
    """Each community's size and its files of highest degree."""
    got = found.join(degree(edges).withColumnRenamed("file", "file_path"), ["codebase", "file_path"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("codebase", "community_id").orderBy(F.desc("degree"), "file_path")
    tops = got.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= best).groupBy("codebase", "community_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "file_path"))), lambda x: x["file_path"]).alias("top_files"))
    return found.groupBy("codebase", "community_id").agg(F.count("*").alias("members")).join(tops, ["codebase", "community_id"]).orderBy(F.desc("members"), "codebase", "community_id")


def bridges(edges: DataFrame, found: DataFrame, limit: int = 200) -> DataFrame:
    """Edges between communities."""
    side = lambda n: found.select("codebase", F.col("file_path").alias(f"{n}_file"), F.col("community_id").alias(f"{n}_community"))
    got = edges.join(side("source"), ["codebase", "source_file"]).join(side("target"), ["codebase", "target_file"]).filter(F.col("source_community") != F.col("target_community"))
    return got.select("codebase", "source_file", "target_file", "edge_type", "source_community", "target_community").orderBy("codebase", "source_file", "target_file", "edge_type").limit(limit)


def drifted(stored: DataFrame, edges: DataFrame, most: float = 0.10) -> DataFrame:
    """(codebase, stale): whether the number of edges has moved by more than a tenth."""
    now = edges.groupBy("codebase").agg(F.count("*").alias("now"))
    both = stored.select("codebase", F.col("edge_count").alias("old")).join(now, "codebase", "full_outer").select("codebase", F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("now", F.lit(0)).alias("now"))
    return both.select("codebase", F.when(F.col("old") == 0, F.col("now") > 0).otherwise(F.abs(F.col("now") - F.col("old")) / F.col("old") > most).alias("stale"))


def newest_edges(edges: DataFrame, most: int) -> DataFrame:
    return edges.orderBy(F.desc("updated_at"), F.desc("id")).limit(most)


def load_graph(edges: DataFrame, most: int = 10_000_000, codebase: str | None = None) -> tuple[DataFrame, int]:
    """The edges that a graph is built from (those with a target; beyond `most` the newest), written once so that a rebuild never shows in
    part, and how many there were: what `drifted` compares later."""
    rows = edges.filter(F.col("target_file").isNotNull() if codebase is None else F.col("target_file").isNotNull() & (F.col("codebase") == codebase))
    n = rows.count()
    return materialise(newest_edges(rows, most) if n > most else rows, "loaded-graph"), n


# ---- lookups ------------------------------------------------------------------------------------


def symbol_search(symbols: DataFrame, name: str, codebase: str | None = None, kind: str | None = None, max_results: int = 20) -> DataFrame:
    """% in the name makes it a pattern, in either case; else equality."""
    pattern = name.replace("\\", "\\\\").replace("_", "\\_")
    rows = symbols.filter(F.col("name").ilike(pattern) if "%" in name else F.col("name") == name)
    rows = rows.filter(F.col("codebase") == codebase) if codebase else rows
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    return rows.withColumn("label", F.get_json_object("metadata", "$.label")).orderBy("codebase", "file_path", "start_line", "name").limit(max_results)


def dependency_search(edges: DataFrame, file_path: str, codebase: str | None = None, direction: str = "imports", edge_type: str | None = None, max_results: int = 50) -> DataFrame:
    """Five directions; arguments match literally, in either case where only a part is asked for."""
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(file_path.lower()))
    rows = {
        "imports": lambda: edges.filter((F.col("source_file") == file_path) & F.col("target_file").isNotNull()),
        "imported_by": lambda: edges.filter(F.col("target_file") == file_path),
        "depended_on_by": lambda: edges.filter((F.col("edge_type") == "build_dependency") & has("metadata")),
        "repo_depends_on": lambda: edges.filter((F.col("edge_type") == "repo_dependency") & (F.col("codebase") == file_path)),
        "repo_depended_on_by": lambda: edges.filter((F.col("edge_type") == "repo_dependency") & has("target_file")),
    }[direction]()
    if direction in ("imports", "imported_by"):
        rows = rows.filter(F.col("codebase") == codebase) if codebase else rows
        rows = rows.filter(F.col("edge_type") == edge_type) if edge_type else rows
    return rows.select("codebase", "source_file", "target_file", "edge_type", "metadata").orderBy("codebase", "source_file", "target_file", "edge_type").limit(max_results)


def repo_dependencies(edges: DataFrame) -> DataFrame:
    """(codebase, edge_count) of repositories' dependencies, the most first."""
    return edges.filter("edge_type = 'repo_dependency'").groupBy("codebase").agg(F.count("*").alias("edge_count")).orderBy(F.desc("edge_count"), "codebase")


def without_dependencies(edges: DataFrame, codebase: str, edge_type: str = "repo_dependency") -> DataFrame:
    """All edges but one repository's dependencies."""
    return edges.filter(~((F.col("edge_type") == edge_type) & (F.col("codebase") == codebase)))


def high_value(symbols: DataFrame, edges: DataFrame, codebase: str, least: int = 5) -> DataFrame:
    """Symbols of files with enough incoming edges, or of entry points."""
    own = symbols.filter(F.col("codebase") == codebase)
    many = in_degree(edges.filter(F.col("codebase") == codebase)).filter(F.col("in_degree") >= least)
    often = own.join(many.select(F.col("file").alias("file_path"), "in_degree"), "file_path", "left")
    entry = F.col("file_path").rlike(r"(?i).*/(?:main|index|app|server)\.[^/]*$|.*/Application\..*")
    return often.filter(F.col("in_degree").isNotNull() | entry).withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).dropDuplicates(["id"])


# ---- cross-repository resolution ----------------------------------------------------------------


def resolve_dependencies(edges: DataFrame, codebases: DataFrame) -> DataFrame:
    """build_dependency edges without a target get `codebase:<name>/`: an equal name first, then the longest that holds the
    artifact, then by name; an empty artifact never fits."""
    artifact = F.lower(F.coalesce(F.get(F.split("metadata", ":"), F.lit(1)), F.lit("")))
    open_ = edges.filter((F.col("edge_type") == "build_dependency") & F.col("target_file").isNull()).withColumn("artifact", artifact).filter("artifact <> ''")
    # An artifact is looked for only in names that hold its first three letters (all of it where it has fewer): an equi-join.
    names = codebases.select(F.col("codebase").alias("name")).distinct()
    low = F.lower("name")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    held = names.select("name", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    wanted = open_.select("artifact").distinct().withColumn("gram", F.substr("artifact", F.lit(1), F.lit(3)))
    fits = F.contains(low, F.col("artifact"))
    best = wanted.join(held, "gram").filter(fits).groupBy("artifact").agg(F.min_by("name", F.struct((low != F.col("artifact")).cast("int"), -F.length("name"), "name")).alias("name"))
    return open_.join(best, "artifact").filter(F.col("name") != F.col("codebase")).select("id", "codebase", "source_file", "metadata", F.concat(F.lit("codebase:"), "name", F.lit("/")).alias("target_file"), F.col("name").alias("target_codebase"))


def resolve_types(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hierarchy edges without a target: a symbol of that name in another codebase, a declared dependency first."""
    short = F.regexp_extract("metadata", r"([^.]+)$", 1)
    open_ = edges.filter(F.col("edge_type").isin("extends", "implements") & F.col("target_file").isNull()).withColumn("name", short)
    declared = edges.filter((F.col("edge_type") == "build_dependency") & F.col("target_file").startswith("codebase:")).select("codebase", F.regexp_extract("target_file", r"^codebase:([^/]+)", 1).alias("target_codebase")).distinct().withColumn("is_dep", F.lit(1))
    there = symbols.select(F.col("name"), F.col("codebase").alias("target_codebase"), F.col("file_path").alias("to_file"), "start_line")
    both = open_.join(there, "name").filter(F.col("target_codebase") != F.col("codebase")).join(declared, ["codebase", "target_codebase"], "left")
    best = F.min_by(F.struct("target_codebase", "to_file"), F.struct(-F.coalesce("is_dep", F.lit(0)), "target_codebase", "to_file", "start_line")).alias("b")
    return both.groupBy("id", "codebase", "source_file", "metadata").agg(best).select("id", "codebase", "source_file", "metadata", F.col("b.to_file").alias("target_file"), F.col("b.target_codebase").alias("target_codebase"))


def resolve_hierarchy(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hierarchy edges without a target: the first symbol of that name, the own codebase first."""
    open_ = edges.filter(F.col("edge_type").isin("extends", "implements", "delegation") & F.col("target_file").isNull()).withColumn("name", F.regexp_extract("metadata", r"([^.]+)$", 1))
    there = symbols.select("name", F.col("codebase").alias("there"), F.col("file_path").alias("to_file"), "start_line")
    best = F.min_by("to_file", F.struct((F.col("there") != F.col("codebase")).cast("int"), "there", "to_file", "start_line")).alias("target_file")
    return open_.join(there, "name").groupBy("id", "codebase", "source_file", "metadata").agg(best)


def index_edges(documents: DataFrame) -> DataFrame:
    """A symbol index (documents: array<struct<relativePath, occurrences: array<struct<symbol, symbolRoles>>>>) to edges from
    the file that refers to the one that defines."""
    seen = documents.select(F.explode("documents").alias("d")).select(F.col("d.relativePath").alias("file"), F.explode("d.occurrences").alias("o")).select("file", F.col("o.symbol").alias("symbol"), (F.col("o.symbolRoles").bitwiseAND(1) == 1).alias("defines")).filter("symbol is not null and symbol <> ''")
    home = seen.filter("defines").groupBy("symbol").agg(F.min("file").alias("target_file"))
    uses = seen.filter("not defines").select("symbol", F.col("file").alias("source_file")).distinct()
    got = uses.join(home, "symbol").filter("source_file <> target_file")
    return got.select("source_file", "target_file", T.scip_edge_type(F.col("symbol")).alias("edge_type"), F.lit(0.95).alias("confidence")).distinct()


def merge_edges(existing: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row for each (source, target): the symbol index wins."""
    columns = ["source_file", "target_file", "edge_type", "confidence"]
    every = existing.select(*columns, F.lit(1).alias("p")).unionByName(indexed.select(*columns, F.lit(0).alias("p")))
    w = Window.partitionBy("source_file", "target_file").orderBy("p", "edge_type", F.desc("confidence"))
    return every.withColumn("n", F.row_number().over(w)).filter("n = 1").select(*columns)


# ---- call resolution ----------------------------------------------------------------------------


def resolve_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (call_id, source_file, callee, receiver), imports (source_file, name, target_file), symbols (name, file_path, short).

    The first strategy that hits: imported name .95, import suffix .85, same folder .90, unique name .75, nearest folder .55,
    similar name .30 to .40; else unresolved. Each is an equi-join; only names that nothing else finds are compared for
    similarity, with those that share two of the rare letters that any name so similar must share."""
    base = F.regexp_extract("receiver", r"^([^.]+)", 1)
    short = F.regexp_extract("callee", r"([^.]+)$", 1)
    c = calls.withColumns({"base": base, "short": short, "dir": T.directory(F.col("source_file"))})
    keys = F.array_distinct(F.filter(F.array("base", "receiver", "callee"), lambda x: x.isNotNull() & (x != "")))
    asked = c.select("call_id", "source_file", F.posexplode(keys).alias("at", "name"))
    by_name = imports.groupBy("source_file", "name").agg(F.max("target_file").alias("target"))
    hit = lambda rows, p, conf, name: rows.select("call_id", F.col("target").alias("target_file"), F.lit(p).alias("p"), conf.alias("confidence"), F.lit(name).alias("strategy"))
    s1 = asked.join(by_name, ["source_file", "name"]).groupBy("call_id").agg(F.min_by("target", "at").alias("target"))
    suffix = imports.withColumn("suffix", F.regexp_extract("name", r"([^.]+)$", 1)).groupBy("source_file", "suffix").agg(F.min("target_file").alias("target"))
    want = c.select("call_id", "source_file", F.posexplode(F.array_distinct(F.filter(F.array("base", "short"), lambda x: x.isNotNull() & (x != "")))).alias("at", "suffix"))
    s2 = want.join(suffix, ["source_file", "suffix"]).groupBy("call_id").agg(F.min_by("target", "at").alias("target"))
    named = symbols.select(F.col("short"), F.col("file_path").alias("target")).distinct()
    placed = named.groupBy("short", T.directory(F.col("target")).alias("dir")).agg(F.slice(F.array_sort(F.collect_set("target")), 1, 2).alias("two"))
    near = c.join(placed, ["short", "dir"]).select("call_id", F.get(F.filter("two", lambda t: t != F.col("source_file")), F.lit(0)).alias("target"))
    s3 = near.filter("target is not null")
    only = named.groupBy("short").agg(F.count_distinct("target").alias("files"), F.min("target").alias("target")).filter("files = 1")
    s4 = c.join(only, "short").select("call_id", "target")
    # Two folders' distance runs over a folder above both: each name keeps, for every folder above its definitions, the one least deep;
    # a call looks up the folders above its own. A folder above the lowest common one only gives more.
    there = placed.select("short", F.get("two", F.lit(0)).alias("target"), _folders("dir").alias("parts"))
    above = there.select("short", F.struct(F.size("parts").alias("deep"), "target").alias("b"), F.explode(_prefixes("parts")).alias("folder")).groupBy("short", "folder").agg(F.min("b").alias("b"))
    asking = c.select("short", "dir").distinct().withColumn("parts", _folders("dir"))
    asking = asking.select("short", "dir", F.size("parts").alias("size"), F.posexplode(_prefixes("parts")).alias("common", "folder"))
    way = F.struct((F.col("size") + F.col("b.deep") - 2 * F.col("common")).alias("d"), F.col("b.target").alias("target"))
    s5 = c.join(asking.join(above, ["short", "folder"]).groupBy("short", "dir").agg(F.min(way).alias("w")), ["short", "dir"]).select("call_id", F.col("w.target").alias("target"))
    found = hit(s1, 1, F.lit(0.95), "import_exact").unionByName(hit(s2, 2, F.lit(0.85), "import_suffix")).unionByName(hit(s3, 3, F.lit(0.90), "same_module")).unionByName(hit(s4, 4, F.lit(0.75), "unique_name")).unionByName(hit(s5, 5, F.lit(0.55), "nearest"))
    best = found.groupBy("call_id").agg(F.min_by(F.struct("target_file", "confidence", "strategy"), "p").alias("b"))
    rest = c.join(best, "call_id", "left_anti")
    unknown = rest.select("short").distinct().withColumn("bag", _bag("short")).withColumn("key", F.explode(_pair_keys("bag")))
    pool = named.groupBy(F.col("short").alias("other")).agg(F.min("target").alias("target")).withColumn("other_bag", _bag("other")).withColumn("key", F.explode(_pair_keys("other_bag")))
    hopeful = 2 * F.size(F.array_intersect("bag", "other_bag")) >= 0.7 * (F.size("bag") + F.size("other_bag"))
    met = unknown.join(pool, "key").filter(hopeful).groupBy("short", "other").agg(F.first("target").alias("target"))
    similar = met.withColumn("ratio", _ratio("short", "other")).filter("ratio >= 0.7")
    fuzzy = similar.groupBy("short").agg(F.min_by(F.struct("target", "ratio"), F.struct(-F.col("ratio"), "other")).alias("f"))
    loose = rest.join(fuzzy, "short").select("call_id", F.struct(F.col("f.target").alias("target_file"), (0.30 + (F.col("f.ratio") - 0.7) / 3).alias("confidence"), F.lit("fuzzy").alias("strategy")).alias("b"))
    every = best.unionByName(loose)
    got = calls.join(every, "call_id", "left")
    return got.select("call_id", "source_file", "callee", F.col("b.target_file").alias("target_file"), F.col("b.confidence").alias("confidence"), F.coalesce("b.strategy", F.lit("none")).alias("strategy"), F.when(F.col("b.target_file").isNotNull(), "calls").otherwise("calls_unresolved").alias("edge_type"))


def _folders(path: str) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _prefixes(parts: str) -> Column:
    """The folder's own path and all above it, from the top."""
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(F.col(parts), 1, n), "/"))


#: Letters by how common they are in names; only the order in which a bag's letters are compared hangs on it.
COMMON = "etaoinsrlcdumpgfhybvkwxjqz"


def _pair_keys(bag: str) -> Column:
    """Of a bag of n letters, pairs of the first n - ceil(.35 (n + .538 n)) + 2, rare ones first: a name at a ratio of .7 or more shares at
    least that many letters, two or more, so two stand in both names' heads. A bag of one letter has that letter."""
    letters = F.col(bag)
    place = lambda x: F.struct((-F.coalesce(F.nullif(F.instr(F.lit(COMMON), F.substr(x, F.lit(1), F.lit(1))), F.lit(0)), F.lit(99))).alias("p"), x.alias("x"))
    ordered = F.transform(F.sort_array(F.transform(letters, place)), lambda y: y["x"])
    n = F.size(letters)
    head = F.slice(ordered, 1, F.greatest(F.lit(1), F.least(n, n - F.ceil(n * 0.5382).cast("int") + 2)))
    pairs = F.flatten(F.transform(head, lambda x, i: F.transform(F.slice(head, i + 2, F.size(head)), lambda y: F.concat_ws("|", x, y))))
    return F.when(n == 1, letters).otherwise(pairs)


def _bag(name: str) -> Column:
    """A name's characters, repeats numbered: what two names share bounds how much of them can match."""
    chars = F.split(F.lower(name), "")
    nth = lambda c, i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))
    return F.transform(chars, lambda c, i: F.concat(c, nth(c, i).cast("string")))


def _ratio(a: str, b: str) -> Column:
    """Similarity of two names by longest matching blocks; no built-in has this measure."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def enclosing_symbol(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call's innermost symbol: the smallest span of its file that holds the line."""
    inside = calls.join(symbols.select("file_path", F.col("name").alias("symbol"), "start_line", "end_line"), "file_path").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = inside.groupBy("file_path", "line").agg(F.min_by("symbol", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "symbol")).alias("symbol"))
    return calls.join(best, ["file_path", "line"], "left")


def import_map(edges: DataFrame) -> DataFrame:
    """(source_file, name, target_file) of resolved imports, by their whole name and, but for wildcards, its last part; of equal names in
    a file the last row by id holds."""
    rows = edges.filter(F.col("edge_type").isin("import", "static_import", "wildcard_import") & F.col("target_file").isNotNull() & (F.coalesce("metadata", F.lit("")) != ""))
    short = F.regexp_extract("metadata", r"([^.]+)$", 1)
    names = F.array_distinct(F.when(short == "*", F.array("metadata")).otherwise(F.array(F.col("metadata"), short)))
    return rows.select("id", "source_file", "target_file", F.explode(names).alias("name")).groupBy("source_file", "name").agg(F.max_by("target_file", "id").alias("target_file"))


def symbol_table(symbols: DataFrame, codebase: str) -> DataFrame:
    """(name, entries) of one codebase: where each name is defined, in order of place."""
    entry = F.struct("file_path", "start_line", "end_line", "kind")
    return symbols.filter(F.col("codebase") == codebase).groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def store_dependencies(edges: DataFrame, found: DataFrame, codebase: str, edge_type: str) -> DataFrame:
    """All edges, a codebase's dependencies of that type replaced by the ones now found."""
    return without_dependencies(edges, codebase, edge_type).unionByName(found.filter(F.col("edge_type") == edge_type), allowMissingColumns=True)


def normal_path(path: Column) -> Column:
    """Without `.` and `..` segments; null where it would climb out of the repository."""
    step = lambda a, s: F.when(a.isNull() | (s == "") | (s == "."), a).when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


CONFIG = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def path_aliases(configs: DataFrame) -> DataFrame:
    """(pattern, nth, base, target, at) of the path aliases in the repository's own tsconfig.json, in their order."""
    rows = configs.filter(F.col("file_path") == "tsconfig.json").select(F.from_json("content", CONFIG)["compilerOptions"].alias("o")).filter("o.paths is not null")
    each = rows.select(F.coalesce("o.baseUrl", F.lit("")).alias("base"), F.posexplode(F.map_entries("o.paths")).alias("nth", "e"))
    return each.select("base", "nth", F.col("e.key").alias("pattern"), F.posexplode("e.value").alias("at", "target"))


SOURCE_ROOT = r"^(?:(.*)/)?src/main/(java|kotlin)/(.+)\.(java|kt)$"


def import_candidates(files: DataFrame, imports: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """imports (source_file, name, language) to (source_file, name, target_file): each way a name can be a file is a candidate
    path with a priority, joined to the files there are.

    Java and Kotlin: below every src/main/java and src/main/kotlin of the repository, then src/, then its top; the class, or the class
    whose member is named. Python: from the top where a setup file says so, then src/. TypeScript: relative paths, aliases
    of `configs` (file_path, content of tsconfig.json; the first pattern that fits decides), else `@/` as src/; then extensions and index files."""
    there = files.select("file_path")
    name = F.col("name")
    dotted = F.replace(F.regexp_replace(name, r"[.*]+$", ""), F.lit("."), F.lit("/"))
    cut = F.regexp_replace(dotted, "/[^/]+$", "")

    # Files by the name they would be imported by: the roots come from the files themselves.
    jvm = imports.filter(F.col("language").isin("java", "kotlin"))
    in_root = F.regexp_extract("file_path", SOURCE_ROOT, 2) != ""
    kind = lambda c: F.when(c == "java", 0).otherwise(1)
    rooted = there.filter(in_root).select("file_path", F.regexp_extract("file_path", SOURCE_ROOT, 3).alias("stem"), kind(F.regexp_extract("file_path", SOURCE_ROOT, 2)).alias("r"), F.regexp_extract("file_path", SOURCE_ROOT, 1).alias("root"), F.regexp_extract("file_path", SOURCE_ROOT, 4).alias("ext"))
    plain = there.filter(F.col("file_path").rlike(r"\.(?:java|kt)$")).select("file_path", F.regexp_replace("file_path", r"\.(?:java|kt)$", "").alias("whole"), F.regexp_extract("file_path", r"\.(java|kt)$", 1).alias("ext"))
    loose = plain.select("file_path", F.explode(F.array(F.struct(F.lit(3).alias("r"), F.col("whole").alias("stem")), F.struct(F.lit(2).alias("r"), F.when(F.col("whole").startswith("src/"), F.substr("whole", F.lit(5))).alias("stem")))).alias("x"), "ext").select("file_path", "x.stem", "x.r", F.lit("").alias("root"), "ext").filter("stem is not null")
    stems = F.array_distinct(F.array(dotted, cut))
    asked = jvm.select("source_file", "name", F.posexplode(stems).alias("member", "stem"))
    found = asked.join(rooted.unionByName(loose), "stem").select("source_file", "name", F.col("file_path").alias("target_file"), F.struct("r", "root", "member", (F.col("ext") != "java").cast("int").alias("e"), F.col("file_path").alias("f")).alias("p"))
    got = found.groupBy("source_file", "name").agg(F.min_by("target_file", "p").alias("target_file"))

    python = imports.filter((F.col("language") == "python") & ~name.startswith("."))
    setup = not there.filter(F.col("file_path").isin("setup.py", "pyproject.toml")).isEmpty()
    ways = [F.concat(F.lit(r), x, F.lit(e)) for r in (("", "src/") if setup else ("src/",)) for x, e in ((dotted, ".py"), (dotted, "/__init__.py"), (cut, ".py"), (cut, "/__init__.py"))]
    candidates = python.select("source_file", "name", F.posexplode(F.array(*ways)).alias("p", "target_file"))

    script = imports.filter(F.col("language") == "typescript")
    near = script.filter(name.rlike(r"^\.\.?/")).select("source_file", "name", F.lit(0).alias("at"), F.concat_ws("/", T.directory(F.col("source_file")), name).alias("base"))
    rest = script.filter(~name.startswith("."))
    home = rest.filter(name.startswith("@/")).select("source_file", "name", F.lit(0).alias("at"), F.concat(F.lit("src/"), F.substr("name", F.lit(3))).alias("base"))
    bases = near
    if configs is None:
        bases = bases.unionByName(home)
    else:
        rules = path_aliases(configs)
        star = F.col("pattern").endswith("/*")
        rules = rules.withColumns({"star": star, "head": F.regexp_replace("pattern", r"/\*$", "")})
        parts = F.split("name", "/")
        heads = rest.select("source_file", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("head"), (n < F.size(parts)).alias("star")))).alias("h")).select("source_file", "name", "h.head", "h.star")
        fits = materialise(heads.join(rules, ["head", "star"]), "aliases")
        first = fits.groupBy("source_file", "name").agg(F.min("nth").alias("nth"))
        tail = F.when(F.col("star"), F.substr("name", F.length("head") + 2)).otherwise(F.lit(""))
        to = F.concat_ws("/", F.nullif(F.col("base"), F.lit("")), F.regexp_replace("target", r"/\*$", ""), F.nullif(tail, F.lit("")))
        fits = fits.join(first, ["source_file", "name", "nth"]).filter(~F.col("star") | F.col("target").endswith("/*"))
        bases = bases.unionByName(fits.select("source_file", "name", "at", to.alias("base"))).unionByName(home.join(first, ["source_file", "name"], "left_anti"))
    base = normal_path(F.col("base"))
    probes = F.array(F.when(base.rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)$"), base), *(F.concat(base, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")))
    tried = bases.select("source_file", "name", "at", F.posexplode(probes).alias("q", "target_file")).select("source_file", "name", (F.col("at") * 100 + F.col("q")).alias("p"), "target_file")
    both = candidates.unionByName(tried).filter("target_file is not null").join(there.select(F.col("file_path").alias("target_file")), "target_file")
    return got.unionByName(both.groupBy("source_file", "name").agg(F.min_by("target_file", "p").alias("target_file")))
