"""Whole-graph algorithms as iterations of joins over an edge table."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.betweenness import sampled_betweenness  # noqa: F401
from graphloom.operators.components import component_counts, connected_components  # noqa: F401
from graphloom.operators.leiden import communities  # noqa: F401
from graphloom.operators.ranks import both_ways, eigenvector, pagerank  # noqa: F401
from graphloom.plans.kg import KnowledgeGraph
from graphloom.session import reliable_checkpoint


def build_graph(relations: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: undirected, parallel edges summed, self-loops dropped, a missing weight is 1."""
    return (
        relations.filter("src <> tgt")
        .groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"))
        .agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
    )


def components(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, component); nodes without edges are components of their own."""
    c = connected_components(graph).withColumnRenamed("node", "name")
    if nodes is None:
        return c
    return nodes.select("name").distinct().join(c, "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def component_sizes(comps: DataFrame) -> DataFrame:
    """Count and size distribution of (name, component) or (component, size); percentiles by nearest rank, round(q * (n - 1))."""
    sizes = comps if "size" in comps.columns else comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # sizes are counted by value first: the histogram is short, however many components there are
    hist = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("upto", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy()))
    pick = lambda q: F.min(F.when(F.col("upto") > F.bround(q * (F.col("n") - 1)), F.col("size")))
    return h.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("components"), F.min("size").alias("min"), F.max("size").alias("max"),
        (F.sum(F.col("size") * F.col("k")) / F.sum("k")).alias("mean"), pick(0.5).alias("p50"), pick(0.9).alias("p90"), pick(0.99).alias("p99"),
    )


def shortest_path(kg: KnowledgeGraph, source: str, target: str, max_hops: int = 6) -> DataFrame:
    """(path, rels, hops) of one shortest undirected path of at most max_hops (1 to 12) edges; the smallest by names on ties.

    No row if there is none; [source] and 0 hops from a node to itself.
    """
    spark = kg.relations.sparkSession
    max_hops = min(max(max_hops, 1), 12)
    schema = "path array<string>, rels array<string>, hops int"
    if source == target:
        known = kg.entities.filter(F.col("name") == source).limit(1)
        return known.select(F.array("name").alias("path"), F.array().cast("array<string>").alias("rels"), F.lit(0).alias("hops"))
    # a frontier node keeps the smallest path alone, so of parallel edges the one of the first type
    step = kg.undirected.filter("a <> b").select("a", "b", F.col("rel_type").alias("rel"))
    seen = spark.createDataFrame([(source,)], "name string")
    front = spark.createDataFrame([(source, [source], [])], "name string, path array<string>, rels array<string>")
    for hop in range(1, max_hops + 1):
        # the filter on the source reaches the tables of each relation type
        near = step.filter(F.col("a") == source) if hop == 1 else step
        nxt = front.join(near, F.col("name") == F.col("a")).select(F.col("b").alias("name"), F.concat("path", F.array("b")).alias("path"), F.concat("rels", F.array("rel")).alias("rels"))
        nxt = nxt.join(seen, "name", "left_anti").groupBy("name").agg(F.min(F.struct("path", "rels")).alias("p")).select("name", "p.path", "p.rels")
        front = reliable_checkpoint(nxt)
        hit = front.filter(F.col("name") == target)
        if hit.limit(1).count():
            return hit.select("path", "rels", F.lit(hop).alias("hops"))
        if not front.limit(1).count():
            break
        seen = reliable_checkpoint(seen.union(front.select("name")))
    return spark.createDataFrame([], schema)


def graph_walk(
    kg: KnowledgeGraph, start: str | list[str], hops: int = 2, rel_types: list[str] | None = None, now: str | None = None, max_nodes: int = 50, max_edges: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Entities (name, hop) and live relations (src, rel, tgt) around a start (or several), nearest first, then by name.

    Negated edges and, given ``now``, edges whose validity has ended (compared at the precision of the bound) are not walked.
    """
    e = kg.undirected.filter(S.live(F.col("polarity")))
    if rel_types:
        e = e.filter(F.col("rel_type").isin(rel_types))
    if now is not None:
        e = e.filter(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(now).substr(F.lit(1), F.length("valid_to"))))
    spark = kg.relations.sparkSession
    starts = [start] if isinstance(start, str) else list(dict.fromkeys(start))
    nodes = spark.createDataFrame([(x, 0) for x in starts], "name string, hop int")
    # at most max_nodes names a hop: named in the filter, they reach the tables of each relation type
    front, known = starts, list(starts)
    for hop in range(1, min(max(hops, 1), 3) + 1):
        reached = e.filter(F.col("a").isin(front) & ~F.col("b").isin(known)).select(F.col("b").alias("name")).distinct()
        front = [r[0] for r in reached.orderBy("name").limit(max_nodes).collect()]
        nodes = nodes.union(spark.createDataFrame([(x, hop) for x in front], nodes.schema))
        known += front
        if not front:
            break
    nodes = nodes.orderBy("hop", "name").limit(max_nodes)
    inside = e.filter(F.col("a").isin(known) & F.col("b").isin(known))
    inside = inside.join(nodes.select(F.col("name").alias("a"), F.col("hop").alias("h")), "a").join(nodes.select(F.col("name").alias("b")), "b", "left_semi")
    edges = inside.groupBy(F.least("a", "b").alias("src"), F.col("rel_type").alias("rel"), F.greatest("a", "b").alias("tgt")).agg(F.min("h").alias("h"))
    return nodes, edges.orderBy("h", "src", "rel", "tgt").limit(max_edges).drop("h")


def degree_stats(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, and the mean, median, 99th percentile and maximum of the degree (nodes without edges count)."""
    d = both_ways(graph).groupBy(F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("d"))
    all_d = nodes.select("name").distinct().join(d, "name", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return all_d.agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.avg("d").alias("avg_degree"), F.percentile("d", F.lit(0.5)).alias("p50"),
        F.percentile("d", F.lit(0.99)).alias("p99"), F.max("d").alias("max_degree"),
    )


#: Sets of at most so many neighbours travel with their prefix and are compared where they meet.
CARRIED_SET = 256


def node_similarity(graph: DataFrame, top_k: int = 10, cutoff: float = 0.5, carried: int = CARRIED_SET) -> DataFrame:
    """(a, b, score): Jaccard similarity of neighbour sets, for each node the top_k others at or above the cutoff.

    Pairs come from shared neighbours. Sets whose sizes differ too much cannot reach the cutoff, and a pair
    above it must share one of the rarer neighbours of each (prefix filter), so hubs do not pair
    all their neighbours; the exact similarity is then taken from the whole sets: of sets of up to ``carried`` neighbours where they
    meet, so that pairs below the cutoff are never shuffled, of larger ones by joins. All of this runs on
    64-bit hashes of the names, which come back at the end.
    """
    g = reliable_checkpoint(graph.select("a", "b").filter("a <> b").distinct())
    hashed = g.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    both = hashed.union(hashed.select("b", "a"))
    freq = both.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("freq"))
    sets = both.join(freq, "b").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("freq", "b"))).alias("s"))
    # a set's rarest neighbours first; beyond the prefix a pair cannot first meet
    sets = reliable_checkpoint(sets.select("a", F.size("s").alias("d"), F.transform("s", lambda x: x["b"]).alias("nb")))
    keep = (F.col("d") - F.ceil(F.lit(cutoff) * F.col("d")) + 1).cast("int")
    # without its set where that is large
    prefix = sets.select("a", "d", F.when(F.col("d") <= carried, F.col("nb")).alias("nb"), F.posexplode(F.slice("nb", F.lit(1), keep)).alias("pos", "b"))
    side = lambda c: prefix.select(F.col("a").alias(c), "b", F.col("d").alias(f"d{c}"), F.col("pos").alias(f"pos{c}"), F.col("nb").alias(f"n{c}"))
    # the overlap that the cutoff asks for, a little less for rounding; where two sets first meet, what is left of them bounds it
    need = F.lit(cutoff / (1 + cutoff)) * (F.col("dx") + F.col("dy")) - 1e-6
    near = (F.least("dx", "dy") >= cutoff * F.greatest("dx", "dy")) & (F.least(F.col("dx") - F.col("posx"), F.col("dy") - F.col("posy")) >= need) & (F.col("x") < F.col("y"))
    met = side("x").join(side("y"), "b").filter(near)
    inter = F.array_intersect("nx", "ny")
    jaccard = F.size(inter) / (F.size("nx") + F.size("ny") - F.size(inter))
    # a pair counts at the first neighbour that the two share
    small = met.filter(F.coalesce(F.size(inter) >= need, F.lit(False))).filter(F.get(inter, F.lit(0)) == F.col("b")).select("x", "y", jaccard.alias("score"))
    large = met.filter((F.col("dx") > carried) | (F.col("dy") > carried)).select("x", "y").distinct()
    large = large.join(sets.select(F.col("a").alias("x"), F.col("nb").alias("nx")), "x").join(sets.select(F.col("a").alias("y"), F.col("nb").alias("ny")), "y").select("x", "y", jaccard.alias("score"))
    s = reliable_checkpoint(small.union(large).filter(F.col("score") >= cutoff))
    # names of the nodes of the result alone
    ends = g.select(F.explode(F.array("a", "b")).alias("n")).withColumn("h", F.xxhash64("n"))
    named = ends.join(s.select(F.explode(F.array("x", "y")).alias("h")).distinct(), "h", "left_semi").distinct()
    s = s.join(named.select(F.col("h").alias("x"), F.col("n").alias("p")), "x").join(named.select(F.col("h").alias("y"), F.col("n").alias("q")), "y").select("p", "q", "score")
    each = s.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.struct(F.col("q").alias("a"), F.col("p").alias("b")))).alias("e"), "score").select("e.a", "e.b", "score")
    top = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return each.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= top_k).drop("k")


def _csr(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, neighbours and weights by node."""
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order], w[order]


def _steps_by_level(s: int, starts: np.ndarray, nbrs: np.ndarray, dist: np.ndarray, sigma: np.ndarray) -> tuple[list, np.ndarray]:
    """Shortest-path steps (from, to) level by level, paths counted in sigma; and the nodes reached."""
    dist[s], sigma[s] = 0, 1.0
    front, levels, seen, d = np.array([s]), [], [np.array([s])], 0
    while len(front):
        lo, k = starts[front], starts[front + 1] - starts[front]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        u, v = np.repeat(front, k), nbrs[at]
        d += 1
        new = np.unique(v[dist[v] < 0])
        dist[new] = d
        on = dist[v] == d
        u, v = u[on], v[on]
        np.add.at(sigma, v, sigma[u])
        levels.append((u, v))
        seen.append(new)
        front = new
    return levels, np.concatenate(seen)


def _steps_by_distance(s: int, starts: np.ndarray, nbrs: np.ndarray, w: np.ndarray, dist: np.ndarray, sigma: np.ndarray) -> tuple[list, np.ndarray]:
    """The same for weights as distances, one step list a settled node, in the order of settling."""
    dist[s], sigma[s] = 0.0, 1.0
    heap, settled, preds, order = [(0.0, s)], set(), {s: []}, []
    while heap:
        d, u = heapq.heappop(heap)
        if u in settled:
            continue
        settled.add(u)
        order.append(u)
        sigma[u] = 1.0 if u == s else sum(sigma[p] for p in preds[u])
        for i in range(starts[u], starts[u + 1]):
            v, far = int(nbrs[i]), d + w[i]
            known = dist[v]
            if known < 0 or far < known - 1e-12 * max(1.0, known):
                dist[v], preds[v] = far, [u]
                heapq.heappush(heap, (far, v))
            elif abs(far - known) <= 1e-12 * max(1.0, known) and v not in settled:
                preds[v].append(u)
    return [(np.array(preds[v], np.int64), np.full(len(preds[v]), v)) for v in order if v != s], np.array(order)


def _folded(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one neighbour folded into it, again and again: each node's root, the nodes that it stands for (itself included), the sum of
    the squares of the branches folded into it, and which edges are left. Folding ends early where a round takes next to none, as along a path; any part of it is exact.
    """
    parent, r, squares, left = np.arange(n), np.ones(n), np.zeros(n), np.ones(len(a), bool)
    deg = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    while True:
        one_a, one_b = left & (deg[a] == 1), left & (deg[b] == 1)
        # of two that have only each other the second goes
        child, to = np.concatenate([b[one_b], a[one_a & ~one_b]]), np.concatenate([a[one_b], b[one_a & ~one_b]])
        if not len(child):
            break
        parent[child] = to
        np.add.at(r, to, r[child])
        np.add.at(squares, to, r[child] ** 2)
        left &= ~(one_a | one_b)
        deg[child] = 0
        np.subtract.at(deg, to, 1)
        if len(child) * 10_000 < left.sum():
            break
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent, r, squares, left
        parent = up


def betweenness(graph: DataFrame, max_edges: int = 2_000_000, sources: int | None = None, weighted: bool = False) -> DataFrame:
    """(name, score): betweenness by Brandes' accumulation, sources dealt over the tasks; with ``weighted``, weights are distances.

    Nodes of one neighbour are folded into it first (:func:`_folded`) and searches begin at the others alone, each standing for what was folded
    into it; the pairs that have an end among the folded follow from their numbers.

    The adjacency goes to every task, so its size is checked: beyond max_edges this raises; :func:`sampled_betweenness` has
    no such bound. ``sources`` takes a part of the sources (a deterministic choice by hash, scores scaled up; nothing is folded then).
    """
    n_edges = graph.limit(max_edges + 1).count()
    if n_edges > max_edges:
        raise ValueError(f"more than {max_edges} edges: too many to send to every task")
    spark = graph.sparkSession
    pairs = graph.select("a", "b", F.col("w").cast("double").alias("w")).toPandas()
    codes, names = pd.factorize(pd.concat([pairs["a"], pairs["b"]], ignore_index=True))
    n = len(names)
    if not n:
        return graph.select(F.col("a").alias("name"), F.lit(0.0).alias("score")).limit(0)
    a, b, w = codes[: len(pairs)], codes[len(pairs) :], pairs["w"].to_numpy()
    chosen = sources is not None and sources < n
    root, r, squares, left = (np.arange(n), np.ones(n), np.zeros(n), np.ones(len(a), bool)) if chosen else _folded(a, b, n)
    # the rest is numbered anew
    core = np.flatnonzero(root == np.arange(n))
    m = len(core)
    at = np.full(n, -1)
    at[core] = np.arange(m)
    a, b, w = at[a[left]], at[b[left]], w[left]
    shared = spark.sparkContext.broadcast((*_csr(np.concatenate([a, b]), np.concatenate([b, a]), np.tile(w, 2), m), r[core]))
    src = spark.range(m).withColumnRenamed("id", "s")
    if chosen:
        src = src.orderBy(F.xxhash64("s")).limit(sources)
    scale = n / sources if chosen else 1.0

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, nbrs, w, r = shared.value
        total, dist, sigma, delta = np.zeros(m), np.full(m, -1.0), np.zeros(m), np.zeros(m)
        for pdf in it:
            reach = []
            for s in pdf["s"]:
                steps, seen = _steps_by_distance(s, starts, nbrs, w, dist, sigma) if weighted else _steps_by_level(s, starts, nbrs, dist, sigma)
                for u, v in reversed(steps):
                    np.add.at(delta, u, sigma[u] / sigma[v] * (r[v] + delta[v]))
                delta[s] = 0.0
                total[seen] += r[s] * delta[seen]
                reach.append(r[seen].sum())
                # only what was touched is wiped, so many small components cost little
                dist[seen], sigma[seen], delta[seen] = -1.0, 0.0, 0.0
            yield pd.DataFrame({"i": pdf["s"], "v": 0.0, "reach": reach})
        live = np.flatnonzero(total)
        yield pd.DataFrame({"i": live, "v": total[live], "reach": 0.0})

    parts = max(1, min(m // 64 + 1, 8 * spark.sparkContext.defaultParallelism))
    got = src.repartition(parts).mapInPandas(run, "i long, v double, reach double").groupBy("i").agg((F.sum("v") / 2 * scale).alias("v"), F.max("reach").alias("reach"))
    known = pd.DataFrame({"i": at[root], "name": np.asarray(names, dtype=object), "r": r, "squares": squares, "folded": root != np.arange(n)})
    named = spark.createDataFrame(known, "i long, name string, r double, squares double, folded boolean").join(got, "i", "left")
    # pairs of different branches of a folded node, the rest of its component being one; of a root's branches, and of those with the rest
    inside = ((F.col("reach") - 1) ** 2 - F.col("squares") - (F.col("reach") - F.col("r")) ** 2) / 2
    outside = ((F.col("r") - 1) ** 2 - F.col("squares")) / 2 + F.when(F.col("r") > 1, (F.col("r") - 1) * (F.col("reach") - F.col("r"))).otherwise(0.0)
    return named.select("name", F.when(F.col("folded"), inside).otherwise(F.coalesce("v", F.lit(0.0)) + outside).alias("score"))


def betweenness_of_any_size(graph: DataFrame, max_edges: int = 200_000, epsilon: float = 0.02) -> DataFrame:
    """Exact, with weights as distances, up to ``max_edges`` edges; beyond, from sampled pairs, where every edge is one step.

    The scores of the two are not comparable with each other where weights differ; those of one graph are.
    """
    if graph.limit(max_edges + 1).count() <= max_edges:
        return betweenness(graph, weighted=True)
    return sampled_betweenness(graph, epsilon)


def community_levels(members: DataFrame, min_size: int = 3) -> tuple[DataFrame, DataFrame]:
    """From (name, ids finest to coarsest): communities (id, level, member_count, members_hash; level 0 the coarsest) and parents."""
    each = members.select("name", F.posexplode(F.reverse("ids")).alias("level", "cid"), "ids")
    c = each.groupBy(F.col("cid").alias("id"), "level").agg(F.count(F.lit(1)).alias("member_count"), S.members_hash(F.collect_list("name")).alias("members_hash"))
    parent = members.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ids")), lambda i: F.struct((F.size("ids") - i).alias("level"), F.get("ids", i - 1).alias("child_id"), F.get("ids", i).alias("parent_id")))).alias("x")).select("x.*").filter("parent_id IS NOT NULL").distinct()
    return c.filter(F.col("member_count") >= min_size), parent


def modularity(graph: DataFrame, label: DataFrame, gamma: float = 1.0) -> float:
    """Of a partition (name, label)."""
    m = graph.agg(F.sum("w")).first()[0] or 1.0
    l = label.select("name", "label")
    inside = graph.join(l.select(F.col("name").alias("a"), F.col("label").alias("la")), "a").join(l.select(F.col("name").alias("b"), F.col("label").alias("lb")), "b").filter("la = lb").agg(F.sum("w")).first()[0] or 0.0
    deg = both_ways(graph).join(l, F.col("a") == F.col("name")).groupBy("label").agg(F.sum("w").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    return inside / m - gamma * deg / (4 * m * m) if not math.isnan(m) else 0.0
