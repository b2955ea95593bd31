"""Betweenness of graphs of any size, from sampled pairs of nodes, with an error bound.

For each pair the shares of its shortest paths that go through a node are found by a search from both ends. The
searches of all pairs run together, level by level, as joins over the edge table: of each pair the end whose
frontier has fewer edges takes a step, until the frontiers meet. Then the shares go back from where they met.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranks import both_ways, numbered
from graphloom.session import discard, stored


def pairs_needed(n: int, epsilon: float, delta: float) -> int:
    """Pairs after which, with a probability of 1 - delta, no node's score is off by more than epsilon * n * (n - 1) / 2.

    A pair's share is in [0, 1], so this is Hoeffding's bound for one node, summed over n nodes.
    """
    return math.ceil(math.log(2 * max(n, 1) / delta) / (2 * epsilon * epsilon))


def _dense(names: DataFrame) -> DataFrame:
    """(id, at) with ``at`` from 0 without gaps; ids hold their partition in the upper bits."""
    part = F.shiftright("id", 33)
    ahead, offsets = 0, []
    for p, n in sorted(names.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, ahead))
        ahead += n
    # one row a partition
    lead = names.sparkSession.createDataFrame(offsets, "p long, ahead long")
    return names.withColumn("p", part).join(F.broadcast(lead), "p").select("id", (F.col("ahead") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("at"))


def sample_pairs(names: DataFrame, n: int, count: int, seed: int) -> DataFrame:
    """(pair, s, t, times): ``count`` draws of two different nodes, equal draws counted; the same for the same seed."""
    draw = lambda salt, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(m))
    x = names.sparkSession.range(count).select(draw("s", n).alias("i"), draw("t", max(n - 1, 1)).alias("j"))
    x = x.select("i", F.when(F.col("j") >= F.col("i"), F.col("j") + 1).otherwise(F.col("j")).alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("times"))
    at = _dense(names)
    x = x.join(at.select(F.col("id").alias("s"), F.col("at").alias("i")), "i").join(at.select(F.col("id").alias("t"), F.col("at").alias("j")), "j")
    return x.select(F.monotonically_increasing_id().alias("pair"), "s", "t", "times")


def sampled_betweenness(graph: DataFrame, epsilon: float = 0.05, delta: float = 0.05, seed: int = 17, max_hops: int = 64) -> DataFrame:
    """(name, score): unweighted betweenness of every node, each pair of nodes counted once.

    With a probability of 1 - delta every score is within epsilon * n * (n - 1) / 2 of the exact one. Pairs without a path
    count as nothing; loops and null ends are no edges. The number of pairs grows with the logarithm of the graph's size;
    searches of more than ``max_hops`` steps raise.
    """
    spark = graph.sparkSession
    names, edges = numbered(graph.filter("a <> b"))
    n = names.count()
    paths: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        out, path = stored(df)
        paths.append(path)
        return out

    if n < 2:
        return names.select("name", F.lit(0.0).alias("score"))
    count = pairs_needed(n, epsilon, delta)
    pairs = put(sample_pairs(names, n, count, seed))
    both = put(both_ways(edges).select("a", "b").distinct())
    deg = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    ends = pairs.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("node")), F.struct(F.lit(1).alias("side"), F.col("t").alias("node")))).alias("e"))
    row = ["pair", "side", "node", "dist", "paths", "deg"]
    last = put(ends.select("pair", "e.side", "e.node", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")).join(deg, "node").select(*row))
    seen, recent, met = last, last, None
    for _ in range(max_hops):
        # of each open pair the end with fewer edges to follow; a pair with an end that found nothing new has no path
        work = last.groupBy("pair", "side").agg(F.sum("deg").alias("work"))
        turn = work.groupBy("pair").agg(F.min(F.struct("work", "side")).alias("x"), F.count(F.lit(1)).alias("open")).filter("open = 2").select("pair", F.col("x.side").alias("side"))
        front = last.join(turn, ["pair", "side"]).select("pair", "side", F.col("node").alias("a"), "dist", "paths")
        step = front.join(both, "a").groupBy("pair", "side", F.col("b").alias("node")).agg((F.first("dist") + 1).alias("dist"), F.sum("paths").alias("paths"))
        # neighbours of a level lie in it, in the one before or in the next
        new = put(step.join(recent.select("pair", "side", "node"), ["pair", "side", "node"], "left_anti").join(deg, "node").select(*row))
        if not new.limit(1).count():
            break
        other = last.select("pair", (1 - F.col("side")).alias("side"), "node", F.col("dist").alias("dist2"), F.col("paths").alias("paths2"))
        hit = put(new.join(other, ["pair", "side", "node"]).select("pair", "side", "node", "dist", "paths", "dist2", "paths2"))
        met = hit if met is None else met.union(hit)
        done, went = hit.select("pair").distinct(), new.select("pair", "side").distinct()
        # ends that took a step have a new frontier; one that found nothing is closed, and its pair with it
        still = last.join(turn, ["pair", "side"], "left_anti").unionByName(new).join(done, "pair", "left_anti")
        recent = put(last.join(went, ["pair", "side"], "left_semi").unionByName(recent.join(went, ["pair", "side"], "left_anti")).unionByName(new).join(done, "pair", "left_anti").select(*row))
        seen = seen.unionByName(new)
        last = put(still.select(*row))
    else:
        raise RuntimeError(f"searches of more than {max_hops} steps")
    if met is None:
        return names.select("name", F.lit(0.0).alias("score"))
    total = met.groupBy("pair").agg(F.sum(F.col("paths") * F.col("paths2")).alias("all"))
    share = met.join(total, "pair").withColumn("f", F.col("paths") * F.col("paths2") / F.col("all"))
    share = put(share.select("pair", "side", "node", "dist", "paths", "dist2", "paths2", "f"))
    one = share.select("pair", "side", "node", "dist", "paths", "f")
    back = put(one.union(share.select("pair", (1 - F.col("side")).alias("side"), "node", F.col("dist2"), F.col("paths2"), "f")).filter("dist > 0"))
    through = share.filter("dist > 0 AND dist2 > 0").select("pair", "node", "f")
    levels = seen.select("pair", "side", F.col("node").alias("b"), F.col("dist").alias("d"), F.col("paths").alias("before"))
    while back.limit(1).count():
        x = back.select("pair", "side", F.col("node").alias("a"), (F.col("dist") - 1).alias("d"), (F.col("f") / F.col("paths")).alias("g"))
        x = x.join(both, "a").join(levels, ["pair", "side", "b", "d"])
        x = x.groupBy("pair", "side", F.col("b").alias("node"), F.col("d").alias("dist")).agg(F.first("before").alias("paths"), F.sum(F.col("g") * F.col("before")).alias("f"))
        back = put(x.filter("dist > 0"))
        through = through.union(back.select("pair", "node", "f"))
    score = through.join(pairs.select("pair", "times"), "pair").groupBy(F.col("node").alias("id")).agg(F.sum(F.col("f") * F.col("times")).alias("f"))
    out = stored(names.join(score, "id", "left").select("name", (F.coalesce("f", F.lit(0.0)) / F.lit(float(count)) * F.lit(n * (n - 1) / 2)).alias("score")))[0]
    discard(spark, *paths)
    return out
