"""Connected components: names are contracted by blocks of edges, the rest goes through large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import reliable_checkpoint


#: Edges that one file of a round's state holds, about.
EDGES_PER_FILE = 100_000
#: Edges, and bytes, that a task contracts at a time.
BLOCK_EDGES, BLOCK_BYTES = 250_000, 64 << 20
#: Contractions of what is left of the edges before the rounds.
LEVELS = 3


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    # joined rows say b -> m; each node itself says a -> m
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest number in each one's component of the edges (x, y) of 0 to n - 1."""
    root = np.arange(n)
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        live = lo < hi
        if not live.any():
            return root
        np.minimum.at(root, hi[live], lo[live])
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = x[live], y[live]


def _contract_blocks(block_edges: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, root) of the edges of each block: the smallest name that a name reaches inside it."""

    def contract(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ends = pa.chunked_array(t.column(0).chunks + t.column(1).chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[ends.indices.to_numpy()]
        names = ends.dictionary.take(pa.array(order))
        out = pa.table([names, names.take(pa.array(_roots(code[: len(t)], code[len(t) :], len(order))))], ["node", "root"])
        yield from out.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for b in batches:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= block_edges or size >= block_bytes:
                yield from contract(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from contract(held)

    return run


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, root, prev): a node's smallest root of all blocks, without prev, and its further roots, each with the one before."""
    pairs = edges.filter("a <> b").mapInArrow(_contract_blocks(BLOCK_EDGES, BLOCK_BYTES), "node string, root string")
    seen = pairs.withColumn("prev", F.lag("root").over(Window.partitionBy("node").orderBy("root")))
    return seen.filter("prev IS NULL OR prev <> root")


def _tops(seen: DataFrame, max_rounds: int, level: int) -> DataFrame:
    """(root, component) of the roots that nodes of several blocks link to others."""
    links = seen.filter("prev IS NOT NULL").select(F.col("root").alias("a"), F.col("prev").alias("b"))
    # few links go straight to the rounds; the links of a node lie side by side, so that a block holds them all
    again = level < LEVELS and links.limit(BLOCK_EDGES + 1).count() > BLOCK_EDGES
    tops = _of_names(links, max_rounds, level + 1) if again else _by_rounds(links, max_rounds)
    return tops.withColumnRenamed("node", "root")


def _of_names(edges: DataFrame, max_rounds: int, level: int = 1) -> DataFrame:
    seen = reliable_checkpoint(_contracted(edges))
    named = seen.filter("prev IS NULL").select("node", "root").join(_tops(seen, max_rounds, level), "root", "left")
    return named.select("node", F.coalesce("component", "root").alias("component"))


def component_counts(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(component, size) of :func:`connected_components` of names, without moving the names again once they are told apart."""
    seen = reliable_checkpoint(_contracted(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))).select("root", "prev"))
    counts = seen.filter("prev IS NULL").groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(_tops(seen, max_rounds, 1), "root", "left")
    return counts.groupBy(F.coalesce("component", "root").alias("component")).agg(F.sum("n").alias("size"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component): for every node that has an edge to another, the smallest node reachable.

    Self-loops, null ends and repeated edges add nothing; nodes without another end are not returned.
    Of names, each task first contracts its edges block by block: a name moves once, with its block's smallest, and only where blocks
    share a name are their smallest ones linked. Numbers, whose rows are short, and those links go through the rounds.
    The rounds needed grow with the logarithm of the longest path; each is kept in the shared folder.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if all(kind == "string" for _, kind in edges.dtypes):
        return _of_names(edges, max_rounds)
    return _by_rounds(edges, max_rounds)


def _by_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    clean = lambda e: e.filter("a <> b").distinct()
    now = reliable_checkpoint(clean(edges))
    mark, n = None, now.count()
    for _ in range(max_rounds):
        # a round's edges lie in as many files as they need, not in one a shuffle partition
        now = reliable_checkpoint(clean(_small_star(clean(_large_star(now)))).coalesce(max(1, -(-n // EDGES_PER_FILE))))
        x = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(x) == mark:
            break
        mark, n = tuple(x), x[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
