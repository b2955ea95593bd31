"""Benchmark decontamination by SimHash over item-sized windows.

Items and windows are fingerprinted over weighted shingles. Fingerprints are cut into blocks, and an
index of every block's neighbourhood finds all items within the Hamming radius (pigeonhole: of so
many differing bits, some block holds at most ``flips``). Candidates are verified by the weighted
Jaccard similarity of their shingles. Windows that cannot reach the threshold, because they hold too few
shingles of any item, are not fingerprinted; that bound is exact and loses nothing.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashing import scramble, shingle_hashes, word_hashes
from graphloom.session import reliable_checkpoint

_WORD = re.compile(r"[^\W_]+")
_GATE_BITS = 20


@dataclass(frozen=True)
class LeakParams:
    """blocks of 16 bits make a fingerprint; the index holds all block values within ``flips`` bits, so every
    fingerprint within blocks * (flips + 1) - 1 bits is found. items_per_pass bounds what a pass over the
    documents carries; a larger benchmark takes more passes. Shingle weights are those of the whole benchmark,
    so the number of passes changes no result.
    """

    shingle: int = 5
    threshold: float = 0.8
    blocks: int = 16
    flips: int = 3
    items_per_pass: int = 1000

    @property
    def radius(self) -> int:
        return self.blocks * (self.flips + 1) - 1


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower-cased."""
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall((text or "").lower())]


def _bits(grams: np.ndarray, blocks: int) -> np.ndarray:
    """+1 or -1 for each gram and bit."""
    steps = np.arange(1, blocks // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lanes = [scramble(grams + step) for step in steps]
    raw = np.stack(lanes, axis=1).view(np.uint8)
    return np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class LeakIndex:
    """Items with their shingle weights and the neighbourhood index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]], p: LeakParams, n_items: int | None = None, common: dict[int, int] | None = None):
        """``n_items`` and ``common`` tell how many items the whole benchmark has and in how many of them
        shingles stand that more than one has; without them ``items`` are the whole benchmark."""
        self.p = p
        kept = [(i, h) for i, h in ((i, word_hashes(words_of(t))) for i, t in items) if len(h)]
        self.ids = [i for i, _ in kept]
        self.length = np.array([len(h) for _, h in kept], np.int64)
        grams = [shingle_hashes(h, p.shingle) for _, h in kept]
        df = Counter(g for x in grams for g in np.unique(x).tolist())
        if n_items is not None:
            df = {g: (common or {}).get(g, 1) for g in df}
        # rare shingles weigh more; one that no item has weighs as the rarest
        n_all = len(kept) if n_items is None else n_items
        weigh = lambda c: float(np.log1p((1 + n_all) / c))
        self.top = weigh(1)
        self.table = np.array(sorted(df), np.uint64)
        self.table_weight = np.array([weigh(df[g]) for g in self.table.tolist()])
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[(self.table >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
        self.counts = [Counter(x.tolist()) for x in grams]
        w = dict(zip(self.table.tolist(), self.table_weight.tolist(), strict=True))
        self.weight = w
        self.total = np.array([sum(w[g] * c for g, c in x.items()) for x in self.counts])
        #: fewest shingles that hold threshold times the item's weight
        self.least = []
        for x, total in zip(self.counts, self.total, strict=True):
            run, k = 0.0, 0
            for v in sorted((w[g] for g, c in x.items() for _ in range(c)), reverse=True):
                run, k = run + v, k + 1
                if run >= p.threshold * total - 1e-9:
                    break
            self.least.append(k)
        self.by_length: dict[int, np.ndarray] = {int(n): np.flatnonzero(self.length == n) for n in np.unique(self.length)}
        if kept:
            self.prints = np.concatenate([_pack((_bits(g, p.blocks) * self._weights(g)[:, None]).sum(axis=0)[None]) for g in grams])
            self._index()

    def _weights(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.table, grams), max(len(self.table) - 1, 0))
        return np.where(self.table[at] == grams, self.table_weight[at], self.top)

    def _index(self) -> None:
        masks = [sum(1 << b for b in c) for k in range(self.p.flips + 1) for c in itertools.combinations(range(16), k)]
        masks = np.array(masks, np.uint16)
        self.posts = []
        for b in range(self.p.blocks):
            values = (self.prints[:, b, None] ^ masks).ravel()
            order = np.argsort(values, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=65536))])
            self.posts.append((starts, (order // len(masks)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint the items within the radius."""
        out = []
        for fp in prints:
            c = np.unique(np.concatenate([post[starts[v] : starts[v + 1]] for v, (starts, post) in zip(fp.tolist(), self.posts, strict=True)]))
            away = np.unpackbits((self.prints[c] ^ fp).view(np.uint8), axis=1).sum(axis=1, dtype=np.int64)
            out.append(c[away <= self.p.radius])
        return out

    def matches(self, text: str | None) -> dict[int, tuple[float, int]]:
        """item -> (similarity, first word) of its most similar window, of those at or above the threshold."""
        found: dict[int, tuple[float, int]] = {}
        if not self.ids:
            return found
        h = word_hashes(words_of(text))
        for k in sorted({min(self.p.shingle, n) for n in self.by_length}):
            if len(h) < k:
                continue
            g = shingle_hashes(h, k)
            maybe = np.flatnonzero(self.gate[(g >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.table, g[maybe]), len(self.table) - 1)
                maybe = maybe[self.table[at] == g[maybe]]
            if len(maybe):
                self._windows(g, maybe, k, found)
        return found

    def _windows(self, g: np.ndarray, hits: np.ndarray, k: int, found: dict) -> None:
        p = self.p
        hit = np.zeros(len(g) + 1, np.int64)
        hit[hits + 1] = 1
        upto = np.cumsum(hit)
        have = set(g[hits].tolist())
        for n, members in self.by_length.items():
            if min(p.shingle, n) != k:
                continue
            size = n - k + 1
            # a document shorter than the item is one window
            width = min(size, len(g))
            live = [t for t in members if sum(c for x, c in self.counts[t].items() if x in have) >= self.least[t]]
            if not live:
                continue
            inside = upto[width:] - upto[: len(g) - width + 1]
            starts = np.flatnonzero(inside >= min(self.least[t] for t in live))
            live = set(live)
            for lo in range(0, len(starts), 256):
                part = starts[lo : lo + 256]
                a, b = part[0], part[-1] + width
                wb = _bits(g[a:b], p.blocks) * self._weights(g[a:b])[:, None]
                sums = np.concatenate([np.zeros((1, wb.shape[1])), np.cumsum(wb, axis=0)])
                prints = _pack(sums[part - a + width] - sums[part - a])
                for s, near in zip(part.tolist(), self.near(prints), strict=True):
                    for t in near.tolist():
                        if t in live:
                            sim = self.similarity(t, g[s : s + width])
                            if sim >= p.threshold - 1e-9 and sim > found.get(t, (0.0, 0))[0]:
                                found[t] = (sim, s)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item's and a window's shingles, with multiplicity."""
        mine, other = self.counts[item], Counter(window.tolist())
        w, top = self.weight, self.top
        both = sum(w[x] * min(c, other.get(x, 0)) for x, c in mine.items())
        theirs = sum(w.get(x, top) * c for x, c in other.items())
        return both / (self.total[item] + theirs - both)


_INDEXES: dict = {}


def _index_of(block: tuple, p: LeakParams) -> LeakIndex:
    """Built once in each worker process."""
    key = (hash(block), p)
    if key not in _INDEXES:
        _INDEXES.clear()
        n_items, items = block
        _INDEXES[key] = LeakIndex([(i, t) for i, t, _ in items], p, n_items, {g: c for *_, common in items for g, c in common})
    return _INDEXES[key]


def _shingles_of_items(p: LeakParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = []
            for t in b.column(1).to_pylist():
                h = word_hashes(words_of(t))
                grams.append(np.unique(shingle_hashes(h, p.shingle)).view(np.int64) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grams, pa.list_(pa.int64()))], names=["item", "text", "grams"])

    return run


def _passes(benchmark: DataFrame, item_col: str, text_col: str, p: LeakParams) -> Iterator[tuple]:
    """The items in blocks of a bounded number, (items with words in all, ((id, text, ((shingle, items that have it), ...)), ...));
    the benchmark is the stated query set and is small beside the documents. Rows equal in id and text are one item."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    rows = reliable_checkpoint(rows.mapInArrow(_shingles_of_items(p), "item long, text string, grams array<long>"))
    n_items = rows.filter(F.size("grams") > 0).count()
    each = rows.select("item", "text", F.explode("grams").alias("gram"))
    common = each.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = each.join(common, "gram").groupBy("item", "text").agg(F.sort_array(F.collect_list(F.struct("gram", "c"))).alias("shared"))
    shared = shared.select(F.col("item").alias("i"), F.col("text").alias("t"), "shared")
    met = rows.join(shared, F.col("item").eqNullSafe(F.col("i")) & F.col("text").eqNullSafe(F.col("t")), "left")
    block = []
    for i, t, common_grams in met.select("item", "text", "shared").orderBy("item", "text").toLocalIterator():
        block.append((i, t, tuple((g & 0xFFFFFFFFFFFFFFFF, c) for g, c in common_grams or ())))
        if len(block) == p.items_per_pass:
            yield n_items, tuple(block)
            block = []
    if block:
        yield n_items, tuple(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: LeakParams | None = None) -> DataFrame:
    """One row per document and item found in it: (doc id, item id, similarity, first_word of the best window).

    Null and empty texts hold and leak nothing; an item of fewer words than a shingle is one shingle; null ids
    and repeated rows of documents pass through; items of equal id and text are one, others are found each by
    itself; empty tables give an empty result. Texts are searched whole; other columns are not read.
    """
    p = params or LeakParams()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def search(items: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(items, p)
            for b in batches:
                at, item, sim, first = [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for t, (s, w) in sorted(index.matches(text).items()):
                        at.append(i), item.append(index.ids[t]), sim.append(round(s, 9)), first.append(w)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int32())), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(first, pa.int64())],
                    names=["id", "item", "similarity", "first_word"],
                )

        return run

    schema = f"id {kind}, item long, similarity double, first_word long"
    parts = [rows.mapInArrow(search(items), schema) for items in _passes(benchmark, item_col, item_text_col, p)]
    out = parts[0] if parts else rows.limit(0).mapInArrow(search((0, ())), schema)
    for x in parts[1:]:
        out = out.union(x)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: LeakParams | None = None) -> DataFrame:
    """``docs`` without the documents that hold an item, own columns only; edge cases as in :func:`find_leaks`.

    Rows are filtered where they are read, so nothing is shuffled and ids need not be unique.
    """
    p = params or LeakParams()

    def clean(items: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(items, p)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    at = docs.columns.index(text_col)
    for items in _passes(benchmark, item_col, item_text_col, p):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
