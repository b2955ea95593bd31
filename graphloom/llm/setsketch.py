"""Near-duplicate groups by SetSketch registers.

A sketch holds, for each of m hash functions, the smallest exponential variate of the set's elements,
truncated to a power of ``base``: registers of a union are the elementwise maxima, and equal registers are
as likely as sets are alike. Bands of register values nominate candidates; candidates come together
in groups, where the Jaccard similarity is first estimated from all registers and both
cardinalities by maximum likelihood and then confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, clear_of
from graphloom.llm.hashing import scramble, shingle_hashes, word_hashes
from graphloom.operators.components import connected_components
from graphloom.session import reliable_checkpoint


@dataclass(frozen=True)
class SketchParams:
    """A link: threshold_pct * |union| <= 100 * |intersection| of the sets of ``shingle`` words.

    bands * band_size registers. A pair at the threshold of 85 is missed by all 25 bands of 5 registers
    with a probability of 4e-7. A pair whose likelihood estimate is more than ``margin`` (over six standard
    deviations) below the threshold is not compared in full. A task compares groups of up to
    ``task_shingles``. In a larger group all members are first compared with a few leaders (``star_rounds``),
    which is linear in the group; what is then not joined yet is compared within each band value, in pairs
    of parts where one is still too large. Whatever the size, the pairs that share a band are linked, and no others.
    """

    shingle: int = 5
    threshold_pct: int = 80
    bands: int = 25
    band_size: int = 5
    base: float = 1.001
    rate: float = 20.0
    margin: float = 0.22
    task_shingles: int = 1_000_000
    star_rounds: int = 2

    @property
    def m(self) -> int:
        return self.bands * self.band_size


def _constants(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = scramble(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:m], seeds[m:] | np.uint64(1)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z are lower-cased, words are runs of non-white-space."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), k)) if text else np.empty(0, np.uint64)


def registers(elements: np.ndarray, p: SketchParams) -> np.ndarray:
    """The sketch of a set; of the empty set, zeros."""
    if not len(elements):
        return np.zeros(p.m, np.uint16)
    xor, mul = _constants(p.m)
    low = np.full(p.m, np.iinfo(np.uint64).max)
    for i in range(0, len(elements), 512):
        v = elements[i : i + 512, None] ^ xor
        v *= mul
        np.minimum(low, v.min(axis=0), out=low)
    # the smallest uniform value is the smallest exponential one after a monotone map
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / p.rate
    return np.clip(np.floor(1 - np.log(x) / math.log(p.base)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate_jaccard(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray, p: SketchParams, steps: int = 64) -> np.ndarray:
    """Maximum-likelihood similarity of one sketch to each of others, given the cardinalities."""
    more = (one > others).sum(axis=1)[:, None]
    less = (one < others).sum(axis=1)[:, None]
    same = p.m - more - less
    u = (n_one / (n_one + n_others))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * (np.arange(steps + 1) / steps)
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (p.base - 1) / p.base) / math.log(p.base)
    up, down = prob(u - v * j), prob(v - u * j)
    eq = np.clip(1 - up - down, 1e-12, 1)
    like = more * np.log(np.clip(up, 1e-12, 1)) + less * np.log(np.clip(down, 1e-12, 1)) + same * np.log(eq)
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], 1)[:, 0]


def band_keys(regs: np.ndarray, p: SketchParams) -> np.ndarray:
    """One 64-bit key a band for each row of registers; keys of different bands differ."""
    k = regs.astype(np.uint64).reshape(len(regs), p.bands, p.band_size)
    acc = np.tile(np.arange(1, p.bands + 1, dtype=np.uint64), (len(regs), 1))
    for c in range(p.band_size):
        acc = scramble(acc * np.uint64(65599) + k[:, :, c])
    return acc


def _sketch_batches(p: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, p.shingle)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64)))
                h2.append(int(np.bitwise_xor.reduce(scramble(s + np.uint64(1)))) if len(s) else 0)
                bands.append(band_keys(registers(s, p)[None], p)[0].view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "t", "n", "h1", "h2", "bands"],
            )

    return run


def link_group(ids: np.ndarray, sets: list[np.ndarray], part: np.ndarray | None, p: SketchParams, known: np.ndarray | None = None) -> np.ndarray:
    """For each member the smallest id of its component, over all pairs that share a band (and are of different parts, if parts are given).

    ``known`` is the component that a member belongs to already. Pairs already in one component need
    no comparison, so a group around a common original costs about one comparison a member.
    """
    s = len(ids)
    comp = (ids if known is None else known).copy()
    if s < 2:
        return comp
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, inv = np.unique(flat, return_inverse=True)
    ends = np.cumsum(n)
    starts = ends - n
    regs = np.stack([registers(x, p) for x in sets])
    keys = band_keys(regs, p)
    # most central first: agreement with the commonest value of each register
    if s > 2:
        agree = np.zeros(s, np.int64)
        for c in range(p.m):
            vals, back, cnt = np.unique(regs[:, c], return_inverse=True, return_counts=True)
            agree += cnt[back]
        order = np.argsort(-agree, kind="stable")
    else:
        order = np.arange(s)
    flag = np.zeros(inv.max() + 1, bool)
    low = p.threshold_pct / 100 - p.margin
    todo = np.ones(s, bool)
    for i in order:
        todo[i] = False
        cand = todo & (comp != comp[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * p.threshold_pct)
        if part is not None:
            cand &= part != part[i]
        c = np.flatnonzero(cand)
        c = c[(keys[c] == keys[i]).any(axis=1)]
        if not len(c):
            continue
        c = c[estimate_jaccard(regs[i], n[i], regs[c], n[c], p) >= low]
        if not len(c):
            continue
        own = inv[starts[i] : ends[i]]
        flag[own] = True
        if len(c) * 4 > s:
            inter = np.add.reduceat(flag[inv].astype(np.int64), starts)[c]
        else:
            inter = np.array([np.count_nonzero(flag[inv[starts[j] : ends[j]]]) for j in c])
        flag[own] = False
        for j in c[100 * inter >= p.threshold_pct * (n[i] + n[c] - inter)]:
            a, b = comp[i], comp[j]
            if a != b:
                comp[comp == max(a, b)] = min(a, b)
    return comp


def _link_groups(p: SketchParams):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cross = key[1] != key[2]
        out = []
        for _, g in pdf.groupby("grp", sort=False):
            sets = [shingle_set(t, p.shingle) for t in g["text"]]
            known = g["comp"].to_numpy()
            comp = link_group(g["node"].to_numpy(), sets, g["part"].to_numpy() if cross else None, p, known)
            out.append(pd.DataFrame({"a": known, "b": comp})[known != comp].drop_duplicates())
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return run


def _link_stars(p: SketchParams):
    """Compares the members of a star with its leader alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lead, g in pdf.groupby("lead", sort=False):
            first = g["node"].to_numpy() == lead
            own = shingle_set(g["text"][first].iloc[0], p.shingle)
            for node, text in zip(g["node"][~first], g["text"][~first], strict=True):
                s = shingle_set(text, p.shingle)
                inter = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * inter >= p.threshold_pct * (len(own) + len(s) - inter):
                    out.append((node, lead))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _joined(big: DataFrame, links: DataFrame) -> DataFrame:
    """``big`` with the component of each node under these links as ``comp``."""
    comps = connected_components(links)
    return reliable_checkpoint(big.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))


def _open_cells(big: DataFrame) -> DataFrame:
    """(cell, node, n, comp) of the band values that hold nodes of two components or more."""
    cells = big.select("node", "n", "comp", F.explode("cells").alias("cell"))
    still = cells.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("total")).filter("lo <> hi")
    return cells.join(still.select("cell", "total"), "cell")


def _links_of_large_groups(big: DataFrame, texts: DataFrame, p: SketchParams) -> DataFrame:
    """Links among ``big`` (node, n, h1, h2, cells), members of groups beyond ``task_shingles``; ``texts`` is (h1, h2, text), one row a set."""
    big = reliable_checkpoint(big.withColumn("comp", F.col("node")))
    links = None
    for r in range(p.star_rounds):
        open_ = _open_cells(big)
        leads = open_.groupBy("cell").agg(F.min_by("node", F.xxhash64("node", F.lit(r))).alias("lead"), F.min_by("comp", F.xxhash64("node", F.lit(r))).alias("lead_comp"))
        # every node meets one leader a round
        met = open_.join(leads, "cell").filter("comp <> lead_comp").groupBy("node").agg(F.min_by("lead", F.xxhash64("lead", F.lit(r))).alias("lead"), F.first("n").alias("n"))
        met = reliable_checkpoint(met)
        size = met.groupBy("lead").agg(F.ceil(F.sum("n") / p.task_shingles).cast("int").alias("parts"))
        rows = met.join(size, "lead").select("node", "lead", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
        heads = size.select(F.col("lead").alias("node"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        with_text = rows.union(heads).join(big.select("node", "h1", "h2"), "node").join(texts, ["h1", "h2"])
        found = reliable_checkpoint(with_text.groupBy("lead", "part").applyInPandas(_link_stars(p), "a long, b long"))
        links = found if links is None else links.union(found)
        big = _joined(big, links)
    open_ = reliable_checkpoint(_open_cells(big).withColumn("parts", F.ceil(F.col("total") / p.task_shingles).cast("int")))
    placed = open_.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = placed.join(big.select("node", "h1", "h2"), "node").join(texts, ["h1", "h2"]).select(
        "node", "text", "comp", F.col("cell").alias("grp"), "part", F.col("cell").alias("bin"), F.least("part", "with").alias("p1"), F.greatest("part", "with").alias("p2")
    )
    found = met.groupBy("bin", "p1", "p2").applyInPandas(_link_groups(p), "a long, b long")
    return found if links is None else links.union(found)


def _set_classes(docs: DataFrame, id_col: str, text_col: str, p: SketchParams) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, t, n, h1, h2), t being the text's hash; and of the sets in which something is to merge
    (h1, h2, comp, least), comp naming the class and ``least`` being the smallest id in it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).cast("binary").alias("text"))
    sketched = reliable_checkpoint(rows.mapInArrow(_sketch_batches(p), "id long, t long, n long, h1 long, h2 long, bands array<long>"))
    # equal sets collapse before anything is compared
    classes = (
        sketched.filter("n > 0").groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.min_by("t", F.struct(F.col("id").isNull(), "id", "t")).alias("rep_t"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    classes = reliable_checkpoint(classes)
    # a set is named by its smallest id; where that names two sets (repeated ids) or none (null ids), by its hash
    twice = classes.filter("rep IS NOT NULL").groupBy("rep").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("rep")
    n_twice = twice.count()
    own = F.coalesce("rep", F.xxhash64("h1", "h2"))
    if n_twice:
        t = twice.withColumn("twice", F.lit(True))
        classes = classes.join(F.broadcast(t) if n_twice <= BROADCAST_ROWS else t, "rep", "left")
        own = F.when(F.col("twice"), F.xxhash64("h1", "h2")).otherwise(own)
    classes = classes.withColumn("node", own)
    cells = classes.select("node", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").select("cell", "lead")
    stars = cells.join(shared, "cell").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    groups = connected_components(stars).withColumnRenamed("component", "grp")
    sized = reliable_checkpoint(classes.join(groups, "node").select("node", "rep", "rep_t", "n", "h1", "h2", "bands", "grp"))
    totals = sized.groupBy("grp").agg(F.sum("n").alias("total"))
    t = totals.agg(F.sum(F.when(F.col("total") <= p.task_shingles, F.col("total"))).alias("small"), F.sum((F.col("total") > p.task_shingles).cast("int")).alias("large")).first()
    bins = max(1, math.ceil((t["small"] or 0) / (p.task_shingles / 2)))
    members = sized.join(totals, "grp")
    n_members = sized.count()
    # one text a set: that of its first row
    key = members.select("h1", "h2", "rep", "rep_t", "node", "grp", "total")
    wanted = F.broadcast(key) if n_members <= BROADCAST_ROWS else key
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("t") == F.col("rep_t")))
    small = texts.filter(F.col("total") <= p.task_shingles).dropDuplicates(["node"])
    met = small.select("node", "text", F.col("node").alias("comp"), F.lit(0).alias("part"), "grp", F.pmod(F.xxhash64("grp"), F.lit(bins)).alias("bin"), F.lit(0).alias("p1"), F.lit(0).alias("p2"))
    links = met.groupBy("bin", "p1", "p2").applyInPandas(_link_groups(p), "a long, b long")
    if t["large"]:
        big = members.filter(F.col("total") > p.task_shingles).withColumnRenamed("bands", "cells").select("node", "n", "h1", "h2", "cells")
        large = reliable_checkpoint(texts.filter(F.col("total") > p.task_shingles).dropDuplicates(["node"]).select("h1", "h2", "text"))
        links = links.union(_links_of_large_groups(big, large, p))
    comps = connected_components(links)
    named = reliable_checkpoint(
        classes.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).filter("copies > 1 OR component IS NOT NULL").select("h1", "h2", "rep", "comp")
    )
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    return sketched.select("id", "t", "n", "h1", "h2"), named.drop("rep").join(least, "comp")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SketchParams | None = None) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept), ids being integers.

    Null and empty texts, and texts without words, have no shingles and link to nothing. Texts with equal
    shingle sets are one node, whatever their number; rows that repeat an id are classed by their
    own texts. Rows with null ids take part: their component is the smallest id in reach, null if there is none, and
    they are kept only in the latter case. An empty table gives an empty result. Only the id and text columns are read.
    """
    p = params or SketchParams()
    sketched, named = _set_classes(docs, id_col, text_col, p)
    every = sketched.join(named.select("h1", "h2", "least"), ["h1", "h2"], "left")
    comp = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    return every.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept")
    )


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SketchParams | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, own columns only: the one of the smallest id (null ids last,
    then the smallest text hash).

    Rows are told apart by id and text, so a repeated id costs no other text. Of rows that agree in both
    one stays (which of them is not defined). Rows without words belong to no class and all stay, as
    do null texts; an empty table gives an empty result.
    """
    sketched, named = _set_classes(docs, id_col, text_col, params or SketchParams())
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("t").alias("t"))
    rows = sketched.filter("n > 0").join(named.select("h1", "h2", "comp"), ["h1", "h2"]).select("comp", order.alias("key"))
    first = rows.groupBy("comp").agg(F.min("key").alias("first"))
    x = clear_of(docs, "__dup_")
    stays = f"{x}stays"
    marked = rows.join(first, "comp").groupBy("key").agg(F.first(F.col("key") == F.col("first")).alias(stays), F.count(F.lit(1)).alias("rows"))
    marked = reliable_checkpoint(marked.filter(F.expr(f"NOT `{stays}` OR rows > 1")).select(F.col("key.id").alias(f"{x}id"), F.col("key.t").alias(f"{x}t"), stays))
    n = marked.count()
    if not n:
        return docs
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({f"{x}key": F.col(id_col).cast("long"), f"{x}hash": F.xxhash64(F.col(text_col))})
    met = keyed.join(F.broadcast(marked) if n <= BROADCAST_ROWS else marked, F.col(f"{x}key").eqNullSafe(F.col(f"{x}id")) & (F.col(f"{x}hash") == F.col(f"{x}t")), "left")
    alone = met.filter(F.col(stays).isNull()).select(*names)
    if marked.filter(F.col(stays)).isEmpty():
        return alone
    return alone.union(met.filter(F.col(stays)).dropDuplicates([f"{x}key", f"{x}hash"]).select(*names))
