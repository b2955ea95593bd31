"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates adapt to how often a feature is seen; the L1 term keeps all but the telling
coordinates at zero, so the model that is sent to the executors is a short sorted list of weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashing import scramble, word_hashes

#: Letters and digits of any script, lower-cased by str.lower.
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class FtrlParams:
    """max_train_rows bounds the labelled rows that the model is fitted on; scoring has no bounds."""

    bits: int = 22
    skips: tuple[int, ...] = (2, 3)
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    positive_weight: float = 1.0
    epochs: int = 4
    max_train_rows: int = 12_000
    seed: int = 6


def features(text: str | None, p: FtrlParams) -> np.ndarray:
    """Distinct hashed coordinates of a whole text: words, pairs of neighbours, and pairs with words skipped between."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int32)
    h = word_hashes([w.encode("utf-8", "surrogatepass") for w in words])
    parts = [scramble(h)]
    for gap in (1, *p.skips):
        if len(h) > gap:
            parts.append(scramble(h[:-gap] * np.uint64(2 * gap + 1) + scramble(h[gap:] + np.uint64(gap))))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - p.bits)).astype(np.int32))


@dataclass(frozen=True)
class FtrlModel:
    """Sorted coordinates with their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    params: FtrlParams

    def score(self, text: str | None) -> float:
        f = features(text, self.params)
        z = self.bias
        if len(f) and len(self.index):
            at = np.minimum(np.searchsorted(self.index, f), len(self.index) - 1)
            z += self.weight[at][self.index[at] == f].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[tuple[np.ndarray, int]], p: FtrlParams = FtrlParams()) -> FtrlModel:
    """FTRL-proximal over rows of coordinates and labels in a seeded order; without rows, or with one class only, the model has its bias alone."""
    size = 1 << p.bits
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    data = rows
    rng = np.random.default_rng(p.seed)

    def bias() -> float:
        return -zb / ((p.beta + np.sqrt(nb)) / p.alpha)

    for _ in range(p.epochs):
        for i in rng.permutation(len(data)):
            f, y = data[i]
            zf, nf = z[f], n[f]
            root = np.sqrt(nf)
            w = np.where(np.abs(zf) <= p.l1, 0.0, -(zf - np.sign(zf) * p.l1) / ((p.beta + root) / p.alpha + p.l2))
            q = 1 / (1 + np.exp(-np.clip(w.sum() + bias(), -35, 35)))
            g = (q - y) * (p.positive_weight if y else 1.0)
            sigma = (np.sqrt(nf + g * g) - root) / p.alpha
            z[f] = zf + g - sigma * w
            n[f] = nf + g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha
            zb += g - sb * bias()
            nb += g * g
    live = np.flatnonzero(np.abs(z) > p.l1)
    w = -(z[live] - np.sign(z[live]) * p.l1) / ((p.beta + np.sqrt(n[live])) / p.alpha + p.l2)
    return FtrlModel(live, w, float(bias()), p)


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, p: FtrlParams) -> list[tuple[np.ndarray, int]]:
    """Coordinates and labels of labelled ids that are not held out: at most max_train_rows ids, the ones of the smallest hash.

    Conflicting labels of an id count as the largest of them; rows that repeat an id are taken in the order of their texts' hashes.
    """
    # an id that is labelled more than once has the larger label: toxic if any row says so
    y = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IS NOT NULL")
    y = y.groupBy("__id").agg(F.max("__y").alias("__y")).filter(~held_out("__id")).withColumn("__rank", F.xxhash64("__id", F.lit(p.seed)))
    # chosen among the narrow labels, so that the texts of chosen rows alone are sent on
    chosen = y.orderBy("__rank", "__id").limit(p.max_train_rows)
    got = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t, p) for t in b.column(1).to_pylist()], pa.list_(pa.int32())), b.column(2), b.column(3)], names=["r", "f", "y", "t"])

    found = got.select("__rank", "__text", "__y", F.xxhash64("__text")).mapInArrow(run, "r long, f array<int>, y int, t long").toArrow()
    # views of the Arrow buffers, put in order by index: the coordinates are held once
    flat: list[np.ndarray] = []
    for chunk in found.column("f").chunks:
        offsets, values = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False)
        flat += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ys = found.column("y").to_pylist()
    return [(flat[i], ys[i]) for i in np.lexsort((found.column("t").to_numpy(), found.column("r").to_numpy()))]


def score_documents(docs: DataFrame, model: FtrlModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, held_out, score, predicted).

    Null and empty texts score what the bias says; a null id is held out; repeated rows score
    alike; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t) for t in b.column(2).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: FtrlParams | None = None) -> DataFrame:
    """Fit on labelled rows outside the held-out fifth and score every document."""
    p = params or FtrlParams()
    return score_documents(docs, fit(training_rows(docs, labels, id_col, text_col, label_col, p), p), id_col, text_col)
