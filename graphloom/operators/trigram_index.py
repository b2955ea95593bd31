"""A stored trigram index over names: substring and similarity search that read a few posting lists instead of all names.

A posting list says in which names a trigram stands and how many trigrams each of them has, in blocks of names that lie together.
A name whose similarity to a query is s shares at least s * (the query's trigrams) of them, and its score follows from the number
that it shares and its own number, so the lists alone rank; only the names of the answer are read. A substring of three characters and
more stands only in names that hold all of its trigrams: those are a superset of the answer, and they are compared.

A block's lists are made where its names lie, so single postings are never shuffled; in a list, a place in the block takes two bytes, and
a run of neighbours (names are sorted, so they share most of their trigrams) takes two places. A name's number of trigrams lies with the name.

Layout: ``names`` (id, name, label, low, size) sorted by id, ``postings/bucket=`` (gram, label, block, runs, at) sorted by gram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S

#: Names of a block (its places fit in two bytes), partitions of the lists, blocks of a file of lists, about, and ids that a search names to the scan.
BLOCK_NAMES, BUCKETS, FILE_BLOCKS, MOST_LITERALS = 16_384, 64, 2048, 1000
_LISTS = "gram string, label string, block long, runs boolean, at array<short>"


def substring_grams(low):
    """All different runs of three characters of a lower-case text."""
    n = F.length(low)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, grams) in the order of the ids as the lists of each batch: a batch is a piece of a block, or of a few."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        labels = pc.fill_null(batch.column(1), "\0").dictionary_encode()
        grams, row = batch.column(2).flatten(), pc.list_parent_indices(batch.column(2)).to_numpy()
        if not len(row):
            continue
        words = grams.dictionary_encode()
        blocks = ids // BLOCK_NAMES
        own = blocks - blocks.min()
        group = (own[row] * len(labels.dictionary) + labels.indices.to_numpy()[row]) * len(words.dictionary) + words.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        g, at = group[order], (ids - blocks * BLOCK_NAMES)[row][order]
        heads = np.flatnonzero(np.diff(g, prepend=-1))
        ends = np.append(heads[1:], len(g))
        # a run goes on while neither the list nor the row of places breaks
        first = np.ones(len(g), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(g) != 0)
        upto = np.concatenate([[0], np.cumsum(first)])
        n_runs, n = upto[ends] - upto[heads], ends - heads
        runs = 2 * n_runs < n
        run_at, run_end = at[first], at[np.append(np.flatnonzero(first)[1:], len(g)) - 1]
        pairs = np.stack([run_at, run_end], axis=1).ravel()
        # both forms lie one after the other; each list takes its own
        both = np.concatenate([at, pairs]).astype(np.int16)
        start, size = np.where(runs, len(at) + 2 * upto[heads], heads), np.where(runs, 2 * n_runs, n)
        offsets = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(both[take], pa.int16()))
        head = g[heads]
        word, rest = head % len(words.dictionary), head // len(words.dictionary)
        label = labels.dictionary.take(pa.array(rest % len(labels.dictionary)))
        label = pc.if_else(pc.equal(label, "\0"), pa.scalar(None, pa.string()), label)
        out = [words.dictionary.take(pa.array(word)), label, pa.array(rest // len(labels.dictionary) + blocks.min(), pa.int64()), pa.array(runs), lists]
        yield pa.RecordBatch.from_arrays(out, ["gram", "label", "block", "runs", "at"])


class TrigramIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, entities: DataFrame, path: str) -> TrigramIndex:
        """Of (name, label); null names are left out, a repeated pair counts once."""
        index = cls(entities.sparkSession, path)
        e = entities.select("name", "label").filter("name IS NOT NULL").distinct().orderBy("name", "label")
        e.select(F.monotonically_increasing_id().alias("id"), "name", "label", F.lower("name").alias("low"), F.size(S.trigrams(F.col("name"))).alias("size")).write.parquet(f"{index.path}/names")
        # ids hold their partition in the upper bits, so a block is a run of one partition
        part = index._names().select("id", "label", S.trigrams(F.col("name")).alias("similar"), substring_grams(F.col("low")).alias("inside"))
        # padded trigrams serve similarity, plain ones substrings; a mark tells them apart
        marked = F.concat(F.transform("similar", lambda g: F.concat(F.lit("~"), g)), F.transform("inside", lambda g: F.concat(F.lit("="), g)))
        lists = part.select("id", "label", marked.alias("grams")).mapInArrow(_lists, _LISTS)
        lists = lists.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        # lists of so many blocks share a file, so a file does not grow with the names
        files = -(-index._names().count() // (BLOCK_NAMES * FILE_BLOCKS)) or 1
        spread = lists.repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64("block"), F.lit(files)))
        spread.sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{index.path}/postings")
        return index

    def _names(self) -> DataFrame:
        return self._spark.read.schema("id long, name string, label string, low string, size int").parquet(f"{self.path}/names")

    def _one(self, value) -> list[str]:
        return self._spark.range(1).select(value).first()[0] or []

    def candidates(self, grams: list[str], least: int, label: str | None = None) -> DataFrame:
        """(id, shared, size) of the names that hold at least ``least`` of the grams; from the lists alone."""
        buckets = [r[0] for r in self._spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(BUCKETS))).distinct().collect()]
        lists = self._spark.read.schema(f"{_LISTS}, bucket int").parquet(f"{self.path}/postings")
        lists = lists.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        lists = lists if label is None else lists.filter(F.col("label") == label)
        pairs = F.transform(F.filter("at", lambda x, i: i % 2 == 0), lambda x, i: F.sequence(x, F.get("at", 2 * i + 1)))
        places = F.when(F.col("runs"), F.flatten(pairs)).otherwise(F.col("at"))
        each = lists.select("block", F.explode(places).alias("at")).groupBy((F.col("block") * BLOCK_NAMES + F.col("at")).alias("id"))
        # a name's lists have the same gram once, whatever batches its block came in
        found = each.agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
        return found.join(self._names().select("id", "size"), "id")

    def similar(self, query: str, least: float = 0.3, label: str | None = None, limit: int = 20) -> DataFrame:
        """(name, label, score) of the names with a trigram similarity of ``least`` (above 0) or more, best first, then by name."""
        grams = self._one(S.trigrams(F.lit(query)))
        if not grams or limit < 1:
            return self._names().select("name", "label", F.lit(0.0).alias("score")).limit(0)
        # |a & b| >= least * |a | b| >= least * |query|
        need = max(1, math.ceil(least * len(grams) - 1e-9))
        score = F.col("shared") / (F.col("size") + F.lit(len(grams)) - F.col("shared"))
        near = self.candidates([f"~{g}" for g in grams], need, label).select("id", score.alias("score")).filter(F.col("score") >= least)
        # the last score of the answer; names that tie with it are told apart by name
        top = near.orderBy(F.desc("score")).limit(limit).collect()
        if len(top) == limit:
            near = near.filter(F.col("score") >= top[-1]["score"])
        rows = near.limit(MOST_LITERALS + 1).collect()
        names = self._names()
        if len(rows) <= MOST_LITERALS:
            # sorted by id, so the scan passes over row groups
            names = names.filter(F.col("id").isin([r["id"] for r in rows]))
            near = self._spark.createDataFrame(rows, near.schema)
        return names.join(near, "id").select("name", "label", "score").orderBy(F.desc("score"), "name", "label").limit(limit)

    def containing(self, part: str, label: str | None = None, limit: int = 20) -> DataFrame:
        """(name, label, score) of the names that hold ``part``, without case, by trigram similarity to it, then by name.

        A part of fewer than three characters has no trigram of its own, so all names are read.
        """
        low = part.lower()
        names = self._names() if label is None else self._names().filter(F.col("label") == label)
        if grams := self._one(substring_grams(F.lit(low))):
            names = names.join(self.candidates([f"={g}" for g in grams], len(grams), label).select("id"), "id", "left_semi")
        hit = names.filter(F.contains(F.col("low"), F.lit(low)))
        return hit.select("name", "label", S.trigram_similarity(F.col("name"), F.lit(part)).alias("score")).orderBy(F.desc("score"), "name", "label").limit(limit)
