"""Stored postings for ranked full-text search: BM25 without reading the texts, and without most of the postings.

Documents are dealt to slots by a hash of their id. A posting block holds the documents of one slot that have one term, with
their counts and lengths, and a head of fixed width: the number of documents and the largest part of a score that one of them gets from the term.
A search reads the heads of its terms, ranks a few slots of the highest bound fully for a threshold, and then reads only
blocks of slots whose bound reaches it. The bound of a slot is at least the score of each of its documents, so
nothing that belongs to the best k is passed over.

Layout: ``postings/bucket=`` (term, slot, n, peak, ids, counts, lens) sorted by term, ``totals`` (docs, words, k1, b).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.retrieval import tokens

#: Documents of a slot, about; partitions by the terms' hash; slots whose blocks share a file; slots that are ranked for the threshold.
SLOT_DOCS, BUCKETS, FILE_SLOTS, LEAD_SLOTS = 512, 64, 32_768, 8


def _part(count, length, avg: float, k1: float, b: float):
    """What a term adds to a score, but for its weight."""
    return count * (k1 + 1) / (count + k1 * (1 - b + b * length / F.lit(avg)))


def _blocks_of(batches: Iterator[pa.RecordBatch], avg: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(id, slot, words) in the order of the slots as posting blocks. A slot that is cut by the end of a batch has several blocks a term: its bound is then
    the sum of theirs, which is a bound still."""
    for batch in batches:
        row, words = pc.list_parent_indices(batch.column(2)).to_numpy(), batch.column(2).flatten().dictionary_encode()
        if not len(row):
            continue
        slot, lens = batch.column(1).to_numpy().astype(np.int64), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        n_words = len(words.dictionary)
        pair, count = np.unique(row.astype(np.int64) * n_words + words.indices.to_numpy(), return_counts=True)
        row, word = pair // n_words, pair % n_words
        order = np.lexsort((row, word, slot[row]))
        row, word, count = row[order], word[order], count[order]
        heads = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(slot[row]) != 0)))
        offsets = pa.array(np.append(heads, len(row)), pa.int32())
        length = lens[row].astype(np.float64)
        peak = np.maximum.reduceat(count * (k1 + 1) / (count + k1 * (1 - b + b * length / avg)), heads)
        a_list = lambda x: pa.ListArray.from_arrays(offsets, x)
        yield pa.RecordBatch.from_arrays(
            [
                words.dictionary.take(pa.array(word[heads])), pa.array(slot[row[heads]], pa.int32()), pa.array(np.diff(np.append(heads, len(row))), pa.int32()), pa.array(peak),
                a_list(batch.column(0).take(pa.array(row))), a_list(pa.array(count, pa.int32())), a_list(pa.array(lens[row], pa.int32())),
            ],
            ["term", "slot", "n", "peak", "ids", "counts", "lens"],
        )


class TextIndex:
    """Postings in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        kind = spark.read.parquet(f"{self.path}/totals").first()
        self.docs, self._avg, self._k1, self._b = kind["docs"], kind["words"] / kind["docs"] if kind["docs"] else 1.0, kind["k1"], kind["b"]
        self._schema = f"term string, slot int, n int, peak double, ids array<{kind['id_type']}>, counts array<int>, lens array<int>, bucket int"

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slot_docs: int = SLOT_DOCS, k1: float = 1.2, b: float = 0.75) -> TextIndex:
        """Writes the postings of all documents. Ids are unique; rows with a null id are left out; null texts have no words but count as documents."""
        spark, path = docs.sparkSession, path.rstrip("/")
        d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).filter("id IS NOT NULL").withColumn("len", F.size("t"))
        n, words = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        spark.createDataFrame([(n, words, float(k1), float(b), dict(d.dtypes)["id"])], "docs long, words long, k1 double, b double, id_type string").write.parquet(f"{path}/totals")
        slots = max(1, -(-n // slot_docs))
        # the hash spreads even a word of every document over all slots; only the texts move, words are counted where their slot lies
        placed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL").withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int"))
        placed = placed.repartition("slot").sortWithinPartitions("slot").select("id", "slot", tokens(F.col("text")).alias("t"))
        kind = f"term string, slot int, n int, peak double, ids array<{dict(d.dtypes)['id']}>, counts array<int>, lens array<int>"
        avg = words / n if n else 1.0
        block = placed.mapInArrow(lambda it: _blocks_of(it, avg, k1, b), kind).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        # blocks of so many slots share a file, sorted by term, so a file does not grow with the documents and its statistics tell terms apart
        files = -(-slots // FILE_SLOTS)
        spread = block.repartition(BUCKETS * files, "bucket", F.pmod("slot", F.lit(files)))
        spread.sortWithinPartitions("bucket", "term", "slot").write.partitionBy("bucket").parquet(f"{path}/postings")
        return cls(spark, path)

    def _blocks(self, terms: list[str]) -> DataFrame:
        # the few partitions of the terms, named to the scan
        buckets = [r[0] for r in self._spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS))).distinct().collect()]
        return self._spark.read.schema(self._schema).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def _weights(self, blocks: DataFrame):
        """A column of a term's weight, from the numbers of documents in the heads."""
        # one row a term of the query
        found = blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()
        pairs = [x for t, df in found for x in (F.lit(t), F.log(1 + (F.lit(float(self.docs)) - F.lit(float(df)) + 0.5) / (F.lit(float(df)) + 0.5)))]
        return F.try_element_at(F.create_map(*pairs), F.col("term")) if pairs else F.lit(0.0)

    def _ranked(self, blocks: DataFrame, weight, k: int) -> DataFrame:
        each = blocks.select(weight.alias("w"), F.explode(F.arrays_zip("ids", "counts", "lens")).alias("p"))
        score = F.sum(F.col("w") * _part(F.col("p.counts"), F.col("p.lens"), self._avg, self._k1, self._b))
        return each.groupBy(F.col("p.ids").alias("id")).agg(score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)

    def bounds(self, query: str) -> DataFrame:
        """(slot, bound, blocks): no document of the slot scores more than the bound."""
        blocks = self._blocks(query_terms(query) or [""]).select("term", "slot", "n", "peak")
        w = self._weights(blocks)
        return blocks.groupBy("slot").agg(F.sum(w * F.col("peak")).alias("bound"), F.count(F.lit(1)).alias("blocks"))

    def threshold(self, query: str, k: int = 10) -> float:
        """A score that k documents reach (0 if the slots looked at hold fewer)."""
        blocks = self._blocks(query_terms(query) or [""])
        lead = [r["slot"] for r in self.bounds(query).orderBy(F.desc("bound"), "slot").limit(LEAD_SLOTS).collect()]
        first = self._ranked(blocks.filter(F.col("slot").isin(lead)), self._weights(blocks), k).collect()
        return first[-1]["score"] if len(first) == k else 0.0

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(id, score) of the k best documents; ties by id. The words of the query count once each."""
        terms = query_terms(query)
        if not terms or not self.docs or k < 1:
            return self._ranked(self._blocks([""]), F.lit(0.0), max(k, 0))
        # sums of the same parts in another order may differ in the last digits
        least = self.threshold(query, k) * (1 - 1e-9)
        live = self.bounds(query).filter(F.col("bound") >= least).select("slot")
        blocks = self._blocks(terms)
        return self._ranked(blocks.join(live, "slot", "left_semi"), self._weights(blocks), k)


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.lower())))


def find_by_name_ranked(index: TextIndex, entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(name, label, score): entities whose names share a word with the query, by full-text rank. The index is over the names."""
    hits = index.search(query, limit)
    # at most ``limit`` hits; a name with several labels has a row for each
    return entities.select("name", "label").distinct().join(F.broadcast(hits.withColumnRenamed("id", "name")), "name").select("name", "label", "score").orderBy(F.desc("score"), "name", "label").limit(limit)
