import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import text_index as T
from graphloom.operators.retrieval import bm25
from graphloom.operators.trigram_index import TrigramIndex

WORDS = ["graph", "node", "edge", "licence", "rights", "заказ", "tree", "x1", "leaf", "root", "very", "common"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(WORDS, weights=[1, 1, 1, 2, 2, 1, 3, 4, 5, 6, 40, 60], k=r.choice((0, 3, 30, 120)))).capitalize() + r.choice(("", ".", "\n!"))) for i in range(600)]
    return spark.createDataFrame([*rows, (9000, None), (9001, "licence licence licence"), (9002, "LICENCE rights")], "doc_id long, text string")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return T.TextIndex.build(docs, f"file://{tmp_path_factory.mktemp('tx')}/a", slot_docs=20)


@pytest.mark.parametrize("query", ["licence rights", "common", "Заказ, graph!", "nothing here", "very common licence", ""])
def test_same_answers_as_a_scan(docs, index, query):
    want = [tuple(r) for r in bm25(docs, query, 7).collect()] if query else []
    got = [tuple(r) for r in index.search(query, 7).collect()]
    assert [d for d, _ in got] == [d for d, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_blocks_are_passed_over_and_bounds_hold(docs, index):
    q = "licence common"
    bound = {r["slot"]: r["bound"] for r in index.bounds(q).collect()}
    slots = max(bound) + 1
    each = bm25(docs, q, 10_000).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)))
    assert all(r["score"] <= bound[r["slot"]] + 1e-9 for r in each.collect())
    # two of about thirty slots hold the short texts that win
    least = index.threshold(q, 1)
    assert 0 < sum(b >= least for b in bound.values()) < slots / 2
    plan = index.search(q)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_names_by_rank(spark, tmp_path):
    e = spark.createDataFrame([("North Sea Trading", "Organization"), ("Sea", "Location"), ("Sea", "Organization"), ("Trading House", "Organization"), ("Other", "Person")], "name string, label string")
    index = T.TextIndex.build(e.select("name").distinct(), f"file://{tmp_path}/n", "name", "name")
    got = [tuple(r)[:2] for r in T.find_by_name_ranked(index, e, "sea trading", 10).collect()]
    assert got == [("North Sea Trading", "Organization"), ("Sea", "Location"), ("Sea", "Organization"), ("Trading House", "Organization")]
    empty = T.TextIndex.build(e.limit(0), f"file://{tmp_path}/e", "name", "name")
    assert empty.search("sea").count() == 0


@pytest.fixture(scope="module")
def names(spark):
    r = random.Random(8)
    parts = ["nord", "süd", "trade", "trading", "haus", "Иван", "ltd", "42", "o'neill", "ab"]
    rows = [(" ".join(r.choices(parts, k=r.randint(1, 3))), r.choice(("Organization", "Person"))) for _ in range(300)]
    return spark.createDataFrame([*rows, (None, "Person"), ("", "Person"), ("!!", "Person"), ("Trading", "Person"), ("trading", "Person")], "name string, label string")


@pytest.fixture(scope="module")
def grams(names, tmp_path_factory):
    return TrigramIndex.build(names, f"file://{tmp_path_factory.mktemp('tg')}/a")


@pytest.mark.parametrize(("query", "least", "label"), [("nord trading", 0.3, None), ("tradin", 0.5, "Person"), ("иван 42", 0.3, None), ("zzz", 0.3, None), ("!!", 0.3, None)])
def test_similar_names_as_by_a_scan(names, grams, query, least, label):
    e = names.filter("name IS NOT NULL").distinct()
    e = e if label is None else e.filter(F.col("label") == label)
    want = e.withColumn("score", S.trigram_similarity(F.col("name"), F.lit(query))).filter(F.col("score") >= least).orderBy(F.desc("score"), "name", "label").limit(12)
    assert [tuple(r) for r in grams.similar(query, least, label, 12).collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("part", ["trad", "D TR", "o'ne", "ва", "zzzz", "ding"])
def test_names_with_a_part_as_by_a_scan(names, grams, part):
    want = names.distinct().filter(F.contains(F.lower("name"), F.lit(part.lower()))).withColumn("score", S.trigram_similarity(F.col("name"), F.lit(part))).orderBy(F.desc("score"), "name", "label").limit(15)
    assert [tuple(r) for r in grams.containing(part, limit=15).collect()] == [tuple(r) for r in want.collect()]
    assert grams.candidates(["=zzz"], 1).count() == 0
