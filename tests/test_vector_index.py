import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators.retrieval import knn, knn_join
from graphloom.operators.vector_index import VectorIndex

D = 16


def vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(7)
    centres = r.standard_normal((30, D))
    return (centres[r.integers(0, 30, 1500)] + 0.35 * r.standard_normal((1500, D))).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    return VectorIndex.build(vectors(spark, clustered), f"file://{tmp_path_factory.mktemp('ix')}/a", D)


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.select("query_id", "id").collect()}


def test_recall_and_rows_read(spark, clustered, index):
    v = vectors(spark, clustered)
    q = v.filter("vec_id % 50 = 0")
    want, got = pairs(knn_join(q, v)), index.search_many(q, probes=6)
    found = pairs(got)
    assert len(found & want) >= 0.95 * len(want) and len(found) == len(want)
    best = got.filter("rank = 1").select("query_id", "id", "score").collect()
    assert all(r["query_id"] == r["id"] and abs(r["score"] - 1) < 1e-6 for r in best)
    # six cells of the thirty-eight are read
    size = {r["cell"]: r["rows"] for r in index.rows_by_cell().collect()}
    assert sum(size.values()) == 1500 and sum(size.get(c, 0) for c in index.probed(clustered[0].tolist(), 6)) < 600
    plan = index.search(clustered[0].tolist(), probes=6)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan


def test_one_query_and_exact_search(spark, clustered, index):
    v = vectors(spark, clustered)
    for i in (3, 77):
        want = [tuple(r) for r in knn(v, clustered[i].tolist(), 5).collect()]
        near, exact = ([tuple(r) for r in f.collect()] for f in (index.search(clustered[i].tolist(), 5), index.search_exact(clustered[i].tolist(), 5)))
        assert [k for k, _ in exact] == [k for k, _ in want] and np.allclose([s for _, s in exact], [s for _, s in want])
        assert near[0][0] == i
    # all cells probed: codes alone may lose nothing but near ties
    assert len(pairs(index.search_many(v.limit(20), probes=99)) & pairs(knn_join(v.limit(20), v))) >= 195


def test_inserts_replace_by_key_and_failed_jobs_leave_no_trace(spark, clustered, tmp_path):
    path = f"file://{tmp_path}/b"
    index = VectorIndex.build(vectors(spark, clustered[:300]), path, D)
    moved = -clustered[5]
    assert index.insert(vectors(spark, [moved, clustered[400]], 5).withColumn("vec_id", F.when(F.col("vec_id") == 6, 1000).otherwise(F.col("vec_id")))) == 2
    got = index.search_exact(moved.tolist(), 1).collect()
    assert got[0]["key"] == 5 and got[0]["score"] == pytest.approx(1)
    assert 5 not in {r["key"] for r in index.search_exact(clustered[5].tolist(), 3).collect()}
    # a job that wrote vectors but no mark
    index._placed(vectors(spark, [clustered[7]], 9000).select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))).withColumn("gen", F.lit(3)).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    again = VectorIndex(spark, path)
    assert 9000 not in {r["key"] for r in again.search_exact(clustered[7].tolist(), 5).collect()}
    assert again.delete(vectors(spark, [clustered[0]], 1000)) == 4
    assert again._alive(None).count() == 300
    whole = again.compact(f"file://{tmp_path}/c")
    assert {r["key"] for r in whole._alive(None).collect()} == set(range(300)) and whole.search_exact(moved.tolist(), 1).first()["key"] == 5


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, f"file://{tmp_path}/d", 2)
    assert [tuple(r) for r in index.search_exact([2.0, 0.0], 5).collect()] == [(1, 1.0), (6, 1.0), (5, 0.0)]
    empty = VectorIndex.build(df.limit(0), f"file://{tmp_path}/e", 2)
    assert empty.search_many(df, probes=3).count() == 0
    empty.insert(df)
    assert empty.search_many(df, probes=3).count() == 9
