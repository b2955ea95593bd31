"""One small case for each mended finding of round 3."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import resolve as X
from graphloom.operators.retrieval import knn_join
from graphloom.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def copies(spark):
    """30 vectors of one label, each under 8 ids."""
    v = np.random.default_rng(4).normal(size=(30, 16)).astype(np.float32)
    rows = [(i, v[i % 30].tolist(), "d") for i in range(240)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")


def test_cross_channel_takes_the_latest_of_equal_copies_whatever_the_blocks(spark, copies):
    side = lambda p, extra: copies.select(F.concat(F.lit(p), F.col("vec_id").cast("string")).alias("name"), F.array("label").alias("source_chunks"), "embedding", *extra)
    odd = spark.createDataFrame([("e null", ["d"], None), ("e short", ["d"], [1.0]), ("e zero", ["d"], [0.0] * 16)], "name string, source_chunks array<string>, embedding array<float>")
    events, entities = side("e", []).union(odd), side("n", [F.col("vec_id").alias("pos")])
    for rows in (4096, 7):
        got = {r["event"]: r["entity"] for r in X.cross_channel_events(events, entities, 0.5, block_rows=rows).collect()}
        assert got == {f"e{i}": f"n{210 + i % 30}" for i in range(240)}


def test_candidate_pairs_rank_copies_by_name_whatever_the_blocks(copies):
    items = copies.select(F.concat(F.lit("v "), F.col("vec_id").cast("string")).alias("name"), "label", F.lit("d").alias("description"), "embedding")
    want = set()
    for i in range(240):
        twins = sorted(f"v {j}" for j in range(i % 30, 240, 30) if j != i)[:3]
        want |= {tuple(sorted((f"v {i}", t))) for t in twins}
    for rows in (2000, 11):
        got = X.candidate_pairs(items, floor=0.3, floor_bare=0.3, token_floor=2.0, top_k=3, block_rows=rows).collect()
        assert {(r["a"], r["b"]) for r in got} == want


def test_candidate_query_leaves_near_copies_to_the_verdicts(spark, tmp_path):
    import __spark_entry__ as e

    v = np.random.default_rng(5).normal(size=(12, 64))
    rows = [(i, (v[i % 12] + 0.01 * (i // 12)).astype(np.float32).tolist(), 1) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[:2] + r[3:] for r in con.execute("SELECT a, b, cosine, decision FROM (" + e.oracle_sql()["er_candidate_pairs"] + ")").fetchall()}
    assert {(r["a"], r["b"], r["decision"]) for r in e.queries()["er_candidate_pairs"](spark, str(tmp_path)).collect()} == want


def test_range_search_finds_all_of_a_large_group(copies, tmp_path):
    index = VectorIndex.build(copies, str(tmp_path / "x"), 16, cells=9)
    q = copies.filter("vec_id < 3")
    got = {(r["query_id"], r["id"]) for r in index.search_within(q, 0.95).collect()}
    assert got == {(i, j) for i in range(3) for j in range(i, 240, 30)}
    near = {(r["query_id"], r["id"]) for r in knn_join(q, copies, 240).filter("score >= 0.4").collect()}
    assert {(r["query_id"], r["id"]) for r in index.search_within(q, 0.4).collect()} == near
    with pytest.raises(ValueError):
        index.search_within(q, 0.0)


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dom_communication_stats", "er_split_events", "ev_event_timeline", "graph_neighbours", "conn_path"])
def test_reads_of_a_few_branches_do_not_store_the_graph(spark, small, name):
    import __spark_entry__ as e
    from graphloom.plans import kg

    kg._STORED.clear()
    df = e.queries()[name](spark, small)
    assert not kg._STORED
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # a relation type or label that the query does not ask for is not computed
    assert "RESOLVED_BY" not in plan and df.count() > 0


def test_walk_and_path_choose_as_before(spark):
    from graphloom.operators import graph as G
    from graphloom.plans.kg import KnowledgeGraph

    r = spark.createDataFrame(
        [("s", "b", "T", None, None), ("s", "c", "Z", None, None), ("s", "c", "A", None, None), ("b", "t", "T", None, None), ("c", "t", "T", None, None), ("t", "u", "T", None, None), ("s", "s", "T", None, None), ("s", "n", "T", "negated", None)],
        "src string, tgt string, rel_type string, polarity string, valid_to string",
    )
    e = spark.createDataFrame([(x, "L") for x in "sbctu"], "name string, label string")
    k = KnowledgeGraph(e, r, e, e, e, e, e)
    assert [tuple(map(tuple, x[:2])) + (x[2],) for x in G.shortest_path(k, "s", "u").collect()] == [(("s", "b", "t", "u"), ("T", "T", "T"), 3)]
    assert [tuple(x["rels"]) for x in G.shortest_path(k, "s", "c").collect()] == [("A",)]
    nodes, edges = G.graph_walk(k, "s", 2)
    assert [tuple(x) for x in nodes.collect()] == [("s", 0), ("b", 1), ("c", 1), ("t", 2)]
    assert len(edges.collect()) == 6


def test_similarity_is_the_same_where_sets_are_carried_and_where_they_are_joined(spark):
    from graphloom.operators import graph as G

    rng = np.random.default_rng(8)
    edges = {(f"l{i // 2}-{i}", f"r{j}") for i in range(24) for j in rng.choice(9, 3 + i % 4, replace=False)} | {("hub", f"r{j}") for j in range(9)} | {("hub2", f"r{j}") for j in range(8)}
    nb: dict[str, set[str]] = {}
    for a, b in edges:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    want = {(a, b, round(len(nb[a] & nb[b]) / len(nb[a] | nb[b]), 9)) for a in nb for b in nb if a != b and 2 * len(nb[a] & nb[b]) >= len(nb[a] | nb[b])}
    g = spark.createDataFrame([(min(e), max(e), 1.0) for e in sorted(edges)], "a string, b string, w double")
    for carried in (256, 4, 0):
        assert {(r["a"], r["b"], round(r["score"], 9)) for r in G.node_similarity(g, 100, carried=carried).collect()} == want


def test_files_of_one_language_are_written_by_several_tasks(spark):
    from graphloom.plans.search_queries import _one_a_file

    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"))
    assert _one_a_file(d, 3000).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500
