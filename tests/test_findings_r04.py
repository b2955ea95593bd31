"""One test for each mended finding of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_a_folder_holds_a_file_a_document_and_no_folder_a_document(spark, tmp_path):
    from graphloom.plans.search_queries import _folder
    from graphloom.sources import readers, sinks

    texts = ["a\nb", "", "é\r\n", "x\x01", None, "same", "same"]
    docs = spark.createDataFrame([(i % 5, x, lang) for i, (x, lang) in enumerate(zip(texts, ["en", "en", "d/e +%", None, "en", "", ""]))], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for x, lang in docs.select("text", "lang").collect():
        n, size = want.get(lang, (0, 0))
        want[lang] = (n + 1, size + len((x or "").encode()))
    assert {r["channel"]: (r["files"], r["bytes"]) for r in _folder(spark, str(tmp_path)).collect()} == want
    # tasks put 300 files straight into their folders: none below them, and none left to be moved by the driver
    many = spark.range(300).select(F.lit("f").alias("folder"), F.col("id").cast("string").alias("text")).repartition(3)
    assert sinks.write_folder(many, f"{tmp_path}/out") == 300
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["f"] and all(p.is_file() for p in (tmp_path / "out/f").iterdir())
    assert {r["text"] for r in readers.read_folder(spark, f"{tmp_path}/out").collect()} == {str(i) for i in range(300)}


@pytest.mark.parametrize("weighted", [False, True])
def test_betweenness_searches_from_no_node_that_was_folded(spark, weighted, monkeypatch):
    from graphloom.operators import graph as G

    rng = np.random.default_rng(5)
    core = [(f"c{i}", f"c{j}") for i in range(9) for j in range(i) if rng.random() < 0.4]
    tree = [(f"t{i}", f"t{int(rng.integers(0, i))}") for i in range(1, 12)] + [("t0", "c0"), ("c1", "x"), ("c1", "y"), ("y", "z"), ("p", "q"), ("s0", "s1"), ("s0", "s2"), ("s2", "s3")]
    e = [(min(x), max(x), float(rng.integers(1, 4))) for x in core + tree]
    g = spark.createDataFrame(e, "a string, b string, w double")
    n = len({x for a, b, _ in e for x in (a, b)})
    got = {r["name"]: r["score"] for r in G.betweenness(g, weighted=weighted).collect()}
    with monkeypatch.context() as m:  # the same without folding
        m.setattr(G, "_folded", lambda a, b, n: (np.arange(n), np.ones(n), np.zeros(n), np.ones(len(a), bool)))
        want = {r["name"]: r["score"] for r in G.betweenness(g, weighted=weighted).collect()}
    assert len(got) == n and got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-9
    # a star's leaves are folded: one search is left, whatever their number
    root, r, squares, left = G._folded(np.zeros(5000, int), np.arange(1, 5001), 5001)
    assert (root == 0).all() and r[0] == 5001 and squares[0] == 5000 and not left.any()


def test_rank_messages_are_those_of_hubs_alone(spark, monkeypatch):
    from graphloom.operators import ranks

    # 4 hubs, each linked with 60 middling nodes of 10 leaves each
    edges = [(f"h{h}", f"m{m}") for h in range(4) for m in range(60)] + [(f"m{m}", f"x{m}-{i}") for m in range(60) for i in range(10)]
    names = sorted({x for e in edges for x in e})
    w = np.zeros((len(names), len(names)))
    for a, b in edges:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = 2.0
    monkeypatch.setattr(ranks, "PART_EDGES", 500)
    g = ranks.RankGraph(spark.createDataFrame([(a, b, 2.0) for a, b in edges], "a string, b string, w double"))
    # each edge once; leaves lie with their node, so that only the hubs are asked for, once by a part
    chunks = g.chunks.collect()
    assert g.parts == 4 and sum(len(c[4]) // 8 for _, c in chunks) == len(edges)
    assert sum(len(ranks._targets(gaps)) for _, (_, gaps) in g.asked.collect()) <= 4 * (g.parts - 1)
    got = {r["name"]: r["score"] for r in ranks.eigenvector(g, iterations=6).collect()}
    y = np.ones(len(names))
    for _ in range(6):
        y = y + w @ y
    assert np.allclose([got[n] for n in names], y / y.max(), atol=1e-9)
