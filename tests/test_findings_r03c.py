"""One small case for each finding of round 3 that was mended in its third pass."""

import dataclasses
import random

import pytest

from graphloom.operators import components as C
from graphloom.operators import graph as G


def _reached(edges):
    """The smallest name reachable, by union-find."""
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize(("block", "block_bytes"), [(250_000, 64 << 20), (5, 64 << 20), (250_000, 1)])
def test_components_of_names_are_the_same_for_blocks_of_any_size(spark, monkeypatch, block, block_bytes):
    r = random.Random(block)
    e = [(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(60)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    e += [("", "я"), ("я", "\U0001f600"), ("￮", "\U0001f600"), ("s", "s")]
    r.shuffle(e)
    monkeypatch.setattr(C, "BLOCK_EDGES", block)
    monkeypatch.setattr(C, "BLOCK_BYTES", block_bytes)
    df = spark.createDataFrame(e + e[:30] + [(None, "x"), ("y", None)], "a string, b string").repartition(3)
    with_blocks = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = C.connected_components(df).collect()
        counts = {x["component"]: x["size"] for x in C.component_counts(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_blocks)
    want = _reached(e)
    assert len(got) == len(want) and {x["node"]: x["component"] for x in got} == want
    assert counts == {c: list(want.values()).count(c) for c in set(want.values())}


def test_component_sizes_keep_a_row_a_name_and_nothing_of_it_in_the_rounds(spark, monkeypatch):
    from graphloom.plans import registry
    import graphloom.plans.graph_queries  # noqa: F401

    sf, kept = "/root/testdata/sf0.001", []
    keep = C.reliable_checkpoint
    monkeypatch.setattr(C, "reliable_checkpoint", lambda df: (out := keep(df), kept.append(out.count()))[0])
    got = registry.QUERIES["graph_component_sizes"](spark, sf).first()
    edges = spark.read.parquet(f"{sf}/events.parquet").count() + spark.read.parquet(f"{sf}/supplier.parquet").count()
    # the rounds kept the edges three times and more
    assert sum(kept) < 1.5 * edges
    whole = G.component_sizes(registry.QUERIES["graph_components"](spark, sf)).first()
    assert got == whole


def test_orphans_need_no_grouping_of_relations_and_null_ends_are_none(spark):
    from graphloom.operators import resolve as X
    from graphloom.plans import registry
    import graphloom.plans.data_queries  # noqa: F401

    plan = registry.QUERIES["er_orphan_endpoints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    groupings = [line for line in plan.splitlines() if "Aggregate [" in line]
    # parts are grouped for their mentions and ends for their names, lines not by supplier, part and flag
    assert len(groupings) >= 2 and not any("l_returnflag" in line or "l_suppkey" in line for line in groupings)
    entities = spark.createDataFrame([("a",), ("b",)], "name string")
    relations = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "b"), ("y", None)], "src string, tgt string")
    assert sorted(map(tuple, X.orphan_endpoints(entities, relations).collect())) == [("x", "Other"), ("y", "Other")]


def test_bare_relations_have_the_ends_of_all_relations(spark):
    from graphloom.plans.kg import KnowledgeGraph

    k = KnowledgeGraph.from_tables(spark, "/root/testdata/sf0.001")
    ends = ["src", "tgt", "rel_type"]
    bare, whole = k.bare_relations.distinct(), k.relations.select(*ends).distinct()
    assert bare.exceptAll(whole).count() == 0 and whole.exceptAll(bare).count() == 0
    assert bare.select("rel_type").distinct().count() == 9
    # a graph whose relations were replaced has the ends of those
    some = dataclasses.replace(k, relations=k.relations.filter("rel_type = 'OWNS'"))
    assert [r[0] for r in some.bare_relations.select("rel_type").distinct().collect()] == ["OWNS"]
