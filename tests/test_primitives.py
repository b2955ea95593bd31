"""Golden graphs for the catalog's primitives."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.operators import primitives as P
from graphloom.plans import catalog as C
from graphloom.plans import materialize as M
from graphloom.plans.kg import KnowledgeGraph
from graphloom.schema import ENTITIES, RELATIONS


def kg_of(spark, entities, relations, **more):
    """entities: name, label and fields; relations: src, tgt, rel_type and fields."""
    ent_cols = [x.split()[0] for x in ENTITIES.split(", ")]
    rel_cols = [x.split()[0] for x in RELATIONS.split(", ")]
    e = [tuple({"name": n, "label": l, **k}.get(c) for c in ent_cols) for n, l, k in entities]
    r = [tuple({"rel_id": str(i), "src": s, "tgt": t, "rel_type": x, "weight": 1.0, **k}.get(c) for c in rel_cols) for i, (s, t, x, k) in enumerate(relations)]
    empty = lambda ddl: spark.createDataFrame([], ddl)
    base = dict(
        entities=spark.createDataFrame(e, ENTITIES), relations=spark.createDataFrame(r, RELATIONS), mentions=empty("chunk_id string, entity_name string"),
        chunks=empty("chunk_id string, doc_id string, doc_date_epoch int, doc_group string"), communities=empty("id string, level int, title string, member_count long, summary string"),
        in_community=empty("name string, community_id string, level int"), parent_of=empty("parent_id string, child_id string, level int"),
    )
    return KnowledgeGraph(**{**base, **more})


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def shell(spark):
    org, inn, mail = "Organization", "INN", "Email"
    return kg_of(
        spark,
        [("Shell", org, {}), ("Mixed", org, {}), ("Alone", org, {}), ("1", inn, {}), ("2", inn, {}), ("m@x", mail, {}), ("Bob", "Person", {"mention_count": 5}), ("bob ", "Person", {"mention_count": 3}), ("60%", "Concept", {"mention_count": 9})],
        [("Shell", "1", "HAS", {}), ("Shell", "m@x", "HAS", {}), ("Mixed", "2", "HAS", {}), ("Mixed", "Bob", "KNOWS", {}), ("Bob", "1", "HAS", {"polarity": "negated"}), ("Bob", "Bob", "SELF", {})],
    )


def test_quality_and_signals(shell):
    assert rows(P.review_queue(shell)) == [("Shell", 2, "shell_signal")]
    assert rows(P.orphans(shell)) == [("60%", 0, "Concept"), ("Alone", 0, "Organization"), ("bob ", 0, "Person")]
    assert rows(P.merge_candidates(shell)) == [("bob", ["Bob", "bob "], 2)]
    inc = {r["name"]: (r["missing"], r["have"]) for r in P.incomplete_entities(shell, "Organization", ("INN", "Email")).collect()}
    assert inc == {"Shell": ([], ["Email", "INN"]), "Mixed": (["Email"], ["INN"]), "Alone": (["INN", "Email"], [])}
    assert rows(P.top_entities_by_mentions(shell, top_n=2)) == [("Bob", 5)]  # the number is dropped after the cut
    assert rows(P.top_entities_by_degree(shell, "Person")) == [("Bob", 2), ("bob ", 0)]  # a self-loop counts once
    assert rows(P.shared_identifier_entities(shell)) == [("1", "INN", ["Bob", "Shell"])]
    assert sorted(rows(P.identifier_lookup(shell, "1"))) == [("Bob", "Person", "HAS"), ("Shell", "Organization", "HAS")]
    assert P.entity_dossier(shell, "nobody").count() == 0
    d = P.entity_dossier(shell, "Mixed").first()
    assert [x["name"] for x in d["neighbors"]] == ["Bob"] and [x["value"] for x in d["identifiers"]] == ["2"]


def test_cycles_of_two_to_six(spark):
    ring = lambda names: [(a, b, "OWNS", {}) for a, b in zip(names, names[1:] + names[:1], strict=True)]
    r = ring(["a1", "a2"]) + ring([f"b{i}" for i in range(4)]) + ring([f"c{i}" for i in range(6)]) + ring([f"d{i}" for i in range(7)]) + [("s", "s", "OWNS", {})]
    got = [c for (c,) in rows(P.circular_ownership(kg_of(spark, [], r), top_n=200))]
    assert sorted(len(c) - 1 for c in got) == [2] * 2 + [4] * 4 + [6] * 6
    assert all(c[0] == c[-1] for c in got)


def test_contradictions_need_overlapping_windows(spark):
    x = lambda p, f, u: {"polarity": p, "valid_from": f, "valid_to": u}
    r = [
        ("a", "b", "R", x("affirmed", "2020", "2021")), ("a", "b", "R", x("negated", "2021", None)), ("c", "d", "R", x("affirmed", "2020", "2020-05")), ("c", "d", "R", x("negated", "2021", "2022")),
        ("e", "f", "R", x("negated", None, None)), ("e", "f", "R", x("affirmed", None, None)), ("g", "h", "R", x("affirmed", None, None)), ("g", "h", "Q", x("negated", None, None)),
    ]
    assert [(a, b) for a, _, b, *_ in rows(P.contradictions(kg_of(spark, [], r)))] == [("a", "b"), ("e", "f")]


def test_partial_dates(spark):
    r = [("a", "b", "R", {"valid_from": v, "valid_to": u, "created_at": c}) for v, u, c in (("2024", None, 1), ("2024-03", None, 1), ("2024-03-15", "2024-04", 1), (None, "2024-03-02", 1), (None, None, 19790), (None, None, 1))]
    got = [(x["valid_from"], x["valid_to"], x["change"]) for x in P.whats_changed(kg_of(spark, [], r), "2024-03", "2024-03-31", "a").collect()]
    assert got == [("2024-03", None, "appeared"), (None, "2024-03-02", "ended"), ("2024-03-15", "2024-04", "appeared"), (None, None, "first_seen")]
    both = P.whats_changed(kg_of(spark, [], r), "2024-03", "2024-03-31")
    assert both.count() == 8  # unanchored, each edge is seen from both ends
    assert P.relationship_timeline(kg_of(spark, [], r), "a").count() == 3


def test_bursts(spark):
    day = 1000
    ev = [(f"e{i}", "EventOrAction", {"event_type": "x", "created_at": c}) for i, c in enumerate([day, day - 1, day - 7, day - 8, day - 36])]
    r = [(f"e{i}", "p", "PARTICIPATED_IN", {}) for i in range(5)] + [("e0", "p", "PARTICIPATED_IN", {}), ("e1", "q", "PARTICIPATED_IN", {"polarity": "negated"})]
    assert rows(P.trending_events(kg_of(spark, ev, r), day)) == [("p", "x", 3, 0.25, 3.0)]
    assert [x["name"] for x in P.event_timeline(kg_of(spark, ev, r), "p").collect()] == ["e0", "e0", "e1", "e2", "e3", "e4"]


def test_topic_trend_and_cooccurrence(spark):
    m = spark.createDataFrame([("c1", "t"), ("c1", "t"), ("c1", "o"), ("c2", "t"), ("c2", "o"), ("c3", "o")], "chunk_id string, entity_name string")
    days = [(dt.date(2024, 3, d) - dt.date(1970, 1, 1)).days for d in (14, 17)]
    c = spark.createDataFrame([("c1", "d", days[0], "g"), ("c2", "d", days[1], "g"), ("c3", "d", None, "g")], "chunk_id string, doc_id string, doc_date_epoch int, doc_group string")
    kg = kg_of(spark, [], [], mentions=m, chunks=c)
    assert rows(P.topic_trend(kg, "t", "week")) == [("2024-03-11", 2)] and rows(P.topic_trend(kg, "t", "quarter")) == [("2024-Q1", 2)]
    assert rows(P.cooccurrence(kg, "t")) == [("o", 2)]


def test_rollup_parses_amounts(spark):
    a = ["1 200,50 RUB", "1,200.75 RUB", "no number", "-5 RUB"]
    kg = kg_of(spark, [(x, "Amount", {}) for x in a] + [("P", "Person", {})], [("P", x, "PAID", {}) for x in a])
    assert rows(P.numeric_rollup(kg)) == [("P", 2396.25, 3)]


def test_risk_and_alerts(spark, shell):
    r = {x["name"]: x for x in M.compute_risk(M.risk_inputs(shell, 0)).collect()}
    assert (r["Shell"]["risk_score"], r["Shell"]["risk_band"]) == (0.45, "medium")
    assert r["Bob"]["risk_components"] == {"controversy": pytest.approx(1 / 3)} and r["Alone"]["risk_score"] == 0.0
    s = spark.createDataFrame([("Bob", 0.5, 0.2), ("Shell", 0.5, 0.45)], "name string, risk_score double, risk_score_prev double")
    got = M.detect_alerts(kg_of(spark, [], [("Bob", "x", "R", {"created_at": 9})]), spark.createDataFrame([("Bob",)], "name string"), 5, s)
    assert sorted(x["alert_key"] for x in got.collect()) == ["new_connection:Bob:R|x", "risk_rise:Bob:"]
    old = got.withColumns({"updated_at": F.lit(1), "pushed_at": F.lit(None).cast("int")})
    again = M.upsert_alerts(old, got.withColumn("score", F.lit(7.0)), 2).collect()
    assert len(again) == 2 and {(x["score"], x["updated_at"]) for x in again} == {(7.0, 2)}


def test_catalog_runs_plans(shell):
    assert len(C.CATALOG) == 42
    plan = C.parse_plan('ok: {"steps": [{"primitive": "count_entities", "params": {"type": "organization"}}, {"primitive": "nope"}, {"primitive": "entity_dossier"}, {"primitive": "count_relationships"}]}', ("Organization",))
    assert [c.primitive for c in plan] == ["count_entities", "count_relationships"]
    steps = C.execute(shell, [*plan, C.PrimitiveCall("top_central_entities", {"metric": "x"})])
    assert [s.rows for s in steps[:2]] == [[{"n": 3}], [{"n": 6}]] and steps[2].error
    assert C.parse_plan("no json") == []


def test_link_reads(spark, shell):
    links = spark.createDataFrame([("Bob", "Shell", 0.9), ("Mixed", "Bob", 0.6)], "a string, b string, score double")
    assert rows(P.link_prediction(dataclasses.replace(shell, likely_links=links), "Bob")) == [("Shell", 0.9), ("Mixed", 0.6)]
