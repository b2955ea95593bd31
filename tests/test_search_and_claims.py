import hashlib

import numpy as np

from graphloom.functions import identifiers as I
from graphloom.functions import scalars as S
from graphloom.operators import claims as C
from graphloom.operators import resolve as X
from graphloom.operators import search as Q
from graphloom.operators import upkeep as U
from graphloom.plans import catalog
from graphloom.plans import materialize as M
from graphloom.streaming import windows as W
from tests.test_primitives import kg_of, rows


def test_subquestions_coverage_and_trends():
    assert Q.parse_subquestions('["a?", " b? ", ""]', "q") == ["a?", "b?"]
    assert Q.parse_subquestions("1. a?\n2) b?\n\n- c?", "q") == ["a?", "b?", "c?"]
    assert [Q.parse_subquestions(x, "q") for x in (None, "", "one line", '["a"]', "[broken")] == [["q"]] * 5
    assert Q.parse_subquestions("a\n" * 9, "q") == ["a"] * 5
    assert Q.coverage_gap(False, " x ", 1) == "x" and [Q.coverage_gap(*a) for a in ((True, "x", 1), (False, "x", 0), (False, " ", 2), (False, None, 1))] == [None] * 4
    steps = catalog.trend_fallback("What is TRENDING now?", today=5, top_n=3)
    assert [(s.primitive, s.params) for s in steps] == [("top_entities_by_mentions", {"top_n": 3}), ("new_events", {"today": 5, "top_n": 3})]
    assert catalog.trend_fallback("who owns it?") == [] and catalog.trend_fallback(None) == []


def test_verdicts_and_claims(spark):
    d = spark.createDataFrame([("It CONTRADICTs, they agree",), ("i agree",), ("disagree",), (None,)], "x string")
    assert [r[0] for r in d.select(C.parse_verdict(d.x)).collect()] == ["CONTRADICT", "AGREE", "NEUTRAL", "NEUTRAL"]
    raw = [(1, "s", '[{"subject": "A", "attribute": "x", "value": "1"}]'), (2, "t", 'so: [{"subject": "a", "attribute": "X", "value": "2", "polarity": "NEG"}, {"subject": "", "attribute": "x", "value": "1"}]'), (3, "u", "no json"), (4, "u", None)]
    replies = spark.createDataFrame(raw, "doc_id long, source string, raw string")
    assert sorted(r["polarity"] for r in C.parse_claims(replies).collect()) == ["affirmed", "negated"]
    none = spark.createDataFrame([], "value_a string, value_b string, raw string")
    assert C.contradictions_of(replies, none).count() == 1
    # a polarity split stays whatever the verdict
    agree = spark.createDataFrame([("2", "1", "AGREE")], "value_a string, value_b string, raw string")
    assert C.contradictions_of(replies, agree).count() == 1
    same = spark.createDataFrame([(1, "s", raw[0][2]), (2, "t", raw[0][2].replace("1", "2"))], replies.schema)
    assert C.contradictions_of(same, none).count() == 1 and C.contradictions_of(same, agree).count() == 0


def test_windows_and_semantic_chunks(spark):
    texts = {1: "one\ntwo\n" + "x" * 25 + "\nend", 2: None, 3: "", 4: "abc\n" * 9}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in X.split_windows(d, 10).orderBy("doc_id", "position").collect():
        assert len(r["text"]) <= 10
        got[r["doc_id"]] = got.get(r["doc_id"], "") + r["text"]
    assert got == {1: texts[1], 4: texts[4]}
    s = spark.createDataFrame([(1, i, f"s{i}", [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)] + [(2, 0, "alone", [1.0, 0.0])], "doc_id long, position int, text string, embedding array<double>")
    assert sorted(r["text"] for r in X.split_semantic(s).collect()) == ["alone", "s0 s1 s2", "s3 s4 s5"]


def test_stored_neighbours_reach_the_recall_and_links(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((300, 48))
    near = base + 0.12 * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(48) * r.standard_normal((300, 48)) * 3
    schema = "name string, label string, embedding array<double>"
    stored = spark.createDataFrame([(f"s{i}", "L", v.tolist()) for i, v in enumerate(base)] + [("other", "M", base[0].tolist()), ("none", "L", None)], schema)
    items = spark.createDataFrame([(f"i{i}", "L", v.tolist()) for i, v in enumerate(near)], schema)
    cos = (near @ base.T) / np.linalg.norm(near, axis=1)[:, None] / np.linalg.norm(base, axis=1)
    want = {(f"i{i}", f"s{j}") for i, j in zip(*np.nonzero(cos >= 0.85), strict=True)}
    got = {(a, b): c for a, b, c in rows(X.nearest_stored(items, stored, 300, 0.85))}
    assert len(want) > 250 and set(got) <= want and len(got) >= 0.95 * len(want)
    assert all(abs(c - cos[int(a[1:]), int(b[1:])]) < 1e-9 for (a, b), c in got.items())
    m = spark.createDataFrame([("Acme", "O", [1.0, 0.0]), ("Acne", "O", [0.99, 0.01]), ("Акме", "O", [1.0, 0.0]), ("far", "O", [0.0, 1.0])], "surface string, label string, embedding array<double>")
    al = spark.createDataFrame([("Acme", "O", "Q1")], "surface string, label string, qid string")
    it = spark.createDataFrame([("Acme Corp", "O", "Q2", [1.0, 0.0])], "name string, label string, qid string, embedding array<double>")
    assert {r["surface"]: (r["qid"], r["how"]) for r in X.link_canonical(m, al, it).collect()} == {"Acme": ("Q1", "alias"), "Acne": ("Q2", "vector"), "Акме": (None, None), "far": (None, None)}


def test_scalars_and_assembly(spark):
    d = spark.createDataFrame([("acme corp",), ("iPhone of RSR",), ("банк мира",), (None,)], "x string")
    assert [r[0] for r in d.select(S.display_entity_name(d.x)).collect()] == ["Acme Corp", "iPhone Of RSR", "банк мира", None]
    assert [r[0] for r in d.select(S.entity_vid(d.x)).collect()] == [hashlib.blake2b((x or "").encode(), digest_size=16).hexdigest() for x, in d.collect()]
    p = spark.createDataFrame([("2015..2020",), ("..2020",), ("2015..",), ("2024-03-15",), ("none",), ("x..2020-13",), (None,)], "x string")
    assert [tuple(r[0]) for r in p.select(S.parse_temporal(p.x)).collect()] == [("2015", "2020"), (None, "2020"), ("2015", None), ("2024-03-15", None), (None, None), (None, None), (None, None)]
    q = spark.createDataFrame([("2024-Q4", "quarter"), ("2024-02", "month"), ("2024", "year"), ("2024-01-29", "week"), ("2024-01-29", "day")], "x string, g string")
    got = {g: tuple(map(str, q.filter(q.g == g).select(S.period_bounds(q.x, g)).first()[0])) for g in ("quarter", "month", "year", "week", "day")}
    assert got == {"quarter": ("2024-10-01", "2024-12-31"), "month": ("2024-02-01", "2024-02-29"), "year": ("2024-01-01", "2024-12-31"), "week": ("2024-01-29", "2024-02-04"), "day": ("2024-01-29", "2024-01-29")}
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    e = spark.createDataFrame([("c1", "b", "P"), ("c1", "a", "P"), ("c1", "a", "P")], "chunk_id string, name string, label string")
    r = spark.createDataFrame([("c1", "a", "R", "b")], "chunk_id string, src string, rel_type string, tgt string")
    got = {x["chunk_id"]: x for x in X.assemble_chunks(chunks, e, r).collect()}
    assert [y["name"] for y in got["c1"]["entities"]] == ["a", "b"] and got["c2"]["relations"] is None
    t = I.with_identifiers(spark.createDataFrame([(1, "b@x.org, a@x.org, https://x.org/y"), (2, None)], "doc_id long, text string"))
    assert [tuple(r) for r in U.augment_block(t).collect()] == [(1, "Email: a@x.org, b@x.org\nURL: https://x.org/y")]
    docs = spark.createDataFrame([(1, "b@x.org, a@x.org, https://x.org/y")], "doc_id long, text string")
    assert I.canonical_entities(t, docs, around=3).filter("canonical = 'a@x.org'").first()["description"] == "g, a@x.org, h"


def test_materialize_keeps_going_when_a_stage_fails(spark):
    r = [("a", "b", "R", {"polarity": "negated"}), ("b", "c", "R", {}), ("c", "d", "R", {"weight": 2.0})]
    kg = kg_of(spark, [(x, "Organization", {}) for x in "abcd"], r)
    old = spark.createDataFrame([("b", 0.5)], "name string, risk_score double")
    out, errors = M.materialize(kg, 0, old, metrics=("pagerank", "betweenness", "nothing"))
    assert set(out) == {"centrality", "likely_links", "risk"} and set(errors) == {"nothing"}
    c = {x["name"]: x for x in out["centrality"].collect()}
    assert c["b"]["betweenness"] == 2.0 and abs(sum(x["pagerank"] for x in c.values()) - 1) < 1e-9
    assert {x["name"]: x["risk_score_prev"] for x in out["risk"].collect()}["b"] == 0.5
    out, errors = M.materialize(kg, 0, old.drop("risk_score"), metrics=("pagerank",))
    assert "centrality" in out and "risk" in errors


def test_alerts_are_upserted_by_batch(spark, tmp_path):
    schema = "alert_key string, kind string, entity string, detail string, created_at int, score double"
    rows_ = [("k1", "x", "e", "d", 1, 1.0), ("k2", "x", "e", "d", 1, 2.0)]
    state = {"t": spark.createDataFrame([], schema + ", updated_at int, pushed_at int")}

    def save(df):
        state["t"] = spark.createDataFrame(df.collect(), df.schema)

    for part in (rows_, [("k1", "x", "e", "d", 9, 5.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        W.alert_sink(W.read_stream(spark, f"{tmp_path}/in", schema), lambda: state["t"], save, f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["alert_key"], r["created_at"], r["score"]) for r in state["t"].collect()) == [("k1", 1, 5.0), ("k2", 1, 2.0)]
