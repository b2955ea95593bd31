import json

import pytest

from graphloom.functions import tolerant_json as J
from graphloom.plans.catalog import parse_plan

DOC = {"title": "A \"quoted\" [title]", "findings": [{"statement": "one, {two}", "importance": 7}, {"statement": "three\nfour", "importance": -1.5e3}], "flag": True, "none": None, "deep": [[1, [2, [3]]], "ü"]}


def leaves(x, path=()):
    if isinstance(x, dict):
        return {p for k, v in x.items() for p in leaves(v, (*path, k))}
    if isinstance(x, list):
        return {p for i, v in enumerate(x) for p in leaves(v, (*path, i))}
    return {(path, x)}


@pytest.mark.parametrize("indent", [None, 2])
def test_cut_at_every_position_the_complete_items_stay(indent):
    text = json.dumps(DOC, ensure_ascii=False, indent=indent)
    before, n = set(), 0
    for cut in range(len(text) + 1):
        got = J.loads(text[:cut])
        now = leaves(got) if got else set()
        # never an item that is not in the whole, never fewer than at a shorter cut
        assert now <= leaves(DOC) and before <= now
        # an item is there at the latest two characters after it ended
        n += now != before
        before = now
    assert J.loads(text) == DOC and n == len(leaves(DOC))


def test_wrapped_and_untidy_replies():
    text = json.dumps(DOC)
    for wrapped in (f"Here is {{it}}:\n```json\n{text}\n```\nDone [ok].", f"[] {text} trailing }}", text.replace("}, {", "},, {").replace("}], ", "},], ")):
        assert J.loads(wrapped) == DOC
    assert J.loads('{"a": "line\nbreak"}') == {"a": "line\nbreak"}
    assert J.loads("no json, {no} [neither") is None and J.loads(None) is None and J.loads("[]") == [] and J.loads("{}") == {}
    assert J.loads("[" * 5000) is None
    assert J.loads('see [1]: {"a": 2}', "{") == {"a": 2} and J.loads('see [1]: {"a": 2}') == [1]
    assert J.loads('{"a": 1] , "b": 2}') == {"a": 1}
    assert J.loads('[1, 2, {"x": 3}, 4') == [1, 2, {"x": 3}]


def test_columns(spark):
    rows = [(1, 'Sure: {"title": " T ", "summary": "S", "findings": [{"statement": " a ", "importance": "3"}, {"statement": ""}, {"importance": 2}, {"statement": "b", "importance": "high"}, {"stat'), (2, " only prose "), (3, None)]
    df = spark.createDataFrame(rows, "id int, reply string")
    got = {r["id"]: r["r"] for r in df.select("id", J.report(df["reply"]).alias("r")).collect()}
    assert got[1]["title"] == "T" and got[1]["summary"] == "S" and [tuple(f) for f in got[1]["findings"]] == [("a", 3), ("b", 0)]
    assert got[2]["summary"] == "only prose" and got[2]["findings"] == [] and got[3]["summary"] == ""


def test_a_plan_that_was_cut_keeps_its_complete_steps():
    plan = '{"steps": [{"primitive": "contradictions"}, {"primitive": "top_entities_by_degree", "params": {"type": "Person"}}, {"primitive": "orphans", "params": {"ty'
    assert [s.primitive for s in parse_plan(plan)] == ["contradictions", "top_entities_by_degree"]
