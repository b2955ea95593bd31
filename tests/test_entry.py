import importlib
import sys

import duckdb
import pytest

ROOT = "/root/testdata/sf0.001"


def test_names_and_oracles():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_works_without_the_optional_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("graphloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("graphloom.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    import graphloom

    monkeypatch.delattr(graphloom, "llm", raising=False)
    e = importlib.reload(importlib.import_module("__spark_entry__"))
    names = e.queries()
    assert "agg_count_entities" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)


@pytest.mark.parametrize("name", ["agg_top_entities_by_degree", "qual_contradictions", "stat_align", "graph_components", "er_merge_events"])
def test_against_the_oracle(spark, name):
    import glob
    import os

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    norm = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)) for r in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in e.queries()[name](spark, ROOT).collect())
    assert got == want
