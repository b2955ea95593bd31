from graphloom.operators import upkeep as U
from tests.test_primitives import rows


def test_spans_gleaning_and_reports(spark):
    s = spark.createDataFrame([("c", "Bob", "P", 0.9, 5), ("c", "bob ", "P", 0.99, 9), ("c", "Al", "P", 0.1, 1)], "chunk string, text string, label string, score double, start int")
    assert [r["text"] for r in U.filter_spans(s).collect()] == ["Bob"]
    a, b = (spark.createDataFrame(x, "key string, v int") for x in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert sorted(rows(U.glean(a, b))) == [("a", 1), ("b", 3)]
    c = spark.createDataFrame([("x", 0, "h1"), ("y", 0, "h2")], "id string, level int, members_hash string")
    old = spark.createDataFrame([(0, "h1", "text")], "level int, members_hash string, report string")
    assert {r["id"]: r["needs_report"] for r in U.report_specs(c, old).collect()} == {"x": False, "y": True}
    t = spark.createDataFrame([("k", i, "x" * 40) for i in range(6)], "community string, pos int, text string")
    assert [r["batch"] for r in U.summary_batches(t, 100).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 2]


def test_labels_and_scripts(spark):
    e = spark.createDataFrame([("Россия", "Organization"), ("a@b.ru", "Email"), ("@user", "Email"), ("http://x.ru", "Email"), ("Acme", "Organization"), (None, "Other")], "name string, label string")
    assert [r["label"] for r in U.correct_labels(e).collect()] == ["Location", "Email", "Other", "Document", "Organization", "Other"]
    assert [r[0] for r in spark.createDataFrame([("привет abc",), ("abc",), ("12",)], "x string").select(U.looks_russian("x")).collect()] == [True, False, False]
