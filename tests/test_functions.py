import datetime as dt
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import event_time as E
from graphloom.functions import identifiers as I
from graphloom.functions import scalars as S
from graphloom.operators import resolve as X
from graphloom.operators import retrieval as R
from graphloom.operators import stats as A
from graphloom.sources import sinks
from tests.test_primitives import rows

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
DAY0 = dt.date(2024, 1, 1)


def values(spark, column, data):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], "x string").select(column(F.col("x"))).collect()]


def test_scalars(spark):
    assert values(spark, S.parse_amount, ["1 200,50 RUB", "1,200.75", "x", None, "-7", "1.2.3"]) == [1200.5, 1200.75, None, None, -7.0, None]
    assert values(spark, S.safe_label, ["works for", "путь", "__a--b__", None]) == ["WORKS_FOR", "RELATED", "A_B", "RELATED"]
    assert values(spark, S.valid_bound, ["2024", "2024-13", "2024-02-30x", "2024-02", None]) == ["2024", None, None, "2024-02", None]
    assert values(spark, S.normalize_polarity, ["NEG", "uncertain", "", None]) == ["negated", "uncertain", "affirmed", "affirmed"]
    assert values(spark, S.deep_normalize, ["  Ünïon-Bank, Ltd ", None]) == ["union bank ltd", ""]
    assert values(spark, S.initials_signature, ["Ivanov I. P.", "I. P. Ivanov", "Ivanov"]) == ["ivanov|i", "ivanov|i", None]
    assert values(spark, lambda c: S.faithfulness(c, F.lit("12 and 3.5")), ["12, then 4", "none", "3,5"]) == [0.5, 1.0, 1.0]
    assert values(spark, R.parse_route, ["use Drift or local", "none", None, "GLOBAL"]) == ["drift", "local", "local", "global"]
    assert (S.day_of_iso("2024-02", True), S.day_of_iso("2024"), S.day_of_iso("x")) == (19782, 19723, None)


@pytest.mark.parametrize(
    ("text", "kind", "canonical"),
    [
        ("ИНН 7707083893", "INN", "7707083893"), ("ИНН 7707083894", None, None), ("ОГРН 1027700132195", "OGRN", "1027700132195"), ("a@B.com.", "Email", "a@b.com"), ("8 (495) 123-45-67", "PhoneNumber", "+74951234567"),
        ("IBAN DE89370400440532013000", "IBAN", "DE89370400440532013000"), ("4111 1111 1111 1111", "CreditCard", "4111111111111111"), ("4111 1111 1111 1112", None, None), ("договор № 12-А/3", "ContractNumber", "12-А/3"),
        ("от 05.03.2024", "DocumentDate", "2024-03-05"), ("5 марта 2024 г.", "DocumentDate", "2024-03-05"), ("2,5 млн руб.", "Amount", "2500000.00 RUB"), ("112-233-445 95", "SNILS", "11223344595"),
        ("https://Ex.com/A).", "URL", "https://ex.com/A"), ("see example.org now", "Domain", "example.org"), ("v1.2.final", None, None), ("https://t.me/durov", "TelegramHandle", "@durov"),
        ("vk.com/id1", "VKProfile", "vk.com/id1"), ("x.com/jack", "TwitterHandle", "twitter.com/jack"), ("linkedin.com/in/a-b", "LinkedInProfile", "linkedin.com/in/a-b"), ("youtube.com/@chan", "YouTubeChannel", "youtube.com/@chan"),
        ("github.com/Ab/C", "GitHubProfile", "github.com/ab/c"), ("github.com/pricing", "Domain", "github.com"), ("123e4567-e89b-12d3-a456-426614174000", "UUID", "123e4567-e89b-12d3-a456-426614174000"),
        ("IMEI 490154203237518", "IMEI", "490154203237518"), ("00-1A-2b-3C-4d-5E", "MACAddress", "00:1a:2b:3c:4d:5e"), ("А123ВС77", "LicensePlate", "А123ВС77"), ("1HGCM82633A004352", "VIN", "1HGCM82633A004352"),
        ("example.pl", "Domain", "example.pl"), ("host.nl и", "Domain", "host.nl"), ("a.example.ch", "Domain", "a.example.ch"), ("github.com/team", "Domain", "github.com"), ("31-12-2024", "DocumentDate", "2024-12-31"),
        ("1 250 300,5 руб", "Amount", "1250300.50 RUB"), ("300 тыс. рублей", "Amount", "300000.00 RUB"), ("github.com/a--b", "Domain", "github.com"), ("twitter: @jack", "TwitterHandle", "twitter.com/jack"),
        ("youtube.com/channel/short", "Domain", "youtube.com"), ("x.com/search", "Domain", "x.com"), ("www.github.com/Ab-c/d.git", "GitHubProfile", "github.com/ab-c/d"), ("№ б/н", None, None),
        ("БИК 044525225 счет 40702810900000005555", "BIC", "044525225"), ("101000, г. Москва, ул. Мира, д. 5", "PostalAddress", "101000 москва ул мира 5"), ("КПП 7736001ZZ", None, None), ("КПП 773601001", "KPP", "773601001"),
    ],
)
def test_identifiers(text, kind, canonical):
    got = [(x["type"], x["canonical"]) for x in I.extract_identifiers(text)]
    assert (kind, canonical) in got if kind else not got


@pytest.mark.parametrize(
    ("phrase", "start", "end", "precision"),
    [
        ("2024-03-05..2024-03-07", "2024-03-05", "2024-03-07", "day"), ("2024-02", "2024-02-01", "2024-02-29", "month"), ("2019–2021 годы", "2019-01-01", "2021-12-31", "year"), ("15 марта", "2024-03-15", "2024-03-15", "day"),
        ("30 декабря", "2023-12-30", "2023-12-30", "day"), ("Q3", "2024-07-01", "2024-09-30", "month"), ("2 квартал 2023", "2023-04-01", "2023-06-30", "month"), ("второе полугодие", "2024-07-01", "2024-12-31", "month"),
        ("в марте", "2024-03-01", "2024-03-31", "month"), ("5-7 февраля", "2024-02-05", "2024-02-07", "day"), ("7 числа", "2024-02-07", "2024-02-07", "day"), ("в течение дня", "2024-01-31", "2024-01-31", "day"),
        ("до 15 марта 2023 года", "2023-03-15", "2023-03-15", "day"), ("7-го числа", "2024-02-07", "2024-02-07", "day"), ("2-й квартал", "2024-04-01", "2024-06-30", "month"), ("май 2021", "2021-05-01", "2021-05-31", "month"),
        ("2020 год", "2020-01-01", "2020-12-31", "year"), ("05.03.2024", "2024-03-05", "2024-03-05", "day"), ("позавчера", "2024-01-29", "2024-01-29", "day"), ("tomorrow", "2024-02-01", "2024-02-01", "day"), ("31 числа", "2024-01-31", "2024-01-31", "day"),
    ],
)
def test_event_times(phrase, start, end, precision):
    sec = lambda x: (dt.date.fromisoformat(x) - dt.date(1970, 1, 1)).days * 86400
    assert E.resolve(phrase, 19753) == (sec(start), sec(end) + 86399, precision)


def test_event_times_that_cannot_be_resolved(spark):
    assert [E.resolve(x, 19753) for x in (None, "", "2024-03-07..2024-03-05", "1700", "soon", "31 февраля", "x" * 99)] == [None] * 7
    assert E.resolve("15 марта", None) is None and E.resolve("1 марта с 10:00 до 12:30", 19753)[2] == "datetime"
    assert E.resolve("с 9:05 до 10:00 мск", 19753) == (19753 * 86400 + 32700, 19753 * 86400 + 36000, "datetime")
    assert [E.resolve(x, 19753) for x in ("с 10:00 до 25:00", "с 12:00 до 9:00", "2024-13", "5 квартал", "марта 15", "2024-xx-01", "вчера и сегодня")] == [None] * 7
    d = spark.createDataFrame([("2020", 1), ("?", None)], "r string, d int").select(E.resolve_event_time(F.col("r"), F.col("d")).alias("t"))
    assert [r["t"]["precision"] for r in d.collect()] == ["year", None]
    assert values(spark, E.sanitize_event_ts, ["(unknown)", "55.75, 37.61", "a; b", " в мае ", ""]) == [None, None, None, "в мае", None]


points = st.lists(st.tuples(st.integers(0, 40), st.integers(-50, 50)), min_size=1, max_size=30)


@few
@given(points, st.sampled_from(["level", "index"]), st.sampled_from(["week", "month"]))
def test_resample(spark, pts, kind, granularity):
    data = [(DAY0 + dt.timedelta(days=d), float(v)) for d, v in pts]
    key = lambda d: d - dt.timedelta(days=d.weekday()) if granularity == "week" else d.replace(day=1)
    want = {}
    for d, v in sorted(data):
        want.setdefault(key(d), []).append(v)
    want = {k: (v[-1] if kind == "level" else statistics.fmean(v)) for k, v in want.items()}
    got = dict(rows(A.resample(spark.createDataFrame(data, "d date, value double"), granularity, kind)))
    assert got == pytest.approx(want)


def test_align_finds_the_lag(spark):
    wave = [0, 3, 1, 7, 2, 9, 4, 4, 8, 1, 5, 2, 6, 0, 3]
    a = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(wave)], "d date, value double")
    b = spark.createDataFrame([(DAY0 + dt.timedelta(days=i + 2), float(v * 10)) for i, v in enumerate(wave)], "d date, value double")
    grid, s = A.align(a, b, "day", "index", "level", 4)
    s = s.first()
    assert s["best_lag"] == 2 and s["correlation"] == pytest.approx(1.0) and s["divergence"] == pytest.approx(0.0, abs=1e-9)
    assert s["warnings"] == ["sparse:a", "sparse:b", "value_kind_mismatch:index/level"] and grid.count() == 17
    flat = a.withColumn("value", F.lit(1.0))
    assert A.align(flat, b, "day", "index", "index", 1)[1].first()["correlation"] is None
    far = b.withColumn("d", F.date_add("d", 400))
    assert "no_overlap" in A.align(a, far, "day", "index", "index")[1].first()["warnings"]


def test_series_and_points(spark):
    o = spark.createDataFrame([("i", DAY0, "", 1, 1.0), ("i", DAY0, "", 2, 5.0), ("i", DAY0, "x", 1, 3.0)], "indicator_id string, period_start date, dims string, revision int, value double")
    assert sorted(r["value"] for r in A.latest_revision(o).collect()) == [3.0, 5.0]
    p = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "value double")
    assert A.valid_points(p).count() == 1


def test_merging_and_resolution(spark):
    n = spark.createDataFrame([("acme corp", "Org", "d1", "c1", 1), ("Acme  Corp", "Org", "d2", "c2", 2), ("ACME CORP", "Person", "d1", "c1", 3)], "name string, label string, description string, chunk string, pos int")
    m = X.merge_entities(n).first()
    assert (m["key"], m["label"], m["mention_count"], m["source_chunks"], m["description"]) == ("Acme Corp", "Org", 3, ["c1", "c2"], "d1\n---\nd2")
    r = spark.createDataFrame(
        [("b", "a", "L", ["works for"], "affirmed", "2020", None, "c1", 1), ("a", "b", "L", ["boss of"], "negated", "2019", "2021", "c2", 2), ("a", "b", "M", None, "negated", None, "2022", "c2", 3)],
        "src string, tgt string, label string, keywords array<string>, polarity string, valid_from string, valid_to string, chunk string, pos int",
    )
    x = X.merge_relations(r).first()
    assert (x["a"], x["b"], x["rel_type"], x["polarity"], x["valid_from"], x["valid_to"], x["weight"]) == ("a", "b", "BOSS_OF", "negated", "2019", "2022", 2.0)
    al = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p")], "name string, canonical string")
    assert dict(rows(X.collapse_aliases(al)))["a"] == "d"
    ents, rels = X.parse_extractions(
        spark.createDataFrame([("c", '("entity"<|#|>Bob<|#|>Person<|#|>a man)##(entity<|#|>bob<|#|>Person<|#|>again)##(relation<|#|>Bob<|#|>Ann<|#|>knows, likes<|#|>d<|#|>neg<|#|>2020..2021)<|COMPLETE|>(entity<|#|>Zed<|#|>P<|#|>x)')], "chunk_id string, extract_raw string")
    )
    assert [e["name"] for e in ents.collect()] == ["Bob"]
    y = rels.first()
    assert (y["src"], y["tgt"], y["keywords"], y["polarity"], y["valid_from"], y["valid_to"]) == ("Bob", "Ann", ["knows", "likes"], "negated", "2020", "2021")
    c = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1]), (3, 3, [0.0, 1.0])], "id long, pos int, embedding array<double>")
    assert dict(rows(X.greedy_clusters(c))) == {1: 0, 2: 0, 3: 1}


def test_claims_cluster_as_in_a_sequential_pass(spark):
    import random

    import numpy as np

    r = random.Random(12)
    rows_ = []
    for i in range(160):
        v = r.choice([None, [], [0.0, 0.0, 0.0], [1.0, 2.0]]) if i % 20 == 0 else [r.choice([1.0, 0.6, 0.0, -1.0]) for _ in range(3)]
        rows_.append((i, r.randrange(90), r.choice(["x", "y", None]), v))

    def sequential(keyed):
        seeds, out = {}, {}
        for i, _, k, v in sorted(rows_, key=lambda x: (x[1], x[0])):
            mine = seeds.setdefault((k or "") if keyed else None, [])
            x = np.asarray(v or [], float)
            x = x / max(np.linalg.norm(x), 1e-300)
            hit = [n for n, s in enumerate(mine) if len(s) == len(x) and len(x) and s @ x >= 0.83]
            out[i] = hit[0] if hit else len(mine)
            if not hit:
                mine.append(x)
        return out

    c = spark.createDataFrame(rows_, "id long, pos int, subject string, embedding array<double>").repartition(3)
    for block in (9, 2048):
        assert dict(rows(X.greedy_clusters(c, block=block))) == sequential(False)
    assert dict(rows(X.greedy_clusters(c, key="subject", block=9))) == sequential(True)
    assert X.greedy_clusters(c.limit(0)).count() == 0


def test_translation_slices_join_and_cut_no_sentence(spark):
    import re

    texts = {1: "One two. Three four! Five?\nSix seven eight. Nine", 2: "no sentence end here", 3: None, 4: "A. " * 40, 5: "Ends. "}
    docs = [(i, 100, x) for i, x in texts.items()] + [(6, 0, "no length. x"), (7, 10, "no chunks.")]
    chunks = [(i, f"{i}{c}", e) for i in (1, 2, 3, 4, 5, 6, 9) for c, e in zip("abcd", (10, 35, 35, 100), strict=True)]
    got = X.translation_slices(spark.createDataFrame(chunks, "doc_id long, chunk_id string, end int"), spark.createDataFrame(docs, "doc_id long, original_chars int, text string"))
    by = {}
    for r in got.orderBy("doc_id", "position").collect():
        by.setdefault(r["doc_id"], []).append((r["chunk_id"], r["text"]))
    assert set(by) == {1, 2, 3, 4, 5}
    for i, parts in by.items():
        assert [c for c, _ in parts] == [f"{i}{c}" for c in "abcd"] and "".join(x for _, x in parts) == (texts[i] or "")
        at = 0
        for _, x in parts:
            at += len(x)
            assert at in (0, len(texts[i] or "")) or re.search(r"[.!?]\s$", texts[i][:at])
    # a part reaches the end of the sentence in which its share ends
    assert by[1][0][1] == "One two. " and by[4][0][1] == "A. " * 4


def test_candidate_pairs_in_blocks_agree(spark):
    import random

    r = random.Random(3)
    v = [(f"name {i}", "L" if i % 3 else "M", "d", [r.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    d = spark.createDataFrame(v, "name string, label string, description string, embedding array<double>")
    key = lambda df: sorted((a, b, round(c, 9), k) for a, b, c, _, k in rows(df))
    one, many = X.candidate_pairs(d), X.candidate_pairs(d, block_rows=7)
    assert key(one) == key(many) and one.count() > 10


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 0.1 * i]) for i in range(6)], "vec_id long, embedding array<float>")
    near = [r["id"] for r in R.knn_join(v.filter("vec_id = 1"), v, 2).orderBy("rank").collect()]
    assert near == [r["vec_id"] for r in R.knn(v, [0.0, 1.0, 0.1], 2).collect()] and near[0] == 1
    g = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "k string, g string")
    assert [r["k"] for r in R.group_filter(g, "g", exclude=["x"]).collect()] == ["b", "c"] and R.group_filter(g, "g", include=["x"]).count() == 1
    pool = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "chunk_id string, pos int")
    ranked = spark.createDataFrame([("c", 1)], "chunk_id string, rank int")
    assert rows(R.append_unranked(ranked, pool)) == [("c", 1), ("a", 2), ("b", 3)]
    assert R.evidence_blob(spark.createDataFrame([(1, "aa"), (2, "bb")], "pos int, text string"), most=5).first()[0] == "aa\n\nb"


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, seen int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 9), (3, "c", 9)], "k int, v string, seen int")
    assert sorted(rows(sinks.upsert(old, new, ["k"], ("seen",)))) == [(1, "a", 5), (2, "B", 9), (3, "c", 9)]
    assert sorted(rows(sinks.insert_new(old, new, ["k"]))) == [(3, "c", 9)]


def test_chunking_and_gates(spark):
    d = spark.createDataFrame([(1, "One two three. Four five. Six seven eight nine."), (2, None)], "doc_id long, text string")
    got = rows(X.split_sentences(d, chunk_tokens=5, overlap=2))
    assert [t for _, _, t in got] == ["One two three. Four five.", "Four five. Six seven eight nine."] or got[0][2].startswith("One two")
    assert X.unchanged(d, d.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))).count() == 0
