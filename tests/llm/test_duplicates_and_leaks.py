import math
import random
import re
from collections import Counter

import numpy as np

from graphloom.llm import line_templates as LT
from graphloom.llm import setsketch as SS
from graphloom.llm import simhash_leaks as SL


def brute_classes(texts, ids, k, pct):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    comp = list(range(len(ids)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                comp[max(root(i), root(j), key=lambda r: ids[r])] = min(root(i), root(j), key=lambda r: ids[r])
    return [(len(sets[i]), ids[root(i)]) for i in range(len(ids))]


def copies(prose):
    r = random.Random(3)
    base = prose(120, 1)
    out = [" ".join(base)]
    for _ in range(40):  # near copies of one original, at various distances
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"q{r.randrange(10**6)}"
        out.append(" ".join(w))
    chain = prose(100, 2)
    for i in range(8):  # a chain: neighbours are alike, ends are not
        chain = chain[4:] + prose(4, 50 + i)
        out.append(" ".join(chain))
    out += [" ".join(prose(80, 100 + i)) for i in range(20)]
    out += [None, "", " \n", "one", "ONE", "one two", "One  Two", out[0].upper(), out[0]]
    return out


def test_classes_match_brute_force(make, prose):
    t = copies(prose)
    ids = list(range(500, 500 + len(t)))
    random.Random(1).shuffle(ids)
    for k, pct in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in SS.near_duplicate_classes(make(t, ids), params=SS.SketchParams(shingle=k, threshold_pct=pct)).collect()}
        want = {i: (n, c, i == c) for i, (n, c) in zip(ids, brute_classes(t, ids, k, pct), strict=True)}
        assert got == want


def test_groups_cut_into_parts_lose_no_link(make, prose):
    t = copies(prose)
    whole = SS.near_duplicate_classes(make(t), params=SS.SketchParams(shingle=3, threshold_pct=85))
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(whole)
    for rounds in (0, 2):
        parts = SS.near_duplicate_classes(make(t), params=SS.SketchParams(shingle=3, threshold_pct=85, task_shingles=700, star_rounds=rounds))
        assert key(parts) == want


def test_repeated_ids_lose_no_text_and_repeated_rows_go(make, prose, monkeypatch):
    a, b, c = (" ".join(prose(60, 4000 + i)) for i in range(3))
    d = make([a, a + " tail", b, c, c, c, None, None, "", a, b + " end", c], ids=[3, 5, 5, 7, 7, 7, 8, 8, 9, None, 6, None])
    for rows in (SS.BROADCAST_ROWS, 0):
        monkeypatch.setattr(SS, "BROADCAST_ROWS", rows)
        kept = SS.keep_one_per_class(d)
        assert kept.columns == d.columns
        assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(3, a), (5, b), (7, c), (8, ""), (8, ""), (9, "")])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in SS.near_duplicate_classes(d).collect()}
    assert {(5, 57, 3), (5, 56, 5), (6, 57, 5), (None, 56, 3), (None, 56, 7)} <= got
    nobody = make([a, a + " tail", a], ids=[None, None, None])
    assert SS.keep_one_per_class(nobody).count() == 1
    assert {(r["component_id"], r["kept"]) for r in SS.near_duplicate_classes(nobody).collect()} == {(None, True)}
    assert SS.keep_one_per_class(make([])).count() == 0


def test_null_ids_repeats_and_empty_tables(make, prose):
    a = " ".join(prose(40, 7))
    got = SS.near_duplicate_classes(make([a, a, a, None, "zz " * 9], ids=[None, 4, 4, None, None])).collect()
    assert len(got) == 5
    by = [(r["doc_id"], r["component_id"], r["kept"]) for r in got]
    assert by.count((4, 4, True)) == 2 and (None, 4, False) in by and by.count((None, None, True)) == 2
    assert SS.near_duplicate_classes(make([])).count() == 0
    d = make([a, a, "other words here entirely"])
    kept = SS.keep_one_per_class(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_sketches_merge_and_estimate():
    p = SS.SketchParams()
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**63, 900).astype(np.uint64), r.integers(0, 2**63, 300).astype(np.uint64)
    x, y = np.concatenate([a[:600], b]), a
    assert (SS.merge(SS.registers(x, p), SS.registers(y, p)) == SS.registers(np.union1d(x, y), p)).all()
    true = 600 / 1200
    est = SS.estimate_jaccard(SS.registers(x, p), 900, SS.registers(y, p)[None], np.array([900]), p)[0]
    assert abs(est - true) < 0.2
    assert SS.estimate_jaccard(SS.registers(a, p), 900, SS.registers(a, p)[None], np.array([900]), p)[0] == 1.0


def bench(spark, prose):
    shared = prose(9, 999)  # a passage that several items have, so that shingles differ in weight
    items = [(i, " ".join(prose(20 + i, 1000 + i) + (shared if i % 2 else []))) for i in range(12)] + [(12, "two words"), (13, None), (14, "")]
    return spark.createDataFrame(items, "item_id long, text string"), items


def brute_leaks(docs, items, k=5, threshold=0.8):
    """Of each document and item the best weighted similarity of an item-sized window, by the definition, without hashes."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    live = [(i, words(t)) for i, t in items if words(t)]
    df = Counter(g for _, w in live for g in set(grams(w, min(k, len(w)))))
    weigh = lambda g: math.log1p((1 + len(live)) / df.get(g, 1))
    out = {}
    for d, t in enumerate(docs):
        for i, w in live:
            n = min(k, len(w))
            mine, all_ = Counter(grams(w, n)), grams(words(t), n)
            width = min(len(w) - n + 1, len(all_))
            for s in range(len(all_) - width + 1) if width else ():
                other = Counter(all_[s : s + width])
                if mine.keys().isdisjoint(other):
                    continue
                both = sum(weigh(g) * c for g, c in (mine & other).items())
                sim = both / sum(weigh(g) * c for g, c in (mine | other).items())
                if sim >= threshold - 1e-9:
                    out[d, i] = max(sim, out.get((d, i), 0))
    return out


def test_leaks_match_brute_force(spark, make, prose):
    b, items = bench(spark, prose)
    r = random.Random(2)
    docs = [None, "", "two words", "Two, WORDS!", "two other words"]
    for i, t in items[:12]:
        w = t.split()
        pad = lambda s: " ".join(prose(60, s))
        docs.append(f"{pad(i)} {t.upper()}. {pad(i + 50)}")
        for e in (1, 2):
            v = list(w)
            for _ in range(e):
                v[r.randrange(len(v))] = "zzz"
            docs.append(f"{pad(i + 80)} {' '.join(v)} {pad(i + 90)}")
        docs.append(" ".join(w[: len(w) // 2]) + " " + pad(i + 20))
        docs.append(t)
    want = brute_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in SL.find_leaks(make(docs), b).collect()}
    assert got == set(want) and len(want) > 25
    few = sorted(map(tuple, SL.find_leaks(make(docs), b, params=SL.LeakParams(items_per_pass=4)).collect()))
    assert few == sorted(map(tuple, SL.find_leaks(make(docs), b).collect()))
    assert all(abs(s - want[d, i]) < 1e-6 for d, i, s, _ in few)
    kept = SL.drop_leaking(make(docs), b)
    assert kept.columns == make(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(docs))) - {d for d, _ in want})


def test_leak_edge_cases(spark, make, prose):
    b, _ = bench(spark, prose)
    none = spark.createDataFrame([], "item_id long, text string")
    assert SL.find_leaks(make(["a b"]), none).count() == 0 and SL.find_leaks(make([]), b).count() == 0
    assert SL.drop_leaking(make(["a b", None]), none).count() == 2
    assert SL.find_leaks(make(["two words"] * 2, ids=[None, None]), b).count() == 2


def test_index_finds_everything_within_the_radius():
    p = SL.LeakParams()
    ix = SL.LeakIndex([(0, " ".join(f"w{i}" for i in range(30)))], p)
    r = np.random.default_rng(1)
    for flips in (0, 5, 40, p.radius):
        for _ in range(20):
            bits = np.unpackbits(ix.prints[0].view(np.uint8))
            bits[r.choice(len(bits), flips, replace=False)] ^= 1
            assert list(ix.near(np.packbits(bits).view(np.uint16)[None])[0]) == [0]


def brute_lines(rows, p):
    """The texts without recurring lines, by the definition and without the operator's code."""
    lines, docs = {}, {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            t = line.split()
            if not t:
                continue
            brief = len(t) < p.min_tokens
            shape = tuple(t) if brief else tuple("<*>" if re.search(r"\d|@|://", x) else x for x in t)
            leaf = shape if brief else (len(t), shape[: p.depth])
            docs.setdefault(shape, set()).add(key)
            lines.setdefault(leaf, set()).add(shape)
    least = lambda shape: p.short_docs if len(shape) < p.min_tokens and len(" ".join(shape)) < p.short_chars else p.min_docs
    often = {x for x, v in docs.items() if len(v) >= least(x)}
    for leaf, shapes in lines.items():
        if len(set().union(*(docs[x] for x in shapes))) < p.min_docs or len(next(iter(shapes))) < p.min_tokens:
            continue
        support = Counter()
        for x in shapes:
            for i, t in enumerate(x):
                support[i, t] += len(docs[x])
        need = p.min_docs
        while need <= max(support.values()):
            made = {}
            for x in shapes:
                fixed = tuple(t if i < p.depth or support[i, t] >= need else None for i, t in enumerate(x))
                if sum(t is not None for t in fixed) >= p.similarity * len(x):
                    made.setdefault(fixed, []).append(x)
            for same in made.values():
                if len(set().union(*(docs[x] for x in same))) >= p.min_docs:
                    often.update(same)
            need *= p.step
    out = []
    for _, text in rows:
        shaped = lambda t: tuple(t) if len(t) < p.min_tokens else tuple("<*>" if re.search(r"\d|@|://", x) else x for x in t)
        out.append("\n".join(x for x in (text or "").split("\n") if not (x.split() and shaped(x.split()) in often)))
    return out


def test_recurring_lines_go_by_template(make, prose, monkeypatch):
    docs = []
    for i in range(12):
        own = [" ".join(prose(12, 300 + 10 * i + j)) for j in range(3)]
        docs.append("\n".join([own[0], f"Posted on {i}/05/2024 by user{i} in the forum", own[1], "Read more about our privacy policy here", f"Greetings to you dear {prose(1, i)[0]} and welcome back again", own[2], ""]))
    docs += [None, "", "short line", "x " * 30_000]
    p = LT.TemplateParams()
    want = brute_lines(list(enumerate(docs)), p)
    got = {r["doc_id"]: r for r in LT.drop_recurring_lines(make(docs)).collect()}
    assert [got[i]["text"] for i in range(len(docs))] == want
    assert got[0]["n_dropped"] == 3 and got[0]["n_lines"] == 7 and got[12]["n_lines"] == 0
    # leaves joined by shuffle instead of broadcast
    monkeypatch.setattr(LT, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["text"] for r in LT.drop_recurring_lines(make(docs)).collect()} == {i: got[i]["text"] for i in got}


def test_templates_with_fields_of_few_values(make, prose, monkeypatch):
    """Two fields of four values each: every pair of values is rare, the template is not; and a leaf may hold two templates."""
    r = random.Random(6)
    names, towns = prose(4, 61), prose(4, 62)
    docs = []
    for i in range(40):
        x, y = r.choice(names), r.choice(towns)
        more = f"This letter was sent in the name of {x} by {y} of the office" if i % 2 else f"This letter was written for all and any at {prose(1, 70 + i)[0]} by hand or so {i}"
        docs.append("\n".join([" ".join(prose(14, 7000 + i)), more, f"This letter was {' '.join(prose(12, 7100 + i))}"]))
    p = LT.TemplateParams()
    want = brute_lines(list(enumerate(docs)), p)
    got = {r["doc_id"]: r for r in LT.drop_recurring_lines(make(docs)).collect()}
    assert [got[i]["text"] for i in range(len(docs))] == want and all(r["n_dropped"] == 1 for r in got.values())
    monkeypatch.setattr(LT, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["text"] for r in LT.drop_recurring_lines(make(docs)).collect()} == dict(enumerate(want))


def test_lines_of_one_repeated_document_do_not_recur(make):
    same = "a line that only one document has in it"
    got = LT.drop_recurring_lines(make([same] * 5, ids=[3] * 5)).collect()
    assert [r["text"] for r in got] == [same] * 5
    got = LT.drop_recurring_lines(make([same] * 5)).collect()
    assert [r["text"] for r in got] == [""] * 5
    assert LT.drop_recurring_lines(make([])).count() == 0


def test_lines_of_few_tokens_recur_as_they_stand(make, prose):
    urls = ",".join(f"http://a.example/{w}" for w in prose(6, 1))
    docs = []
    for i in range(12):
        few = ["Thanks, all.", urls] if i < 3 else []
        docs.append("\n".join([" ".join(prose(12, 900 + i)), "Reply now", f"Page {i}", *few]))
    p = LT.TemplateParams()
    got = {r["doc_id"]: r for r in LT.drop_recurring_lines(make(docs)).collect()}
    for i in range(12):
        # in 3 documents a brief line stays and a long one goes; numbers in lines this short are not masked
        assert got[i]["text"] == "\n".join([" ".join(prose(12, 900 + i)), f"Page {i}", *(["Thanks, all."] if i < 3 else [])])
        assert got[i]["n_dropped"] == (2 if i < 3 else 1)
    assert LT.parse_line(" \t", p) is None
