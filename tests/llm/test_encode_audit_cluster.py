import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from graphloom.llm import filter_audit, piece_bpe, sort_means
from graphloom.llm.sampled_splitters import assign_shards
from graphloom.llm.setsketch import keep_one_per_class

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return piece_bpe.PieceModel(f.read())


def test_ids_and_texts_equal_the_library(model, library):
    r = random.Random(1)
    odd = ["", " ", "  a", "▁", "▁▁ x", "\n\n\t x", "a\x00b", " " * 300, "ab" * 900, "aaab" * 300, "的一是不了" * 90, "é́x", "😀👍🏽 ok", "<s></s><unk><0x0A>", " ⁇ x", "x" * 5000, "²." * 9, "e​ﬁ"]
    bits = ["a", "b", "th", "the", " ", "  ", "▁", "\n", "é", "的", "😀", "1", "00", "ing", "\t", "_", "=", "ﬁ", "²", "."]
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = odd + ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(1500)] + ["".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(800)]
    got = [np.frombuffer(x, "<u4") for x in model.encode(texts)]
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == library.encode(t, add_bos=True, add_eos=True), t
        assert model.decode(g) == library.decode(g.tolist()), t
    bad = [1, 3 + 0xE7, 3 + 0x9A, 319, 3 + 0xFF, 2]
    assert model.decode(np.array(bad)) == library.decode(bad)


def test_very_long_words_are_cut_where_it_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "BLOCK_CHARS", 50)
    r = random.Random(2)
    for text in ("".join(r.choice("的一是不了abcdef123.,") for _ in range(2000)), "x" * 400, "abc" * 200 + " " + "é" * 300):
        assert np.frombuffer(next(model.encode([text])), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_token_tables(spark, make, library):
    d = make(["Some text, twice.", "Some text, twice.", None, "", "línea\n два"], ids=[1, 1, None, 3, 4])
    ids = piece_bpe.encode_texts(d, MODEL)
    assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in ids.collect())[0] == (0, (1, 2))
    back = {(r["doc_id"], r["text"]) for r in piece_bpe.decode_ids(ids, MODEL).collect()}
    assert back == {(1, "Some text, twice."), (None, ""), (3, ""), (4, "línea\n два")}
    for r in piece_bpe.token_digests(d, MODEL).collect():
        want = library.encode({1: "Some text, twice.", 4: "línea\n два"}.get(r["doc_id"], ""), add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert piece_bpe.token_digests(make([]), MODEL).count() == 0


def brute_audit(rows, labels):
    """rows: (id, text, source)."""
    def fails(i, t):
        w = filter_audit._words(t)
        return {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }

    said = {d: (any(q == 1 for x, q, _ in labels if x == d), any(t == 1 for x, _, t in labels if x == d)) for d, _, _ in labels if d is not None}
    docs = [(s or "", fails(i, t or ""), *said.get(i, (False, False))) for i, t, s in rows]
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [d for d in mine if d[1][f] and not any(d[1][g] for g in order[: step - 1])]
                kept = [d for d in mine if not any(d[1][g] for g in order[:step])]
                vain = [d for d in mine if d[1][f] and any(d[1][g] for g in order[: step - 1])]
                alone = [d for d in mine if d[1][f] and sum(d[1].values()) == 1]
                out[part, order, step] = (len(kept), len(here), len(vain), len(alone), sum(d[2] for d in here), sum(d[3] for d in here))
                total[part, f] = total.get((part, f), 0) + len(here)
    return {(p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_against_brute_force(spark, make, prose):
    r = random.Random(4)
    long = [" ".join(prose(230, 50 + i)) for i in range(6)]
    few = " ".join(["word"] * 150 + ["other"] * 100)
    pool = [*long, few, few + " #", "SHORT CAPS", "", None, long[0].upper(), "a" * 9000, "x\x0by"]
    texts = [r.choice(pool) for _ in range(90)]
    ids = [r.choice([None, *range(60)]) for _ in texts]
    sources = [r.choice(["s1", "s2", None, ""]) for _ in texts]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)]
    d, lab = make(texts, ids, sources), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(list(zip(ids, texts, sources, strict=True)), labels)
    got = {tuple(x) for x in filter_audit.audit_filters(d.repartition(5), lab, 3).collect()}
    assert got == want and len(got) == 600 * len({s or "" for s in sources})
    assert filter_audit.audit_filters(make([]), lab).count() == 0


def test_copies_are_settled_alike_however_they_lie(spark, make):
    texts, ids = ["copy"] * 300 + ["other"] * 3 + ["copy"], [*range(500, 200, -1), 7, 7, 9, None]
    masks = [filter_audit.failed_masks(make(texts, ids).repartition(n), 4) for n in (1, 7)]
    for m in masks:
        assert {r[0] for r in filter_audit.duplicate_ids(m).collect()} == {*range(202, 501), 9}
        assert m.agg(F.sum("n")).first()[0] == 304
    # texts of one fingerprint are told apart by their whole text; a full buffer changes nothing
    rows = [(i, f"t{i % 3}".encode(), "s") for i in range(30)]
    for held in (1, 1 << 20):
        records = sorted(((1, k[1]), v) for k, v in filter_audit._outgoing(rows, held) if v[0] is not None)
        fails = {d for d, m, _, _ in filter_audit._settle(records) if m & 16} | {v[3] for _, v in filter_audit._outgoing(rows, held) if v[0] is None}
        assert fails == set(range(3, 30))


def brute_means(rows, k, rounds, dims):
    keep = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(keep, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in keep]
        for j in range(len(cents)):
            if mine := [v for (_, v), a in zip(keep, at, strict=True) if a == j]:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = [(i, *near(v)) for i, v in keep]
    inertia, each = sum(d for _, d, _ in got), {}
    for _, d, j in got:
        each[j] = each.get(j, 0) + d
    sha = lambda j: hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()
    fit = lambda x: x if x < 2**63 else None
    return sorted((i or 0, j, fit(d), fit(each[j]), fit(inertia), sha(j)) for i, d, j in got)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_sort_means_against_brute_force(spark, scale):
    r = random.Random(6)
    # few values, so that ties abound; one far vector is larger by ``scale``
    rows = [(i, [r.choice([-1.0, -0.3, 0.0, 0.003, 0.5]) for _ in range(4)]) for i in range(120)]
    rows += [(500, [scale, 0.5, -scale, 0.0]), (501, None), (502, [1.0]), (503, [float("nan"), 0.0, 0.0, 0.0]), (504, [None, 0.0, 0.0, 0.0]), (505, [float("inf"), 0.0, 0.0, 0.0]), rows[0], rows[1], (None, rows[2][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = sort_means.cluster_digest(df, k=7, rounds=4, dims=4)
    got = sorted((r[0] or 0, *tuple(r)[1:]) for r in got.collect())
    if scale < 1e20:
        assert got == brute_means(rows, 7, 4, 4)
    else:
        # beyond longs: components saturate, distances and inertia that do not fit are null
        assert len(got) == 124 and {r[4] for r in got} <= {None, *(r[4] for r in got)}


def test_sort_means_of_few_and_of_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [-0.5, 0.25])], "vec_id int, embedding array<float>")
    assert sorted((r[0], r[2]) for r in sort_means.cluster_digest(df, k=40, dims=2).collect()) == [(1, 0), (2, 0)]
    assert sort_means.cluster_digest(df.limit(0), dims=2).count() == 0


def test_scan_stops_early_and_misses_nothing():
    r = np.random.default_rng(1)
    c = r.integers(-100, 100, (12, 3))
    x = np.concatenate([c[r.integers(0, 12, 400)] + r.integers(-9, 9, (400, 3)), r.integers(-300, 300, (100, 3))])
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for kind in (np.int64, object):
        best, dist = sort_means.nearest(x.astype(kind), c.astype(kind), r.integers(0, 12, 500))
        assert (best == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


@pytest.mark.parametrize("names", [["stays", "__dup_id", "Slot", "__shard_h", "comp", "key", "rows", "h1", "n", "t"], ["STAYS", "__DUP_stays", "SHARD", "__Shard_no", "__shard_unit"]])
def test_columns_called_like_helpers_pass_through(spark, make, prose, names):
    a = " ".join(prose(40, 5))
    d = make([a, a + " end", "other words stand here"]).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    kept = keep_one_per_class(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {0, 2}
    out = assign_shards(d)
    assert out.columns == [*[c for c in d.columns if c.lower() not in ("shard", "slot")], "shard", "slot"]
    rows = out.collect()
    assert len(rows) == 3 and all(r[n] == i for r in rows for i, n in enumerate(names) if n.lower() not in ("shard", "slot"))
