from collections import Counter

import corpus_pipeline as CP


def test_stages_over_small_tables(spark, make, prose, tmp_path):
    base = [" ".join(prose(60, 9000 + i)) for i in range(30)]
    item = " ".join(prose(30, 77))
    texts = [*base, base[0], base[1] + " tail", "too short", None, base[5] + " " + item]
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in CP.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        docs = out
    assert kept[0] == set(range(32)) | {34}
    assert kept[1] == set(range(30)) | {34}
    assert kept[2] == kept[3] == set(range(30))
    out = CP.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(range(30)) and out.columns[-2:] == ["shard", "slot"]
    assert [n for n, _ in CP.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "mix_sources", "shard"]


def tables(spark, d, folder, item=None):
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)] if item else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return CP.run(spark, folder)


def test_empty_table(spark, make, tmp_path):
    out = tables(spark, make([]), str(tmp_path))
    assert out.count() == 0 and out.columns == [*make([]).columns, "shard", "slot"]


def test_null_and_repeated_ids_and_repeated_rows(spark, make, prose, tmp_path):
    a, b, c, e = (" ".join(prose(60, 300 + i)) for i in range(4))
    item = " ".join(prose(25, 88))
    long = " ".join(prose(30_000, 89))
    texts = [a, a, a, b, c, None, "", e, e + " " + item, long, long + " end"]
    d = make(texts, ids=[7, 7, 7, 7, None, 1, 2, None, 3, 4, 5], sources=["s"] * 4 + [None] * 7)
    out = tables(spark, d, str(tmp_path), item)
    # three equal rows are one; the other text under their id, and rows without ids, stay
    rows = out.collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(7, a), (7, b), (None, c), (None, e), (4, long)}
    assert max(Counter((r["doc_id"], r["text"]) for r in rows).values()) <= 2  # the mix passes over the small source twice
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) and out.columns == [*d.columns, "shard", "slot"]


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
