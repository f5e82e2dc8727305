"""Pipeline stages on the smallest tables: what each keeps, and that what it says holds on its own input."""

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == COLUMNS
            now = {r.doc_id: r.text for r in out.collect()}
            assert set(now) <= set(before) and out.count() == len(now)
            if i < 3:
                assert all(before[k] == v for k, v in now.items())
            else:
                assert set(now) == set(before)
            if i < 2:
                assert len(now) > 0.7 * len(before)
            before = now
        else:
            ids = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
            assert {r.doc_id for r in ids} == set(before) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in ids)
        docs = out


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, words[2]), (7, words[3]), (7, words[3]), (7, words[4]), (7, words[5])]
    rows += [(3, words[4] + " tail"), (None, words[5] + " tail"), (9, ""), (9, " "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == COLUMNS
    want = [(None, words[0]), (None, words[1]), (None, words[2]), (7, words[3]), (3, words[4] + " tail"), (7, words[5]), (9, ""), (9, " "), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
