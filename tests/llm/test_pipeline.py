"""The pipeline on small fixtures: what stages keep, planted cases and odd rows. The operators' own tests hold the brute force."""

import corpus_pipeline


def test_stages(spark, tmp_path, small):
    rng_docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    rng_docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept and kept <= seen, name
        seen = kept
        if k < 4:
            assert sorted(docs.columns) == sorted(columns)
            assert docs.count() == len(kept)
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert whole == sorted(map(tuple, docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_planted_cases(spark, tmp_path):
    import random

    rng = random.Random(9)
    stop = "the of and to in is that for".split()
    word = lambda: rng.choice(stop) if rng.random() < 0.3 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    a, passage = text(300), text(55)
    near = a.split()
    near[100], near[200] = "changed", "words"
    docs = {1: a, 2: a, 3: " ".join(near), 4: text(200) + " " + passage + " " + text(200), 5: text(100) + " " + passage, 6: text(150), 7: " ".join(w + "%%%" for w in text(100).split())}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(8, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.keep_quality(spark, df, "")
    assert {r.doc_id for r in good.collect()} == {1, 2, 3, 4, 5, 6}
    single = corpus_pipeline.drop_near_copies(spark, good, "")
    assert {r.doc_id for r in single.collect()} == {1, 4, 5, 6}
    cut = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, single, "").collect()}
    assert set(cut) == {1, 4, 5, 6} and cut[6] == docs[6] and passage not in cut[4] and len(cut[5].split()) == 100


ROW = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_rows_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 1), (None, b, "en", "s", 1), (None, c, None, None, None), (None, c, None, None, None)], ROW)
    single = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), "")
    assert sorted((str(r.doc_id), r.text) for r in single.collect()) == [("1", a), ("2", b), ("None", c)]
    cut = corpus_pipeline.drop_repeats(spark, single, "")
    assert sorted((str(r.doc_id), r.text) for r in cut.collect()) == [("1", a), ("2", b), ("None", c)]


def test_odd_rows_and_empty_tables(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", None, 3), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long))]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROW + ", _key string, n_words int, id int, k_text int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name
        out = stage(spark, docs, "")
        assert {r.doc_id for r in out.collect()} <= {1, 2, 3, 4}, name
        if name != "best-fit packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3, 4}
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs.where("doc_id < 4 or doc_id = 4").dropDuplicates(["doc_id"]), "").collect()}
    assert kept == {1: "", 2: "", 3: "one", 4: long}
