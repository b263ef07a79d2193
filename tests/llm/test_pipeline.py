import corpus_pipeline
from graphloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = queries.table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "retrieval_packing"]
    toxic = {r.doc_id for r in queries.QUERIES["op7_toxicity"](spark, SF).where("predicted = 1").collect()}
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert first.schema == docs.schema
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - toxic
    second = corpus_pipeline.one_of_each_group(spark, docs, SF)
    classes = queries.QUERIES["op8_ngram_jaccard_join"](spark, SF).collect()
    assert second.schema == docs.schema
    assert sorted(r.doc_id for r in second.collect()) == sorted({r.component_id for r in classes})
    third = corpus_pipeline.cut_repeats(spark, docs, SF)
    cut = {r.doc_id: r for r in queries.QUERIES["op9_substring_dedup"](spark, SF).collect()}
    assert third.schema == docs.schema
    for r in third.collect():
        assert len(r.text.split()) == cut[r.doc_id].n_words - cut[r.doc_id].n_removed
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (3, None, None, None, None), (None, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "x"), (1, "a b c d e f"), (3, "")]


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(1, a), (1, a), (2, b), (2, c), (3, b.upper()), (4, c), (5, None), (5, ""), (6, "s t u v w x"), (6, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    want = [(1, a), (2, b), (2, c), (5, None), (5, ""), (6, "s t u v w x"), (None, a)]
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t in want)


def test_every_stage_takes_an_empty_table_nulls_and_repeats(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], kind)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 9), (3, long, "en", "s", 9), (None, "x y", "en", "s", 3), (4, "word " * 50_000, "en", "s", 250_000)]
    some = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    assert corpus_pipeline.drop_toxic(spark, some, SF).count() == len(rows)
    cut = sorted((r.doc_id or 0, r.n_chars or 0, r.text or "") for r in corpus_pipeline.cut_repeats(spark, some, SF).collect())
    assert cut == [(0, 0, ""), (0, 3, "x y"), (1, 0, ""), (2, 0, ""), (3, 0, ""), (3, 0, ""), (4, 0, "")]
    packed = corpus_pipeline.pack_sequences(spark, some, SF).collect()
    assert sum(r.doc_tokens == 1 and r.length == 1 for r in packed) == 3 and {r.doc_id for r in packed} == {None, 1, 2, 3, 4}
    total = sum(r.doc_tokens for r in packed if r.start == 0)
    assert total > 50_000 and total == sum(r.length for r in packed)
    # At most one short sequence for each partition.
    assert -(-total // 1024) <= len({r.sequence_id for r in packed}) <= -(-total // 1024) + 4


def test_extra_columns_of_any_name_stay_as_they_are(spark):
    """Names that the stages use themselves; of repeated ids, too."""
    extra = ["__text", "__n", "__sig", "__id", "__words", "text_", "row", "id", "n", "sig", "sig2", "score", "predicted", "toxic", "n_words", "n_removed", "spans", "others", "stands", "stays", "times", "n_shingles", "component_id", "start", "ids"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(i, t, "en", "s", 1, *(f"{c}-{k}" for c in extra)) for k, (i, t) in enumerate([(1, long), (1, "other words here"), (2, long + " x"), (3, None), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "y")])]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        found = got.collect()
        assert found, name
        for r in found:
            assert tuple(r)[5:] in {x[5:] for x in rows}, name
            assert next(x for x in rows if x[5:] == tuple(r)[5:])[0] == r.doc_id, name
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0
