import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def by_hand(spark):
    """Each stage by itself on the rows that the one before kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF_DIR)
        if stage is not corpus_pipeline.tokens:
            assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
        docs = spark.createDataFrame(rows.collect(), rows.schema)
    return docs


def test_run_is_the_stages_in_order(spark):
    want = sorted(map(tuple, by_hand(spark).collect()), key=repr)
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()), key=repr)
    assert got == want and got


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_DIR).collect()


CLASHING = [
    "__n", "__key", "__clean", "__spans", "__cut", "__host", "__doc_id", "__text_hash", "__kept", "__mix_place",
    "__mix_epoch", "__mix_source", "__key_", "__epochs_", "key", "spans", "host", "text_hash", "size", "last",
]


def test_columns_with_the_names_of_helpers_keep_their_values(spark):
    words = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(80)) for i in range(6)]
    texts = [*words, words[0] + " mail ann@example.org now", "", None]
    rows = [(i, t, "en", "ab"[i % 2], 1, *[100 * i + c for c in range(len(CLASHING))]) for i, t in enumerate(texts)]
    own = ", ".join(f"`{name}` long" for name in CLASHING)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {own}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert got
        for row in got:
            assert tuple(row)[5:] == tuple(100 * row.doc_id + c for c in range(len(CLASHING)))
            assert row.doc_id != 6 or row.text == texts[6] or "[EMAIL]" in row.text
