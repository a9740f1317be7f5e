import corpus_pipeline as C


def test_nothing_to_learn_from(spark):
    rows = [(n, text, None, "a", 5) for n, text in enumerate(["one two", "drei vier", "12 34", "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.keep_known_languages(spark, df, "unused").collect()) == [0, 1]
