import corpus_pipeline
import test_language_id

SAY = {lang: " ".join(dict.fromkeys(words.split())) for lang, words in test_language_id.SAY.items()}


def test_line_dedup_stage_keeps_one_of_each_copy_group(spark):
    rows = [(10 * k + c, text + "\n\n" + text[::-1], lang) for k, (lang, text) in enumerate(SAY.items()) for c in range(5)]
    rows += [(900, "", "en"), (901, " \n", "en"), (902, None, "en"), (903, "words of its own stay here\n" + SAY["en"], "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.dedup_lines(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [10 * k for k in range(len(SAY))] + [900, 901, 902, 903]
