"""Every stage of the pipeline against brute force on its own input, which is what the stage before it kept."""

import random
from math import ceil

import test_decontaminate
import test_language_id
import test_line_dedup
import test_ngram_join
import test_packing

import corpus_pipeline
from ledgerloom.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def made():
    rng = random.Random(9)
    say = test_language_id.SAY
    vocab = {lang: words.split() + [f"{rng.choice(words.split())}{rng.choice(words.split())}" for _ in range(300)] for lang, words in say.items()}
    line = lambda lang, k: " ".join(rng.choice(vocab[lang]) for _ in range(k))
    items = [(k, line("en", rng.choice([4, 10, 30]))) for k in range(4)] + [(9, None)]
    docs = [(900, None, "en"), (901, "", "de"), (902, "12 34 !", "fr")]
    shared = [line("en", 25) for _ in range(3)]
    for i in range(90):
        lang = rng.choice(list(say))
        lines = [line(lang, rng.randint(8, 30)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            lines.append(rng.choice(shared))
        if i % 11 == 0:
            lines.append("see " + items[2 if i % 2 else 3][1])
        docs.append((i, "\n".join(lines), lang))
    # near copies of whole texts that differ at a line's start, and exact ones
    for k in range(20):
        text, lang = docs[3 + k][1:]
        docs.append((300 + k, text if k % 2 else "intro " + text, lang))
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in docs], items


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = made()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        after = docs.collect()
        short = [r[:2] for r in before]
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "language_id":
            judged = {r[0]: r for r in test_language_id.brute([r[:3] for r in before])}
            assert sorted(r[0] for r in after) == sorted(r[0] for r in before if judged[r[0]][2] != "und" and judged[r[0]][3] >= 0.5)
            assert {900, 901, 902}.isdisjoint(r[0] for r in after)
        elif name == "line_dedup":
            # a document that loses all its words is a copy and goes; one that was blank before stays
            text = dict(short)
            want = [(i, t) for i, t in test_line_dedup.brute(short) if t == text[i] or (t or "").split()]
            assert sorted(r[:2] for r in after) == want and len(want) < len(short)
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "ngram_join":
            want = test_ngram_join.brute(short)
            assert sorted(r[0] for r in after) == sorted({c for _, size, c in want if size} | {i for i, size, _ in want if not size})
        elif name == "decontamination":
            found = {r[0]: r[5] for r in test_decontaminate.brute(short, items)}
            assert sorted(r[0] for r in after) == sorted(i for i, _ in short if not found[i]) and any(found.values())
        else:
            used, total = test_packing.check(before, after, 1024)
            assert used <= ceil(total / 1024) + 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r[:5] for r in map(tuple, got.collect())) == sorted(tuple(r)[:5] for r in after)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
