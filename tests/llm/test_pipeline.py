"""Stages of the corpus pipeline on small cases."""

import numpy as np

import corpus_pipeline


def test_near_stage_takes_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    two = [*words[:30], "x", *words[31:60], "y", *words[61:]]  # 5-word Jaccard 86/106, 3-word 92/104
    four = [*words[:20], "x", *words[21:40], "y", *words[41:60], "z", *words[61:80], "u", *words[81:]]  # 5-word 76/116
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate([words, two, four])] + [(3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2, 3]


def test_near_stage_judges_each_text_of_a_key_and_rows_without_one(spark):
    a, b = [f"w{i}" for i in range(100)], " ".join(f"v{i}" for i in range(50))
    copies = [" ".join([*a[:i], "x", *a[i + 1 :]]) for i in range(0, 100, 20)]
    rows = [(1, copies[0]), (2, copies[1]), (2, b), (None, copies[2]), (None, copies[3]), (None, "other words than these"), (9, b + " end"), (None, None), (7, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[i] for i in (0, 2, 5, 7, 8)], key=str)


def test_language_stage_drops_junk_and_unseen_languages(spark):
    words = {
        "en": "the and of to in that with from this which have they were when their there would about people because",
        "de": "der und die das mit nicht ist auch eine wird sich auf dem haben werden wurde einen durch zwischen menschen",
        "fr": "le les des est dans que pour une avec sont plus cette mais nous vous leur comme aussi être même",
        "es": "el los las que por una con para del como más pero sus este también cuando hasta sobre entre porque",
    }
    rows = []
    for lang, text in words.items():
        w = text.split()
        rows += [(len(rows) + i, " ".join(w[(i * 7 + j * (1 + i % 5)) % 20] for j in range(12)), lang, "s", 0) for i in range(100)]
    bad = ["zqxj kvwp qqzx 123 xkcd", "добрый день у меня есть кошка и собака", "我们今天去学校", "123 !", None]
    rows += [(1000 + i, t, None, "s", 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(400))


def test_whole_pipeline_against_what_was_planted(spark, tmp_path):
    """Copies, near copies, benchmark passages and junk go; all else stays, with its columns under any name."""
    rng = np.random.default_rng(3)
    vocab = {lang: [lang + "".join(rng.choice(list(letters), 5)) for _ in range(400)] for lang, letters in (("en", "theandofwi"), ("de", "derunschüß"), ("fr", "lesquêéàou"), ("es", "elñosparác"))}
    rows = []
    for lang, words in vocab.items():
        rows += [(len(rows) + i, " ".join(rng.choice(words, 60)), lang, "s", 0) for i in range(80)]
    kept = {r[0] for r in rows}
    text = dict((r[0], r[1]) for r in rows)
    passage = " ".join(text[7].split()[10:30])
    kept -= {7}
    rows += [(1000 + i, text[20 + i], "en", "s", 0) for i in range(5)]  # copies: the largest doc_id stays, then
    kept = kept - {20 + i for i in range(5)} | {1000 + i for i in range(5)}
    for i in range(5):  # near copies: the smallest doc_id stays
        rows.append((2000 + i, text[100 + i].rsplit(" ", 1)[0] + " other", "de", "s", 0))
    rows += [(3000, text[90] + " " + passage, "de", "s", 0), (3001, "12 34 !", None, "s", 0), (3002, None, None, "s", 0), (3003, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept and all(len(r.piece_ids) == r.piece_ids_n > 0 for r in out)


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_hit string, dropped string, component_id string"
    docs = spark.createDataFrame([(i, f"the words of text {i} and more", "en", "s", 0, *"abcde") for i in range(30)] + [(None, None, None, None, None, *"abcde")], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple("abcde")}, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
