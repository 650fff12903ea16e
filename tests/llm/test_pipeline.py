"""The pipeline's stages on rows without an id and rows given more than once."""

from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_mix_takes_rows_not_ids(spark):
    import corpus_pipeline

    rows = [(1, "a b"), (1, "a b"), (1, "e f g"), (None, "c d"), (None, "h"), (2, None), (4, "x y z")]
    docs = table(spark, rows)
    out = corpus_pipeline.mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    # One leaf and as many tokens as it has: each row once.
    assert counted(out) == Counter(rows)


def test_mix_keeps_to_its_epochs(spark):
    import corpus_pipeline

    # Two leaves; the one of more weight gives its tokens more than once.
    rows = [(k, "w " * 3, "en", "src0", 6) for k in range(3)] * 2 + [(None, "n " * 3, "en", "src0", 6)] + [(100 + k, "v " * 30, "xx", "src2", 60) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = counted(corpus_pipeline.mix_stage(spark, docs, ""))
    given = Counter((r[0], r[1]) for r in rows)
    assert (None, "n " * 3) in out
    assert all(n <= given[row] * corpus_pipeline.MIX_EPOCHS for row, n in out.items())
    assert out[(None, "n " * 3)] == corpus_pipeline.MIX_EPOCHS and out[(0, "w " * 3)] == 2 * corpus_pipeline.MIX_EPOCHS


def test_one_row_of_each_text(spark):
    import corpus_pipeline

    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (None, "c d"), (None, "c d"), (5, "q"), (None, "q"), (7, "q"), (2, None), (3, ""), (4, "x y z"), (4, "other")]
    docs = table(spark, rows)
    out = corpus_pipeline.exact_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert counted(out) == Counter([(1, "a b"), (None, "c d"), (7, "q"), (3, ""), (4, "x y z"), (4, "other")])
    assert corpus_pipeline.exact_stage(spark, table(spark, []), "").count() == 0


def test_columns_of_the_names_used_within(spark):
    """Columns named as those that the stages use for themselves stay as they are."""
    import corpus_pipeline

    names = ["col", "copies", "__id", "__sha", "id", "h", "bucket"]
    docs = spark.createDataFrame([(1, "a b", "en", "src0", 3, *"1234567"), (2, "a b", "en", "src0", 3, *"abcdefg"), (3, "c", None, None, None, *[None] * 7)], SCHEMA + "".join(f", {n} string" for n in names))
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.mix_stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {(r.doc_id, r["col"], r["copies"], r["__id"]) for r in out.collect()} <= {(1, "1", "2", "3"), (2, "a", "b", "c"), (3, None, None, None)}


def test_near_stage_against_all_pairs(spark):
    import corpus_pipeline
    from tests.llm.test_dedup import brute_near, near_rows

    rows = near_rows(11)
    out = corpus_pipeline.near_stage(spark, table(spark, rows), "")
    assert {r.doc_id for r in out.collect()} == {i for i, v in brute_near(rows).items() if v[2]}
    assert corpus_pipeline.near_stage(spark, table(spark, []), "").count() == 0


def labelled(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_toxic_documents_go(spark, tmp_path):
    import corpus_pipeline

    clean, vile = "a calm green river runs by the old stone house every day", "you vile hateful thing go away"
    rows = [(k, vile + f" {k}" if k % 4 == 0 else clean + f" {k}") for k in range(200)] + [(500, None), (501, ""), (None, clean), (502, vile), (502, vile)]
    out = corpus_pipeline.toxicity_stage(spark, table(spark, rows), labelled(spark, tmp_path, [(k, 1, int(k % 4 == 0)) for k in range(200)]))
    kept = {r.doc_id for r in out.collect()}
    assert kept == {k for k in range(200) if k % 4} | {500, 501, None}


def test_whole_run(spark, tmp_path):
    """From documents to ids, against each stage by plain Python."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    clean, vile = "calm green river number {0} runs by stone {0} and old house {0} on day {0}", "you vile hateful thing go away {0}"
    texts = {k: (vile if k % 4 == 0 else clean).format(k) for k in range(120)}
    texts |= {200: texts[1], 201: texts[1] + " ", 202: None, 203: ""}
    table(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    folder = labelled(spark, tmp_path, [(k, 1, int(k % 4 == 0)) for k in range(120)])
    out = corpus_pipeline.run(spark, folder).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # Of the equal texts 200 stays, then of the near ones the smallest id; 203 has no words and is its own.
    want = {k for k in range(120) if k % 4 and k != 1} | {200, 203}
    assert {r.doc_id for r in out} <= want and len({r.doc_id for r in out}) >= len(want) - 2
    for r in out:
        assert list(r.ids) == sp.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
