from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, docs, corpus):
    df = docs
    names = []
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        path = spark.conf.get("spark.checkpoint.dir") + f"/stage-test-{name}"
        out.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        if name != "pack":
            assert out.columns == docs.columns
        names.append(name)
        counts.append(out.count())
        df = out
    assert names == ["language", "line_dedup", "near_dedup", "mix", "pack"]
    assert counts[0] == len(corpus) - 4  # null, empty, blank and digits only go
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] >= counts[2]


def test_language_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf)
    lost = docs.join(kept.select("doc_id"), "doc_id", "left_anti").filter("text rlike '[A-Za-z]'")
    assert lost.count() == 0


def test_line_stage_drops_only_what_is_empty(spark, docs):
    out = corpus_pipeline.line_dedup(spark, docs, "")
    gone = docs.join(out.select("doc_id"), "doc_id", "left_anti")
    assert {r["doc_id"] for r in gone.collect()} <= {None, *range(60, 107)}


def test_language_rejects_what_it_has_not_learned(spark):
    rows = [(i, f"the house and the garden are green number {i} of many houses", "en", "s") for i in range(40)]
    rows += [(100 + i, f"das Haus und der Garten sind schön und {i} ist eine Zahl", "de", "s") for i in range(40)]
    rows += [(200, "\u13a0\u13a1\u13a2 \u13a3\u13a4\u13a5 \u13a6\u13a7\u13a8 \u13a9\u13aa\u13ab" * 9, None, "s"), (201, "12 34", "en", "s"), (None, None, None, None), (202, "", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {*range(40), *range(100, 140)}
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, blind, "").collect()} == {*range(40), *range(100, 140), 200}


def test_stages_take_any_columns_and_repeated_rows(spark):
    """Columns named like the stages' own, ties, repeated rows, null ids and an empty table pass every stage."""
    text = "one two three four five six seven eight nine ten\neleven twelve thirteen"
    rows = [(i % 3, text if i % 2 else f"{text} {i}", "en", "s") for i in range(8)] + [(None, text, "en", None), (None, None, None, "s")]
    extra = ["row", "key", "label", "score", "lang_pred", "n_lines", "n_removed", "mix_rank", "t", "d", "dt", "_a", "_b", "words", "stay"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert corpus_pipeline.pack(spark, docs, "").count() >= len(rows)
