"""The corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import langid, lines, mixing, packing, simhash
from larkspur.llm.common import keep

#: Words of a shingle of the third stage, whose near-duplicates have a similarity of 0.8 at least.
SHINGLE = 5


#: A text is in none of the languages learned if the model scores it lower, or knows a smaller share of its grams.
LEAST_SCORE, LEAST_KNOWN = 0.3, 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in none of the learned languages: no letter (``und``), or a score
    below LEAST_SCORE, or a share of known grams below LEAST_KNOWN.

    With no labelled row to learn from, documents with a letter stay.  Null and empty texts go; null labels are not
    learned from; equal rows are judged alike; columns pass through, whatever their names."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "text", F.col("lang").alias("label"), F.col("doc_id").alias("key"))
    model = langid.fit(row.filter(~langid.held_out("key")), label="label", key="key")
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    scored = langid.predict(row.select("row", "text"), model)
    return scored.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE) & (F.col("lang_known") >= LEAST_KNOWN)).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines with an earlier match; a document of which no word is left goes.

    Null texts stay, and texts that lost no line; ids may be null or repeat (``lines``); n_chars is counted anew
    where it is a column; other columns pass through, whatever their names."""
    whole = F.struct(*docs.columns).alias("row")
    out = lines.dedup(docs.select(whole, "doc_id", "text"))
    some = F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != ""
    kept = out.filter((F.col("n_removed") == 0) | some)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return kept.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by pairs of 5-word similarity >= 0.8 stays; every such pair is found:
    by SimHash with the Gray-order index, verified, then by an exact join for what fingerprints miss.

    Null ids come last in their groups; rows that repeat id and text are one; texts without words stay."""
    return simhash.keep_similar(docs, SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them; null sources are one source, texts without words are read once.

    Columns pass through, whatever their names."""
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"))
    return mixed.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences; a null text has the separator's id alone."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID has no SQL; the stages are tested one by one.
ORACLE_SQL = None
