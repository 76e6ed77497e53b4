"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import langid, licenses, lines, mixing, neighbours, packing, sharding, simhash, suffixes, topk

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    """Decorator: adds a query, and its oracle SQL where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op4_resharding")
def op4(spark, sf_dir):
    return sharding.reshard(table(spark, sf_dir, "documents"))


@register("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@register("op9_license_scan", licenses.oracle_sql())
def op9(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))  # n_blocks: blocks that contain a template


@register("op2_packing")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@register(
    "op5_temperature_mixing",
    f"""
    WITH docs AS (SELECT doc_id, text, source FROM documents), {mixing.SQL}
    SELECT d.doc_id, d.source, d.tokens AS mix_tokens, CAST(c.pass AS INTEGER) AS mix_pass, d.block AS mix_block,
           c.block_rank AS mix_rank, c.exponent AS mix_exponent
    FROM docs_t d JOIN chosen c USING (src, block)
    """,
)
def op5(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix_tokens", "mix_pass", F.col("mix_block").cast("bigint").alias("mix_block"), F.col("mix_rank").cast("bigint").alias("mix_rank"), "mix_exponent")


@register("op3_simhash")
def op3(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


@register("op6_suffix_array_dedup")
def op6(spark, sf_dir):
    return suffixes.removed(table(spark, sf_dir, "documents"))


@register("op1_line_dedup", lines.ORACLE_SQL)
def op1(spark, sf_dir):
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"))


@register(
    "op10_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
    """,
)
def op10(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


@register(
    "op7_nn_descent",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    named AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN named ON x = vec_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = vec_id
    """,
)
def op7(spark, sf_dir):
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))
