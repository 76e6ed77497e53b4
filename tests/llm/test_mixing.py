import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing


@pytest.fixture(scope="module")
def skewed(spark):
    n = "CASE WHEN id < 600 THEN 'big' WHEN id < 800 THEN 'mid' WHEN id < 990 THEN concat('s', cast(id % 4 as string)) END"
    return spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 97 = 0 THEN NULL ELSE repeat('w x ', 1 + cast(id % 13 as int)) END AS text", f"{n} AS source").cache()


def test_matches_sql(skewed):
    got = skewed.sparkSession.createDataFrame(mixing.mix(skewed).select("doc_id", "mix_pass", "mix_block", "mix_rank", "mix_exponent").toPandas()).toPandas()
    docs = skewed.toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(f"WITH {mixing.SQL} SELECT doc_id, c.pass AS mix_pass, d.block AS mix_block, c.block_rank AS mix_rank, c.exponent AS mix_exponent FROM docs_t d JOIN chosen c USING (src, block)").df()
    as_rows = lambda df: sorted(map(tuple, df[["doc_id", "mix_pass", "mix_block", "mix_rank", "mix_exponent"]].astype(float).round(6).values.tolist()))
    assert as_rows(got) == as_rows(want) and len(want) > 1000


def test_target_and_limit(skewed):
    rows = mixing.mix(skewed, target_entropy=0.95, max_repeat=1000.0).groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    n = [r["n"] for r in rows]
    import math

    shares = [x / sum(n) for x in n]
    assert -sum(p * math.log(p) for p in shares) > 0.93 * math.log(len(shares))
    assert sum(r["d"] for r in rows) == 1000  # every document is read at least once
    limited = mixing.mix(skewed, target_entropy=1.0, max_repeat=2.0).groupBy("source", "doc_id").count().agg(F.max("count")).first()[0]
    assert limited <= 2


def test_repeated_rows_null_and_empty(docs, empty, corpus):
    out = mixing.mix(docs)
    assert out.filter("mix_pass = 0").count() == len(corpus)
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumnRenamed("lang", "mix_rank"))


def test_native(docs):
    text = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
