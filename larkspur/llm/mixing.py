"""Temperature mixing of sources, in DataFrame functions only.

Source token shares p are raised to an exponent a: weights are p^a / sum p^a.
a = 1 is the natural mix, a = 0 an even one.  Bisection finds the largest a on a
grid of 1/GRID whose weights reach the target entropy (a fraction of the largest
possible), then raises it, if need be, until no source is repeated more than
MAX_REPEAT times.  The token budget is the smallest one for which every source
is read at least once, so source i is read r_i = (p_max / p_i)^(1 - a) times.

The budget is realised by block permutations: a hash of the id deals a source's
documents to BLOCKS blocks; every pass orders the blocks anew by a seeded hash;
whole passes take all blocks, the last one the first blocks that fit what is left
of the source's token budget.

Defined cases: a null source is a source of its own; a null or empty text has no
tokens, and a source without tokens is read once; null ids share a block;
repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare

TARGET_ENTROPY = 0.9
MAX_REPEAT = 4.0
BLOCKS = 1024
SEED = "mix"
GRID = 10_000
STEPS = 14  # halvings that bring GRID + 1 down to one
#: Rows of the schedule up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def n_tokens(text="text"):
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0b\f\r]+")), F.lit(0)).cast("bigint")


def _bisect(good):
    """Largest k in 0..GRID for which good(k) holds, given that it holds for 0 and is monotone."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(GRID + 1).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        ok = (s["hi"] - s["lo"] > 1) & good(mid)
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["lo"])


def _total(array, of):
    return F.aggregate(array, F.lit(0.0), lambda a, p: a + of(p))


def schedule(rows: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(src, block, pass, block_rank, exponent, weight): which blocks each pass takes; rows has src, block, tokens.

    As many rows as sources x BLOCKS x passes."""
    cells = keep(rows.groupBy("src", "block").agg(F.sum("tokens").alias("tokens")), "mix-cells")
    sources = cells.groupBy("src").agg(F.sum("tokens").alias("n"))
    # one row with one number per source
    shares = sources.filter("n > 0").agg(F.sort_array(F.collect_list("n")).alias("ns")).select(F.transform("ns", lambda n: n / F.aggregate("ns", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("ps"))
    ps = F.col("ps")

    def entropy_ok(k):
        a = k / F.lit(float(GRID))
        z = _total(ps, lambda p: F.pow(p, a))
        h = F.log(z) - a * _total(ps, lambda p: F.pow(p, a) * F.log(p)) / z
        return h >= target_entropy * F.log(F.size(ps)) - 1e-9

    def repeat_ok(k):  # k counts down from the natural mix
        return F.pow(F.array_max(ps) / F.array_min(ps), k / F.lit(float(GRID))) <= max_repeat + 1e-9

    k = F.greatest(_bisect(entropy_ok), F.lit(GRID) - _bisect(repeat_ok))
    mix = shares.select(k.alias("k"), F.array_max(ps).alias("p_max"), _total(ps, lambda p: F.pow(p, k / F.lit(float(GRID)))).alias("z"))
    # figures of the whole mixture are scalars of a one-row query
    whole = sources.agg(F.sum("n").alias("total"))
    sources = sources.select("src", "n", mix.select("k").scalar().alias("k"), mix.select("p_max").scalar().alias("p_max"), mix.select("z").scalar().alias("z"), whole.scalar().alias("total"))
    a = F.col("k") / F.lit(float(GRID))
    p = F.col("n") / F.col("total")
    micro = F.when(F.col("n") > 0, F.floor(F.pow(F.col("p_max") / p, 1 - a) * 1_000_000 + 0.5)).otherwise(1_000_000).cast("bigint")
    plan = sources.select("src", "n", micro.alias("micro"), a.alias("exponent"), F.when(F.col("n") > 0, F.pow(p, a) / F.col("z")).otherwise(0.0).alias("weight"))
    passes = plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("cast(micro div 1000000 as int)"))))
    put = cells.join(passes, "src").withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), "src", F.col("pass").cast("string"), F.col("block").cast("string"))))
    w = Window.partitionBy("src", "pass").orderBy("order", "block")
    left = F.expr("CASE WHEN pass < micro div 1000000 THEN n ELSE ((micro % 1000000) * n) div 1000000 END")
    ranked = put.withColumn("block_rank", F.row_number().over(w) - 1).withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("left", left)
    whole = F.expr("pass < micro div 1000000")
    return ranked.filter(whole | ((F.col("left") > 0) & (F.col("upto") <= F.col("left")))).select("src", "block", "pass", "block_rank", "exponent", "weight")


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Every row of docs once for each pass that takes its block: docs' columns, then
    mix_tokens, mix_pass, mix_block, mix_rank, mix_exponent and mix_weight.

    Read in the order of (mix_pass, mix_rank) the rows are the mixture."""
    prepare(docs.sparkSession)
    if clash := {c for c in docs.columns if c.startswith("mix_")}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    block = F.expr("cast(conv(substr(md5(concat('%s', '|', coalesce(cast(doc_id as string), ''))), 1, 6), 16, 10) as int) %% %d" % (seed.replace("'", "''"), BLOCKS))
    rows = docs.select(F.struct(*docs.columns).alias("row"), src.alias("src"), block.alias("block"), n_tokens().alias("tokens"))
    chosen = keep(schedule(rows.select("src", "block", "tokens"), target_entropy, max_repeat, seed), "mix-schedule")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, ["src", "block"]).select(
        "row.*",
        F.col("tokens").alias("mix_tokens"),
        F.col("pass").alias("mix_pass"),
        F.col("block").alias("mix_block"),
        F.col("block_rank").alias("mix_rank"),
        F.col("exponent").alias("mix_exponent"),
        F.col("weight").alias("mix_weight"),
    )


#: The same in DuckDB SQL, over a relation "docs" (doc_id, text, source).
SQL = f"""
docs_t AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS src,
         ('0x' || substr(md5('{SEED}' || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6))::BIGINT % {BLOCKS} AS block,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0) AS tokens
  FROM docs),
cells AS (SELECT src, block, sum(tokens)::BIGINT AS tokens FROM docs_t GROUP BY 1, 2),
sources AS (SELECT src, sum(tokens)::BIGINT AS n FROM cells GROUP BY 1),
ps AS (SELECT src, n / (SELECT sum(n) FROM sources)::DOUBLE AS p FROM sources WHERE n > 0),
grid AS (SELECT k, k / {GRID}.0::DOUBLE AS a FROM range(0, {GRID} + 1) t(k)),
zs AS (SELECT k, a, sum(pow(p, a)) AS z, sum(pow(p, a) * ln(p)) AS l FROM grid, ps GROUP BY 1, 2),
by_entropy AS (SELECT max(k) AS k FROM zs WHERE ln(z) - a * l / z >= {TARGET_ENTROPY} * ln((SELECT count(*) FROM ps)) - 1e-9),
by_repeat AS (SELECT {GRID} - max(k) AS k FROM grid WHERE pow((SELECT max(p) / min(p) FROM ps), a) <= {MAX_REPEAT} + 1e-9),
best AS (SELECT greatest(by_entropy.k, by_repeat.k) AS k FROM by_entropy, by_repeat),
plan AS (
  SELECT src, n, k / {GRID}.0::DOUBLE AS exponent,
         CASE WHEN n > 0 THEN floor(pow((SELECT max(p) FROM ps) / (n / (SELECT sum(n) FROM sources)::DOUBLE), 1 - k / {GRID}.0::DOUBLE) * 1000000 + 0.5)::BIGINT ELSE 1000000 END AS micro
  FROM sources, best),
passes AS (SELECT *, unnest(range(0, micro // 1000000 + 1)) AS pass FROM plan),
ranked AS (
  SELECT c.src, c.block, pass, micro, exponent,
         CASE WHEN pass < micro // 1000000 THEN n ELSE ((micro % 1000000) * n) // 1000000 END AS lft,
         row_number() OVER w - 1 AS block_rank, sum(tokens) OVER w AS upto
  FROM cells c JOIN passes p USING (src)
  WINDOW w AS (PARTITION BY c.src, pass ORDER BY md5(concat_ws('|', '{SEED}', c.src, CAST(pass AS VARCHAR), CAST(c.block AS VARCHAR))), c.block ROWS UNBOUNDED PRECEDING)),
chosen AS (SELECT * FROM ranked WHERE pass < micro // 1000000 OR (lft > 0 AND upto <= lft))
"""
