"""Resharding with the fewest moved bytes, as a minimum-cost flow.

The old layout holds documents by the hash of their text, so equal texts lie in
one old shard and in one block.  Old shard sizes and new capacities make a
transport network: keeping bytes costs nothing, moving one costs one.  Its
cheapest flow says how many bytes each old shard hands to each new one; whole
blocks realise it, the largest first.  A block too large for that is cut by
further bits of the text's hash, and its large texts become blocks of their own.
Equal texts stay in one shard; only a text whose copies together outgrow a shard is
cut, by a hash of the ids.  Only shards that lose or gain a block are written anew.

Defined cases: a null text counts 0 bytes and has the checksum of no bytes; null
ids are allowed; repeated rows are rows of their own with slots of their own;
an empty table gives an empty result and a plan without moves; columns beside
doc_id and text are ignored by the plan and carried along by rewrite().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare

SHARDS = 24
OLD_SHARDS = 16
BLOCKS = 256  # per old shard
CELLS = 64  # parts of a hot block, and of a hot text
#: Documents that one rank window should hold on average.
RANK_ROWS = 50_000


def min_cost_flow(supply: list, demand: list, cost) -> list:
    """Integer flow [i][j] of least total cost from supplies to demands (equal sums),
    by successive cheapest augmenting paths (Bellman-Ford on the residual network)."""
    n, m = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow = [[0] * m for _ in range(n)]
    while any(left):
        far = [0 if left[i] else None for i in range(n)]
        to, back_i, back_j = [None] * m, [None] * n, [None] * m
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if far[i] is None:
                    continue
                for j in range(m):
                    d = far[i] + cost(i, j)
                    if to[j] is None or d < to[j]:
                        to[j], back_j[j], changed = d, i, True
            for j in range(m):
                if to[j] is None:
                    continue
                for i in range(n):
                    if flow[i][j] and (far[i] is None or to[j] - cost(i, j) < far[i]):
                        far[i], back_i[i], changed = to[j] - cost(i, j), j, True
        end = min((j for j in range(m) if room[j] and to[j] is not None), key=lambda j: to[j])
        path, j = [], end
        while True:
            i = back_j[j]
            path.append((i, j, 1))
            if back_i[i] is None or (far[i] == 0 and left[i]):
                break
            path.append((i, back_i[i], -1))
            j = back_i[i]
        much = min([left[i], room[end], *(flow[a][b] for a, b, s in path if s < 0)])
        for a, b, s in path:
            flow[a][b] += s * much
        left[i] -= much
        room[end] -= much
    return flow


def assign_blocks(blocks: list, capacity: list) -> dict:
    """{block: new shard} for blocks [(old shard, block, bytes)]: flows realised with whole blocks."""
    n_old = max([b[0] for b in blocks], default=-1) + 1
    sizes = [0] * max(n_old, len(capacity))
    for old, _, size in blocks:
        sizes[old] += size
    demand = list(capacity) + [0] * (len(sizes) - len(capacity))
    flow = min_cost_flow(sizes, demand, lambda i, j: int(i != j))
    room = list(capacity)
    out = {}
    own: dict = {}
    for old, block, size in sorted(blocks, key=lambda b: (-b[2], b[1])):
        quota = own.setdefault(old, {j: f for j, f in enumerate(flow[old]) if f})
        fits = [j for j, f in quota.items() if f >= size] or [j for j, f in quota.items() if f > 0 and room[j] >= size]
        # a block that no quota holds goes where most room is left
        j = max(fits, key=lambda j: (j == old, quota[j], -j)) if fits else max(range(len(room)), key=lambda j: (room[j], -j))
        quota[j] = quota.get(j, 0) - size
        room[j] -= size
        out[block] = j
    return out


#: What names a block: old shard, two parts of the text's hash, the hash of a large text, a part of its ids.
BLOCK = {"old": "int", "part": "int", "sub": "int", "own": "bigint", "cut": "int"}


def facts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, size, text_crc32 and the block of every row; the text itself goes no further.

    Blocks: the old shard and a hash of the text; parts of hot blocks follow in plan()."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    h = F.shiftrightunsigned(F.xxhash64(F.sha2(data, 256)), 1)  # not negative
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(data) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(h, F.lit(OLD_SHARDS)).cast("int").alias("old"),
        F.pmod(F.shiftright(h, 8), F.lit(BLOCKS)).cast("int").alias("part"),
        F.pmod(F.shiftright(h, 16), F.lit(CELLS)).cast("int").alias("sub"),
        h.alias("own"),
        F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(CELLS)).cast("int").alias("cut"),
        *columns,
    )


def _marked(rows: DataFrame, hot: set, keys: list, then: str) -> DataFrame:
    """rows with -1 in column then where keys are not in hot, which has 16 x shards entries at most."""
    if not hot:
        return rows.withColumn(then, F.lit(-1).cast(BLOCK[then]))
    table = rows.sparkSession.createDataFrame(sorted(hot), ", ".join(f"{k} {BLOCK[k]}" for k in keys)).withColumn("_hot", F.lit(True))
    out = rows.join(F.broadcast(table), keys, "left")
    return out.withColumn(then, F.when(F.col("_hot"), F.col(then)).otherwise(-1).cast(BLOCK[then])).drop("_hot")


def _sizes(rows: DataFrame, keys: list, above: float = -1) -> dict:
    """Bytes of the groups of rows by keys that have more than above."""
    sums = rows.groupBy(*keys).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > above)
    return {tuple(r[k] for k in keys): r["bytes"] for r in sums.collect()}


def plan(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, dict, DataFrame]:
    """(rows with their block, summary, block table with the new shard); rows are from facts().

    A block of more than a sixteenth of a shard is planned by its CELLS parts, and texts above that by
    themselves: there are at most 16 x shards such blocks, parts and texts, and shards texts that
    outgrow a shard, so what is collected is bounded by OLD_SHARDS x BLOCKS + 17 x shards x CELLS +
    16 x shards sizes, whatever the input.  Small texts of one part stay one block."""
    spark = rows.sparkSession
    keys = list(BLOCK)
    sizes = _sizes(rows, keys[:2])
    total = sum(sizes.values())
    limit = total / shards / 16
    hot = {k for k, v in sizes.items() if v > limit}
    rows = _marked(rows, hot, keys[:2], "sub")
    finer = _sizes(rows.filter("sub >= 0"), keys[:3]) if hot else {}
    hotter = {k for k, v in finer.items() if v > limit}
    large, cut = {}, {}
    if hotter:
        inside = spark.createDataFrame(sorted(hotter), ", ".join(f"{k} {BLOCK[k]}" for k in keys[:3]))
        large = _sizes(rows.join(F.broadcast(inside), keys[:3]), keys[:4], limit)
        giants = {k for k, v in large.items() if v > total / shards}
    else:
        giants = set()
    rows = _marked(rows, set(large), keys[:4], "own")
    if giants:
        rows = _marked(rows, giants, keys[:4], "cut")
        cut = _sizes(rows.filter("cut >= 0"), keys)
    else:
        rows = rows.withColumn("cut", F.lit(-1))
    blocks = [((*k, -1, -1, -1), v) for k, v in sizes.items() if k not in hot]
    rest = dict(finer)
    for k, v in large.items():
        rest[k[:3]] -= v
    blocks += [((*k, -1, -1), v) for k, v in rest.items() if v]
    blocks += [((*k, -1), v) for k, v in large.items() if k not in giants]
    blocks += list(cut.items())
    blocks = [(k[0], k, v) for k, v in blocks]
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    to = assign_blocks(blocks, capacity)
    moved = sum(v for old, k, v in blocks if to[k] != old)
    table = spark.createDataFrame([(*k, to[k]) for _, k, _ in blocks], ", ".join(f"{k} {v}" for k, v in BLOCK.items()) + ", shard int")
    touched = sorted({s for old, k, _ in blocks if to[k] != old for s in (old, to[k]) if s < shards})
    return rows, {"bytes": total, "moved": moved, "blocks": len(blocks), "touched": touched}, table


def reshard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard per row of docs.

    law is ``bytes``.  Slots count from 0 in each shard: rows are ranked within
    pieces of blocks, and the pieces' counts are summed up, so no task holds a shard."""
    prepare(docs.sparkSession)
    rows = keep(facts(docs), "shard-facts")
    n = rows.count()
    rows, _, table = plan(rows, shards)
    pieces = max(1, min(4096, n // RANK_ROWS))
    put = rows.join(table, list(BLOCK)).withColumn("piece", F.pmod(F.xxhash64(F.lit(11), "old", "part", "doc_id", "text_crc32"), F.lit(pieces)).cast("int"))
    counts = put.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size"))
    return (
        put.withColumn("rank", rank)
        .join(starts, ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
    )


def rewrite(docs: DataFrame, path: str, shards: int = SHARDS) -> dict:
    """Writes the shards that the plan touches under path/shard=k, each in as many files
    as its blocks ask for, and leaves the others as they lie; returns the plan's summary."""
    prepare(docs.sparkSession)
    full = facts(docs, *(F.col(c).alias(f"doc_{i}") for i, c in enumerate(docs.columns)))
    full, summary, table = plan(full, shards)
    out = full.join(table, list(BLOCK)).filter(F.col("shard").isin([*summary["touched"], -1]))
    (
        out.select(*(F.col(f"doc_{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("shard").alias("shard"), "part")
        .repartition("shard", F.expr("part div 16"))
        .drop("part")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    )
    return summary
