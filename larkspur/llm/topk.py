"""Exact top-k inner-product search over norm buckets.

Vectors become integers floor(SCALE x).  They are dealt to range partitions by
length, longest first, and within a partition to buckets of similar length.
Queries are searched a block at a time: a block is broadcast, every bucket is
searched with it, and each task keeps the k best per query.  For a bucket the
running k-th best score of a query, divided by the query's length and the
longest length in the bucket, is a local cosine threshold.  Above one the
bucket is left out (length pruning); where it is high, only vectors whose value
in the query's largest coordinate lies in the range that the threshold allows
stay (coordinate pruning); elsewhere a prefix of the bucket by length stays.
What stays is verified by exact products of whole numbers.  The longest vectors
of all are scored first: a query's k-th best among them is a threshold that every
task has from its first bucket on.

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors of another dimension than the query's score nothing with it;
ties go to the smaller vec_id; rows that repeat a vec_id are queries and
candidates of their own, so such a query finds its namesakes and the id has k
rows for each of its rows; null ids take no part as a query and come last among
equals as a candidate; a query without candidates has no rows; integers and
scores beyond the range of long are set to its ends, and scores are ranked so;
other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, prepare, shared_dir

SCALE = 256
K = 5
#: Queries are the rows whose id is divisible by this.
EVERY = 50
#: Queries in a block that is broadcast: 4096 x dimension x 8 bytes.
BLOCK = 4096
#: Vectors in a bucket at most, and the least ratio of lengths in it.
BUCKET, RATIO = 1024, 0.95
#: Local cosine threshold from which coordinates prune.
COORDINATE_FROM = 0.6
#: Longest vectors that are scored first, on the driver.
SEED = 1024
_LAST = (1 << 63) - 1
#: The score of a place not taken; scores begin above it.
_NONE = -(1 << 63)
#: Below this, sums of whole numbers are exact in double precision.
EXACT = 2.0**53 * 0.999


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v array<bigint>, norm): rows with vectors that take part, numbered."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    ok = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    whole = ok.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", norm.alias("norm"))


class Queries:
    """A block of queries of one dimension with their k best so far in this task."""

    def __init__(self, rows, vectors, k: int):
        self.rows, self.whole, self.k = np.array(rows, np.int64), np.array(vectors, np.int64).reshape(len(rows), -1), k
        self.v = self.whole.astype(np.float64)
        self.norm = np.maximum(np.sqrt((self.v**2).sum(1)), 1e-12)
        self.unit = self.v / self.norm[:, None]
        self.focus = np.abs(self.unit).argmax(1) if len(rows) else np.zeros(0, np.int64)
        self.scores = np.full((len(rows), k), _NONE)
        self.found = np.full((len(rows), k), _LAST)
        self.floor = np.full(len(rows), -np.inf)

    def least(self) -> np.ndarray:
        """For each query a score that its k-th best reaches."""
        last = self.scores[:, -1]
        return np.maximum(np.where(last == _NONE, -np.inf, last.astype(np.float64)), self.floor)

    def offer(self, q, scores, ids) -> None:
        """Scores (len(q), n) of the vectors ids against queries q; _NONE leaves one out."""
        down = ~np.concatenate([self.scores[q], scores], 1)  # ascending where scores descend, without overflow
        all_i = np.concatenate([self.found[q], np.broadcast_to(ids, scores.shape)], 1)
        if scores.shape[1] > 4 * self.k:  # ties at the k-th place all stay for the exact order
            least = np.partition(down, self.k - 1, 1)[:, self.k - 1]
            deep = int((down <= least[:, None]).sum(1).max())
            if deep < down.shape[1]:
                top = np.argpartition(down, deep, 1)[:, :deep]
                down, all_i = np.take_along_axis(down, top, 1), np.take_along_axis(all_i, top, 1)
        order = np.lexsort((all_i, down), 1)[:, : self.k]
        self.scores[q], self.found[q] = ~np.take_along_axis(down, order, 1), np.take_along_axis(all_i, order, 1)

    def search(self, rows: np.ndarray, ids: np.ndarray, whole: np.ndarray, norm: np.ndarray) -> None:
        """A bucket: vectors of whole numbers (longest first) with their lengths."""
        if whole.shape[1] != self.v.shape[1] or not len(self.rows):
            return
        longest = max(norm[0], 1e-12)
        least = self.least()
        theta = least / (self.norm * longest)  # local cosine threshold
        live = np.flatnonzero(theta <= 1 + 1e-9)  # length pruning of the bucket
        by_coordinate = live[theta[live] >= COORDINATE_FROM]
        rest = live[theta[live] < COORDINATE_FROM]
        if len(by_coordinate):
            unit = whole / np.maximum(norm, 1e-12)[:, None]
            for f in np.unique(self.focus[by_coordinate]):
                own = by_coordinate[self.focus[by_coordinate] == f]
                # a unit vector with cosine t or more to q has its coordinate f within q_f t -+ sqrt((1 - q_f^2)(1 - t^2))
                t = np.minimum(theta[own], 1.0)
                mid, wide = self.unit[own, f] * t, np.sqrt(np.maximum((1 - self.unit[own, f] ** 2) * (1 - t * t), 0)) + 1e-9
                upper = np.where(self.unit[own, f] >= t, 1.0, mid + wide)
                lower = np.where(-self.unit[own, f] >= t, -1.0, mid - wide)
                order = np.argsort(unit[:, f])
                column = unit[order, f]
                lo, hi = np.searchsorted(column, lower), np.searchsorted(column, upper, "right")
                if (a := lo.min()) < (b := hi.max()):
                    at = order[a:b]
                    self._verify(own, rows[at], ids[at], whole[at], longest)
        if len(rest):
            # vectors too short for every query of the rest are a suffix
            need = (least[rest] / self.norm[rest]).min()
            n = int((norm >= need - 1e-9 * abs(need)).sum()) if np.isfinite(need) else len(norm)
            if n:
                self._verify(rest, rows[:n], ids[:n], whole[:n], longest)

    def _verify(self, q, rows, ids, whole, longest) -> None:
        if self.norm[q].max() * longest < EXACT:  # so is every partial sum
            products = (self.v[q] @ whole.T.astype(np.float64)).astype(np.int64)
        else:
            exact = self.whole[q].astype(object) @ whole.T.astype(object)
            products = np.clip(exact, _NONE + 1, _LAST).astype(np.int64)
        products[rows[None] == self.rows[q][:, None]] = _NONE
        self.offer(q, products, ids)


def search(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query."""
    spark = rows.sparkSession
    prepare(spark)
    vectors = keep(integers(rows, scale), "vectors")  # written, so the numbers of rows stay
    queries = vectors.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    # queries numbered in blocks: a count per hash part, so that no task sorts them all
    n = queries.count()
    blocks = max(1, -(-n // (BLOCK // 2)))
    queries = keep(queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "queries")
    ordered = keep(vectors.withColumn("tie", F.xxhash64("row")).repartitionByRange(F.desc("norm"), F.asc("tie")).sortWithinPartitions(F.desc("norm")).drop("tie"), "by-length")
    forget(vectors)
    longest = _by_size(ordered.orderBy(F.desc("norm"), "row").limit(SEED).collect())
    path = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    for block in range(blocks):
        own = queries.filter(F.col("block") == block).limit(BLOCK + 1).collect()
        if len(own) > BLOCK:
            raise RuntimeError("a block of queries outgrew its bound")
        sized = {}
        for d, asking in _by_size(own).items():
            seed = Queries(asking["row"], asking["v"], k)
            if d in longest:
                x = longest[d]
                seed.search(np.array(x["row"], np.int64), np.array(x["id"], np.int64), np.array(x["v"], np.int64), np.array(x["norm"]))
            sized[d] = (seed.rows, seed.whole, seed.least())
        sent = spark.sparkContext.broadcast(sized)
        _block(ordered, sent, k).write.mode("append").parquet(path)
        sent.destroy()
    forget(ordered)
    found = spark.read.schema("row bigint, vec_id bigint, score bigint").parquet(path)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    asked = queries.select("row", F.col("vec_id").alias("query_id"))
    return best.join(asked, "row").select("query_id", "rank", F.when(F.col("vec_id") == _LAST, None).otherwise(F.col("vec_id")).alias("vec_id"), "score")


def _by_size(rows) -> dict:
    """Collected rows as lists of columns, by dimension; their order stays."""
    sizes: dict = {}
    for r in rows:
        own = sizes.setdefault(len(r["v"]), {"row": [], "id": [], "v": [], "norm": []})
        own["row"].append(r["row"])
        own["id"].append(_LAST if r["vec_id"] is None else r["vec_id"])
        own["v"].append(r["v"])
        own["norm"].append(r["norm"] if "norm" in r else 0.0)
    return sizes


def _block(ordered: DataFrame, sent, k: int) -> DataFrame:
    """The k best of each query of a block, per task."""

    def run(batches):
        state = {}
        for d, (rows, whole, floor) in sent.value.items():
            state[d] = Queries(rows, whole, k)
            state[d].floor = floor
        held: dict = {}

        def flush(d):
            rows, ids, norm, v = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            at = 0
            while at < len(ids):
                end = min(at + BUCKET, at + int(np.searchsorted(-norm[at:], -RATIO * norm[at], "right")))
                end = max(end, at + 1)
                state[d].search(rows[at:end], ids[at:end], v[at:end], norm[at:end])
                at = end

        for b in batches:
            lists = b["v"]
            rows = b["row"].to_numpy(zero_copy_only=False)
            ids = b["vec_id"].fill_null(_LAST).to_numpy(zero_copy_only=False)
            norm = b["norm"].to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            for d in np.unique(size).tolist():
                if d in state and d:
                    at = np.flatnonzero(size == d)
                    held.setdefault(d, []).append((rows[at], ids[at], norm[at], values[begin[at][:, None] + np.arange(d)]))
                    if sum(len(x[0]) for x in held[d]) >= 4 * BUCKET:
                        flush(d)
        for d in list(held):
            flush(d)
        out = [(q, i, s) for st in state.values() for q, row_i, row_s in zip(st.rows.tolist(), st.found.tolist(), st.scores.tolist(), strict=True) for i, s in zip(row_i, row_s, strict=True) if s != _NONE]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "vec_id", "score"])

    return ordered.mapInArrow(run, "row bigint, vec_id bigint, score bigint")
