"""Packing of token sequences by non-negative least squares.

Documents become token ids with one id 0 at the end and are cut into windows of
at most WINDOW ids, so that what is left is a histogram of piece lengths.  All
ways to fill a window exactly with one, two or three lengths are enumerated;
non-negative least squares (accelerated projected gradient steps) finds how
often each is used so that the histogram is met; the counts are rounded, and
greedy best-fit packing places the pieces left over.  The plan's size is bounded
by the window, whatever the input, and is broadcast; pieces find their place by
their rank among pieces of equal length.

Defined cases: a null text is an empty one, a single id 0; ids may be null or
repeat, each row's pieces are placed; texts are tokenised whole; an empty table
gives an empty result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare

WINDOW = 1024
#: Gradient steps of the least squares.
STEPS = 400
#: Pieces that one rank window should hold on average: the root of their number, this at least.
RANK_ROWS = 1_000
SPECIAL = "<|endoftext|>"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE of a tokenizer file, with the merges run by tiktoken; texts that
    spell out the special token, or that it cannot encode, go to the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow, self.added = path, None, added

    def ids(self, text: str) -> np.ndarray:
        if not any(a in text for a in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except Exception:  # noqa: BLE001  the regular expression engine gives up on some texts
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


PIECES = "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of at most window ids of every document; with_ids adds them as little-endian uint32 bytes."""
    prepare(docs.sparkSession)
    path = path or tokenizer_path()
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches):
        encoder = Encoder(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.ids(text or ""), np.uint32(0)).astype("<u4")
                for at in range(0, len(ids), window):
                    raw = ids[at : at + window].tobytes()
                    rows.append((doc, at, len(raw) // 4, zlib.crc32(raw), len(ids)) + ((raw,) if with_ids else ()))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """(n, 3) lengths a <= b <= c with a + b + c = window, 0 standing for none; all in the histogram."""
    there = counts > 0
    there[0] = True
    a, b = np.meshgrid(np.arange(window // 3 + 1), np.arange(window // 2 + 1), indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c) & ((a == 0) | (b > 0))
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[a] & there[b] & there[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def solve(counts: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - counts|^2, A from the combinations."""
    if not len(combos):
        return np.zeros(0)
    n = len(counts)

    def down(x):
        y = np.bincount(combos.ravel(), np.repeat(x, 3), n)
        y[0] = 0
        return y

    def up(r):
        r = r.copy()
        r[0] = 0
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue gives the step
        v = up(down(v))
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(len(combos))
    t = 1.0
    target = counts.astype(float)
    for _ in range(steps):
        new = np.maximum(z - up(down(z) - target) / (1.01 * top), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict, window: int = WINDOW) -> list:
    """[(lengths, repeats)] that use up the histogram {length: pieces}, each within the window."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    if counts[window]:
        out.append(((window,), int(counts[window])))
        counts[window] = 0
    combos = combinations(counts, window)
    x = solve(counts, combos)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        used, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = int(min(np.floor(x[k] + 0.5), (counts[used] // times).min()))
        if n > 0:
            counts[used] -= n * times
            out.append((tuple(int(v) for v in combos[k][::-1] if v), n))
    left = counts
    while (have := np.flatnonzero(left)).size:
        bin_, gap = [], window
        trial = left.copy()
        while gap and (k := np.searchsorted(have, gap, "right")) and (fit := have[:k][trial[have[:k]] > 0]).size:
            bin_.append(int(fit[-1]))
            trial[fit[-1]] -= 1
            gap -= fit[-1]
        used, times = np.unique(bin_, return_counts=True)
        n = int((left[used] // times).min())
        left[used] -= n * times
        out.append((tuple(bin_), n))
    return out


def places(layout: list, window: int) -> dict:
    """Arrays keyed by length and first rank: sequence and offset of the piece with that rank."""
    key, seq, off = [], [], []
    cursor = np.zeros(window + 1, np.int64)
    base = 0
    for lengths, n in layout:
        at = 0
        # equal lengths in one combination take turns of n ranks each
        for length in lengths:
            key.append((length << 44) + int(cursor[length]))
            seq.append(base - int(cursor[length]))
            off.append(at)
            cursor[length] += n
            at += length
        base += n
    order = np.argsort(key, kind="stable")
    return {"key": np.array(key, np.int64)[order], "seq": np.array(seq, np.int64)[order], "off": np.array(off, np.int64)[order]}


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; every id of every document lies in exactly one."""
    spark = docs.sparkSession
    cut = keep(pieces(docs, path, window, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # window rows at most
    sent = spark.sparkContext.broadcast(places(plan(histogram, window), window))
    rows = max(RANK_ROWS, math.isqrt(sum(histogram.values())))
    salts = F.expr("array(%s)" % ",".join(str(1 + histogram.get(k, 0) // rows) for k in range(window + 1)))
    own = ["doc_id", "start", "ids_crc32"]
    put = cut.withColumn("salt", F.pmod(F.xxhash64(*own), F.get(salts, F.col("length"))))
    counts = put.groupBy("length", "salt").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "salt", F.coalesce(upto, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*own)) - 1
    ranked = put.withColumn("rank", rank).join(starts, ["length", "salt"]).select(*cut.columns, (F.col("before") + F.col("rank")).alias("rank"))
    names = [*cut.columns, "sequence_id", "offset"]

    def placed(batches):
        p = sent.value
        for b in batches:
            length = b["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b["rank"].to_numpy(zero_copy_only=False)
            k = np.searchsorted(p["key"], (length << 44) + rank, "right") - 1
            arrays = [b[c] for c in names[:-2]] + [pa.array(p["seq"][k] + rank), pa.array(p["off"][k])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ranked.mapInArrow(placed, PIECES + (", ids binary" if with_ids else "") + ", sequence_id bigint, offset bigint")


def assemble(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id, n_ids and ids of whole sequences (from pack(..., with_ids=True)): padded to
    the window, unless their length is a power of two."""

    def joined(key, rows):
        rows = sorted(zip(rows["offset"].to_pylist(), rows["ids"].to_pylist(), strict=True))
        ids = np.frombuffer(b"".join(r[1] for r in rows), "<u4")
        n = len(ids)
        size = n if n & (n - 1) == 0 else window
        ids = np.append(ids, np.full(size - n, pad)).astype(np.int64)
        return pa.table({"sequence_id": [key[0].as_py()], "n_ids": [n], "ids": [ids.tolist()]}, schema=pa.schema([("sequence_id", pa.int64()), ("n_ids", pa.int32()), ("ids", pa.list_(pa.int64()))]))

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(joined, "sequence_id bigint, n_ids int, ids array<bigint>")
