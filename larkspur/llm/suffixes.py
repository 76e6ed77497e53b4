"""Suffix-array dedup: removal of byte strings that occur more than once.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else
in the corpus, the same document included.  Such strings are neighbours in the
corpus' suffix array; the array is built by the difference-cover algorithm, and
neighbouring suffixes are compared on their first LENGTH bytes.

What is sorted is first narrowed down without loss.  Equal texts are one class;
a class of several rows of at least LENGTH bytes goes entirely.  In every string
of LENGTH bytes the K-byte substring with the least hash (its anchor, the
leftmost of equal ones) depends on the string alone, so two equal strings have
equal anchors at equal places: only starts whose anchor occurs again can
repeat.  The starts of one anchor are a run; the run's bytes are its context.
Contexts are dealt by anchor to partitions and sorted there, anchor by anchor,
in batches of bounded size: triples at the positions 1 and 2 modulo 3 are sorted
and named, their names are sorted by recursion until they are unique or longer
than LENGTH, the remaining suffixes follow from them and are merged in.

An anchor with more than HOT_ROWS contexts is cut by the offset of the start and
by a hash of the bytes all those starts share, and its contexts pass a first
round over salted parts that leaves one of equal contexts to the second.

Defined cases: null is the empty text; texts shorter than LENGTH stay; ids may
be null or repeat (rows are told apart by text, and rows with equal texts are
copies of each other); texts are read in pieces; an empty table gives an empty
result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare

LENGTH = 400
K = 100
PIECE = 1 << 19
#: Contexts of an anchor from which on they are cut further and salted.
HOT_ROWS = 2_000
#: Offsets of starts that share a cut.
STRIDE = 32
#: Bytes of contexts sorted at a time.
BATCH_BYTES = 1 << 20

_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_tables = None


def _powers():
    global _tables
    if _tables is None:
        n = PIECE + 2 * LENGTH
        up, down = np.full(n, _B, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        _tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables


def anchors(data: bytes, length: int = LENGTH, k: int = K):
    """(hash, place, first start, end of starts) of the anchors of all strings of length bytes."""
    up, down = _powers()
    out = []
    w = length - k + 1
    for at in range(0, len(data) - length + 1, PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(up[: len(b)] * (b.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: len(b) - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        m, starts = len(h), len(b) - length + 1
        key = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (h & ~np.uint64((1 << 20) - 1)) | np.arange(m, dtype=np.uint64)
        blocks = key.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        pos = place[lo]
        out.append((h[pos].view(np.int64), pos + at, lo + at, np.append(lo[1:], starts) + at))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def alone(data: bytes, found: list, length: int = LENGTH):
    """(anchors left, runs): where a text holds equal contexts more than once their starts repeat
    already; one of each is left to be compared with other texts.  Runs are joined (from, to) starts."""
    h, pos, lo, hi = found
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[inverse] > 1)
    if not len(again):
        return found, []
    seen: dict = {}
    for i in again.tolist():
        seen.setdefault((int(h[i]), int(pos[i] - lo[i]), data[lo[i] : hi[i] - 1 + length]), []).append(i)
    drop, runs = [], []
    for same in seen.values():
        if len(same) > 1:
            drop += same[1:]
            runs += [(int(lo[i]), int(hi[i])) for i in same]
    left = np.ones(len(h), bool)
    left[drop] = False
    return [x[left] for x in found], joined(sorted(runs))


def joined(runs: list) -> list:
    """Sorted runs with those that touch made one."""
    out: list = []
    for s, e in runs:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of rows of two or three columns of values below 2^31, equal rows alike."""
    if len(columns) == 3:
        if max(int(c.max(initial=0)) for c in columns) >= 1 << 21:
            return names(names(*columns[:2])[0], columns[2])
        key = (columns[0] << 42) | (columns[1] << 21) | columns[2]
    else:
        key = (columns[0] << 31) | columns[1]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), np.int64)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum())


def ranks(t: np.ndarray, depth: int, want: np.ndarray | None = None, covered: int = 1) -> np.ndarray:
    """Ranks from 1 of the suffixes of t (letters > 0) by difference covers modulo 3.

    Recursion ends at names of depth letters of the first level, so suffixes that agree
    that far are neighbours in any order.  want: other suffixes may be left out (rank 0)."""
    n = len(t)
    if n < 8:
        out = np.zeros(n, np.int64)
        letters = t.tolist()
        out[sorted(range(n), key=lambda i: letters[i:])] = np.arange(1, n + 1)
        return out
    pad = np.concatenate([t, np.zeros(4, np.int64)])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    name, distinct = names(pad[sample], pad[sample + 1], pad[sample + 2])
    if distinct < len(sample) and covered * 3 < depth:
        name = ranks(name, depth, None, covered * 3)
    order = sample[np.argsort(name)]
    order = order[order < n]
    rank = np.zeros(n + 4, np.int64)
    if distinct < len(sample) and covered * 3 >= depth:
        rank[sample] = name
        rank[n:] = 0
    else:
        rank[order] = np.arange(1, len(order) + 1)
    zero = np.arange(0, n, 3)
    if want is not None:
        zero = zero[want[zero]]
    pick = zero[np.argsort((pad[zero] << 31) | rank[zero + 1])]
    # merge: how many sample suffixes lie below each of the others, by bisection
    letters = pad[order]
    lo, hi = np.searchsorted(letters, pad[pick]), np.searchsorted(letters, pad[pick], "right")
    live = np.flatnonzero(lo < hi)
    while live.size:
        mid = (lo[live] + hi[live]) >> 1
        i, j = pick[live], order[mid]
        # letters are equal; j at 1: then the rank of the next; j at 2: the next letter, the rank of the one after
        by_one = j % 3 == 1
        x, y = np.where(by_one, rank[i + 1], pad[i + 1]), np.where(by_one, rank[j + 1], pad[j + 1])
        below = (y < x) | ((y == x) & ~by_one & (rank[j + 2] < rank[i + 2]))
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)
        live = live[lo[live] < hi[live]]
    lo = np.maximum.accumulate(lo)
    out = np.zeros(n, np.int64)
    out[pick] = lo + np.arange(1, len(pick) + 1)
    at = np.arange(len(order))
    out[order] = at + 1 + np.searchsorted(lo, at, "right")
    return out


def repeats(contexts: list, counts: list, length: int = LENGTH) -> list:
    """For each context (bytes) the starts 0..count-1 whose string of length bytes also starts
    at another start of any context.

    Returns (context number, start, end of starts) runs."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    t = raw.astype(np.int64) + 2
    t[begin + sizes] = 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begin[owner] + offset
    want = np.zeros(len(t), bool)
    want[starts] = True
    rank = ranks(t, length, want)
    order = np.argsort(rank[starts])
    hit = np.zeros(len(starts), bool)
    whole = np.lib.stride_tricks.sliding_window_view(raw, length)
    for at in range(0, len(order) - 1, 4096):  # neighbours, their first length bytes
        a, b = order[at : at + 4097][:-1], order[at : at + 4097][1:]
        near = raw[starts[a] + length - 1] == raw[starts[b] + length - 1]
        a, b = a[near], b[near]
        same = (whole[starts[a]] == whole[starts[b]]).all(1)
        hit[a[same]] = hit[b[same]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (hit * (owner + 1)), [0]])))
    runs = []
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        if hit[s]:
            runs.append((int(owner[s]), int(offset[s]), int(offset[e - 1]) + 1))
    return runs


def _cut(text: bytes, rows: list, length: int):
    """(group, salt, first start, starts, context) for anchors (h, pos, lo, hi, n) of text."""
    for h, pos, lo, hi, n in rows:
        if n <= HOT_ROWS:
            yield h, -1, lo, hi - lo, text[lo : hi - 1 + length]
            continue
        # starts by their offset from the anchor; all starts of a full cut share core
        for c in range((pos - hi + 1) // STRIDE, (pos - lo) // STRIDE + 1):
            first, last = max(lo, pos - STRIDE * (c + 1) + 1), min(hi - 1, pos - STRIDE * c)
            core = text[pos - STRIDE * c : pos - STRIDE * (c + 1) + 1 + length]
            g = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=h.to_bytes(8, "little", signed=True) + bytes([c])).digest(), "little", signed=True)
            yield g, n // HOT_ROWS, first, last - first + 1, text[first : last + length]


def _grouped(batches, keys: tuple):
    """Yields ({context: {place: row}}) of each group of a sorted partition: equal contexts meet, each place once."""
    group: dict = {}
    last = None
    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in b.schema.names), strict=True):
            key = row[: len(keys)]
            if key != last and group:
                yield group
                group = {}
            group.setdefault(row[-1], {})[row[2:5]] = row
            last = key
    if group:
        yield group


CONTEXTS = "g bigint, salt int, c1 bigint, c2 bigint, lo bigint, n int, context binary"
_types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_names = ["g", "salt", "c1", "c2", "lo", "n", "context"]


def _batch(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _types, strict=True)], names=_names)


def classed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and the two words c1, c2 that name equal texts (128 bits of SHA-256)."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sha = F.sha2(data, 256)
    word = lambda a: F.conv(F.substring(sha, a, 16), 16, -10).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), data.alias("data"), word(1).alias("c1"), word(17).alias("c2"))


def starts(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(classes, runs): classes has c1, c2, n_bytes, rows and rep (least id) of all texts;
    runs has c1, c2, lo, hi: starts whose string of length bytes starts elsewhere in another class or place."""
    prepare(docs.sparkSession)
    rows = classed(docs)

    def first(batches):
        for b in batches:
            found, own = [], []
            for d in b["data"].to_pylist():
                f, r = alone(d, anchors(d, length), length) if len(d) >= length else ([np.zeros(0, np.int64)] * 4, [])
                found.append(f)
                own.append([{"lo": a, "hi": z} for a, z in r])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
            parts = [pa.array(np.concatenate([f[k] for f in found]) if found else [], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            items = pa.StructArray.from_arrays(parts, names=["h", "pos", "lo", "hi"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["c1"], b["c2"], pa.compute.binary_length(b["data"]).cast(pa.int64()), pa.ListArray.from_arrays(offsets, items), pa.array(own, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], names=["doc_id", "c1", "c2", "n_bytes", "anchors", "own"])

    schema = "doc_id bigint, c1 bigint, c2 bigint, n_bytes bigint, anchors array<struct<h:bigint,pos:int,lo:int,hi:int>>, own array<struct<lo:bigint,hi:bigint>>"
    prints = keep(rows.select("doc_id", "c1", "c2", "data").mapInArrow(first, schema), "anchors")
    classes = keep(prints.groupBy("c1", "c2", "n_bytes").agg(F.count("*").alias("rows"), F.min("doc_id").alias("rep")), "classes")
    reps = prints.join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    places = reps.select("c1", "c2", "rep", F.explode("anchors").alias("a")).select("c1", "c2", "rep", "a.*").distinct()
    places = keep(places, "places")
    often = places.groupBy("h").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    wanted = places.join(often, "h").groupBy("c1", "c2", "rep").agg(F.collect_list(F.struct("h", "pos", "lo", "hi", "n")).alias("a"))
    wanted = keep(wanted, "wanted")
    texts = rows.alias("r").join(wanted.alias("w"), (F.col("r.c1") == F.col("w.c1")) & (F.col("r.c2") == F.col("w.c2")) & F.col("r.doc_id").eqNullSafe(F.col("w.rep"))).select("w.c1", "w.c2", "a", "data")

    def contexts(batches):
        for b in batches:
            for c1, c2, a, data in zip(*(b[c].to_pylist() for c in ("c1", "c2", "a", "data")), strict=True):
                made, size = [], 0
                for g, salts, lo, n, context in _cut(data, [(x["h"], x["pos"], x["lo"], x["hi"], x["n"]) for x in a], length):
                    salt = -1 if salts < 0 else (c1 & 0x7FFFFFFF) % (salts + 1)
                    made.append((g, salt, c1, c2, lo, n, context))
                    size += len(context)
                    if size > 4 << 20:
                        yield _batch(made)
                        made, size = [], 0
                if made:
                    yield _batch(made)

    cut = keep(texts.mapInArrow(contexts, CONTEXTS), "contexts")

    def once(batches):
        """Leaves one of equal contexts of a salted part; all but single ones repeat as a whole (context null)."""
        out, size = [], 0
        for group in _grouped(batches, ("g", "salt")):
            for context, same in group.items():
                r = next(iter(same.values()))
                if len(same) > 1:
                    texts: dict = {}
                    for x in same.values():
                        texts.setdefault(x[2:4], []).append((x[4], x[4] + x[5]))
                    out.extend((r[0], -2, *c, s, e - s, None) for c, runs in texts.items() for s, e in joined(sorted(runs)))
                out.append((r[0], -1, *r[2:6], context))
                size += len(context) + 20 * len(same)
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    order = ["g", "salt", "c1", "c2", "lo"]
    hot = cut.filter("salt >= 0").repartition("g", "salt").sortWithinPartitions(*order).mapInArrow(once, CONTEXTS)
    hot = keep(hot, "hot")
    last = cut.filter("salt < 0").unionByName(hot.filter("salt = -1"))

    def search(batches):
        """Equal contexts repeat as a whole; the different ones of a group go to a suffix array, some groups at a time."""
        found, held, size = [], [], 0

        def flush():
            for k, s, e in repeats([r[-1] for r in held], [r[5] for r in held], length):
                found.append((held[k][2], held[k][3], held[k][4] + s, held[k][4] + e))

        for group in _grouped(batches, ("g",)):
            for same in group.values():
                if len(same) > 1:
                    found.extend((r[2], r[3], r[4], r[4] + r[5]) for r in same.values())
            if len(group) > 1:  # starts of one anchor lie at different offsets: within one context none repeats another
                first = [next(iter(same.values())) for same in group.values()]
                held += first
                size += sum(len(r[-1]) + 1 for r in first)
                if size > BATCH_BYTES:
                    flush()
                    held, size = [], 0
            if len(found) > 50_000:
                yield _runs(found)
                found = []
        if held:
            flush()
        yield _runs(found)

    runs = last.repartition("g").sortWithinPartitions("g", "c1", "c2", "lo").mapInArrow(search, "c1 bigint, c2 bigint, lo bigint, hi bigint")
    runs = runs.unionByName(hot.filter("salt = -2").select("c1", "c2", "lo", (F.col("lo") + F.col("n")).alias("hi")))
    inner = reps.select("c1", "c2", F.explode("own").alias("o")).select("c1", "c2", "o.lo", "o.hi").distinct()
    return classes, keep(runs.unionByName(inner), "runs")


def _runs(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["c1", "c2", "lo", "hi"])


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def removed(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; with_text adds
    spans (array of [from, to) byte offsets) and kept (the bytes that stay)."""
    classes, runs = starts(docs, length)
    # a place is read from one class row, whatever the number of its copies
    per = runs.groupBy("c1", "c2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    copied = classes.filter((F.col("rows") > 1) & (F.col("n_bytes") >= length)).select("c1", "c2", F.lit(True).alias("copied"))
    marks = per.join(copied, ["c1", "c2"], "full").withColumnRenamed("c1", "m1").withColumnRenamed("c2", "m2")
    rows = classed(docs).join(marks, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")), "left").select("doc_id", "data", "runs", "copied")

    def cut(batches):
        for b in batches:
            out = []
            for doc, data, found, copied in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans: list = []
                if copied:
                    spans = [[0, len(data)]]
                else:
                    for s, e in sorted((x["lo"], x["hi"] + length - 1) for x in found or ()):
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(e, spans[-1][1])
                        else:
                            spans.append([s, e])
                left, at = [], 0
                for s, e in spans:
                    left.append(data[at:s])
                    at = e
                kept = b"".join(left) + data[at:]
                out.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) + ((spans, kept) if with_text else ()))
            kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.list_(pa.list_(pa.int64())), pa.binary()] if with_text else [])
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            names_ = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names_)

    return rows.mapInArrow(cut, RESULT + (", spans array<array<bigint>>, kept binary" if with_text else ""))
