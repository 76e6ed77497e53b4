"""Exact set-similarity self-join of the units (lines, or whole texts) of a corpus.

A unit is the set of its tokens' hashes.  Equal sets are one class, whose first
unit stands for it; classes are numbered in the order of their first units (by
doc_id, null ids last, then by a hash of the text, then by number).  Members are
ordered by rarity: a sketch of token counts over the whole corpus ranks them,
rarest first, a hash breaks ties.  Two different sets of Jaccard similarity t
share a member among the first n - ceil(t n) + 1 of each (prefix filter), have
sizes within the factor t (length filter), have enough members left behind the
first shared one (positional filter), and their parity signatures differ in no
more bits than their symmetric difference may have.  What is left is verified on
the whole sets, which are made again from the texts that hold them.

Most links are settled before that in a number of pairs linear in the input: in
groups of units with equal least members in random orders, each unit meets, of the
first and the last units before it, those with the most similar signatures (``star``).  Then units that are still open meet all earlier ones that share a prefix token
(``cross``), which makes the join exact.  Groups of frequent tokens are dealt to cells, so that a task holds at most the
units of a cell; open units visit all cells of a token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, prepare
from .tokens import SINGLE, Sets, ranges, slices, tally

#: Bands by which units meet the first time; first and last predecessors looked at, and how many of them are met.
BANDS, NEAR, BEST = 2, 64, 2
#: Count class (6 log2 of the count) of a token from which on groups are dealt to cells, for each of the two meetings.
STAR_CLASS, CROSS_CLASS = 72, 84
#: Rounds in which open units meet their groups, each with the tokens of one hash part: what a round shuffles is what lies on disk.
SLICES = 4
#: Pairs looked at at a time.
PAIRS = 1 << 20


@dataclass
class Join:
    """What a join works on: units makes (row, number, hash) of a column, t is the least similarity."""

    docs: DataFrame  # doc_id, t, text
    units: object
    t: float
    sets: DataFrame = None


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text, which tells rows of one id or of none apart) and text of the rows that have a text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text").filter("text is not null")


def classes(docs: DataFrame, units, t: float) -> Join:
    """The join of docs(doc_id, text) with its table of classes: id, void (no doc_id), doc_id, t, number, n, sig, more,
    skip, bands and prefix: the tokens by which the set may meet others, the first of them the skip-th rarest."""
    spark = docs.sparkSession
    prepare(spark)
    slim = keyed(docs)
    sketch = spark.sparkContext.broadcast(tally(slim, units, docs.count()))  # 16 MB at most
    least = t / (1 - t) - 1e-9  # smaller sets match equal ones only

    def made(batches):
        for b in slices(batches, "text"):
            s = Sets(*units(b["text"]), sketch.value)
            (h1, h2), (sig, more) = s.names(), s.parity()
            single = np.bincount(s.unit[(s.key >> np.uint64(56)) <= SINGLE], minlength=len(s.n))  # they come first and stand nowhere else
            length = np.where(s.n >= least, s.n - np.ceil(t * s.n - 1e-9).astype(np.int64) + 1, 0)
            skip = np.minimum(single, length)
            pick = ranges(s.first + skip, length - skip)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length - skip)]), pa.int32()), pa.array(s.key[pick].view(np.int64)))
            row = pa.array(s.row)
            doc = b["doc_id"].take(row)
            numbers = [pa.array(x.astype(d)) for x, d in ((s.number, np.int64), (s.n, np.int64), (sig, np.int64), (more, np.int64), (h1, np.int64), (h2, np.int64), (skip, np.int32))]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(s.n) + 1) * BANDS, pa.int32()), pa.array(np.stack(s.bands(BANDS), 1).ravel()))
            yield pa.RecordBatch.from_arrays([doc.is_null(), doc, b["t"].take(row), *numbers, bands, lists], names=["void", "doc_id", "t", "number", "n", "sig", "more", "h1", "h2", "skip", "bands", "prefix"])

    rows = slim.mapInArrow(made, "void boolean, doc_id bigint, t bigint, number bigint, n bigint, sig bigint, more bigint, h1 bigint, h2 bigint, skip int, bands array<bigint>, prefix array<bigint>")
    first = F.min(F.struct("void", "doc_id", "t", "number", "n", "sig", "more", "skip", "bands", "prefix"))
    once = keep(rows.groupBy("h1", "h2").agg(first.alias("c")).select("c.*"), "set-classes")
    order = ["void", "doc_id", "t", "number"]
    numbered = once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    sets = keep(numbered, "sets")
    forget(once)
    return Join(slim, units, t, sets)


def differing(*pairs) -> np.ndarray:
    """Bits in which signatures differ."""
    return sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in pairs)


def possible(nx, px, ny, py, bits, t: float) -> np.ndarray:
    """Whether sets of sizes n that share a token at places p, with signatures that differ in bits, may have similarity t."""
    total = nx + ny
    need = np.ceil(total * (t / (1 + t)) - 1e-9).astype(np.int64)
    return (np.minimum(nx, ny) >= np.maximum(nx, ny) * t - 1e-9) & (np.minimum(nx - px, ny - py) >= need) & (bits <= total - 2 * need)


def _cells(token, least: int):
    """Cells of a token's group, as many as the sketch's count asks for."""
    more = F.greatest(F.lit(0), F.floor((F.shiftrightunsigned(token, 56) - least) / 6))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), more.cast("int"))


def _group(token, cell, order, bits: int):
    """One number for a cell of a group, its last bits the order in it: rows are sorted by one long.

    Two groups that meet by chance cost a comparison and no more."""
    return F.shiftleft(F.xxhash64(token, cell), bits).bitwiseOR(order.cast("bigint")).alias("group")


def _pairs(found: list):
    x, y = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])


def _starts(group: np.ndarray) -> np.ndarray:
    """For each row of sorted groups the first row of its group."""
    new = np.concatenate([[True], group[1:] != group[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _continued(batches, bits: int, held_of):
    """(columns, first rows of groups, rows seen before) of sorted batches; the first group goes on with the
    rows that held_of chose of it in the batch before."""
    held = None
    for b in batches:
        if b.num_rows:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            old = 0 if held is None else len(held[0])
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)] if old else cols
            begin = _starts(cols[0] >> bits)
            yield cols, begin, old
            keep_ = held_of(cols, begin[-1])
            held = [c[keep_] for c in cols]


#: Bits of the order in a group: of a unit's part of the corpus, and of its role.
_PART, _ROLE = 20, 2


def star(join: Join) -> DataFrame:
    """(x, y), y < x: of the first and the last NEAR units before a unit in its groups of equal bands,
    the BEST by signature that it may match.  Groups are met roughly in the order of units."""
    t = join.t
    # the prefix' last token stands in all units of a large group of similar ones: its count bounds the group
    cell = F.pmod(F.xxhash64("id"), _cells(F.element_at("prefix", -1), STAR_CLASS))
    rows = join.sets.filter(F.size("prefix") > 0).select("id", "n", "sig", "more", cell.alias("cell"), F.explode("bands").alias("band"))
    part = F.least(F.shiftright("id", 33), F.lit((1 << _PART) - 1))  # ids number the parts of the corpus in their upper bits
    rows = rows.select(_group(F.col("band"), F.col("cell"), part, _PART), "id", "n", "sig", "more")

    def held_of(cols, last):
        size = len(cols[0])
        return np.unique(np.concatenate([np.arange(last, min(last + NEAR, size)), np.arange(max(last, size - NEAR), size)]))

    def met(batches):
        for (_, ids, n, sig, more), begin, old in _continued(batches, _PART, held_of):
            new = np.arange(old, len(ids))
            best = np.full((BEST, len(ids)), 1 << 40)  # differing bits and the row, the least first
            for k in range(2 * NEAR):
                # first the last rows before it, then the first rows of its group
                i = new[new - begin[new] > (k if k < NEAR else k - NEAR)]
                j = i - k - 1 if k < NEAR else begin[i] + k - NEAR
                if k >= NEAR:
                    i, j = i[j < i - NEAR], j[j < i - NEAR]
                if not len(i):
                    continue
                bits = differing((sig[i], sig[j]), (more[i], more[j]))
                ok = possible(n[i], 0, n[j], 0, bits, t)
                i, found = i[ok], (bits[ok] << 32) | j[ok]
                for rank in range(BEST):
                    best[rank, i], found = np.minimum(best[rank, i], found), np.maximum(best[rank, i], found)
            some = [np.flatnonzero(b < 1 << 40) for b in best]
            two = [np.stack([ids[i], ids[best[rank, i] & 0xFFFFFFFF]]) for rank, i in enumerate(some)]
            yield _pairs([np.stack([p.max(0), p.min(0)]) for p in two])

    sent = rows.repartition(F.shiftright("group", _PART)).sortWithinPartitions("group")
    return sent.mapInArrow(met, "x bigint, y bigint").distinct()


def cross(join: Join, marked: DataFrame, part: int, labels: bool) -> DataFrame:
    """(x, y), y < x: open units x with all earlier ones that they may match in their groups, for the tokens of a part.

    marked: the classes with open (boolean).  With labels it also has a label: pairs of one label are left out,
    and x may also be a unit that is not open if y is."""
    t = join.t
    last = "label" if labels else "more"
    rows = marked.filter(F.size("prefix") > 0).select("id", "n", "sig", "skip", "open", last, F.posexplode("prefix").alias("i", "token"))
    rows = rows.filter(F.col("token").bitwiseAND(F.lit(SLICES - 1)) == part)
    cells = _cells(F.col("token"), CROSS_CLASS)
    own = F.pmod(F.xxhash64("id"), cells)
    visits = F.when(F.col("open") & (cells > 1), F.sequence(F.lit(0).cast("bigint"), cells - 1)).otherwise(F.array(own))
    rows = rows.withColumn("own", own).withColumn("cell", F.explode(visits))
    role = F.when(~F.col("open"), 0).when(F.col("cell") == F.col("own"), 1).otherwise(2)  # settled hosts, open hosts, open guests
    at = F.shiftleft("n", 32).bitwiseOR((F.col("skip") + F.col("i")).cast("bigint"))  # size and place
    rows = rows.select(_group(F.col("token"), F.col("cell"), role, _ROLE), "id", at.alias("at"), "sig", last)

    def held_of(cols, first):  # the hosts of a cell, which bounds them
        return first + np.flatnonzero((cols[0][first:] & 3) < 2)

    def met(batches):
        for (group, ids, at, sig, more), begin, old in _continued(batches, _ROLE, held_of):
            n, place, role = at >> 32, at & 0xFFFFFFFF, group & 3
            host = role < 2
            hosts = np.flatnonzero(host)
            before = np.cumsum(host) - host  # hosts before a row
            i = np.arange(old, len(ids))
            i = i[role[i] > 0]
            lo, many = before[begin[i]], before[i] - before[begin[i]]
            i, lo, many = i[many > 0], lo[many > 0], many[many > 0]
            found, upto, cut = [], np.cumsum(many), 0
            while cut < len(i):
                end = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + PAIRS, "right")))
                p, j = np.repeat(i[cut:end], many[cut:end]), hosts[ranges(lo[cut:end], many[cut:end])]
                cut = end
                # a guest meets open hosts as a host elsewhere, too: there only the later unit asks
                later = ids[j] < ids[p]
                ok = later | ((role[j] == 1) & (role[p] == 1))
                if labels:
                    ok = (more[p] != more[j]) & (ok | (role[j] == 0))
                else:
                    ok &= ids[j] != ids[p]
                p, j = p[ok], j[ok]
                bits = differing((sig[p], sig[j])) if labels else differing((sig[p], sig[j]), (more[p], more[j]))
                ok = possible(n[p], place[p], n[j], place[j], bits, t)
                two = np.stack([ids[p[ok]], ids[j[ok]]])
                found.append(np.stack([two.max(0), two.min(0)]))
            yield _pairs(found)

    sent = rows.repartition(F.shiftright("group", _ROLE)).sortWithinPartitions("group")
    return sent.mapInArrow(met, "x bigint, y bigint").distinct()


def members(join: Join, pairs: DataFrame) -> DataFrame:
    """(id, h): the whole sets of the units in pairs(x, y), made again from their texts."""
    units = join.units
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    places = join.sets.select("id", "doc_id", "t", "number").join(wanted.hint("shuffle_hash"), "id")
    by_doc = places.groupBy("doc_id", "t").agg(F.collect_list(F.struct("number", "id")).alias("places")).withColumnRenamed("doc_id", "d").withColumnRenamed("t", "dt")
    texts = join.docs.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt"))).select("text", "places")

    def made(batches):
        for b in slices(batches, "text"):
            s = Sets(*units(b["text"]))
            number = {(r, k): i for i, (r, k) in enumerate(zip(s.row.tolist(), s.number.tolist(), strict=True))}
            ids, at = [], []
            for r, asked in enumerate(b["places"].to_pylist()):
                for x in asked:
                    ids.append(x["id"])
                    at.append(number[r, x["number"]])
            at = np.array(at, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s.n[at])]), pa.int32()), pa.array(s.h[ranges(s.first[at], s.n[at])].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["id", "h"])

    # rows that repeat a document give its sets again: one is enough
    return texts.mapInArrow(made, "id bigint, h array<bigint>").groupBy("id").agg(F.first("h").alias("h"))


def verified(join: Join, whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(x, y) whose sets have similarity t or more; whole is from members()."""
    t = join.t
    side = lambda c: whole.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"))
    both = pairs.hint("shuffle_hash").join(side("x"), "x").hint("shuffle_hash").join(side("y"), "y")
    shared = F.size(F.array_intersect("hx", "hy"))
    return both.filter(shared * (1 + t) >= t * (F.size("hx") + F.size("hy")) - 1e-9).select("x", "y")
