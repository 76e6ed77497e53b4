"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of
its word shingles.  Fingerprints that differ in at most DISTANCE bits are linked
and links are followed to components.

Equal fingerprints are one node from the start.  By the pigeonhole principle two
linked fingerprints agree in one of DISTANCE + 1 bit segments, so every segment's
value deals the nodes to groups.  In each group the fingerprints are sorted by
Gray rank, which brings those with shared bits together; runs of them form the
leaves of a hierarchy whose upper nodes hold the bits that all below share (a
mask and a pattern), each level only bits that no node above has counted.  A
query descends with its differences so far and leaves a whole subtree when they
exceed the distance.  Groups above GROUP_ROWS are cut into tiles in Gray order,
and pairs of tiles are searched as tasks of their own, so that no task holds an
unbounded group.  From each group only a spanning forest of its links goes on.

Defined cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; a text with fewer words than a shingle is one
shingle; null ids take part but name no component (a component of null ids only
has a null id); repeated rows share fingerprint and component; texts are read
whole, in pieces; columns beside doc_id and text are ignored.

A fingerprint tells a similarity only roughly.  So the pipeline (``similar``) takes from the
Gray index the texts whose fingerprints are NEAR_BITS apart at most, links those whose shingle
sets are similar, and has the exact join of ``setjoin`` look for the pairs that this leaves.
"""

from __future__ import annotations

import re
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import components, forget, keep, prepare
from .tokens import shingle_hashes

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Members of a leaf, and children of an upper node.
LEAF, FAN = 16, 8
#: Rows of a group that one task searches; larger groups are cut into tiles.
GROUP_ROWS = 20_000
PIECE = 1 << 20
#: Similarity of shingle sets at which the pipeline's texts are near-duplicates.
SIMILAR = 0.8
#: Differing bits up to which the pipeline's texts are compared, and the segments that find them.
NEAR_BITS, NEAR_SEGMENTS = 6, 8
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes):
    """data in pieces that end between words."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = _SPACE.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def _shingles(text: str | None, shingle: int, seed: int):
    """Lists of the hashes of a text's word shingles, piece by piece; nothing without words."""
    from xxhash import xxh64_intdigest as xxh

    some, last = False, []
    for piece in _pieces((text or "").encode().lower()):
        words = last + piece.split()
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        k = max(0, len(words) - shingle + 1)
        if k:
            some = True
            yield [xxh(line[i : j - 1], seed) for i, j in zip(starts[:k].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        last = words[max(0, len(words) - shingle + 1) :]
    if not some and last:
        yield [xxh(b" ".join(last), seed)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half of the shingle hashes; 0 without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _shingles(text, shingle, seed):
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def hashed(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(hashed, "doc_id bigint, fp bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence (prefix parity of the bits from the top)."""
    r = fp.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


class GrayIndex:
    """Levels of (mask, pattern) over fingerprints in Gray order; the last level are the fingerprints."""

    def __init__(self, fp: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.order = np.argsort(gray_rank(fp), kind="stable")
        self.fp = fp[self.order]
        spans = []
        width = leaf
        while width < len(fp) * fan:
            spans.append(width)
            if width >= len(fp):
                break
            width *= fan
        self.levels = []  # from the top: span, mask of bits shared and not counted above, pattern
        above = None
        for width in reversed(spans):
            at = np.arange(0, len(fp), width)
            both, some = np.bitwise_and.reduceat(self.fp, at), np.bitwise_or.reduceat(self.fp, at)
            shared = ~(both ^ some)
            counted = np.zeros(len(at), np.uint64) if above is None else above[1][at // above[0]]
            self.levels.append((width, shared & ~counted, both))
            above = (width, shared)
        self.counted = above[1][np.arange(len(fp)) // above[0]] if len(fp) else np.zeros(0, np.uint64)

    def near(self, queries: np.ndarray, most: int = DISTANCE, chunk: int = 2048):
        """Yields (query positions, member positions in Gray order) of pairs within the distance."""
        for q0 in range(0, len(queries), chunk):
            own = queries[q0 : q0 + chunk]
            width, mask, pattern = self.levels[0]
            q, node = np.divmod(np.arange(len(own) * len(mask)), len(mask))
            so_far = np.zeros(len(q), np.int64)
            for k, (width, mask, pattern) in enumerate(self.levels):
                if k:
                    fan = self.levels[k - 1][0] // width
                    node = (node[:, None] * fan + np.arange(fan)).ravel()
                    q, so_far = np.repeat(q, fan), np.repeat(so_far, fan)
                    there = node < len(mask)
                    q, node, so_far = q[there], node[there], so_far[there]
                so_far = so_far + np.bitwise_count((own[q] ^ pattern[node]) & mask[node])
                ok = so_far <= most
                q, node, so_far = q[ok], node[ok], so_far[ok]
            member = (node[:, None] * width + np.arange(width)).ravel()
            q, so_far = np.repeat(q, width), np.repeat(so_far, width)
            there = member < len(self.fp)
            q, member, so_far = q[there], member[there], so_far[there]
            ok = so_far + np.bitwise_count((own[q] ^ self.fp[member]) & ~self.counted[member]) <= most
            yield q[ok] + q0, member[ok]


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Least member of each of n nodes' components after the links a-b, by vectorised hooking and halving."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _links(fp: np.ndarray, most: int):
    """Spanning forest of the links among fp: positions and the roots they hang from."""
    index = GrayIndex(fp)
    root = np.arange(len(fp))
    for q, member in index.near(fp, most):
        root = forest(len(fp), q, index.order[member], root)
    move = root != np.arange(len(fp))
    return np.flatnonzero(move), root[move]


def segment_keys(most: int, segments: int) -> list:
    """Bit masks such that two codes within the distance agree under one of them: of
    ``segments`` runs of bits at least segments - most are free of differences."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    runs = [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(runs, segments - most)]


def link(nodes: DataFrame, most: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """(a, b) links that join all fingerprints of nodes(node bigint, fp bigint, one row each) within the distance.

    Nodes are unique per fingerprint; the links are a spanning forest of every group's links."""
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in segment_keys(most, segments or most + 1)]
    groups = F.array(*(F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(m)).alias("val")) for i, m in enumerate(masks)))
    dealt = nodes.select("node", "fp", F.explode(groups).alias("g")).select("node", "fp", "g.seg", "g.val")
    sizes = dealt.groupBy("seg", "val").agg(F.count("*").alias("n")).filter("n > 1")
    cells = dealt.join(sizes, ["seg", "val"])
    tiles = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    # a large group is dealt to tiles by a hash, and every pair of tiles is searched on its own
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    pairs = F.when(tiles <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), tiles - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    )
    spread = cells.select("node", "fp", "seg", "val", F.explode(pairs).alias("t")).select("node", "fp", "seg", "val", "t.i", "t.j")

    def search(batches):
        for b in batches:
            key = [b[c].to_numpy() for c in ("seg", "val", "i", "j")]
            fp, node = b["fp"].to_numpy().view(np.uint64), b["node"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], 0)])) if len(fp) else []
            left, right = [], []
            for s, e in zip(new, [*new[1:], len(fp)], strict=True):
                if e - s > 2:
                    a, r = _links(fp[s:e], most)
                    left.append(node[s:e][a])
                    right.append(node[s:e][r])
                elif e - s == 2 and int(fp[s] ^ fp[s + 1]).bit_count() <= most:
                    left.append(node[s : s + 1])
                    right.append(node[s + 1 : s + 2])
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or empty), pa.int64()) for x in (left, right)], names=["a", "b"])

    whole = spread.repartition("seg", "val", "i", "j").sortWithinPartitions("seg", "val", "i", "j")
    return whole.mapInArrow(_whole_groups(search, ("seg", "val", "i", "j")), "a bigint, b bigint")


def _whole_groups(search, key, rows: int = 4 * GROUP_ROWS):
    """Feeds search batches that hold whole groups of a sorted partition, of about rows rows."""

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = np.zeros(t.num_rows, bool)
            for k in key:
                v = t[k].to_numpy()
                last |= v != v[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield from search(t.slice(0, cut).combine_chunks().to_batches())
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from search(pa.Table.from_batches(held).combine_chunks().to_batches())

    return run


def classes(docs: DataFrame, most: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    prints = keep(fingerprints(docs, shingle, seed), "prints")
    # one node per fingerprint; components are found over fingerprints and named by the least id of any member
    nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "nodes")
    links = keep(link(nodes.select("node", "fp"), most, segments), "links")
    found = components(links)
    joined = nodes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("c"))
    names = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(names, "c").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_pairs(join: setjoin.Join, shingle: int, most: int = NEAR_BITS, segments: int = NEAR_SEGMENTS) -> DataFrame:
    """(x, y), y < x: sets of the join that the Gray index links, and those of equal fingerprints with their first."""
    prints = fingerprints(join.docs.select(F.col("t").alias("doc_id"), "text"), shingle).toDF("t", "fp").dropDuplicates(["t"])
    own = keep(join.sets.select("id", "t").join(prints.hint("shuffle_hash"), "t").select("id", "fp"), "near-prints")
    nodes = keep(own.groupBy("fp").agg(F.min("id").alias("node")), "near-nodes")
    links = link(nodes.select("node", "fp"), most, segments).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    equal = own.join(nodes.hint("shuffle_hash"), "fp").filter("id <> node").select(F.col("id").alias("x"), F.col("node").alias("y"))
    out = keep(links.unionByName(equal).distinct(), "near-pairs")
    forget(own)
    forget(nodes)
    return out


def similar(docs: DataFrame, shingle: int = 5, t: float = SIMILAR) -> DataFrame:
    """(doc_id, t): the rows of docs, by id and a hash of the text, that come first in their group of similar texts.

    Texts are linked where their sets of word shingles have a Jaccard similarity of t at least; links are followed.
    Pairs come from the Gray index over fingerprints and are verified on the sets.  An exact join follows, which
    finds what the fingerprints miss.  Texts that have been put in one component are not compared again: only those outside
    the largest component go on, and ask those of other components.  Texts without words are not among the rows."""
    join = setjoin.classes(docs, partial(shingle_hashes, shingle=shingle), t)

    def linked(pairs):
        whole = keep(setjoin.members(join, pairs), "near-members")
        out = keep(setjoin.verified(join, whole, pairs).toDF("a", "b"), "near-links")
        forget(whole)
        forget(pairs)
        return out

    near = near_pairs(join, shingle)
    first = keep(near.unionByName(setjoin.star(join)).distinct(), "near-pairs")
    forget(near)
    links = linked(first)
    found = keep(components(links), "near-label")
    largest = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).collect()
    label = F.coalesce("component", "id")
    is_open = F.lit(True) if not largest else label != largest[0]["component"]
    named = join.sets.join(found.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left")
    marked = keep(named.select("id", "n", "sig", "skip", "prefix", is_open.alias("open"), label.alias("label")), "near-marked")
    parts = [keep(setjoin.cross(join, marked, i, labels=True), "near-pairs") for i in range(setjoin.SLICES)]
    forget(marked)
    pairs = keep(reduce(DataFrame.unionByName, parts).distinct(), "near-pairs")
    for p in parts:
        forget(p)
    more = linked(pairs)
    forget(found)
    found = keep(components(links.unionByName(more)), "near-label")
    later = found.filter("node <> component").select(F.col("node").alias("id")).hint("shuffle_hash")
    first = keep(join.sets.select("id", "doc_id", "t").join(later, "id", "left_anti").select("doc_id", "t"), "near-first")
    for table in (links, more, found, join.sets):
        forget(table)
    return first


def keep_similar(docs: DataFrame, shingle: int = 5, t: float = SIMILAR) -> DataFrame:
    """Rows of docs that come first in their group of similar texts (``similar``); of rows that repeat id and text one
    stays, and of texts that are equal or similar the one with the least id, null ids last.

    Texts without words are similar to none: all of them stay, null ones too."""
    first = similar(docs.select("doc_id", "text"), shingle, t).toDF("d", "dt")
    words = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) != "", F.lit(False))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("dt"), words.alias("words"))
    own = rows.alias("r").join(first.alias("f").hint("shuffle_hash"), F.col("r.d").eqNullSafe(F.col("f.d")) & (F.col("r.dt") == F.col("f.dt")), "left_semi")
    kept = own.filter("words").dropDuplicates(["d", "dt"]).select("row").unionByName(rows.filter(~F.col("words")).select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def keep_first(docs: DataFrame, most: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, segments: int | None = None) -> DataFrame:
    """Rows of docs that are the first of their component of near fingerprints."""
    return first_rows(docs, classes(docs, most, shingle, seed, segments))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs that are the first (least doc_id) of their component in found, one of equal rows.

    An id names one document: rows that repeat it share the decision.  Rows with a
    null id stay where their component has no other, equal texts once."""
    # rows travel as one struct beside a null-safe key of two columns: no name of theirs can clash
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("a"), c.isNull().alias("b"))
    first = keep(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key(F.col("doc_id"))).distinct(), "first")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("c"), *key(F.col("doc_id").cast("bigint")))
    kept = rows.join(first, ["a", "b"], "left_semi").dropDuplicates(["a", "b", "c"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
