"""Embedding near-duplicates with NN-descent.

Equal vectors are one node from the start.  A first neighbour graph comes from
random hyperplane codes: nodes of one code, in chunks of bounded size, compare
with each other.  Then the graph is refined: at every node its neighbours and a
bounded number of reverse neighbours meet and are compared, and what is closer
than a list's last entry enters the list.  Lists in which every entry reaches the
threshold are saturated and grow for the next round.  Rounds end when they add hardly
a link.  Then sampled nodes are held against all vectors, more of them until enough
with few links are seen; the recall is a mean over nodes, apart for those with few and
with many links, so that one large group does not hide lost pairs.  Below RECALL fresh
tables join the graph and the rounds go on; if that does not help, an error is raised.
The first graph has as many tables as let two vectors at the threshold meet with
probability MEET, whatever the number of nodes (large codes are cut to chunks that
overlap by half, which the probability leaves out).

Edges at the threshold join nodes to components, and within each component all
pairs are compared in double precision, in tiles of bounded size: that counts
every link, also of nodes whose lists were full, without listing the pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components
link with nothing; vectors of other dimensions are never linked; repeated rows
are copies (each links to the others); a null vec_id takes part but names no
component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, keep, prepare
from .simhash import forest

THRESHOLD = 0.9
#: Neighbours kept at first and at most, reverse neighbours that take part.
LIST, LONGEST, REVERSE = 8, 64, 8
#: Probability that a pair at the threshold shares a code, nodes per code aimed at, nodes per chunk.
MEET, LEAF, CHUNK = 0.99, 48, 192
#: Rounds before an audit, share of new links that ends them, times that fresh tables are added.
MAX_ROUNDS, SETTLED, EXTRA = 8, 0.001, 3
#: Audit: nodes compared with all at first and at most, nodes with few links wanted, recall that is enough.
AUDIT, AUDIT_MOST, ENOUGH, RECALL = 256, 4096, 64, 0.98
#: Nodes of a component that one task compares with as many others.
TILE = 2048
SEED = 5


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector takes part, as arrays of double."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    some = F.exists(x, lambda c: c != 0)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("v")).filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


def _matrix(column) -> np.ndarray:
    """Unit rows of a list column whose lists have one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _groups(batches, keys: tuple, most: int = 1 << 30):
    """Tables of whole groups of a sorted partition, cut only where a group has over most rows."""
    held: list = []

    def ready(t):
        cuts = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            cuts[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(cuts)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        cuts = ready(t)
        start = 0
        for c in cuts:
            yield t.slice(start, c - start)
            start = c
        rest = t.slice(start)
        while rest.num_rows >= 2 * most:  # half a chunk is seen again by the next
            yield rest.slice(0, most)
            rest = rest.slice(most // 2)
        held = rest.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_LISTS = "node bigint, nb array<bigint>, sim array<double>"
_list_types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]


def _best(nodes: np.ndarray, sims: np.ndarray, k: np.ndarray, least: np.ndarray):
    """Per row of a group: the k closest other nodes that are closer than least."""
    np.fill_diagonal(sims, -2)
    top = min(int(k.max()), len(nodes) - 1)
    if top < 1:
        return []
    near = np.argpartition(-sims, top - 1, 1)[:, :top]
    val = np.take_along_axis(sims, near, 1)
    out = []
    for i in np.flatnonzero(val.max(1) > least):
        ok = np.flatnonzero(val[i] > least[i])
        ok = ok[np.argsort(-val[i][ok])][: k[i]]
        out.append((int(nodes[i]), nodes[near[i][ok]].tolist(), val[i][ok].tolist()))
    return out


def _rows(out):
    cols = list(zip(*out, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _list_types, strict=True)], names=["node", "nb", "sim"])


def tables_for(bits: int, threshold: float) -> int:
    """Tables in which two vectors at the threshold share a code of bits hyperplanes with probability MEET."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if same > 1 - 1e-12 else max(1, math.ceil(math.log(1 - MEET) / math.log1p(-same)))


def first_graph(nodes: DataFrame, n: int, threshold: float, salt: int = 0) -> DataFrame:
    """Lists from chunks of nodes that share a hyperplane code in one of the tables."""
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    tables = tables_for(bits, threshold)

    def coded(batches):
        for b in batches:
            size = b["v"].value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                own = b.filter(pa.array(size == d))
                x = _matrix(own["v"])
                rng = np.random.default_rng((SEED, d, salt))
                for t in range(tables):
                    p = x @ rng.standard_normal((d, bits + 1))
                    code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    key = (code * 4096 + t) * 65536 + d
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(p[:, bits]), own["node"], own["v"]], names=["code", "at", "node", "v"])

    def compared(batches):
        for g in _groups(batches, ("code",), CHUNK):
            if g.num_rows > 1:
                g = g.combine_chunks()
                x, ids = _matrix(g["v"].chunk(0)), g["node"].to_numpy()
                for at in range(0, len(ids), CHUNK):  # a last chunk may hold up to two
                    s = slice(max(0, min(at, len(ids) - CHUNK)), at + CHUNK)
                    sims = x[s] @ x[s].T
                    yield _rows(_best(ids[s], sims, np.full(len(ids[s]), LIST), np.full(len(ids[s]), -1.5)))

    dealt = nodes.select("node", "v").mapInArrow(coded, "code bigint, at double, node bigint, v array<double>")
    lists = dealt.repartition("code").sortWithinPartitions("code", "at", "node").mapInArrow(compared, _LISTS)
    return keep(merged(lists, nodes.select("node", F.lit(LIST).alias("k"))), "graph")


def merged(lists: DataFrame, lengths: DataFrame) -> DataFrame:
    """(node, nb, sim, k): the k closest of all entries of a node's lists."""
    flat = lists.select("node", F.explode(F.arrays_zip("nb", "sim")).alias("e")).groupBy("node", F.col("e.nb").alias("nb")).agg(F.max("e.sim").alias("sim"))
    own = flat.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sim", "nb")), asc=False).alias("all"))
    top = lengths.join(own, "node", "left").withColumn("all", F.slice(F.coalesce("all", F.array().cast("array<struct<sim:double,nb:bigint>>")), F.lit(1), F.col("k")))
    return top.select("node", F.transform("all", lambda e: e["nb"]).alias("nb"), F.transform("all", lambda e: e["sim"]).alias("sim"), "k")


def refine(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """One round: neighbours of neighbours are compared; returns the new graph."""
    full = (F.size("sim") >= F.col("k")) & (F.element_at("sim", -1) >= threshold)
    grown = graph.select("node", "nb", "sim", F.when(full & (F.size("sim") > 0), F.least(F.lit(LONGEST), F.col("k") * 2)).otherwise(F.col("k")).alias("k"))
    edges = grown.select(F.col("node").alias("u"), F.explode("nb").alias("v"))
    # reverse neighbours: one for each of REVERSE hash cells, so that no hub gathers all of its own
    back = edges.groupBy(F.col("v").alias("u"), F.pmod(F.xxhash64("u", F.lit(SEED)), F.lit(REVERSE)).alias("cell")).agg(F.min("u").alias("v")).select("u", "v")
    self_ = grown.select(F.col("node").alias("u"), F.col("node").alias("v"))
    meet = edges.unionByName(back).unionByName(self_).distinct()
    last = F.when(F.size("sim") >= F.col("k"), F.element_at("sim", -1)).otherwise(-1.5)
    facts = nodes.select("node", "v").withColumnRenamed("v", "x").join(grown.select("node", "k", last.alias("least")), "node")
    sent = meet.join(facts, meet.v == facts.node).select("u", "node", "k", "least", "x")

    def local(batches):
        out, size = [], 0
        for g in _groups(batches, ("u",)):
            if g.num_rows < 2:
                continue
            g = g.combine_chunks()
            x = _matrix(g["x"].chunk(0))
            out += _best(g["node"].to_numpy(), x @ x.T, g["k"].to_numpy(), g["least"].to_numpy() + 1e-12)
            size += g.num_rows
            if size > 20_000:
                yield _rows(out)
                out, size = [], 0
        yield _rows(out)

    found = keep(sent.repartition("u").sortWithinPartitions("u").mapInArrow(local, _LISTS), "found")
    new = keep(merged(found.unionByName(grown.select("node", "nb", "sim")), grown.select("node", "k")), "graph")
    forget(found)
    return new


def link_count(graph: DataFrame, threshold: float) -> int:
    """Entries of all lists that reach the threshold."""
    return graph.agg(F.sum(F.size(F.filter("sim", lambda s: s >= threshold)))).first()[0] or 0


def audit(nodes: DataFrame, label: DataFrame, threshold: float, n: int) -> tuple[float | None, int]:
    """(recall, nodes with links seen): sampled nodes are compared with all, and of each the share of links inside
    its component is taken.  The recall is the lower of the means over nodes of at most LIST links and of more;
    None if no sampled node has a link."""
    asked = nodes.join(label, "node", "left").select("node", "v", F.coalesce("component", "node").alias("c"))
    size = AUDIT
    while True:
        seen = _audited(asked, threshold, size)
        few = [i / k for k, i in seen if k <= LIST]
        if len(few) >= ENOUGH or size >= min(n, AUDIT_MOST):
            break
        size = min(4 * size, AUDIT_MOST)
    many = [i / k for k, i in seen if k > LIST]
    return min((sum(x) / len(x) for x in (few, many) if x), default=None), len(seen)


def _audited(asked: DataFrame, threshold: float, size: int) -> list:
    """(links, links inside components) of those of size sampled nodes that have links."""
    some = asked.orderBy(F.xxhash64("node", F.lit(SEED))).limit(size).collect()
    by: dict = {}
    for r in some:
        by.setdefault(len(r["v"]), []).append(r)
    by = {d: (np.array([r["node"] for r in x]), np.array([r["c"] for r in x]), _matrix(pa.array([r["v"] for r in x], pa.list_(pa.float64())))) for d, x in by.items()}

    def counted(batches):
        total = {d: np.zeros((2, len(x[0])), np.int64) for d, x in by.items()}
        for b in batches:
            length = b["v"].value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                if d in by:
                    own = b.filter(pa.array(length == d))
                    ids, c, x = by[d]
                    near = (x @ _matrix(own["v"]).T >= threshold) & (ids[:, None] != own["node"].to_numpy()[None])
                    total[d][0] += near.sum(1)
                    total[d][1] += (near & (c[:, None] == own["c"].to_numpy()[None])).sum(1)
        for d, (found, inside) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(x[found > 0]) for x in (by[d][0], found, inside)], names=["node", "links", "inside"])

    rows = asked.mapInArrow(counted, "node bigint, links bigint, inside bigint").groupBy("node").agg(F.sum("links").alias("links"), F.sum("inside").alias("inside")).collect()  # a row for each sampled node at most
    return [(r["links"], r["inside"]) for r in rows]


def links(nodes: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): per tile, the rows a node links to in its component and the least node of the tile it reaches."""
    member = label.join(nodes, "node").select("component", "node", "v", "n")
    sizes = label.groupBy("component").agg(F.count("*").alias("size"))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    spread = member.join(sizes, "component").select("component", "node", "v", "n", own.alias("own"), F.explode(pairs).alias("t")).select("component", "t.i", "t.j", "own", "node", "n", "v")

    def counted(batches):
        out, size = [], 0
        for g in _groups(batches, ("component", "i", "j")):
            g = g.combine_chunks()
            i, j, side = g["i"][0].as_py(), g["j"][0].as_py(), g["own"].to_numpy()
            ids, n = g["node"].to_numpy(), g["n"].to_numpy()
            x = _matrix(g["v"].chunk(0))
            total, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for at in range(0, len(ids), 512):
                near = x[at : at + 512] @ x.T >= threshold
                near[np.arange(len(near)), np.arange(at, at + len(near))] = False
                if i != j:
                    near &= side[at : at + 512, None] != side[None]
                total[at : at + 512] = near @ n
                a, b = np.nonzero(near)
                root = forest(len(ids), a + at, b, root)
            out += zip(ids.tolist(), total.tolist(), ids[root].tolist(), strict=True)
            size += len(ids)
            if size > 20_000:
                yield _triples(out)
                out, size = [], 0
        yield _triples(out)

    return keep(spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(counted, "node bigint, links bigint, root bigint"), "links")


def _triples(out):
    cols = list(zip(*out, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "links", "root"])


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; report gets rounds and recall."""
    prepare(rows.sparkSession)
    good = usable(rows)
    nodes = good.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = keep(nodes, "nodes")  # the ids are fixed by the table
    n = nodes.count()
    graph = first_graph(nodes, n, threshold)
    rounds, since, extra, had = 0, 0, 0, link_count(graph, threshold)
    while True:
        if n:
            new = refine(nodes, graph, threshold)
            forget(graph)
            graph, rounds, since = new, rounds + 1, since + 1
            got = link_count(graph, threshold)
            settled = got - had <= SETTLED * got
            had = got
            if not settled and since < MAX_ROUNDS:
                continue
        edges = graph.select(F.col("node").alias("a"), F.explode(F.arrays_zip("nb", "sim")).alias("e")).filter(F.col("e.sim") >= threshold - 1e-9).select("a", F.col("e.nb").alias("b"))
        label = keep(components(edges), "label")
        recall, seen = audit(nodes, label, threshold, n) if n else (None, 0)
        if recall is None or recall >= RECALL:  # none seen: the tables' probability stands
            break
        if extra == EXTRA:
            raise RuntimeError(f"recall {recall:.3f} of {seen} nodes with links is below {RECALL} after {rounds} rounds and {extra} sets of fresh tables")
        extra, since = extra + 1, 0
        more = first_graph(nodes, n, threshold, extra)
        new = keep(merged(graph.select("node", "nb", "sim").unionByName(more.select("node", "nb", "sim")), graph.select("node", "k")), "graph")
        forget(graph)
        forget(more)
        graph = new
    if report is not None:
        report.update(rounds=rounds, recall=recall, seen=seen, extra=extra, nodes=n)
    found = links(nodes, label, threshold)
    exact = keep(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "label")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.join(total, "node", "left").join(exact, "node", "left").select("v", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("c"))
    names = facts.groupBy("c").agg(F.min("least").alias("component_id"))
    facts = facts.join(names, "c").select("v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(facts, "v").select("vec_id", "n_links", "component_id")
    x = F.col("embedding")
    bad = F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))
    rest = rows.filter(bad).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
