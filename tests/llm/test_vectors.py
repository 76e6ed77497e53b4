import math

import numpy as np
import pytest

from larkspur.llm import neighbours, topk


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = []
    centers = rng.standard_normal((40, 16))
    for i in range(400):
        c = centers[i % 40] * rng.uniform(0.5, 3)
        rows.append((i, (c + rng.standard_normal(16) * (0.05 if i % 3 else 0.6)).astype(np.float32).tolist(), i % 4))
    rows += [(400 + i, rows[5][1], 0) for i in range(6)]  # copies
    rows += [(410, None, 1), (411, [0.0] * 16, 1), (412, [1.0, None] + [0.5] * 14, 1), (413, [float("nan")] + [1.0] * 15, 1), (414, [float("inf")] + [1.0] * 15, 1), (415, [1.0, 2.0], 1)]
    rows += [(7, rows[7][1], 2), (None, rows[9][1], 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicates_match_brute_force(spark, vectors):
    report: dict = {}
    got = sorted(map(tuple, neighbours.near_duplicates(frame(spark, vectors), report=report).collect()), key=repr)
    use = [i for i, (_, v, _) in enumerate(vectors) if good(v) and any(v)]
    linked: dict = {i: set() for i in range(len(vectors))}
    for i in use:
        for j in use:
            a, b = np.array(vectors[i][1], float), np.array(vectors[j][1], float)
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                linked[i].add(j)
    seen: dict = {}
    for i in range(len(vectors)):
        if i not in seen:
            todo, part = [i], set()
            while todo:
                k = todo.pop()
                if k not in part:
                    part.add(k)
                    todo += linked[k]
            name = min((vectors[k][0] for k in part if vectors[k][0] is not None), default=None)
            seen |= dict.fromkeys(part, name)
    want = [(v[0], len(linked[i]), seen[i], v[0] == seen[i] if v[0] is not None else False) for i, v in enumerate(vectors)]
    assert got == sorted(want, key=repr)
    assert report["recall"] >= 0.9


def test_tiles(spark, vectors, monkeypatch):
    want = sorted(map(tuple, neighbours.near_duplicates(frame(spark, vectors)).collect()), key=repr)
    monkeypatch.setattr(neighbours, "TILE", 3)
    monkeypatch.setattr(neighbours, "CHUNK", 8)
    assert sorted(map(tuple, neighbours.near_duplicates(frame(spark, vectors)).collect()), key=repr) == want


LONG = (1 << 63) - 1


def clip(x):
    return max(-LONG, min(LONG, int(x)))


def brute_top(vectors, k, every):
    rows = [(i, [max(-LONG - 1, min(LONG, math.floor(256 * float(x)))) for x in v]) for i, v, _ in vectors if good(v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q is None or q % every:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(v, w, strict=True))), LONG if i is None else i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v))
        out += [(q, r + 1, None if i == LONG else i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [50, 7, 1])
def test_top_k_matches_brute_force(spark, vectors, every):
    got = sorted(map(tuple, topk.search(frame(spark, vectors), every=every).collect()), key=repr)
    assert got == brute_top(vectors, 5, every)


def test_pruning_and_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "COORDINATE_FROM", 0.0)
    monkeypatch.setattr(topk, "BLOCK", 60)
    got = sorted(map(tuple, topk.search(frame(spark, vectors), every=7).collect()), key=repr)
    assert got == brute_top(vectors, 5, 7)


def test_rows_that_repeat_a_query(spark):
    """Rows of one id are queries and candidates of their own, copies among them."""
    rows = [(50, [1.0, 2.0], 0), (50, [1.0, 2.0], 0), (50, [3.0, -1.0], 0), (1, [0.5, 0.5], 0), (100, [-1.0, -1.0], 0), (None, [1.0, 2.0], 0)]
    got = sorted(map(tuple, topk.search(frame(spark, rows)).collect()), key=repr)
    assert got == brute_top(rows, 5, 50) and sum(r[0] == 50 for r in got) == 15


def test_large_products(spark):
    """Products above 2^53 are exact; those beyond long are set to its ends."""
    big = [[2.0**22 + i, 2.0**22 - 3 * i, 1.0] for i in range(12)] + [[3e9, 1.0, -3e9], [3e9, -2.0, 3e9], [1e30, 1.0, 0.0], [-1e30, 0.0, 1.0]]
    rows = [(i, v, 0) for i, v in enumerate(big)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(2)
    assert sorted(map(tuple, topk.search(data, every=1).collect()), key=repr) == brute_top(rows, 5, 1)


def test_seed_threshold_loses_nothing(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "SEED", 8)
    monkeypatch.setattr(topk, "BUCKET", 4)
    assert sorted(map(tuple, topk.search(frame(spark, vectors), every=3).collect()), key=repr) == brute_top(vectors, 5, 3)


def test_empty(spark, vectors):
    none = frame(spark, vectors).limit(0)
    assert neighbours.near_duplicates(none).count() == 0 and topk.search(none).count() == 0


def test_lone_pairs_beside_a_large_group(spark, monkeypatch):
    """Pairs just above 0.9 are found though a third of the vectors is one group, whose links are nearly all links."""
    monkeypatch.setattr(neighbours, "LEAF", 4)
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    group = unit(rng.standard_normal((1, 48)) + 0.05 * rng.standard_normal((1000, 48)))
    left = unit(rng.standard_normal((300, 48)))
    side = rng.standard_normal((300, 48))
    side = unit(side - (side * left).sum(1, keepdims=True) * left)
    right = 0.91 * left + np.sqrt(1 - 0.91**2) * side
    x = np.concatenate([left, right, group, unit(rng.standard_normal((1400, 48)))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    report: dict = {}
    got = {r["vec_id"]: r["component_id"] for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), report=report).collect()}
    assert sum(got[i] == got[i + 300] for i in range(300)) / 300 >= 0.98
    assert len({got[i] for i in range(600, 1600)}) == 1
    assert report["recall"] >= neighbours.RECALL and report["seen"] >= neighbours.ENOUGH


def test_tables_grow_with_the_code():
    for bits in (0, 5, 11, 21):
        same = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - same) ** neighbours.tables_for(bits, 0.9) >= neighbours.MEET - 1e-9
