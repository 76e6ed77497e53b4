import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from larkspur.llm import simhash


def plain_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(rows, most):
    """Component ids by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    names: dict = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted(((doc, f"{fps[i]:016x}", names.get(find(i))) for i, (doc, *_) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("most", "segments"), [(2, None), (6, 8), (12, 14)])
def test_matches_brute_force(docs, corpus, most, segments):
    got = [tuple(r) for r in simhash.classes(docs, most, segments=segments).collect()]
    assert sorted(got, key=repr) == brute(corpus, most)


def test_pieces_of_a_long_text(monkeypatch):
    text = "Alpha beta\tgamma delta \n" * 40
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for _ in range(6)] + [base]))
    index = simhash.GrayIndex(fp)
    got = {(int(a), int(index.order[b])) for q, m in index.near(fp, 2) for a, b in zip(q, m, strict=True)}
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_gray_rank_inverts_the_code():
    i = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


def test_large_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 5)
    rng = np.random.default_rng(2)
    fp = np.unique(np.concatenate([np.uint64(0xABCD << 30) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)), rng.integers(0, 1 << 63, 50).astype(np.uint64)])).view(np.int64)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fp], "node bigint, fp bigint")
    links = simhash.link(nodes).collect()
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    u = fp.view(np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 2), strict=True):
        assert find(int(fp[i])) == find(int(fp[j]))


def test_keep_first_and_empty(docs, corpus, empty):
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert len(kept) == len(set(kept)) and 0 in kept and not set(kept) & set(range(60, 80))
    assert simhash.classes(empty).count() == 0


def jaccard(a, b, k=5):
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_finds_every_pair_and_no_other(spark):
    """Edited copies on both sides of 0.8: components equal those of brute force over all pairs."""
    import random

    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, "  "), (len(rows) + 2, rows[0][1].upper())]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"] for r in simhash.keep_similar(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect()}
    wordless = {i for i, t in rows if not (t or "").split()}
    assert len(pairs) > 40
    assert got == {find(i) for i in range(len(rows))} | wordless


def test_similar_in_small_cells(spark, monkeypatch):
    """A chain of copies, each near the one before, beside a group that is larger: one text of each stays."""
    from larkspur.llm import setjoin

    for name, value in {"NEAR": 1, "BEST": 1, "BANDS": 1, "STAR_CLASS": 6, "CROSS_CLASS": 6, "PAIRS": 7}.items():
        monkeypatch.setattr(setjoin, name, value)
    chain = [" ".join(f"c{j}" for j in range(4 * i, 4 * i + 90)) for i in range(12)]
    group = [" ".join(f"g{j}" if j != i else "edit" for j in range(100)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(chain + group)]
    got = simhash.keep_similar(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 12]


def test_similar_defined_cases(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (None, text + " b", 4), (2, "one two", 5), (3, "one two", 6), (3, "other words", 7), (None, None, 8), (4, " ", 9), (4, "", 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, dt int").withColumnRenamed("dt", "_a")
    out = simhash.keep_similar(df)
    assert out.columns == ["doc_id", "text", "_a"]
    got = sorted(r["_a"] for r in out.collect())
    assert got in ([1, 5, 7, 8, 9, 10], [2, 5, 7, 8, 9, 10])
    assert simhash.keep_similar(df.limit(0)).count() == 0
    assert simhash.keep_first(df.withColumn("_b", F.lit(1))).columns == ["doc_id", "text", "_a", "_b"]


def test_pipeline_stage_keeps_what_is_less_similar(spark):
    import corpus_pipeline

    rows = [(1, " ".join(f"a{i}" for i in range(100))), (2, " ".join(f"a{i}" for i in range(90)) + " x" * 10), (3, " ".join(f"a{i}" for i in range(70)) + " y z" * 15)]
    assert 0.8 < jaccard(rows[0][1], rows[1][1]) < 0.9 and jaccard(rows[0][1], rows[2][1]) < 0.8
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_similar_links_by_the_gray_index(spark, monkeypatch):
    """With no pair of the exact join, near fingerprints still find edited copies; what is less similar stays."""
    from larkspur.llm import setjoin

    none = spark.createDataFrame([], "x bigint, y bigint")
    monkeypatch.setattr(setjoin, "star", lambda join: none)
    monkeypatch.setattr(setjoin, "cross", lambda *a, **k: none)
    words = [f"w{i}" for i in range(600)]
    texts = [words, [*words[:300], "edit", *words[301:]], ["edit", *words[1:]], [f"v{i}" for i in range(50)], words[:1], [*words, "one", "two"]]
    # a text of a repeated run has the fingerprint of the run, with other shingles where runs meet
    texts += [words[:3] * 2, words[:3] * 2 + words[:1]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (plain_fingerprint(rows[i][1], 5) ^ plain_fingerprint(rows[j][1], 5)).bit_count() <= simhash.NEAR_BITS]
    links = [(i, j) for i, j in near if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    assert {(1, 0), (2, 0)} <= set(links)
    got = {r["doc_id"] for r in simhash.keep_similar(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    gone = {i for i, _ in links}
    assert got == set(range(len(rows))) - gone
