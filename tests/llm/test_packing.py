import zlib

import numpy as np

from larkspur.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_round_trip(docs, corpus):
    rows = packing.pack(docs, with_ids=True).collect()
    tok = tokenizer()
    expected = sorted((doc is None, doc or 0, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for doc, t, *_ in corpus)
    by: dict = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 1024
        by.setdefault((r["doc_id"] is None, r["doc_id"] or 0), []).append((r["start"], r["ids"], r["doc_tokens"]))
    found = []
    for key, parts in by.items():
        total = {p[2] for p in parts}
        assert len(total) == 1
        copies = sum(p[0] == 0 for p in parts)  # a repeated row has its pieces twice
        whole = b"".join(p[1] for p in sorted(parts)[::copies])
        found += [(*key, tuple(np.frombuffer(whole, "<u4").tolist()))] * copies
    assert sorted(found) == expected


def test_sequences_have_no_gaps(docs):
    seqs: dict = {}
    for r in packing.pack(docs).collect():
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_padding_is_little():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.gamma(1.5, 250, 20_000).astype(int) + 1, 1024)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    layout = packing.plan(histogram)
    used: dict = {}
    for combo, n in layout:
        assert sum(combo) <= 1024
        for length in combo:
            used[length] = used.get(length, 0) + n
    assert used == histogram
    assert lengths.sum() / (1024 * sum(n for _, n in layout)) > 0.995


def test_solution_meets_the_histogram():
    counts = np.zeros(33, np.int64)
    counts[[8, 12, 20, 24]] = [30, 40, 40, 30]
    combos = packing.combinations(counts, 32)
    x = packing.solve(counts, combos)
    made = np.bincount(combos.ravel(), np.repeat(x, 3), 33)
    assert (x >= 0).all() and np.allclose(made[1:], counts[1:], atol=0.5)


def test_assemble_pads_unless_power_of_two(docs):
    rows = packing.assemble(packing.pack(docs, with_ids=True)).collect()
    for r in rows:
        n = r["n_ids"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 1024)


def test_special_string_and_empty(spark, empty):
    text = "a <|endoftext|> b"
    got = packing.pack(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), with_ids=True).collect()
    ids = np.frombuffer(got[0]["ids"], "<u4").tolist()
    assert ids == tokenizer().encode(text, add_special_tokens=False).ids + [0]
    assert packing.pack(empty).count() == 0
