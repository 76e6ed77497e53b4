import re

from pyspark.sql import functions as F

from larkspur.llm import licenses

WORD = re.compile(b"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    words = WORD.findall((text or "").encode().lower())
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = [w.encode() for w in phrase.split()]
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "under the mit licenses; sunder the mit license; under-the--MIT\nlicense and under the mit license",
    "CC BY-NC 4.0 cc by nc cc by nc",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache license version 22 apache license version 2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
    "é under the mit licenseé under the mit license",
    "permission is granted",
    "x " * 50_000 + "cc by nc",
]


def test_matches_plain_search(spark, docs, corpus):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("n_words", F.lit(5))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert got[7]["labels"] == "mit" and got[7]["base_labels"] == "" and got[5]["labels"] == "apache-2"
    assert sorted(r["n_words"] for r in licenses.scan(docs).collect()) == sorted(plain(t)[0] for _, t, *_ in corpus)


def test_join_is_exact():
    """Every block of random token sets is found exactly where its containment reaches the threshold."""
    import random

    rng = random.Random(3)
    templates = {f"t{i}": [" ".join(rng.sample("a b c d e f g h i j k l m n o p".split(), rng.randint(3, 9)))] for i in range(8)}
    counts = {w: rng.randint(0, 50) for [t] in templates.values() for w in t.split()}
    index = licenses.Index(templates, counts, 0.8)
    for _ in range(2000):
        block = set(rng.sample("a b c d e f g h i j k l m n o p q r s".split(), rng.randint(1, 12)))
        want = {k: len(block & set(t.split())) / len(set(t.split())) for k, [t] in templates.items()}
        want = {k: v for k, v in want.items() if v >= 0.8 - 1e-9}
        got = list(index.blocks(" ".join(block).encode()))
        assert len(got) == 1 and index.labels(got[0]) == want


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"


def test_wrapped_and_short_notices_are_found(spark):
    """A notice is found however it is wrapped and wherever it starts; its words scattered over a long text are none."""
    import textwrap

    texts = [("\n".join(textwrap.wrap(MIT, w)), "mit") for w in (20, 40, 79, 500)]
    texts += [("some words before it " * 40 + "\n".join(textwrap.wrap("and then " + MIT, 40)) + "\nand words after it", "mit")]
    texts += [("This work is licensed under the GNU General Public License, version 3.", "gpl")]
    texts += [("\n".join(f"{w} {'filler ' * 40}" for w in MIT.split()), "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert got == {i: label for i, (_, label) in enumerate(texts)}


def test_empty(empty):
    assert licenses.scan(empty).count() == 0


def test_matches_sql(spark, sf):
    import duckdb

    from larkspur.llm import queries

    got = queries.QUERIES["op9_license_scan"](spark, sf)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.ORACLE["op9_license_scan"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
