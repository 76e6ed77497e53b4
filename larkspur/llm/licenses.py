"""License scan: phrases in place, and containment of license templates in text blocks.

Words are runs of ASCII letters and digits and of any character above U+007F,
after A-Z are lower-cased.  A phrase stands where its words follow one another.
Beyond that every text block is joined with the license templates.  A block is a
line with the lines after it until they hold as many words as the longest template,
so a template is found wherever it starts and however its lines are wrapped.  A
template's token set is ordered by corpus frequency, rarest first; a block that
holds at least THRESHOLD of a template's tokens must share one of the first
n - ceil(t n) + 1 of them (prefix filter), must have at least ceil(t n) tokens
(length filter) and enough tokens left after the first shared one (positional
filter); survivors are verified on the whole sets.

Defined cases: a null or empty text has no words, no labels and score 0; ids may
be null or repeat, each row is judged for itself; texts are read whole; other
columns of the input do not reach the result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences and notices that stand for a license; the words are those of the public license texts.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "this software is released under the mit license",
    ],
    "apache-2": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
THRESHOLD = 0.8
PIECE = 1 << 22

_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
_word = np.ones(256, bool)
_word[0x00:0x30] = _word[0x3A:0x61] = _word[0x7B:0x80] = False
WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_in(data: bytes) -> np.ndarray:
    """Start offsets of the words of lower-cased bytes, piece by piece."""
    out, before = [], False
    for at in range(0, len(data), PIECE):
        w = _word[np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at)]
        out.append(np.flatnonzero(w & ~np.concatenate([[before], w[:-1]])) + at)
        before = bool(w[-1])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def phrase_pattern(phrase: str) -> re.Pattern:
    """Matches the first of the phrase's words where the others follow, so that overlapping places are found too."""
    first, *rest = (re.escape(w.encode()) for w in phrase.split())
    return re.compile(first + rb"(?=" + b"".join(_SEP + rb"+" + w for w in rest) + rb"(?:" + _SEP + rb"|\Z))")


def places(pattern: re.Pattern, data: bytes) -> list:
    """Starts of the matches that begin a word."""
    return [m.start() for m in pattern.finditer(data) if not m.start() or not _word[data[m.start() - 1]]]


def words_of(templates: dict) -> list:
    """(label, words) of every template, in order."""
    return [(label, t.lower().split()) for label, ts in sorted(templates.items()) for t in ts]


class Index:
    """Templates in frequency order with their prefixes."""

    def __init__(self, templates: dict, counts: dict, threshold: float):
        self.sets, self.first = [], {}
        self.order = {}
        vocabulary = {w for _, ws in words_of(templates) for w in ws}
        for rank, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))):
            self.order[w.encode()] = rank
        for label, ws in words_of(templates):
            ranks = sorted({self.order[w.encode()] for w in ws})
            need = math.ceil(threshold * len(ranks) - 1e-9)
            self.sets.append((label, ranks, frozenset(ranks), need))
            for place, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.first.setdefault(rank, []).append((len(self.sets) - 1, place))
        self.longest = max((len(ws) for _, ws in words_of(templates)), default=0)
        self.rare = [w for w, r in self.order.items() if r in self.first]

    def near(self, data: bytes) -> bool:
        """False only if data holds no prefix token at all."""
        return any(w in data for w in self.rare)

    def blocks(self, data: bytes):
        """Token ranks of every block: a line and those after it until they hold as many words as the longest template."""
        lines = [WORDS.findall(line) for line in data.split(b"\n")]
        ranks = [{self.order[w] for w in set(ws) if w in self.order} for ws in lines]
        upto = [0, *accumulate(map(len, lines))]  # words before each line, and in all
        for i in range(len(lines)):
            # the first line by which enough words follow line i, else the last
            end = min(max(bisect_left(upto, upto[i + 1] + self.longest), i + 1), len(lines))
            yield set().union(*ranks[i:end])

    def labels(self, block: set) -> dict:
        """Label -> containment of the templates that the block of token ranks contains to the threshold."""
        ranks = sorted(block)
        found, tried = {}, set()
        for i, rank in enumerate(ranks):
            for k, place in self.first.get(rank, ()):
                label, own, whole, need = self.sets[k]
                if k in tried:
                    continue
                tried.add(k)
                if min(len(ranks) - i, len(own) - place) < need:  # length and position
                    continue
                share = len(whole & block) / len(own)
                if share >= need / len(own):
                    found[label] = max(found.get(label, 0.0), share)
        return found


def token_counts(docs: DataFrame, templates: dict) -> dict:
    """In how many of all lines each template token stands: one counted row per token and task."""
    words = sorted({w for _, ws in words_of(templates) for w in ws})

    def counted(batches):
        wanted = {w.encode() for w in words}
        total = dict.fromkeys(wanted, 0)
        for b in batches:
            for text in b.column(0).to_pylist():
                for block in (text or "").encode().lower().split(b"\n"):
                    for w in wanted.intersection(WORDS.findall(block)):
                        total[w] += 1
        yield pa.RecordBatch.from_pydict({"w": [w.decode() for w in total], "n": list(total.values())}, schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(counted, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()  # a row for each template token
    return {r["w"]: r["n"] for r in rows}


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_blocks bigint"


def scan(docs: DataFrame, phrases: dict = PHRASES, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: words, phrase places and labels; n_blocks counts the blocks that contain a template.

    score: 1 if a phrase stands in the text, else the largest containment found, else 0.
    """
    prepare(docs.sparkSession)
    counts = token_counts(docs, templates)
    kinds = [(phrase_pattern(p), max(p.split(), key=len).encode(), label) for p, label in phrases.items()]

    def scanned(batches):
        index = Index(templates, counts, threshold)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode().lower()
                starts = words_in(data)
                at, base, more, blocks = [], set(), {}, 0
                for pattern, sure, label in kinds:
                    if sure in data and (hits := places(pattern, data)):
                        at += hits
                        base.add(label)
                if index.near(data):
                    for block in index.blocks(data):
                        if got := index.labels(block):
                            blocks += 1
                            for label, share in got.items():
                                more[label] = max(more.get(label, 0.0), share)
                place = np.searchsorted(starts, [min(at), max(at)]).tolist() if at else [None, None]
                rows.append((doc, len(starts), len(at), *place, ",".join(sorted(base)), ",".join(sorted(base | more.keys())), 1.0 if at else max(more.values(), default=0.0), blocks))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds_ = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scanned, SCHEMA)


def oracle_sql(phrases: dict = PHRASES, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB SQL over "documents": phrases by place, containment by whole sets."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = []
    for phrase, label in phrases.items():
        tests = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(f"SELECT rid, '{label}' AS label, i - 1 AS place FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE {tests}")
    kinds = ", ".join(f"({i}, '{label}', {sorted(set(ws))})" for i, (label, ws) in enumerate(words_of(templates)))
    longest = max(len(ws) for _, ws in words_of(templates))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low} AS t, regexp_extract_all({low}, '{pattern}') AS ws FROM documents),
    hits AS ({" UNION ALL ".join(places)}),
    base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY rid),
    templates AS (SELECT * FROM (VALUES {kinds}) x(tid, label, words)),
    lines AS (SELECT rid, b, regexp_extract_all(line, '{pattern}') AS own FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS b FROM d)),
    summed AS (SELECT rid, b, sum(len(own)) OVER (PARTITION BY rid ORDER BY b) AS upto FROM lines),
    ends AS (SELECT x.rid, x.b, coalesce(min(y.b) FILTER (y.upto >= x.upto + {longest}), max(y.b)) AS e FROM summed x JOIN summed y ON x.rid = y.rid AND y.b >= x.b GROUP BY x.rid, x.b),
    vocabulary AS (SELECT DISTINCT unnest(words) AS w FROM templates),
    placed AS (SELECT DISTINCT rid, b, w FROM (SELECT rid, b, unnest(own) AS w FROM lines) JOIN vocabulary USING (w)),
    held AS (SELECT DISTINCT ends.rid, ends.b, w FROM ends JOIN placed p ON p.rid = ends.rid AND p.b BETWEEN ends.b AND ends.e),
    contained AS (
      SELECT rid, b, label, count(*) / any_value(len(words))::DOUBLE AS share FROM held JOIN (SELECT tid, label, words, unnest(words) AS w FROM templates) USING (w)
      GROUP BY rid, b, tid, label HAVING count(*) >= ceil({threshold} * any_value(len(words)) - 1e-9)),
    more AS (SELECT rid, max(share) AS share, count(DISTINCT b) AS n_blocks FROM contained GROUP BY rid),
    every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM hits UNION SELECT rid, label FROM contained) GROUP BY rid)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0) AS n_blocks
    FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid) LEFT JOIN every USING (rid)
    """
