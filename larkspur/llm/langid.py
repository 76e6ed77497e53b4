"""Language identification with string kernels.

The kernel is the blended spectrum presence kernel: k(x, y) counts the distinct
character 1-, 2- and 3-grams that x and y share, divided by the root of their
own counts.  A Nystroem map over landmark texts makes it finite, one-versus-rest
kernel ridge regression learns a score per language, and whole batches of texts
are scored by two matrix products (texts x grams x landmarks, then x languages).

Texts are lower-cased; a run of characters that are not letters is one blank; grams
are of code points as they are, of every script.

Defined cases: a null text, an empty one or one without a letter is ``und`` with
score 0; null labels are not learned from; with nothing to learn from every text
is ``und``; texts are read whole, in pieces; repeated rows are scored alike; other
columns pass through untouched, and a clash with an output name is an error that
names the column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, prepare

#: Bounds of the fit's sample: rows per label and in all, and landmarks per label and in all (one
#: per label at least).  They bound what is learned from, not what is scored.
ROWS_PER_LABEL, SAMPLE_ROWS = 400, 40_000
LANDMARKS_PER_LABEL, LANDMARKS = 40, 640
RIDGE = 1e-2

UND = "und"
PIECE = 1 << 20
#: Grams whose presence is multiplied with the landmarks' at a time.
BLOCK = 1 << 15
_PAD = 0x1FFFFF  # no code point: fills up grams of one or two characters
_table = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _table
    if _table is None:
        _table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _table


def grams(text: str | None) -> np.ndarray:
    """The distinct grams of a text, in order, as numbers of three code points; none if it has no letter."""
    found, tail, some = np.zeros(0, np.int64), np.zeros(1, np.int64), False
    letter, text = _letters(), text or ""
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points[~letter[points]] = 0
        some = some or bool(points.any())
        end = np.zeros(1 if at + PIECE >= len(text) else 0, np.int64)
        c = np.concatenate([tail, points, end])
        c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
        tail = c[-2:]
        two = (c[:-1] << 21) | c[1:]
        found = np.unique(np.concatenate([found, (two[:-1] << 21) | c[2:], (two << 21) | _PAD, (c[c > 0] << 42) | (_PAD << 21) | _PAD]))
    return found if some else found[:0]


class Model:
    """Landmark grams and regression weights, and the scoring of a batch."""

    def __init__(self, labels, grams, landmarks, weights, bias):
        self.labels, self.grams, self.landmarks, self.weights, self.bias = labels, grams, landmarks, weights, bias

    def places(self, own: list) -> tuple[np.ndarray, np.ndarray]:
        """(text, gram) numbers of the grams of own that a landmark has."""
        row = np.repeat(np.arange(len(own)), [len(g) for g in own])
        codes = np.concatenate(own)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        hit = self.grams[at] == codes
        return row[hit], at[hit]

    def kernel(self, own: list, places: tuple | None = None) -> np.ndarray:
        """Grams shared with each landmark, over the root of each text's own number; own has at most some dozen texts."""
        row, at = places or self.places(own)
        shared = np.zeros((len(own), self.landmarks.shape[0]), np.float32)
        for k in range(0, len(self.grams), BLOCK):
            here = (at >= k) & (at < k + BLOCK)
            seen = np.zeros((len(own), min(BLOCK, len(self.grams) - k)), np.float32)
            seen[row[here], at[here] - k] = 1
            shared += seen @ self.landmarks[:, k : k + BLOCK].T.astype(np.float32)
        return shared / np.sqrt(np.maximum([[len(g)] for g in own], 1))

    def score(self, texts: list) -> tuple[list, list, list]:
        """Labels, scores and shares of known grams of texts (None allowed), in batches of 64."""
        names, scores, shares = [], [], []
        for at in range(0, len(texts), 64):
            own = [grams(t) for t in texts[at : at + 64]] if self.labels else []
            if not self.labels:
                names += [UND] * len(texts[at : at + 64])
                scores += [0.0] * len(texts[at : at + 64])
                shares += [0.0] * len(texts[at : at + 64])
                continue
            size = np.array([len(g) for g in own])
            known, places = size > 0, self.places(own)
            out = self.kernel(own, places) @ self.weights + self.bias
            best = out.argmax(1)
            top = np.clip((out[np.arange(len(own)), best] + 1) / 2, 0, 1)
            names += [self.labels[b] if k else UND for b, k in zip(best, known, strict=True)]
            scores += np.where(known, top, 0.0).tolist()
            shares += (np.bincount(places[0], minlength=len(own)) / np.maximum(size, 1)).tolist()
        return names, scores, shares


def sample(df: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """(label, text, h) of about ROWS_PER_LABEL rows per label and SAMPLE_ROWS in all, chosen by a hash of key and text; repeated rows count once."""
    rows = df.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h")).filter("label is not null and text is not null")
    counts = keep(rows.groupBy("label").count().withColumnRenamed("label", "counted"), "labels")
    each = max(1, min(ROWS_PER_LABEL, SAMPLE_ROWS // max(1, counts.count())))
    share = F.least(F.lit(1.0), F.lit(1.25 * each) / F.col("count"))
    return rows.join(counts, F.col("label") == F.col("counted")).filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("label", "text", "h").dropDuplicates(["label", "h"])


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """Learns from the labelled rows of df, of which a bounded sample reaches the driver as grams: the rows of each
    label with the least hashes, as many as the bounds say."""
    prepare(df.sparkSession)

    def coded(batches):
        for b in batches:
            found = [grams(t) for t in b["text"].to_pylist()]
            codes = pa.array([g.tobytes() for g in found], pa.binary())
            out = pa.RecordBatch.from_arrays([b["label"], b["h"], codes], names=["label", "h", "codes"])
            yield out.filter(pa.array([len(g) > 0 for g in found], pa.bool_()))

    coded_rows = sample(df, text, label, key).mapInArrow(coded, "label string, h bigint, codes binary")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "codes"))
    rows = coded_rows.withColumn("rank", rank).filter(F.col("rank") <= ROWS_PER_LABEL).drop("rank").collect()
    rows = sorted((r["label"], r["h"], bytes(r["codes"])) for r in rows)
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), None, None)
    marks = max(1, min(LANDMARKS_PER_LABEL, LANDMARKS // len(labels)))
    taken: dict = {}
    fitting, chosen = [], []
    for lab, _, codes in rows:
        n = taken[lab] = taken.get(lab, 0) + 1
        fitting.append((lab, np.frombuffer(codes, np.int64)))
        if n <= marks:
            chosen.append(fitting[-1])
    every = np.unique(np.concatenate([c for _, c in chosen]))
    landmarks = np.stack([np.isin(every, c, assume_unique=True) for _, c in chosen]).astype(np.uint8)
    size = np.sqrt(np.array([len(c) for _, c in chosen], float))
    model = Model(labels, every, landmarks, None, None)
    kernel = lambda group: np.concatenate([model.kernel([c for _, c in group[i : i + 64]]) for i in range(0, len(group), 64)]) / size
    values, vectors = np.linalg.eigh(kernel(chosen).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nystroem: features = kernel @ root
    feats = kernel(fitting) @ root
    targets = np.where(np.array([lab for lab, _ in fitting])[:, None] == np.array(labels), 1.0, -1.0)
    weight = np.array([1 / taken[lab] for lab, _ in fitting])
    weight = (weight / weight.mean())[:, None]  # each language counts alike
    mean_x, mean_y = (feats * weight).mean(0), (targets * weight).mean(0)
    x, y = feats - mean_x, targets - mean_y
    beta = np.linalg.solve(x.T @ (weight * x) + RIDGE * len(x) / 100 * np.eye(x.shape[1]), x.T @ (weight * y))
    model.weights, model.bias = (root @ beta) / size[:, None], mean_y - mean_x @ beta
    return model


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score and lang_known (the share of a text's grams that any landmark has); the model, a byte for each gram and landmark at most LANDMARKS of the sample, is broadcast."""
    spark = df.sparkSession
    prepare(spark)
    if clash := {"lang_pred", "score", "lang_known"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    sent = spark.sparkContext.broadcast((model.labels, model.grams, model.landmarks, model.weights, model.bias))
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_known", T.DoubleType())])

    def scored(batches):
        m = Model(*sent.value)
        for b in batches:
            names, scores, shares = m.score(b.column(at).to_pylist())
            more = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "lang_pred", "score", "lang_known"])

    return df.mapInArrow(scored, schema)


def held_out(key="doc_id"):
    """True for the fold that is never learned from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) with lang_pred and score, learned from the rows outside the held-out fold."""
    return predict(docs, fit(docs.filter(~held_out())))
