import numpy as np
import pytest

from larkspur.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs).withColumn("out", langid.held_out()).collect()
    held = [r for r in rows if r["out"] and r["lang"] is not None]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(docs, empty):
    model = langid.fit(docs.filter(~langid.held_out()))
    rows = {(r["doc_id"], r["text"]): r for r in langid.predict(docs, model).collect()}
    assert {r["lang_pred"] for k, r in rows.items() if k[0] in (100, 101, 102, 103)} == {"und"}
    assert rows[(105, [k[1] for k in rows if k[0] == 105][0])]["lang_pred"] in ("en", "xx")
    assert langid.predict(empty, model).count() == 0
    none = langid.predict(docs, langid.fit(empty)).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and {r["score"] for r in none} == {0.0}
    with pytest.raises(ValueError):
        langid.predict(docs.withColumnRenamed("source", "score"), model)


def plain(text):
    """Grams by the book: letters lower-cased, every other run one blank, blanks at both ends."""
    c = " " + "".join(x if x.isalpha() else " " for x in text.lower()) + " "
    while "  " in c:
        c = c.replace("  ", " ")
    return {c[i : i + k] for k in (1, 2, 3) for i in range(len(c) - k + 1)} - {" "}


@pytest.mark.parametrize("text", ["Hallo Welt", "hallo  welt!", "a", "Ελληνικά και 中文字 русский", "x1y2 z", "İstanbul ẞ"])
def test_grams_are_those_of_the_text(text):
    assert len(langid.grams(text)) == len(plain(text))


def test_kernel_is_exact():
    texts = ["Hallo Welt", "hallo  welt!", "Ελληνικά", "ελλάδα hallo"]
    own = [langid.grams(t) for t in texts]
    every = np.unique(np.concatenate(own))
    model = langid.Model(["x"], every, np.stack([np.isin(every, g) for g in own]).astype(np.uint8), None, None)
    want = [[len(plain(a) & plain(b)) / len(plain(a)) ** 0.5 for b in texts] for a in texts]
    assert np.allclose(model.kernel(own), want)


def test_pieces_and_blocks(monkeypatch):
    text = "Ein langer Satz mit Wörtern, 12 Zahlen und Ääö. " * 9
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.grams(text) == whole).all() and not len(langid.grams("12 34")) and not len(langid.grams(None))


def test_scripts_and_many_labels(spark):
    """Scripts whose code points are far apart are told apart, and no label is dropped, however many there are."""
    greek, cyrillic = "αβγδεζηθ", "абвгдежз"
    rows = [(i, " ".join(alphabet[j % 8] * 2 + alphabet[(i + j) % 8] for j in range(20)), name) for i in range(40) for name, alphabet in (("el", greek), ("ru", cyrillic))]
    rows += [(100 + i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]} " * 3, f"l{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    assert len(model.labels) == 122
    got = langid.predict(df, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["lang"] in ("el", "ru")]) == 1.0


def test_repeated_and_idless_rows_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LABEL", 5)
    df = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'text ' || id % 300 AS text", "'en' AS lang")
    assert 0 < langid.sample(df, "text", "lang", "doc_id").count() < 40
