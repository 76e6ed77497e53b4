import random

import pytest

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "nd", "lo")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(5, 120)) for _ in range(60)]
    rows = []
    for i, t in enumerate(base):
        lines = t.split()
        text = "\n".join(" ".join(lines[k : k + 12]) for k in range(0, len(lines), 12))
        rows.append((i, text, "en" if i % 2 else "xx", f"src{i % 5 if i % 3 else 0}"))
    for i in range(60, 80):  # copies
        rows.append((i, rows[i % 7][1], "en", "src0"))
    for i in range(80, 95):  # near copies
        words = rows[20][1].split(" ")
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "src1"))
    passage = sentence(rng, 90)
    for i in range(95, 100):
        rows.append((i, f"{sentence(rng, 20)}\n{passage}\n{sentence(rng, 20)}", "xx", "src2"))
    rows += [(100, None, "en", "src1"), (101, "", None, None), (102, "   \n \n", "en", "src1"), (103, "1234 5678", None, "src3")]
    rows += [(104, "word " * 30_000, "en", "src3"), (105, "ab" * 1500 + "é\U0001f600", "xx", "src4")]
    rows += [(106, rows[3][1], "en", "src1"), (106, rows[3][1], "en", "src1"), (None, "a text without an id here", "en", "src2")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string").repartition(3)
    path = spark.conf.get("spark.checkpoint.dir") + "/corpus"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
