import pytest
from xxhash import xxh64_intdigest

from larkspur.llm import lines, setjoin


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(rows, t=0.8):
    """Texts after dedup, comparing every line with all earlier ones; rows with one id and text are one document."""
    places = {(doc is None, doc or 0, signed(xxh64_intdigest(text.encode(), 42)), text) for doc, text, *_ in rows if text is not None}
    all_lines = []
    for place in sorted(places):
        for k, line in enumerate(place[3].split("\n")):
            all_lines.append((place, k, frozenset(w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w)))
    gone = set()
    for i, (place, k, s) in enumerate(all_lines):
        if s and any(r and len(s & r) >= t * len(s | r) - 1e-9 for _, _, r in all_lines[:i]):
            gone.add((place[:3], k))
    out = []
    for doc, text, *_ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
        else:
            parts = text.split("\n")
            own = (doc is None, doc or 0, signed(xxh64_intdigest(text.encode(), 42)))
            kept = [p for k, p in enumerate(parts) if (own, k) not in gone]
            out.append((doc, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup(df).collect()), key=repr)


def test_matches_brute_force(docs, corpus):
    assert result(docs) == brute(corpus)


def test_small_groups_and_cells(docs, corpus, monkeypatch):
    monkeypatch.setattr(setjoin, "NEAR", 2)
    monkeypatch.setattr(setjoin, "BEST", 1)
    monkeypatch.setattr(setjoin, "BANDS", 1)
    monkeypatch.setattr(setjoin, "STAR_CLASS", 6)
    monkeypatch.setattr(setjoin, "CROSS_CLASS", 9)
    monkeypatch.setattr(setjoin, "PAIRS", 50)
    assert result(docs) == brute(corpus)


LINE = "a b c d e f g h i j"


@pytest.mark.parametrize("id_", [None, 1, 5])
def test_rows_without_ids_of_their_own_lose_no_unique_line(spark, id_):
    """Unique lines stay and copies go, whether ids are null, repeated or neither."""
    rows = [(1, LINE), (id_, LINE + " k"), (id_, "zeta eta theta iota kappa unique one"), (id_, "other words here\n" + LINE), (id_, None), (id_, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = result(df)
    assert got == brute(rows)
    assert (id_, "zeta eta theta iota kappa unique one", 1, 0) in got


def test_repeated_rows_stay_equal(spark):
    rows = [(3, LINE + "\nx y z"), (3, LINE + "\nx y z"), (None, LINE), (None, LINE), (None, "x y z q r"), (4, "x y z q r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(df) == brute(rows)


def test_words_are_lower_cased_sets_of_any_length(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, "Alpha BETA gamma Émile\tÀ"), (2, "émile à\rbeta  ALPHA gamma gamma"), (3, "x" * 700 + " one two three"), (4, "one two three " + "x" * 700), (5, "one two three " + "x" * 699 + "y"), (6, long), (7, long + " more"), (8, "\n \n\t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df) == brute(rows)


def test_wide_ids(spark):
    rows = [((1 << 62) + i, text) for i, text in enumerate(["a b c d e", "a b c d e f", "x y", "e d c b a"])]
    rows += [(-(1 << 62), "x y"), ((1 << 63) - 1, "x y"), (None, "x y")]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_extra_columns_and_empty(docs, empty):
    out = lines.dedup(docs.withColumnsRenamed({"source": "t", "lang": "stay"}))
    assert out.columns == ["doc_id", "text", "stay", "t", "n_lines", "n_removed"]
    assert out.count() == docs.count()
    assert lines.dedup(empty).count() == 0
    with pytest.raises(ValueError):
        lines.dedup(docs.withColumnRenamed("source", "n_lines"))


def test_runs_no_python_on_the_executors(docs, monkeypatch):
    """The plans of all tables on the way, and of the result, are DataFrame operations only."""
    plans, keep = [], lines.keep
    monkeypatch.setattr(lines, "keep", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    plans.append(lines.dedup(docs)._jdf.queryExecution().toString())
    assert len(plans) > 5
    assert not [p for p in plans if any(x in p for x in ("Python", "Arrow", "Pandas"))]


@pytest.mark.parametrize("often", [0, 12, 127])
def test_frequent_and_rare_tokens_lose_no_pair(docs, corpus, often, monkeypatch):
    """All groups frequent, some, or none: the rows are the same."""
    monkeypatch.setattr(lines, "OFTEN_CLASS", often)
    assert result(docs) == brute(corpus)


def test_words_are_made_once_a_pass(docs, monkeypatch):
    """No plan makes a line's words twice, as a filter on their number would, or looks up every character."""
    plans, keep = [], lines.keep
    monkeypatch.setattr(lines, "keep", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name))
    plans.append(("result", lines.dedup(docs)._jdf.queryExecution().optimizedPlan().toString()))
    assert not [name for name, p in plans if "translate(" in p]
    assert [p.count("split(lower(") for name, p in plans if name == "line-classes"] == [2]  # the sketch, the sets
