"""Line dedup as an exact set-similarity self-join, in DataFrame functions only.

A line's tokens are its lower-cased words, as a set.  A line goes if an earlier
line of the corpus (by doc_id, null ids last, then by a hash of the text, then by
number) has a token set of Jaccard similarity THRESHOLD or more; lines without
words stay.

Tokens are ordered by rarity: a sketch of token counts (one class per hash
bucket, of fixed size) ranks them, rarest first, and a hash breaks ties; any
fixed order keeps the join exact.  Equal sets are one class, whose first line
stands for it; classes are numbered in the order of these lines.  Two different
sets can only match if they share a token among their first n - ceil(t n) + 1
(prefix filter), have sizes within the factor t (length filter), have enough
tokens left behind the first shared one (positional filter), and if their parity
signatures differ in no more bits than their symmetric difference may have.
Survivors are verified on the whole sets.

One earlier match settles a line.  Groups of tokens below OFTEN_CLASS hold so few
lines that all their pairs are linear in the input.  In the groups of frequent
tokens each line first meets the first line and its last few predecessors, which
settles nearly all copies in a number of candidates linear in the input; the most
frequent are salted for that.  Only lines unsettled by both then meet the whole
groups of their frequent tokens.

Defined cases: a null text has no lines and stays null; an empty one has one
line without words; ids may be null or repeat: rows are told apart by their
texts, and rows that repeat both id and text are one document, whose lines are
judged once, so equal rows stay equal; lines are of any length; other columns
pass through, whatever their names and types; an empty table gives an empty
result; a column named n_lines or n_removed is an error that names it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep
from .setjoin import keyed

THRESHOLD = 0.8
#: White space in a line besides the blank.
BLANK = "\t\r\x0b\x0c"
#: Buckets of the token sketch as powers of two: sixteen a document between these bounds, a byte each.
SKETCH_BITS = (16, 24)
#: Class of buckets that counted nothing but one token: 6 log2(1 + 1).
SINGLE = 6
#: Predecessors in a token's group that a line meets at once, besides the first.
BACK = 2
#: Count class (6 log2 of the count) from which on a token is frequent; 42: 127 of a bucket, so smaller groups make few pairs.
OFTEN_CLASS = 42
#: Count class from which on a token's group is salted.
SALT_CLASS = 72
#: Rounds in which postings are joined, each with the tokens of one hash part: a round's shuffle is what lies on disk.
SLICES = 4


def spaced(text, space: str = BLANK):
    """text with each character of space made a blank; replace() runs over bytes, translate() looks every character up."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), space, text)


def blank(line):
    """Whether a line has no words; reads no further than its first character that is not white space."""
    return F.ltrim(line, F.lit(" " + BLANK)) == ""


def words(line, space: str = BLANK):
    """Words of a line between ASCII white space, lower-cased; empty strings are left in."""
    return F.split(F.lower(spaced(F.col(line) if isinstance(line, str) else line, space)), " ")


def hashes(line):
    """Distinct 64-bit hashes of a line's words."""
    return F.array_remove(F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bit(place):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """One row: the count class of each of size hash buckets, over all tokens of all documents."""
    token = docs.select(F.explode(words("text", BLANK + "\n")).alias("w")).filter("w <> ''")
    counts = token.select(F.xxhash64("w").bitwiseAND(F.lit(size - 1)).cast("int").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    zeros = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("bigint").alias("n"))
    full = counts.unionByName(zeros).groupBy("b").agg(F.least(F.lit(127), F.floor(6 * F.log2(F.sum("n") + 1))).cast("tinyint").alias("v"))
    runs = full.groupBy(F.shiftright("b", 10).alias("hi")).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]).alias("vs"))
    return runs.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("hi", "vs"))), lambda x: x["vs"])).alias("sketch"))


def line_sets(docs: DataFrame, t: float) -> DataFrame:
    """One row per distinct token set: id, doc_id, t and number of its first line, n, sig, skip and prefix: the tokens,
    rarest first, by which the set may meet others; the first of them is the skip-th rarest."""
    buckets = 1 << min(max(docs.count().bit_length() + 4, SKETCH_BITS[0]), SKETCH_BITS[1])
    low = F.lit((1 << 56) - 1)
    # lines without words go by a test of the line: one of the size of h would be pushed down and make h twice
    lines = docs.select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("number", "line")).filter(~blank("line"))
    hashed = lines.select("doc_id", "t", "number", hashes("line").alias("h"))
    rank = lambda v: F.shiftleft(F.get("sketch", v.bitwiseAND(F.lit(buckets - 1)).cast("int")).cast("bigint"), 56).bitwiseOR(v.bitwiseAND(low))
    parity = F.aggregate("h", F.lit(0).cast("bigint"), lambda a, v: a.bitwiseXOR(_bit(v.bitwiseAND(F.lit(63)).cast("int"))))
    # every column of these steps is used once, so the optimizer puts the scalar into the lambda and no row carries it
    ranked = hashed.select("doc_id", "t", "number", F.size("h").alias("n"), parity.alias("sig"), "h").select("*", sketch(docs, buckets).scalar().alias("sketch"))
    ranked = ranked.select("doc_id", "t", "number", "n", "sig", F.sort_array(F.transform("h", rank)).alias("keys"))
    small = t / (1 - t) - 1e-9  # sets of fewer tokens match equal ones only
    length = F.when(F.col("n") >= small, F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).otherwise(0).cast("int")
    first = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "t", "number", "n", "sig", "head")
    once = ranked.select("doc_id", "t", "number", "n", "sig", F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), F.slice("keys", F.lit(1), length).alias("head"))
    once = keep(once.groupBy("h1", "h2").agg(F.min(first).alias("c")).select("c.*"), "line-classes")
    order = ["void", "doc_id", "t", "number"]
    numbered = once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    # tokens that stand nowhere else come first and meet nothing
    single = F.size(F.filter("head", lambda v: F.shiftrightunsigned(v, 56) <= SINGLE))
    out = numbered.select("id", "doc_id", "t", "number", "n", "sig", single.alias("skip"), "head")
    out = keep(out.select("id", "doc_id", "t", "number", "n", "sig", "skip", F.slice("head", F.col("skip") + 1, F.size("head")).alias("prefix")), "line-sets")
    forget(once)
    return out


def possible(x, y, t: float):
    """Whether postings x and y (structs n, pos, sig) may belong to sets of similarity t."""
    total = x["n"] + y["n"]
    need = F.ceil(total * (t / (1 + t)) - 1e-9)
    return (
        (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * t - 1e-9)
        & (1 + F.least(x["n"] - x["pos"] - 1, y["n"] - y["pos"] - 1) >= need)
        & (F.bit_count(x["sig"].bitwiseXOR(y["sig"])) <= total - 2 * need)
    )


def postings(sets: DataFrame, part: int, often: bool, *more: str) -> DataFrame:
    """(token, id, n, pos, sig, more): the prefix tokens of a part that another set may share, those from OFTEN_CLASS on or the others."""
    count = lambda token: F.shiftrightunsigned(token, 56)
    wanted = lambda token: count(token) >= OFTEN_CLASS if often else count(token) < OFTEN_CLASS
    end = F.get("prefix", F.size("prefix") - 1 if often else F.lit(0))  # the most or the least frequent
    rows = sets.filter(wanted(end)).select("id", "n", "sig", *more, "skip", F.posexplode("prefix").alias("i", "token"))
    rows = rows.filter((F.col("token").bitwiseAND(F.lit(SLICES - 1)) == part) & wanted(F.col("token")))
    return rows.select("token", "id", "n", (F.col("skip") + F.col("i")).alias("pos"), "sig", *more)


def first_pairs(sets: DataFrame, t: float, part: int) -> DataFrame:
    """(x, y): each line with those it may match of the first line of its token's group and its last predecessors.

    Groups of frequent tokens are salted by what the sketch says of them."""
    salts = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.floor((F.shiftrightunsigned("token", 56) - SALT_CLASS) / 6)).cast("int"))
    rows = postings(sets, part, True).withColumn("cell", F.pmod(F.xxhash64("id"), salts).cast("int"))
    by = Window.partitionBy("token", "cell").orderBy("id")
    me = F.struct("id", "n", "pos", "sig")
    near = [F.first(me).over(by), *(F.lag(me, i).over(by) for i in range(1, BACK + 1))]
    rows = rows.select("*", *(y.alias(f"y{i}") for i, y in enumerate(near)))
    own = {c: F.col(c) for c in ("n", "pos", "sig")}
    ok = lambda y: F.when((y["id"] < F.col("id")) & possible(own, y, t), y["id"])
    ys = F.array(*(ok(F.col(f"y{i}")) for i in range(len(near))))
    return rows.select(F.col("id").alias("x"), F.explode(ys).alias("y")).filter("y is not null").distinct()


def group_pairs(rows: DataFrame, t: float, open_=None) -> DataFrame:
    """(x, y): lines of the postings rows with every earlier line of their groups that they may match.

    Both sides are one exchange: a condition open_ on x is asked in the join, not before it."""
    left, right = rows.alias("l"), rows.alias("r")
    side = lambda s: {c: F.col(f"{s}.{c}") for c in ("n", "pos", "sig")}
    on = (F.col("l.token") == F.col("r.token")) & (F.col("r.id") < F.col("l.id")) & possible(side("l"), side("r"), t)
    return left.join(right, on if open_ is None else on & open_).select(F.col("l.id").alias("x"), F.col("r.id").alias("y")).distinct()


def near_pairs(sets: DataFrame, t: float, part: int) -> DataFrame:
    """(x, y): the first pairs of frequent tokens, and all pairs of the others, whose groups are small."""
    return group_pairs(postings(sets, part, False), t).unionByName(first_pairs(sets, t, part))


def other_pairs(known: DataFrame, t: float, part: int) -> DataFrame:
    """(x, y): lines not settled yet (done = 0) with every earlier line they may match by a frequent token."""
    open_ = F.col("l.done") * 2 <= F.col("r.done")  # l is open; both sides need the same columns
    return group_pairs(postings(known, part, True, "done"), t, open_)


def token_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, h): the whole token sets of the lines in pairs(x, y), made again from their texts."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    places = sets.select("id", "doc_id", "t", "number").join(wanted.hint("shuffle_hash"), "id")
    by_doc = places.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg(F.collect_list(F.struct("number", "id")).alias("places"))
    texts = docs.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")))
    lines = texts.select("places", F.split("text", "\n").alias("lines")).select(F.explode("places").alias("e"), "lines")
    return lines.select("e.id", F.get("lines", F.col("e.number")).alias("line")).select("id", hashes("line").alias("h"))


def verified(whole: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """Ids x of pairs(x, y) whose lines have similarity t or more."""
    side = lambda c: whole.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"))
    both = pairs.hint("shuffle_hash").join(side("x"), "x").hint("shuffle_hash").join(side("y"), "y")
    shared = F.size(F.array_intersect("hx", "hy"))
    return both.filter(shared * (1 + t) >= t * (F.size("hx") + F.size("hy")) - 1e-9).select("x").distinct()


def settled(docs: DataFrame, sets: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """Ids x of pairs(x, y) with a verified match: one is enough, so the first y is tried before the others.

    The texts are shuffled once, for the token sets of all lines in pairs."""
    whole = keep(token_sets(docs, sets, pairs), "line-tokens")
    one = keep(pairs.groupBy("x").agg(F.min("y").alias("y")), "line-one")
    got = keep(verified(whole, one, t), "line-later")
    rest = pairs.join(got.hint("shuffle_hash"), "x", "left_anti").join(one.hint("shuffle_hash"), ["x", "y"], "left_anti")
    more = keep(verified(whole, rest, t), "line-later")
    forget(whole)
    forget(one)
    return got.unionByName(more)


def rounds(pairs_of) -> DataFrame:
    """The pairs of all rounds, each once."""
    parts = [keep(pairs_of(i), "line-pairs") for i in range(SLICES)]
    out = keep(reduce(DataFrame.unionByName, parts).distinct(), "line-pairs")
    for p in parts:
        forget(p)
    return out


def stays(docs: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(sets, lines that stay): doc_id, t and number of the first lines of all token sets without an earlier match."""
    slim = keyed(docs)
    sets = line_sets(slim, t)
    pairs = rounds(lambda i: near_pairs(sets, t, i))
    later = settled(slim, sets, pairs, t)
    forget(pairs)
    done = later.select(F.col("x").alias("id"), F.lit(1).alias("done")).hint("shuffle_hash")
    often = sets.filter(F.shiftrightunsigned(F.get("prefix", F.size("prefix") - 1), 56) >= OFTEN_CLASS)
    known = keep(often.join(done, "id", "left").select("id", "n", "sig", "skip", "prefix", F.coalesce("done", F.lit(0)).alias("done")), "line-known")
    pairs = rounds(lambda i: other_pairs(known, t, i))
    forget(known)
    more = settled(slim, sets, pairs, t)
    forget(pairs)
    gone = later.unionByName(more).withColumnRenamed("x", "id").hint("shuffle_hash")
    return sets, sets.select("id", "doc_id", "t", "number").join(gone, "id", "left_anti").select("doc_id", "t", "number")


def dedup(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """docs with text reduced to the lines that stay, and n_lines, n_removed; no row is dropped."""
    if clash := {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    sets, lines = stays(docs.select("doc_id", "text"), t)
    bits = lines.groupBy("doc_id", "t", F.shiftright("number", 6).alias("at")).agg(F.bit_or(_bit(F.col("number").bitwiseAND(F.lit(63)))).alias("bits"))
    masks = bits.groupBy("doc_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"), F.max("at").alias("top"))
    masks = keep(masks.select("doc_id", "t", F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("bigint"))).alias("mask")), "line-masks")
    forget(sets)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"))
    both = rows.alias("r").join(masks.alias("m").hint("shuffle_hash"), F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.t") == F.col("m.t")), "left")
    bit = lambda i: F.call_function("shiftright", F.coalesce(F.get("mask", F.shiftright(i, 6)), F.lit(0).cast("bigint")), i.bitwiseAND(F.lit(63)))
    kept = F.filter("lines", lambda line, i: (bit(i).bitwiseAND(F.lit(1).cast("bigint")) == 1) | blank(line))
    out = both.select("row", "m.mask", F.split("row.text", "\n").alias("lines")).select("row", "lines", kept.alias("kept"))
    columns = [F.array_join("kept", "\n").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    count = lambda c: F.when(F.col("lines").isNull(), 0).otherwise(F.size(c))
    return out.select(*columns, count("lines").alias("n_lines"), (count("lines") - count("kept")).alias("n_removed"))


#: The same in DuckDB SQL over "documents"; candidates by shared prefix tokens in order of frequency.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
tokens AS (
  SELECT doc_id, k, line, list_sort(list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda w: w <> ''))) AS ws FROM lines),
classes AS (
  SELECT ws, len(ws) AS n, min((doc_id, k)) AS id FROM tokens WHERE len(ws) > 0 GROUP BY ws),
flat AS (SELECT id, n, unnest(ws) AS w FROM classes),
freq AS (SELECT w, count(*) AS c FROM flat GROUP BY w),
ranked AS (SELECT id, n, flat.w, row_number() OVER (PARTITION BY id ORDER BY c, flat.w) AS pos FROM flat JOIN freq USING (w)),
prefix AS (SELECT * FROM ranked WHERE pos <= n - ceil({THRESHOLD} * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.w = b.w AND b.id < a.id AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9),
later AS (
  SELECT DISTINCT x FROM pairs JOIN classes p ON p.id = x JOIN classes q ON q.id = y
  WHERE len(list_intersect(p.ws, q.ws)) * {1 + THRESHOLD} >= {THRESHOLD} * (p.n + q.n) - 1e-9),
stay AS (SELECT id FROM classes WHERE id NOT IN (SELECT x FROM later)),
marked AS (SELECT t.doc_id, t.k, t.line, len(ws) = 0 OR stay.id IS NOT NULL AS ok FROM tokens t LEFT JOIN stay ON stay.id = (t.doc_id, t.k))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (ok), '') AS text, count(*) AS n_lines, count(*) FILTER (NOT ok) AS n_removed
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
