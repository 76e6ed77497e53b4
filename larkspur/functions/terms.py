"""RDF terms as structs, and their comparison, arithmetic and order as Columns.

A term is struct<kind, lex, dt, lang, num>: kind 0 blank node, 1 IRI, 2 literal;
num is the value of a numeric literal.  NULL is an unbound variable or an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string,num:double>"
XSD = "http://www.w3.org/2001/XMLSchema#"
STRING = XSD + "string"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_INTEGERS = "integer int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte"
INTEGERS = [XSD + t for t in _INTEGERS.split()]
NUMERIC = [*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double"]
ORDERED = [STRING, XSD + "boolean", XSD + "date", XSD + "dateTime"]


def term(kind, lex, dt=None, lang=None, num=None) -> Column:
    one = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(one(kind, "tinyint").alias("kind"), one(lex, "string").alias("lex"), one(dt, "string").alias("dt"), one(lang, "string").alias("lang"), one(num, "double").alias("num"))


def iri(value) -> Column:
    """An IRI; value is a text or a Column of texts."""
    made = term(1, value)
    return F.when(value.isNotNull(), made) if isinstance(value, Column) else made


def literal(lex, dt: str = STRING, lang: str | None = None) -> Column:
    """A literal of a constant datatype; lex is a text or a Column of texts."""
    column = lex if isinstance(lex, Column) else F.lit(lex)
    num = column.cast("string").try_cast("double") if dt in NUMERIC else None
    made = term(2, column, LANG_STRING if lang else dt, lang, num)
    return F.when(column.isNotNull(), made)


def number(value: Column, dt) -> Column:
    """A numeric literal; dt is a text or a Column; whole numbers print without a fraction."""
    dt = dt if isinstance(dt, Column) else F.lit(dt)
    lex = F.when(dt.isin(INTEGERS), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("double").cast("string"))
    return F.when(value.isNotNull(), term(2, lex, dt, None, value))


def boolean(value: Column) -> Column:
    return F.when(value.isNotNull(), term(2, F.when(value, "true").otherwise("false"), XSD + "boolean"))


def id_key(t: Column) -> Column:
    """Term identity: kind, datatype, language and lexical form."""
    return F.when(t.isNotNull(), F.concat_ws("\x1f", t["kind"].cast("string"), F.coalesce(t["dt"], F.lit("")), F.coalesce(t["lang"], F.lit("")), t["lex"]))


def value_key(t: Column) -> Column:
    """Value identity: numbers of equal value have equal keys; large ones go by their digits."""
    exact = t["num"].isNotNull() & (F.abs(t["num"]) < float(1 << 53))
    zero = F.when(t["num"] == 0, F.lit(0.0)).otherwise(t["num"])
    return F.when(exact, F.concat(F.lit("n\x1f"), zero.cast("string"))).when(t["num"].isNotNull(), F.concat(F.lit("n\x1f"), F.regexp_replace(t["lex"], r"^\+|\.0*$", ""))).otherwise(id_key(t))


def render(t: Column) -> Column:
    """Lexical term: <iri>, _:b, "lex", "lex"@lang or "lex"^^<dt>."""
    text = F.concat(F.lit('"'), F.replace(F.replace(F.replace(t["lex"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return (
        F.when(t["kind"] == 1, F.concat(F.lit("<"), t["lex"], F.lit(">")))
        .when(t["kind"] == 0, F.concat(F.lit("_:"), t["lex"]))
        .when(t["lang"].isNotNull(), F.concat(text, F.lit("@"), t["lang"]))
        .when(F.coalesce(t["dt"], F.lit(STRING)) == STRING, text)
        .otherwise(F.concat(text, F.lit("^^<"), t["dt"], F.lit(">")))
    )


def compare(op: str, a: Column, b: Column) -> Column:
    """=, !=, <, <=, > or >=; NULL where the terms cannot be compared."""
    numbers = a["num"].isNotNull() & b["num"].isNotNull()
    if op in ("=", "!="):
        same = value_key(a) == value_key(b)
        return F.when(a.isNotNull() & b.isNotNull(), same if op == "=" else ~same)
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    alike = (a["kind"] == 2) & (b["kind"] == 2) & (a["dt"] == b["dt"]) & a["dt"].isin(ORDERED)
    return F.when(numbers, ops[op](a["num"], b["num"])).when(alike, ops[op](a["lex"], b["lex"]))


def _rank(t: Column) -> Column:
    return F.when(t["dt"].isin(INTEGERS), 0).when(t["dt"] == XSD + "decimal", 1).when(t["dt"] == XSD + "float", 2).otherwise(3)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """+, -, * or / with promotion; NULL for operands that are no numbers and for division by 0."""
    x, y = a["num"], b["num"]
    value = {"+": x + y, "-": x - y, "*": x * y}.get(op, F.when(y != 0, F.try_divide(x, y)))
    rank = F.greatest(_rank(a), _rank(b), F.lit(1 if op == "/" else 0))
    dt = F.element_at(F.array(*map(F.lit, (XSD + "integer", XSD + "decimal", XSD + "float", XSD + "double"))), rank + 1)
    return F.when(x.isNotNull() & y.isNotNull() & value.isNotNull(), number(value, dt))


def cast(t: Column, dt: str) -> Column:
    """xsd casts to a numeric type, boolean or string."""
    if dt == STRING:
        return literal(F.when(t["kind"] != 0, t["lex"]))
    if dt == XSD + "boolean":
        value = F.when(t["num"].isNotNull(), t["num"] != 0).when(t["lex"].isin("true", "1"), True).when(t["lex"].isin("false", "0"), False)
        return boolean(value)
    value = F.coalesce(t["num"], F.when(t["dt"] == XSD + "boolean", F.when(t["lex"].isin("true", "1"), 1.0).otherwise(0.0)), F.when(t["kind"] == 2, t["lex"].try_cast("double")))
    if dt in INTEGERS:
        value = F.signum(value) * F.floor(F.abs(value))
    return number(value, dt)


def truth_value(t: Column) -> Column:
    """Effective boolean value; NULL for terms that have none."""
    return F.when(t["dt"] == XSD + "boolean", t["lex"].isin("true", "1")).when(t["num"].isNotNull(), t["num"] != 0).when((t["kind"] == 2) & t["dt"].isin(STRING, LANG_STRING), F.length(t["lex"]) > 0)


def order_keys(t: Column, descending: bool = False) -> list:
    """Sort keys: unbound first, then blank nodes, IRIs, literals; numbers by value, others by text."""
    keys = [F.coalesce(t["kind"].cast("int"), F.lit(-1)), t["num"].isNull(), t["num"], t["lex"], t["dt"], t["lang"]]
    return [k.desc() if descending else k.asc() for k in keys]
