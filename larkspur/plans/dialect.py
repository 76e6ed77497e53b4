"""Rewrites of the SQL dialect into Spark SQL.

The text is cut into tokens and nested by parentheses; rewrites work on that
tree, so strings, comments and nesting are safe.  What they supply:

* ``x op ANY/SOME/ALL (query)`` and ``x NOT IN (query)`` as (NOT) EXISTS, without
  the null trap of NOT IN;
* NULL sorts above every value: ascending orders get NULLS LAST, descending ones
  NULLS FIRST, whatever the text says;
* a window with an order and no frame covers ROWS UNBOUNDED PRECEDING to the
  current row; RANGE and GROUPS count rows;
* ``/`` of two integers drops the fraction;
* SUBSTRING positions below 1 use up length; REGEXP_REPLACE takes ``\\1``;
* ``|> AGGREGATE ... GROUP BY ROLLUP`` and type names of the dialect.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\$\$.*?\$\$|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_][A-Za-z_0-9$]*|\|>|\|\||::|<=>|<=|>=|<>|!=|==|->|.""",
    re.S,
)
COMPARISONS = {"=", "<>", "!=", "<", "<=", ">", ">="}
_BOUND = {"WHERE", "AND", "OR", "ON", "HAVING", "SELECT", "NOT", "WHEN", "THEN", "ELSE", "CASE", "EXTEND", "SET", "DISTINCT", ",", "|>", "BY", "AS", "BETWEEN"}
_TYPES = {"TEXT": "STRING", "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "REAL": "FLOAT", "INT8": "BIGINT", "INT4": "INT", "INT2": "SMALLINT", "BOOL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP_NTZ"}
_INTEGERS = "('tinyint', 'smallint', 'int', 'bigint')"
_KEYWORDS = _BOUND | {"FROM", "GROUP", "ORDER", "LIMIT", "IN", "LIKE", "IS", "END", "UNION", "INTERSECT", "EXCEPT", "JOIN", "USING", "EXISTS", "ANY", "SOME", "ALL", "VALUES", "OVER", "INTERVAL", "DATE"}


def tokens(text: str) -> list:
    """Tokens without white space and comments."""
    return [t for t in _TOKEN.findall(text) if not t.isspace() and not t.startswith(("--", "/*"))]


def tree(flat: list) -> list:
    """Nested lists, one for each pair of parentheses."""
    stack: list = [[]]
    for t in flat:
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced parentheses")
            group = stack.pop()
            stack[-1].append(group)
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError("unbalanced parentheses")
    return stack[0]


def render(node) -> str:
    """SQL text of a tree."""
    out = []
    for x in node:
        if isinstance(x, list):
            out.append("(" + render(x) + ")")
        else:
            out.append(x)
    text = " ".join(out)
    return re.sub(r"(?<=[\w\"`]) \. (?=[\w\"`*])", ".", text)


def up(x) -> str:
    return x.upper() if isinstance(x, str) else ""


def split(node: list, *by: str) -> list:
    """Parts of node between the separators at this level."""
    parts: list = [[]]
    for x in node:
        if up(x) in by:
            parts.append([])
        else:
            parts[-1].append(x)
    return parts


def is_query(node) -> bool:
    return isinstance(node, list) and bool(node) and (up(node[0]) in {"SELECT", "WITH", "VALUES", "FROM"} or is_query(node[0]) and (len(node) == 1 or up(node[1]) in {"UNION", "INTERSECT", "EXCEPT", "ORDER", "LIMIT"}))


def _operand_start(seq: list, end: int) -> int:
    i = end
    while i > 0 and up(seq[i - 1]) not in _BOUND:
        i -= 1
    return i


def _exists(operand: list, op: list, query: list, negate: bool) -> list:
    if len(operand) == 1 and isinstance(operand[0], list) and len(cols := split(operand[0], ",")) > 1 and op == ["="]:
        names = [f"_c{i}" for i in range(len(cols))]
        cond: list = []
        for c, n in zip(cols, names, strict=True):
            cond += (["AND"] if cond else []) + [c, "=", n]
    else:
        names, cond = ["_c"], [*operand, *op, "_c"]
    head = [x for n in names for x in (",", n)][1:]
    return ["EXISTS", ["SELECT", "1", "FROM", query, "AS", "_q", head, "WHERE", *([cond, "IS", "NOT", "TRUE"] if negate else cond)]]


def quantified(seq: list) -> list:
    """ANY, SOME, ALL and NOT IN over queries."""
    i = 0
    while i < len(seq):
        word = up(seq[i])
        if word in {"ANY", "SOME", "ALL"} and i + 1 < len(seq) and is_query(seq[i + 1]) and i > 0 and up(seq[i - 1]) in COMPARISONS | {"LIKE"}:
            op_at = i - 2 if up(seq[i - 1]) == "LIKE" and up(seq[i - 2]) == "NOT" else i - 1
            start = _operand_start(seq, op_at)
            made = _exists(seq[start:op_at], seq[op_at:i], seq[i + 1], word == "ALL")
            seq[start : i + 2] = [["NOT", *made]] if word == "ALL" else made
            i = start + 1
        elif word == "IN" and up(seq[i - 1]) == "NOT" and i + 1 < len(seq) and is_query(seq[i + 1]):
            start = _operand_start(seq, i - 1)
            seq[start : i + 2] = [["NOT", *_exists(seq[start : i - 1], ["="], seq[i + 1], False)]]
            i = start + 1
        i += 1
    return seq


_AFTER_ORDER = {"LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "|>", ";", "FETCH"}


def null_order(seq: list) -> list:
    """Explicit null placement in every ORDER BY."""
    out, i = [], 0
    while i < len(seq):
        if up(seq[i]) == "ORDER" and i + 1 < len(seq) and up(seq[i + 1]) == "BY":
            end = i + 2
            while end < len(seq) and up(seq[end]) not in _AFTER_ORDER:
                end += 1
            out += ["ORDER", "BY"]
            for k, item in enumerate(split(seq[i + 2 : end], ",")):
                if len(item) > 2 and up(item[-2]) == "NULLS":
                    item = item[:-2]
                out += ([","] if k else []) + item + ["NULLS", "FIRST" if up(item[-1]) == "DESC" else "LAST"]
            i = end
        else:
            out.append(seq[i])
            i += 1
    return out


def frames(seq: list) -> list:
    """Frames of windows count rows."""
    for i, x in enumerate(seq[:-1]):
        if up(x) == "OVER" and isinstance(seq[i + 1], list):
            w = ["ROWS" if up(t) in {"RANGE", "GROUPS"} else t for t in seq[i + 1]]
            words = [up(t) for t in w]
            if "ORDER" in words and "ROWS" not in words:
                w += ["ROWS", "BETWEEN", "UNBOUNDED", "PRECEDING", "AND", "CURRENT", "ROW"]
            seq[i + 1] = w
    return seq


def _primary_back(seq: list, end: int) -> int:
    """Start of the primary expression that ends before end."""
    i = end - 1
    if isinstance(seq[i], list):
        if i > 0 and isinstance(seq[i - 1], str) and re.match(r"\w", seq[i - 1]) and up(seq[i - 1]) not in _KEYWORDS:
            i -= 1
    while i > 1 and seq[i - 1] in (".", "::"):
        i -= 2
    return i


def _primary_ahead(seq: list, start: int) -> int:
    """End of the primary expression that starts at start."""
    i = start
    while i < len(seq) and seq[i] in ("-", "+"):
        i += 1
    i += 1
    while i < len(seq) and (isinstance(seq[i], list) or seq[i] in (".", "::")):
        i += 1 if isinstance(seq[i], list) else 2
    return min(i, len(seq))


def division(seq: list) -> list:
    """Integer division where both sides are integers."""
    i = 0
    while i < len(seq):
        if seq[i] == "/" and 0 < i < len(seq) - 1:
            start = _primary_back(seq, i)
            while start > 1 and seq[start - 1] in ("*", "%"):
                start = _primary_back(seq, start - 1)
            end = _primary_ahead(seq, i + 1)
            a, b = seq[start:i], seq[i + 1 : end]
            seq[start:end] = [["IF", [["typeof", a, "IN", [_INTEGERS[1:-1]], "AND", "typeof", b, "IN", [_INTEGERS[1:-1]]], ",", "CAST", [a, "AS", "BIGINT"], "DIV", "CAST", [b, "AS", "BIGINT"], ",", a, "/", b]]]
            # both branches are typed at analysis: DIV sees bigint casts only
            i = start
        i += 1
    return seq


def functions(seq: list) -> list:
    """Functions whose arguments mean something else in Spark."""
    for i, x in enumerate(seq[:-1]):
        args = seq[i + 1]
        if not isinstance(args, list):
            continue
        name = up(x)
        if name in {"SUBSTRING", "SUBSTR"}:
            parts = split(args, ",", "FROM", "FOR")
            if len(parts) < 2:
                continue
            first = ["greatest", [parts[1], ",", "1"]]
            seq[i] = "substring"
            if len(parts) == 2:
                seq[i + 1] = [*parts[0], ",", *first]
            else:
                seq[i + 1] = [*parts[0], ",", *first, ",", "greatest", [parts[1], "+", parts[2], ",", *first], "-", *first]
        elif name == "REGEXP_REPLACE" and len(parts := split(args, ",")) == 3 and len(parts[2]) == 1:
            seq[i + 1] = [*parts[0], ",", *parts[1], ",", re.sub(r"\\(\d)", r"$\1", parts[2][0])]
        elif name == "HASH":
            seq[i] = "xxhash64"
        elif name == "CAST" and len(args) > 2 and up(args[-1]) in _TYPES:
            args[-1] = _TYPES[up(args[-1])]
    for i, x in enumerate(seq[:-1]):
        if x == "::" and up(seq[i + 1]) in _TYPES:
            seq[i + 1] = _TYPES[up(seq[i + 1])]
    return seq


def marks(seq: list) -> list:
    """EXISTS among the selected values as a count over the same rows."""
    inside = False
    for i, x in enumerate(seq):
        word = up(x)
        if word in {"SELECT", "EXTEND"}:
            inside = True
        elif word in {"FROM", "WHERE", "|>", "UNION", "INTERSECT", "EXCEPT", "HAVING", "ORDER"}:
            inside = False
        elif inside and word == "EXISTS" and i + 1 < len(seq) and isinstance(q := seq[i + 1], list):
            words = [up(t) for t in q]
            plain = words[0] == "SELECT" and "FROM" in words and not {"GROUP", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "HAVING"} & set(words)
            body = q[words.index("FROM") :] if plain else ["FROM", q, "AS", "_e"]
            seq[i : i + 2] = ["", [["SELECT", "count", ["1"], *body], ">", "0"]]
    return seq


def pipe_rollup(seq: list) -> list:
    """|> AGGREGATE f GROUP BY ROLLUP(a, b) as a query over the pipe so far."""
    for i in range(len(seq)):
        if seq[i] == "|>" and i + 1 < len(seq) and up(seq[i + 1]) == "AGGREGATE":
            end = i + 2
            while end < len(seq) and seq[end] != "|>":
                end += 1
            body = seq[i + 2 : end]
            at = next((k for k in range(len(body) - 2) if up(body[k]) == "GROUP" and up(body[k + 1]) == "BY" and up(body[k + 2]) == "ROLLUP"), None)
            if at is None:
                continue
            keys = body[at + 3]
            aggregates = body[:at]
            made = [["SELECT", *keys, *([","] if aggregates else []), *aggregates, "FROM", seq[:i], "GROUP", "BY", "ROLLUP", keys]]
            return pipe_rollup(["FROM", *made, *seq[end:]])
    return seq


def rewrite_tree(seq: list) -> list:
    seq = [rewrite_tree(x) if isinstance(x, list) else x for x in seq]
    for step in (functions, division, quantified, marks, frames, null_order, pipe_rollup):
        seq = step(seq)
    return seq


def rewrite(sql: str) -> str:
    """Spark SQL of a query in the dialect."""
    return render(rewrite_tree(tree(tokens(sql))))


def statements(text: str) -> list:
    """Statements between semicolons outside strings, comments and braces."""
    out, depth, current = [], 0, []
    for t in re.findall(r"<[^<>\s]*>|" + _TOKEN.pattern, text, re.S):
        if t.startswith("--") or t.startswith("/*"):
            continue
        depth += (t == "{") - (t == "}")
        if t == ";" and depth == 0:
            out.append("".join(current).strip())
            current = []
        else:
            current.append(t)
    out.append("".join(current).strip())
    return [s for s in out if s]
