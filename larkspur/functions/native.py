"""User functions written in C.

A body that is one ``return`` of an expression becomes a SQL function, which the
optimizer inlines; any other body is compiled once per executor and called by
Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Types a C function may take and return: C, Spark, NumPy names.
TYPES = {
    "int": ("int32_t", "int", "int32"),
    "integer": ("int32_t", "int", "int32"),
    "bigint": ("int64_t", "bigint", "int64"),
    "smallint": ("int16_t", "smallint", "int16"),
    "float4": ("float", "float", "float32"),
    "real": ("float", "float", "float32"),
    "float": ("float", "float", "float32"),
    "float8": ("double", "double", "float64"),
    "double": ("double", "double", "float64"),
    "bool": ("_Bool", "boolean", "bool"),
    "boolean": ("_Bool", "boolean", "bool"),
}
_HEAD = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(\w+)\s*\((.*?)\)\s*RETURNS\s+(\w+)\s+LANGUAGE\s+(\w+)\s+AS\s*\$\$(.*)\$\$\s*$", re.I | re.S)


def parse(statement: str) -> tuple:
    """(name, [(argument, type)], result type, language, body)."""
    m = _HEAD.match(statement.strip())
    if not m:
        raise ValueError("not a function definition")
    name, args, result, language, body = m.groups()
    pairs = [tuple(a.split()[:2]) for a in args.split(",") if a.strip()]
    for _, t in [*pairs, ("", result)]:
        if t.lower() not in TYPES:
            raise ValueError(f"type {t} isn't supported in functions")
    return name, pairs, result, language.lower(), body


def source(name: str, args: list, result: str, body: str) -> str:
    """C text: the function and a loop over columns."""
    own = ", ".join(f"{TYPES[t.lower()][0]} {a}" for a, t in args)
    columns = "".join(f", const {TYPES[t.lower()][0]}* c{i}" for i, (_, t) in enumerate(args))
    call = ", ".join(f"c{i}[i]" for i in range(len(args)))
    out = TYPES[result.lower()][0]
    return f"#include <stdint.h>\n#include <math.h>\n#include <stdbool.h>\nstatic {out} {name}_({own}) {{ {body} }}\nvoid {name}_all(long n, {out}* out{columns}) {{ for (long i = 0; i < n; i++) out[i] = {name}_({call}); }}\n"


_loaded: dict = {}


def _library(text: str):
    """The compiled library, built at first use on each machine."""
    if text not in _loaded:
        import ctypes
        import os
        import subprocess
        import tempfile

        folder = tempfile.mkdtemp()
        with open(os.path.join(folder, "f.c"), "w") as f:
            f.write(text)
        subprocess.run(["cc", "-O3", "-shared", "-fPIC", "f.c", "-o", "f.so", "-lm"], cwd=folder, check=True, capture_output=True)
        _loaded[text] = ctypes.CDLL(os.path.join(folder, "f.so"))
    return _loaded[text]


_C_TOKEN = re.compile(r"\s+|[A-Za-z_]\w*|\d+\.\d*f?|\.\d+f?|\d+[lLuU]*|==|!=|<=|>=|&&|\|\||[-+*/%<>!()]")


def expression(body: str, args: list, result: str) -> str | None:
    """SQL of a body that returns one expression over its arguments, else None."""
    m = re.fullmatch(r"\s*return\b(.*?);\s*", body, re.S)
    if not m or ";" in m[1]:
        return None
    names = {a: t.lower() for a, t in args}
    integers = all(TYPES[t][2].startswith("int") for t in names.values())
    out, at = [], 0
    while at < len(m[1]):
        t = _C_TOKEN.match(m[1], at)
        if not t:
            return None
        at, word = t.end(), t.group().strip()
        if not word:
            continue
        if re.match(r"[A-Za-z_]", word) and word not in names:
            return None
        if word == "/" and not integers or word == "!":
            return None  # mixed division and negation of numbers are left to the compiler
        word = re.sub(r"[fFlLuU]+$", "", word) if word[0].isdigit() or word[0] == "." else word
        out.append({"==": "=", "!=": "<>", "&&": "AND", "||": "OR", "/": "DIV"}.get(word, word))
    return " ".join(out)


def register(spark: SparkSession, statement: str) -> None:
    """CREATE FUNCTION: nulls in, null out; defining again replaces."""
    name, args, result, language, body = parse(statement)
    if language == "c" and args and (sql := expression(body, args, result)) is not None:
        kinds = ", ".join(f"{a} {TYPES[t.lower()][1]}" for a, t in args)
        kind = TYPES[result.lower()][1]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} ({kinds}) RETURNS {kind} RETURN CAST({sql} AS {kind})")
        return
    spark_type, numpy_type = TYPES[result.lower()][1:]
    if language != "c":
        raise ValueError(f"language {language} isn't supported")
    text = source(name, args, result, body)
    kinds = [TYPES[t.lower()][2] for _, t in args]

    def run(*columns: pd.Series) -> pd.Series:
        import ctypes

        import numpy as np

        n = len(columns[0])
        null = np.zeros(n, bool)
        data = []
        for c, kind in zip(columns, kinds, strict=True):
            null |= c.isna().to_numpy()
            data.append(np.ascontiguousarray(c.fillna(0).to_numpy(), kind))
        out = np.zeros(n, numpy_type)
        getattr(_library(text), f"{name}_all")(ctypes.c_long(n), *(x.ctypes.data_as(ctypes.c_void_p) for x in (out, *data)))
        s = pd.Series(out)
        return s.astype(object).where(~null, None) if null.any() else s

    spark.udf.register(name, F.pandas_udf(run, spark_type))
