"""CSV input and the result formats."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema, delimiter=",", escape_char=None, header=False, null="") -> DataFrame:
    """Rows of a delimited file with a fixed schema; empty strings are NULL, values may hold line breaks."""
    reader = spark.read.schema(schema).option("sep", delimiter).option("header", header).option("nullValue", null or "").option("emptyValue", "").option("multiLine", True)
    if escape_char:
        reader = reader.option("escape", escape_char)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, delimiter=",", header=True) -> None:
    """A folder of delimited files."""
    df.write.mode("overwrite").option("sep", delimiter).option("header", header).csv(path)


def format_rows(columns: list, rows: list, kind: str) -> str:
    """Small results as csv, tsv, json or xml (the SPARQL result formats)."""
    if kind in ("csv", "tsv"):
        sep = "," if kind == "csv" else "\t"
        quote = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if kind == "csv" and any(c in v for c in ',"\n') else v.replace("\t", "\\t").replace("\n", "\\n")
        return "\n".join([sep.join(columns), *(sep.join(quote(None if v is None else str(v)) for v in r) for r in rows)]) + "\n"
    if kind == "json":
        bindings = [{c: _binding(str(v)) for c, v in zip(columns, r, strict=True) if v is not None} for r in rows]
        return json.dumps({"head": {"vars": columns}, "results": {"bindings": bindings}})
    if kind == "xml":
        head = "".join(f'<variable name="{escape(c)}"/>' for c in columns)
        body = []
        for r in rows:
            cells = []
            for c, v in zip(columns, r, strict=True):
                if v is not None:
                    b = _binding(str(v))
                    more = f' datatype="{escape(b["datatype"])}"' if "datatype" in b else f' xml:lang="{b["xml:lang"]}"' if "xml:lang" in b else ""
                    cells.append(f'<binding name="{escape(c)}"><{b["type"]}{more}>{escape(b["value"])}</{b["type"]}></binding>')
            body.append("<result>" + "".join(cells) + "</result>")
        return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>{"".join(body)}</results></sparql>'
    raise ValueError(f"no format {kind}")


def _binding(term: str) -> dict:
    if term.startswith("<"):
        return {"type": "uri", "value": term[1:-1]}
    if term.startswith("_:"):
        return {"type": "bnode", "value": term[2:]}
    if term.startswith('"'):
        end = term.rindex('"')
        value = term[1:end].replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
        tail = term[end + 1 :]
        if tail.startswith("@"):
            return {"type": "literal", "value": value, "xml:lang": tail[1:]}
        if tail.startswith("^^"):
            return {"type": "literal", "value": value, "datatype": tail[3:-1]}
        return {"type": "literal", "value": value}
    return {"type": "literal", "value": term}
