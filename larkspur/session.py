"""The engine: tables, SQL in the dialect, graphs and SPARQL over one Spark session."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import native
from .plans import dialect
from .plans.durable import shared_dir
from .sources import tabular

_SQL_TYPES = {"text": "string", "real": "float", "float": "float", "float4": "float", "float8": "double", "bool": "boolean", "integer": "int", "int4": "int", "int8": "bigint", "numeric": "decimal", "timestamp": "timestamp_ntz", "character": "char", "varying": "string"}


class Engine:
    """Tables are temporary views.  Rows that are inserted become Parquet files of the table,
    under ``path`` or else in the shared folder of the cluster, so lineages stay short.
    ``SET persist = 1`` also writes the tables' definitions there, for open()."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        if path is None:
            path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.path = path
        self.tables: dict = {}
        self.keys: dict = {}
        self.required: dict = {}
        self.stored: set = set()
        self.settings: dict = {"persist": "0"}
        self.graphs = None

    # -- tables

    def add_table(self, name: str, data) -> DataFrame:
        """Registers a DataFrame, an Arrow table or a pandas frame."""
        df = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data)
        self.tables[name.lower()] = df
        df.createOrReplaceTempView(name)
        return df

    def append_table(self, name: str, data) -> DataFrame:
        """Appends rows; columns are matched by name and cast to the table's types."""
        old = self.tables[name.lower()]
        new = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data)
        if missing := {c.lower() for c in old.columns} - {c.lower() for c in new.columns}:
            raise ValueError(f"no value for columns {sorted(missing)}")
        rows = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields))
        for f in old.schema.fields:
            if f.name in self.required.get(name.lower(), ()):
                rows = rows.withColumn(f.name, F.coalesce(F.col(f.name), F.raise_error(F.lit(f"NULL in column {f.name}")).cast(f.dataType)))
        target = f"{self.path}/{name.lower()}"
        if name.lower() not in self.stored and not old.isEmpty():
            old.write.mode("append").parquet(target)
        rows.write.mode("append").parquet(target)
        self.stored.add(name.lower())
        if self.settings["persist"] == "1":
            self._definitions()
        return self.add_table(name, self.spark.read.schema(old.schema).parquet(target))

    def _definitions(self) -> None:
        rows = [(n, self.tables[n].schema.json(), ",".join(self.keys.get(n, []))) for n in sorted(self.stored)]
        self.spark.createDataFrame(rows, "name string, columns string, keys string").coalesce(1).write.mode("overwrite").json(f"{self.path}/_tables")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        """An engine over the tables persisted under path."""
        import json

        engine = cls(spark, path)
        for r in spark.read.json(f"{path}/_tables").collect():  # one row per table
            engine.stored.add(r["name"])
            engine.keys[r["name"]] = r["keys"].split(",") if r["keys"] else []
            engine.add_table(r["name"], spark.read.schema(T.StructType.fromJson(json.loads(r["columns"]))).parquet(f"{path}/{r['name']}"))
        return engine

    # -- statements

    def sql(self, text: str) -> DataFrame | None:
        """Runs statements; returns the last one's rows, None for those that have none."""
        out = None
        for statement in dialect.statements(text):
            out = self._statement(statement)
        return out

    def _statement(self, s: str) -> DataFrame | None:
        word = s.split(None, 2)
        kind = " ".join(word[:2]).upper()
        if kind in ("CREATE TABLE", "CREATE TEMP", "CREATE TEMPORARY"):
            return self._create(s)
        if kind.startswith("INSERT INTO"):
            return self._insert(s)
        if word[0].upper() == "COPY":
            return self._copy(s)
        if word[0].upper() == "SET":
            name, value = re.match(r"SET\s+(\w+)\s*(?:=|TO)\s*'?([^']*?)'?\s*$", s, re.I | re.S).groups()
            self.settings[name.lower()] = value
            return None
        if re.match(r"CREATE\s+(OR\s+REPLACE\s+)?FUNCTION", s, re.I):
            native.register(self.spark, s)
            return None
        return self.spark.sql(dialect.rewrite(s))

    def explain(self, text: str) -> str:
        """The Spark SQL that a query becomes."""
        return dialect.rewrite(text)

    def _create(self, s: str) -> None:
        name, body = re.match(r"CREATE\s+(?:TEMP\s+|TEMPORARY\s+)?TABLE\s+(\w+)\s*\((.*)\)\s*$", s, re.I | re.S).groups()
        fields, keys = [], []
        for part in dialect.split(dialect.tree(dialect.tokens(body)), ","):
            words = [dialect.up(x) for x in part]
            if words[0] == "PRIMARY":
                keys += [c[0] for c in dialect.split(part[-1], ",")]
                continue
            kind = " ".join(x.lower() for x in part[1:2])
            base = _SQL_TYPES.get(kind, kind)
            if kind == "character" and len(part) > 2 and words[2] == "VARYING" or kind in ("varchar", "char", "character"):
                base = "string"
            size = next((x for x in part[2:3] if isinstance(x, list)), None)
            if base == "decimal":
                base = f"decimal({dialect.render(size)})" if size else "decimal(18,2)"
            elif kind == "float" and size:
                base = "double" if int(size[0]) > 24 else "float"
            key = "PRIMARY" in words
            if key:
                keys.append(part[0])
            strict = key or any(a == "NOT" and b == "NULL" for a, b in zip(words, words[1:], strict=False))
            fields.append(T.StructField(part[0], T._parse_datatype_string(base), not strict))
        fields = [T.StructField(f.name, f.dataType, f.nullable and f.name not in keys) for f in fields]
        self.keys[name.lower()] = keys
        self.required[name.lower()] = [f.name for f in fields if not f.nullable]
        self.add_table(name, self.spark.createDataFrame([], T.StructType(fields)))

    def _insert(self, s: str) -> None:
        name, cols, query = re.match(r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^()]*)\))?\s*((?:SELECT|VALUES|WITH|FROM|\().*)$", s, re.I | re.S).groups()
        rows = self.spark.sql(dialect.rewrite(query))
        names = [c.strip() for c in cols.split(",")] if cols else self.tables[name.lower()].columns
        if len(names) != len(rows.columns):
            raise ValueError(f"{len(names)} columns, {len(rows.columns)} values")
        self.append_table(name, rows.toDF(*names))

    def _copy(self, s: str) -> None:
        name, path, rest = re.match(r"COPY\s+(\w+)\s+FROM\s+'([^']*)'\s*(.*)$", s, re.I | re.S).groups()
        option = lambda key, default=None: (re.search(rf"{key}\s+(?:AS\s+)?'([^']*)'", rest, re.I) or [None, default])[1]
        schema = self.tables[name.lower()].schema
        rows = tabular.read_csv(self.spark, path, schema, option("delimiter", ","), option("escape"), bool(re.search(r"\bheader\b", rest, re.I)), option("null", ""))
        self.append_table(name, rows)

    # -- graphs

    def sparql(self, text: str):
        """Runs SPARQL statements (SELECT, DESCRIBE, LOAD, settings); the last one's rows, as strings."""
        from .sparql import engine

        if self.graphs is None:
            self.graphs = engine.GraphStore(self.spark)
        return engine.run(self.graphs, text)
