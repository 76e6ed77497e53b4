"""Command line: run-sql, run-sparql, sql and sparql (prompts), endpoint.

    python -m larkspur run-sql FILE [DIR]        statements of FILE over the Parquet tables in DIR
    python -m larkspur run-sparql FILE [TTL...]  statements of FILE over graphs named by their paths
    python -m larkspur sql [DIR] | sparql [TTL...] | endpoint PORT [TTL...]
    python -m larkspur sql-to-spark FILE         the Spark SQL that a query becomes
"""

from __future__ import annotations

import os
import sys


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("larkspur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _engine(folder=None, graphs=()):
    from .session import Engine
    from .sparql.engine import GraphStore

    engine = Engine(_session())
    for name in sorted(os.listdir(folder)) if folder else ():
        if name.endswith(".parquet"):
            engine.add_table(name.removesuffix(".parquet"), engine.spark.read.parquet(os.path.join(folder, name)))
    engine.graphs = GraphStore(engine.spark)
    for path in graphs:
        engine.graphs.load(path, f"file://{path}#rdf")
    return engine


def _prompt(run) -> None:
    text = ""
    while True:
        try:
            text += input("> " if not text else ". ") + "\n"
        except EOFError:
            return
        if text.rstrip().endswith(";"):
            try:
                out = run(text)
                if out is not None:
                    out.show(1000, False)
            except Exception as e:  # noqa: BLE001  the prompt goes on
                print(f"error: {str(e).splitlines()[0]}")
            text = ""


def main(args: list) -> int:
    if not args:
        print(__doc__)
        return 2
    command, *rest = args
    if command == "sql-to-spark":
        from .plans import dialect

        print(dialect.rewrite(open(rest[0]).read()))
    elif command == "run-sql":
        out = _engine(rest[1] if len(rest) > 1 else None).sql(open(rest[0]).read())
        if out is not None:
            out.show(1000, False)
    elif command == "run-sparql":
        out = _engine(graphs=rest[1:]).sparql(open(rest[0]).read())
        if out is not None:
            out.show(1000, False)
    elif command == "sql":
        _prompt(_engine(rest[0] if rest else None).sql)
    elif command == "sparql":
        _prompt(_engine(graphs=rest).sparql)
    elif command == "endpoint":
        from .endpoint import serve

        serve(_engine(graphs=rest[1:]), int(rest[0])).serve_forever()
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
