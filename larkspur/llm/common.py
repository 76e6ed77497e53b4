"""Shared pieces: durable intermediate tables, Arrow batch size, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch; keeps a Python worker's memory bounded for long texts.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
#: Set while a table is written: its job's shuffle files go at once, since nothing runs that plan again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, unless the session's own bound is lower.

    The operators' results are lazy, so the bound holds for the session."""
    key, most = BATCH_BYTES
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < own <= most:
        spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; a temporary one only in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/larkspur"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the
    lineage ends there, so a lost executor costs no more than the running job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes a table written by keep()."""
    path = getattr(df, "kept_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b), long ids; component is the
    smallest id reachable.

    Alternating large-star and small-star contractions: each round is two
    aggregations and joins on node ids, its result is a table, and the number of
    rounds grows with the logarithm of the longest path.  Nothing is collected
    but one count a round.  Loops (a = b) and repeated edges are allowed; an
    empty input gives an empty result.
    """
    pairs = keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        "edges",
    )
    nodes = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: neighbours above a point to the least of a's neighbourhood
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a <> b")
            .distinct()
        )
        new = keep(small, "edges")
        # both are sets: with as many rows they are the same if nothing is new
        same = new.count() == pairs.count() and new.join(pairs, ["a", "b"], "left_anti").isEmpty()
        forget(pairs)
        pairs = new
        if same:
            nodes = pairs
            break
    if nodes is None:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        nodes.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
