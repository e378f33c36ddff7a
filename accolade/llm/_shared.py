"""Reading tables, the folder all machines share, stored intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bytes that a batch handed to a Python worker holds, however long the texts are (a batch has one row at least).
_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return in_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def in_batches(df: DataFrame) -> DataFrame:
    """The frame; its session hands texts to Python workers in batches of bounded bytes, unless it sets a bound of its own below ours."""
    conf, (name, most) = df.sparkSession.conf, _BATCH_BYTES
    now = conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > most:
        conf.set(name, str(most))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster's session raises, as
    no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_dir()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='accolade-')}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: computed once, with no lineage to lose."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes stored() tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """A broadcast hint for a side that was counted and is within the bounds of rows and bytes; beyond them the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b), root being the smallest node it reaches.

    Alternates large-star and small-star steps, each one shuffle of at most as many rows as
    there are links, until the number of links and the sum of their ends stay the same. Every
    step is a stored table, so neither lineage nor driver memory grows. A node with many
    neighbours is safe: its neighbourhood is reduced to a minimum by partial aggregation.
    Null ends are ignored; self links make a node its own root. Steps halve the distances to the root, so
    `rounds` is far beyond what any number of links takes; without a fixed point by then it raises.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and a is not null and b is not null").distinct()
    edges = stored(edges, "edges")
    before = None
    for _ in range(rounds):
        # Large star: neighbours above a node hang from the least of its neighbourhood.
        both = edges.select("u", "v").union(edges.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is the least of its neighbourhood and has nothing above it is kept by its own link.
        large = large.union(edges.where("u != v").join(least.where("m < u"), "u").select("u", F.col("m").alias("v"))).distinct()
        # Small star: neighbours below a node, and the node, hang from the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        after = down.join(floor, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).distinct()
        after = stored(after, "edges")
        drop_stored(edges)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now
    raise RuntimeError(f"no fixed point of the components after {rounds} rounds")
