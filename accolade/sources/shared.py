"""The folder that driver and executors share, and tables kept there between the rounds of an iterative step."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='accolade-')}"


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local session without it gets a temporary folder, a cluster's session an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_dir()
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


class Kept:
    """Tables that an iterative step writes and reads again, so that no round recomputes the one before; `free` deletes what no later round reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/rounds/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                delete(self.spark, path)

    def free_all(self) -> None:
        delete(self.spark, self.root)
        self.paths.clear()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path, for renames and deletes on whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint for a side that was counted and is within the bounds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df


# --- published states: small JSON documents by number, each made visible at once ---


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The highest published number and its state; (0, {}) where nothing was published."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at):
        return 0, {}
    numbers = [int(name.removesuffix(".json")) for s in fs.listStatus(at) if (name := s.getPath().getName()).endswith(".json") and not name.startswith(".")]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(spark.read.text(f"{folder}/{max(numbers):08d}.json", wholetext=True).first()[0])


def publish(spark: SparkSession, folder: str, number: int, state: dict) -> None:
    """Makes a state visible under its number by one rename, or raises FileExistsError if another writer has taken the number."""
    fs, at = file_system(spark, f"{folder}/{number:08d}.json")
    jvm, draft = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(draft, at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(at):
            raise FileExistsError(f"{folder} has a state {number} already: another writer was first") from e
        raise
