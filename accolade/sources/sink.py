"""A keyed table for write-backs: only buckets that hold a changed row are rewritten, and a batch counts once.

Rows lie in buckets by a hash of their key. A merge reads the buckets of changed rows, writes those again under a version
of its own, and publishes by one rename which version each bucket has now; all other buckets stay the files they are. Readers see the
state before or after a merge, never a part of it, and a merge that dies leaves files that nothing names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accolade.sources.shared import latest, publish

BUCKETS = 64


@dataclass(frozen=True)
class Merged:
    """What a merge did: the state's number, the buckets it wrote, and whether the batch had been merged before."""

    number: int
    buckets: list[int]
    repeated: bool = False


class KeyedTable:
    """The table at `path`, one row a key. The number of buckets is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.wanted = spark, path.rstrip("/"), key, buckets

    def _state(self) -> tuple[int, dict]:
        number, state = latest(self.spark, f"{self.path}/states")
        return number, state or {"count": self.wanted, "buckets": {}, "batches": {}, "schema": None}

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in state["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(state["schema"]).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def read(self) -> DataFrame:
        """All rows as of now; a table that was never written is a ValueError."""
        _, state = self._state()
        if state["schema"] is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        found = self._read(state)
        return self.spark.createDataFrame([], state["schema"]) if found is None else found

    def merge(self, updates: DataFrame, batch: int | None = None, writer: str = "") -> Merged:
        """Takes the rows of `updates` (the key, any other columns, and `changed`) that are changed in place of the rows with their keys.

        Rows that are not changed, or of which that is unknown, write nothing. Two changed rows of one key are a ValueError, and so is a changed row
        without a key or columns other than the table's. A batch number that its writer has merged before, or one below it,
        changes nothing, so a micro-batch may run again. Two merges at a time: the one that publishes last fails with FileExistsError.
        """
        number, state = self._state()
        if batch is not None and batch <= state["batches"].get(writer, -1):
            return Merged(number, [], True)
        rows = updates.where("changed").drop("changed")
        schema = state["schema"] or ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        if state["schema"] and sorted(rows.dtypes) != sorted(self.spark.createDataFrame([], schema).dtypes):
            raise ValueError(f"rows of {rows.dtypes} do not fit the table's {schema}")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(state["count"])).cast("int")
        facts = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).groupBy(bucket.alias("bucket")).agg(F.max(F.when(F.col("n") > 1, F.col(self.key).cast("string"))).alias("twice"), F.bool_or(F.col(self.key).isNull()).alias("none")).collect()
        twice = [r["twice"] for r in facts if r["twice"] is not None]
        if twice or any(r["none"] for r in facts):
            raise ValueError(f"two rows of key {min(twice)} in one merge" if twice else "a changed row has no key")
        touched = sorted(r["bucket"] for r in facts)
        if touched:
            there = self._read(state, touched)
            if there is not None:
                rows = there.join(rows.select(self.key), self.key, "left_anti").unionByName(rows)
            folder = f"data/{number + 1:08d}-{uuid.uuid4().hex[:8]}"
            rows.withColumn("_bucket", bucket).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            state["buckets"] |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        if batch is not None:
            state["batches"][writer] = batch
        if touched or batch is not None:
            number += 1
            publish(self.spark, f"{self.path}/states", number, state | {"schema": schema})
        return Merged(number, touched)
