"""Archives of pages that outlive a session: a page is read once for as long as it does not change, and a bad load replaces nothing.

A page's address in the store is the digest of all that its reader sees (place, address, status, headers, body). A load reads
the pages whose digests are new, adds their raw rows, and notes which digests it consists of. A source's archive is moved to the
load by one rename, and only if its pages are there and its contract holds; else its last good load stays the archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accolade.plans.lookup import SOURCES, Archives, Source
from accolade.sources.shared import Kept, latest, publish
from accolade.sources.snapshots import RAW, raw_rows

_PAGE = "digest string, source_key string, page_role string, category_key string, page_ord int, url string"


def page_digest() -> Column:
    """Of a snapshot's columns; equal digests mean equal raw rows."""
    headers = F.to_json(F.array_sort(F.map_entries("headers")))
    told = F.to_json(F.struct("source_key", "page_role", "category_key", "page_ord", "url", "http_status", headers.alias("headers")), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(told.cast("binary"), F.coalesce("body", F.lit(b""))), 256)


@dataclass(frozen=True)
class Load:
    """A load's number, how many pages it read and how many were there, and why sources kept an earlier archive."""

    number: int
    read: int
    unchanged: int
    refused: dict[str, str]


class ArchiveStore:
    """The store at `path`, a folder that all machines share; `open` gives the archives, `load` takes new snapshots."""

    def __init__(self, spark: SparkSession, path: str, sources: tuple[Source, ...] = SOURCES, full_history: bool = True):
        self.spark, self.path, self.sources, self.full_history = spark, path.rstrip("/"), sources, full_history

    def _state(self) -> tuple[int, dict]:
        number, state = latest(self.spark, f"{self.path}/states")
        return number, state or {"rows": [], "loads": {}}

    def _table(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _listed(self, loads: dict[str, int]) -> DataFrame:
        """The pages of the sources' loads."""
        pages = self.spark.createDataFrame([], _PAGE)
        for number in sorted(set(loads.values())):
            keys = [k for k, n in loads.items() if n == number]
            pages = pages.unionByName(self._table([f"loads/{number:08d}"], _PAGE).where(F.col("source_key").isin(keys)))
        return pages

    def _archives(self, pages: DataFrame, rows: list[str]) -> Archives:
        raw = self._table(rows, RAW).join(pages.select("digest").distinct(), "digest", "left_semi").select(*[c.split()[0] for c in RAW.split(", ")])
        return Archives(pages, self.full_history, self.sources, raw)

    def load(self, snapshots: DataFrame) -> Load:
        """Reads what is new of the snapshots and makes them the archives of the sources whose contracts they keep.

        Snapshots are all pages of the sources that they hold; sources without any snapshot here are left as they are. Equal rows are one page.
        """
        number, state = self._state()
        number += 1
        named = snapshots.withColumn("digest", page_digest())
        pages = named.select(*[c.split()[0] for c in _PAGE.split(", ")]).distinct()
        pages.write.mode("overwrite").parquet(f"{self.path}/loads/{number:08d}")
        pages = self._table([f"loads/{number:08d}"], _PAGE)
        known = self._table([f"seen/{r.split('/')[1]}" for r in state["rows"]], "digest string")
        fresh = pages.select("digest").distinct().join(known, "digest", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/seen/{number:08d}")
        fresh = self._table([f"seen/{number:08d}"], "digest string")
        count = fresh.count()
        rows = state["rows"]
        if count:
            new = named.join(fresh, "digest", "left_semi").dropDuplicates(["digest"])
            kept = Kept(self.spark, "elements")
            raw_rows(new, kept).write.mode("overwrite").parquet(f"{self.path}/rows/{number:08d}")
            kept.free_all()
            rows = [*rows, f"rows/{number:08d}"]
        keys = {r["source_key"] for r in pages.select("source_key").distinct().collect()} & {s.key for s in self.sources}
        with self._archives(pages, rows) as archives:
            refused = {k: archives.broken[k] for k in sorted(keys) if k in archives.broken}
        loads = state["loads"] | dict.fromkeys(keys - set(refused), number)
        publish(self.spark, f"{self.path}/states", number, {"rows": rows, "loads": loads})
        return Load(number, count, pages.select("digest").distinct().count() - count, refused)

    def open(self) -> Archives:
        """The archives as of now, for lookups; no page is read again."""
        _, state = self._state()
        return self._archives(self._listed(state["loads"]), state["rows"])
