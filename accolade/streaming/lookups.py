"""Lookups over a stream of requests: each micro-batch runs the batch plan against the stored archives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from accolade.plans.lookup import Archives, lookup_awards

REQUEST = "query_id long, title string, author string, series string"


def stream_lookups(requests: DataFrame, snapshots: DataFrame | Archives, out: str, checkpoint: str, once: bool = True, full_history: bool = True, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Writes results and failures of every batch to out/results and out/failures, under the batch's number.

    Snapshots are read and checked once, before the first batch; Archives that were opened before are used as they are. A batch's
    matches are computed once, for its results and its failures. Archives opened here are closed when the query ends.
    A batch that runs again after a failure overwrites its own folder only, so results are there exactly once.
    """

    own = not isinstance(snapshots, Archives)
    archives = Archives(snapshots, full_history) if own else snapshots

    def run(batch: DataFrame, number: int) -> None:
        report = lookup_awards(batch, archives, once=True)
        report.results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        report.failures.write.mode("overwrite").parquet(f"{out}/failures/batch={number}")
        report.free()
        if on_batch:
            on_batch(number)

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if own:
        requests.sparkSession.streams.addListener(_Closer(archives, query))
    return query


class _Closer(StreamingQueryListener):
    """Closes the archives of a query when it ends, however it does."""

    def __init__(self, archives: Archives, query: StreamingQuery):
        self.archives, self.id, self.session = archives, str(query.id), archives.pages.sparkSession
        if not query.isActive:  # it ended before anyone listened
            archives.close()

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.id:
            self.archives.close()
            self.session.streams.removeListener(self)
