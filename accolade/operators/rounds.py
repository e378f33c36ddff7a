"""Sequential rules in a bounded number of shuffles: places along chains of links, and merges in which earlier records win.

Both run in rounds over tables kept in the shared folder, so no round computes the one before again, nothing is walked on the
driver, and a lost executor costs the tasks of one round. The driver sees counts only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accolade.sources.shared import Kept, small

#: A merge hands a group to one task when its undecided records are at most this many.
LOCAL_ROWS = 20_000


def list_ranks(links: DataFrame, starts: DataFrame, node: str, following: str, keys: list[str] | None = None) -> DataFrame:
    """Places (from 0) of the nodes that each chain of `starts` reaches over its links: (*keys, node, place).

    links has (*keys, node, following), one row a node; a link to a node that has no row ends the chain, as does a null. starts has
    (*keys, node), one row a chain; keys tell chains apart, a start without a row gives nothing.
    A node that a chain meets twice keeps its first place, so a ring ends where it comes back.

    Pointer doubling: after round k a chain's first 2^k nodes are known, and each node knows the node 2^k further on;
    known nodes jump to the next 2^k, jumps are composed with themselves. A chain of n nodes takes log2(n) + 2 rounds of two
    equi-joins each; rounds end when no chain grows. Rows of repeated nodes keep the least `following`; a null key is a key.
    """
    keys = keys or []
    on = [*keys, node]
    kept = Kept(links.sparkSession, "chain")
    own = links.where(F.col(node).isNotNull()).groupBy(*on).agg(F.min(following).alias("_to")).alias("a")
    there = own.select(*on).alias("b")
    jump = own.join(there, [*safe_on("a", "b", keys), F.col("a._to") == F.col(f"b.{node}")], "left").select(*[F.col(f"a.{c}").alias(c) for c in on], F.col(f"b.{node}").alias("_to"))
    jump = kept(jump)
    found = kept(starts.select(*on).distinct().alias("s").join(jump.alias("j"), safe_on("s", "j", on), "left_semi").withColumn("place", F.lit(0).cast("long")))
    step, known, now = 1, 0, found.count()
    while now > known:
        ahead = jump.where("_to is not null").alias("j")
        further = found.alias("s").join(ahead, safe_on("s", "j", on)).select(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("j._to").alias(node), (F.col("s.place") + step).alias("place"))
        more = kept(found.unionByName(further).groupBy(*on).agg(F.min("place").alias("place")))
        twice = kept(jump.alias("i").join(ahead, [*safe_on("i", "j", keys), F.col("i._to") == F.col(f"j.{node}")]).select(*[F.col(f"i.{c}").alias(c) for c in on], F.col("j._to").alias("_to")))
        kept.free(found, jump)
        found, jump, step = more, twice, step * 2
        known, now = now, found.count()
    return found


def safe_on(left: str, right: str, names: list[str]) -> list[Column]:
    """Equality of columns of two aliased frames, null with null."""
    return [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]


def _greedy(batches):
    """Takes the records of each group in order unless a key of theirs is taken; what is left out takes none. `_first` begins a group."""
    taken = set()
    for batch in batches:
        fresh = []
        for first, keys in zip(batch.column("_first").to_pylist(), batch.column("_keys").to_pylist(), strict=True):
            if first:
                taken = set()
            fresh.append(taken.isdisjoint(keys))
            if fresh[-1]:
                taken.update(keys)
        yield batch.select(["_row"]).filter(pa.array(fresh, pa.bool_()))


def first_fit(records: DataFrame, group: list[str], order: list[str], keys: str, local_rows: int | None = None) -> DataFrame:
    """Of the records of a group those that, in order, share no key with a record taken before them.

    `keys` is an array; a record that is left out takes none of its keys. Records without keys are always taken; null keys do not
    count; null is a group, and comes first in an order. Of records with equal places in the order the first one as stored counts first.

    This is the lexicographically first maximal independent set of the graph in which records of a group with a common key are
    neighbours. A group of at most `local_rows` undecided records is settled in one task, which walks all of its groups in one pass. A larger one is settled in
    rounds over (record, key) pairs, never over pairs of records: a record that is first at each of its keys is taken, all that
    hold one of its keys are out, and what is undecided goes on until its group is small. Each round decides the first record of
    each group with all holders of its keys, so a key that all records of a group hold takes one round.
    """
    most = LOCAL_ROWS if local_rows is None else local_rows
    kept = Kept(records.sparkSession, "merge")
    base = kept(records.withColumn("_row", F.monotonically_increasing_id()))
    own = F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))
    narrow = base.select(*group, *[c for c in order if c not in group], "_row", own.alias("_keys"))
    free = F.coalesce(F.size("_keys") <= 0, F.lit(True))
    in_group = Window.partitionBy(*group).orderBy(*order, "_row")
    taken, open_, before = [narrow.where(free).select("_row")], narrow.where(~free), []
    while True:
        crowded = kept(open_.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*group))
        n = crowded.count()
        side = small(crowded, n, 128).alias("l")
        quiet = open_.alias("o").join(side, safe_on("o", "l", group), "left_anti") if n else open_
        placed = quiet.withColumn("_first", F.row_number().over(in_group) == 1).select("_row", "_keys", "_first")
        taken.append(kept(placed.mapInArrow(_greedy, "_row long")))
        if not n:
            break
        busy = kept(open_.alias("o").join(side, safe_on("o", "l", group), "left_semi"))
        edges = busy.select("_row", F.struct(*order, "_row").alias("_at"), F.explode("_keys").alias("_key"), *group).withColumn("_node", F.struct(*group, "_key"))
        lead = edges.groupBy("_node").agg(F.min("_at").alias("_lead"))
        met = kept(edges.join(lead, "_node").select("_row", F.col("_lead._row").alias("_first")))
        won = kept(met.groupBy("_row").agg(F.bool_and(F.col("_first") == F.col("_row")).alias("_won")).where("_won").select("_row"))
        decided = met.join(won.select(F.col("_row").alias("_first")), "_first", "left_semi").select("_row").distinct()
        taken.append(won)
        open_ = kept(busy.join(decided, "_row", "left_anti"))
        kept.free(busy, met, crowded, *before)
        before = [open_]
    rows = taken[0]
    for more in taken[1:]:
        rows = rows.unionByName(more)
    return base.join(rows, "_row", "left_semi").drop("_row")
