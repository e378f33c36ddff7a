"""Joins whose condition is not an equality, turned into equi-joins: containment of sets, and ranges of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accolade.operators.rounds import safe_on
from accolade.sources.shared import Kept, small

#: Entries of the index under one member that one share of them holds.
SHARE_ROWS = 10_000
#: More rules than this, of which one at most can hold, are looked up by a walk over sorted rules and numbers.
WALKED_RULES = 20_000


def contains_all(inner: Column, outer: Column) -> Column:
    """Whether an array has members and all of them stand in another one; never null."""
    return F.coalesce((F.size(inner) > 0) & (F.size(F.array_except(inner, outer)) == 0), F.lit(False))


def _signature(hashes: Column, word: int) -> Column:
    """64 of 128 bits of a set, from its members' hashes, such that a subset's bits are among its superset's."""
    bit = lambda h: F.when(h % 2 == 0 if word == 0 else h % 2 != 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 1), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(bit(h)))


def containment_join(queries: DataFrame, records: DataFrame, query_id: str, record_id: str, asked: str, held: str, share_rows: int | None = None) -> DataFrame:
    """(query_id, record_id) of all records whose members (array `held`) are all among a query's (array `asked`), without any other key.

    Records without members match nothing, null members do not count, and equal rows give a pair once.

    Records with the same members are one set. A set stands in the index once, under its rarest member, so a query that asks for each
    of its own members meets each set at most once, and the sets it meets share a member that few sets have. What a query sends to
    each of its members is its number and a 128-bit signature, which drops most sets that do not fit; its array goes once, to the sets that are left. Where very many sets share their rarest member, its
    entries are dealt over shares and the queries that ask for it look into each, so no task holds all of them.
    """
    most = SHARE_ROWS if share_rows is None else share_rows
    kept = Kept(queries.sparkSession, "contained")
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda m: m.isNotNull())))
    rows = kept(records.select(record_id, clean(F.col(held)).alias("_held")).where("size(_held) > 0").distinct())
    sets = kept(rows.select("_held").distinct().withColumn("_set", F.monotonically_increasing_id()))
    common = sets.select(F.explode("_held").alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
    rare = sets.select("_set", F.explode("_held").alias("_m")).join(common, "_m").groupBy("_set").agg(F.min(F.struct("_n", "_m")).alias("_r")).select("_set", F.col("_r._m").alias("_m"))
    words, hashes = (0, 1), lambda c: F.transform(c, lambda m: F.xxhash64(m))
    entries = kept(sets.join(rare, "_set").withColumns({f"_bits{w}": _signature(hashes("_held"), w) for w in words}))
    named = kept(rows.join(sets, "_held").select(record_id, "_set"))
    kept.free(rows, sets)
    shares = entries.groupBy("_m").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_shares"))
    crowded = kept(shares.where("_shares > 1"))
    n = crowded.count()
    # Signatures are stored: beside an explode they would be computed for each of its rows.
    asks = queries.select(query_id, clean(F.col(asked)).alias("_asked")).where("size(_asked) > 0").distinct().withColumn("_q", F.monotonically_increasing_id())
    asks = kept(asks.withColumns({f"_all{w}": _signature(hashes("_asked"), w) for w in words}))
    probes = asks.select("_q", F.col(query_id).alias("_id"), *[f"_all{w}" for w in words], F.explode("_asked").alias("_m"))
    if n:
        side = small(crowded, n, 64)
        entries = entries.join(side, "_m", "left").withColumn("_share", F.pmod(F.xxhash64("_set"), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
        probes = probes.join(side, "_m", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    on = ["_m", "_share"] if n else ["_m"]
    fits = [F.col(f"_bits{w}").bitwiseAND(F.col(f"_all{w}")) == F.col(f"_bits{w}") for w in words]
    # A set of one member fits who asks for that member; only larger ones meet the query's array.
    single = probes.join(entries.where("size(_held) = 1"), on).where(fits[0] & fits[1]).select(F.col("_id").alias(query_id), "_set")
    several = probes.join(entries.where("size(_held) > 1"), on).where(fits[0] & fits[1]).select("_q", "_set", "_held")
    several = several.join(asks.select("_q", query_id, "_asked"), "_q").where(contains_all(F.col("_held"), F.col("_asked"))).select(query_id, "_set")
    return single.unionByName(several).join(named, "_set").select(query_id, record_id)


# --- rules that hold over ranges of whole numbers ---


def _covering(first: Column, last: Column, bits: int) -> Column:
    """The fewest dyadic blocks (level, block) that make up first..last, numbers below 2^bits; a block of level k is 2^k numbers.

    In blocks of 2^k the range is low..high; it has a block of its own at that level where low is a right half or high's
    last one a left half, so two at most a level.
    """
    parts = []
    for k in range(bits + 1):
        low, high = F.shiftright(first + ((1 << k) - 1), k), F.shiftright(last + 1, k)
        own = lambda block, k=k: F.struct(F.lit(k).alias("level"), block.alias("block"))
        parts += [F.when((low < high) & (low % 2 == 1), own(low)), F.when((low < high) & (high % 2 == 1), own(high - 1))]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Rules:
    """A checked table of rules: blocks has (keys, _level, _block, rule), rule being a struct of a rule's columns; a large one is walked instead."""

    blocks: DataFrame
    keys: list[str]
    any_keys: list[str]
    low: int
    high: int
    levels: list[int]
    rows: int
    #: For a table that is walked: (keys, _part, _place, rule, _last, _open), a rule once for each part of 2^shift numbers that it reaches into.
    walked: DataFrame | None = None
    shift: int = 0

    def _place(self, at: Column) -> Column:
        # Bounds are one number further out on each side, so that what lies beyond all rules meets the open ones.
        return (F.greatest(F.least(at, F.lit(self.high)), F.lit(self.low)) - self.low).cast("long")

    def walked_to(self, points: DataFrame, at: str) -> DataFrame:
        """looked_up() where one rule at most can hold: the last one that begins at or before the number in its part, if it has not ended.

        A number that is unknown looks from the first place on, where only a rule open at both ends may be its own.
        """
        place = F.coalesce(F.when(F.col(at).isNotNull(), self._place(F.col(at))), F.lit(0).cast("long"))
        asked = points.select(*self.keys, F.col(at).alias("_at"), place.alias("_place")).withColumn("_part", F.shiftright("_place", self.shift))
        found = F.struct("rule", "_last", "_open").alias("_found")
        rows = self.walked.select(*self.keys, "_part", "_place", F.lit(False).alias("_asks"), F.lit(None).cast(dict(points.dtypes)[at]).alias("_at"), found)
        rows = rows.unionByName(asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
        walk = Window.partitionBy(*self.keys, "_part").orderBy("_place", "_asks").rowsBetween(Window.unboundedPreceding, 0)
        met = rows.withColumn("_found", F.last("_found", ignorenulls=True).over(walk)).where("_asks and _place <= _found._last and (_at is not null or _found._open)")
        return met.select(*self.keys, F.col("_at").alias(at), F.col("_found.rule").alias("rule"))

    def looked_up(self, points: DataFrame, at: str) -> DataFrame:
        """(keys, at, rule) of the rules that hold for distinct (keys, at)."""
        if self.walked is not None:
            return self.walked_to(points, at)
        place = self._place(F.col(at))
        ancestors = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(place, k).alias("block")) for k in self.levels if k >= 0])
        unknown = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("block")))
        probes = points.select(*self.keys, at).withColumn("_at", F.explode(F.when(F.col(at).isNull(), unknown).otherwise(ancestors)))
        for k in self.any_keys:
            either = F.array_distinct(F.array(F.col(k), F.lit(None).cast(dict(points.dtypes)[k])))
            probes = probes.withColumn(f"_{k}", F.explode(either))
        names = {k: f"_{k}" if k in self.any_keys else k for k in self.keys}
        side = small(self.blocks, self.rows, 256).alias("r")
        on = [F.col(f"p.{names[k]}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys] + [F.col("p._at.level") == F.col("r._level"), F.col("p._at.block") == F.col("r._block")]
        return probes.alias("p").join(side, on).select(*[F.col(f"p.{k}").alias(k) for k in self.keys], F.col(f"p.{at}").alias(at), F.col("r.rule").alias("rule"))


def rules_table(rules: DataFrame, keys: list[str], first: str, last: str, any_keys: list[str] | None = None, exclusive: bool = True) -> Rules:
    """Rules that hold for equal keys from `first` to `last`, both inclusive whole numbers; a null bound is open, a null in one of any_keys stands for any value.

    A rule that ends before it begins is a ValueError, and so, if the table is exclusive, are two rules of which some key and number
    could meet both: that is found here, before a row is matched. Numbers that are null meet rules open at both ends only.

    Overlaps are found by a sweep in order of first: a rule overlaps if it begins at or before the largest end of those before it. The
    sweep has two levels, within blocks of numbers and over blocks, so a key with most of the rules is not in one task. A large exclusive
    table without any_keys is kept as it is, cut at parts of numbers so wide that rules and cuts are at most three times the rules; no blocks are made of it. A rule for any
    value and one for a value overlap if one begins within the other, which is the lookup of a point.
    """
    any_keys = any_keys or []
    kept = Kept(rules.sparkSession, "rules")
    wrong = rules.where(F.col(first) > F.col(last)).limit(1).collect()
    if wrong:
        raise ValueError(f"a rule ends before it begins: {wrong[0].asDict()}")
    low, high, n = rules.agg(F.min(F.least(first, last)), F.max(F.greatest(first, last)), F.count(F.lit(1))).first()
    low, high = (low if low is not None else 0) - 1, (high if high is not None else 0) + 1
    bits = max(1, (high - low).bit_length())
    bound = rules.select(*keys, F.struct(*rules.columns).alias("rule"), (F.coalesce(F.col(first), F.lit(low)) - low).cast("long").alias("_first"), (F.coalesce(F.col(last), F.lit(high)) - low).cast("long").alias("_last"))
    bound = kept(bound.withColumn("_open", F.col("_first").eqNullSafe(F.lit(0)) & F.col("_last").eqNullSafe(F.lit(high - low))))
    if exclusive and not any_keys and n > WALKED_RULES:
        spans = [F.sum(F.shiftright("_last", k) - F.shiftright("_first", k) + 1) for k in range(bits + 1)]
        shift = next(k for k, total in enumerate(bound.agg(*[c.alias(f"_{k}") for k, c in enumerate(spans)]).first()) if total <= 3 * n)
        parts = bound.withColumn("_part", F.explode(F.sequence(F.shiftright("_first", shift), F.shiftright("_last", shift))))
        parts = parts.select(*keys, "_part", F.greatest("_first", F.shiftleft("_part", shift)).alias("_place"), "rule", "_last", "_open")
        table = Rules(parts, keys, any_keys, low, high, [], n, parts, shift)
        twice = _overlapping(bound, table, bits)
        if twice is not None:
            raise ValueError(f"rules overlap: {twice}")
        return table
    unknown = F.when(F.col("_open"), F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("block")))).otherwise(F.array())
    covering = F.concat(_covering(F.col("_first"), F.col("_last"), bits), unknown)
    blocks = kept(bound.select(*keys, F.explode(covering).alias("_b"), "rule").select(*keys, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"), "rule"))
    count, levels = blocks.agg(F.count(F.lit(1)), F.collect_set("_level")).first()
    table = Rules(blocks, keys, any_keys, low, high, sorted(levels), count)
    if exclusive:
        twice = _overlapping(bound, table, bits)
        if twice is not None:
            raise ValueError(f"rules overlap: {twice}")
    return table


def _overlapping(bound: DataFrame, table: Rules, bits: int) -> dict | None:
    """A rule that shares a key and a number with another one."""
    keys = table.keys
    rows = bound.withColumn("_part", F.shiftright("_first", bits // 2))
    inside = Window.partitionBy(*keys, "_part").orderBy("_first", "_last").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_part").agg(F.max("_last").alias("_end")).withColumn("_end", F.max("_end").over(over))
    swept = rows.withColumn("_near", F.max("_last").over(inside)).alias("r").join(ends.alias("e"), safe_on("r", "e", [*keys, "_part"]))
    found = swept.where(F.col("r._first") <= F.greatest("r._near", "e._end")).select("r.rule").limit(1).collect()
    if not found and table.any_keys:
        # Of two rules that overlap one begins within the other. A rule for set values finds itself and, if there is one, a rule for any value.
        begins = bound.select(*keys, (F.col("_first") + table.low).alias("_begin")).distinct()
        found = table.looked_up(begins, "_begin").groupBy(*keys, "_begin").agg(F.count(F.lit(1)).alias("_n"), F.max("rule").alias("rule")).where("_n > 1").select("rule").limit(1).collect()
    if not found and table.any_keys:
        # A rule for any value looks at all rules that its begin lies in, whatever their values.
        wide = " or ".join(f"{k} is null" for k in table.any_keys)
        narrowed = Rules(table.blocks, [k for k in keys if k not in table.any_keys], [], table.low, table.high, table.levels, table.rows)
        begins = bound.where(wide).select(*keys, (F.col("_first") + table.low).alias("_begin"), F.col("rule").alias("_own"))
        met = begins.alias("b").join(narrowed.looked_up(begins.select(*narrowed.keys, "_begin").distinct(), "_begin").alias("f"), safe_on("b", "f", [*narrowed.keys, "_begin"]))
        either = [F.coalesce(F.col(f"b.{k}") == F.col(f"f.rule.{k}"), F.lit(True)) for k in table.any_keys]
        for condition in either:
            met = met.where(condition)
        found = met.where(F.col("f.rule") != F.col("b._own")).select("f.rule").limit(1).collect()
    return found[0][0].asDict(recursive=True) if found else None


def with_rule(points: DataFrame, table: Rules, at: str) -> DataFrame:
    """points with `rule`, the rule that holds for a row's keys and number, or null; a row for each rule if the table is not exclusive.

    Rules are looked up once for each distinct (keys, number): a range becomes blocks, a number the blocks that
    it lies in, and they meet in an equi-join (a large exclusive table is walked in order with the numbers instead). Rows then get their rule by an equi-join on what was looked up.
    """
    found = table.looked_up(points.select(*table.keys, at).distinct(), at)
    on = [*table.keys, at]
    return points.alias("p").join(found.alias("f"), safe_on("p", "f", on), "left").select("p.*", "f.rule")
