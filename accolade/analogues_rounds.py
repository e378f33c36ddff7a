"""More of the award operators over the driver's tables: chains, merges in order, containment, many rules, reports and sources of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accolade.analogues import _query, _t
from accolade.operators import matching as M
from accolade.operators import present as P
from accolade.operators import rounds
from accolade.plans.lookup import user_source


@_query("""
WITH RECURSIVE l AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) % 11 = 0 THEN 0 ELSE turn + 1 + length(text) % 2 END AS to_turn FROM conversations),
r AS (SELECT conv_id, min(turn) AS turn, 0 AS place, [min(turn)] AS seen FROM conversations GROUP BY conv_id
  UNION ALL SELECT r.conv_id, m.turn, r.place + 1, list_append(r.seen, m.turn) FROM r JOIN l ON l.conv_id = r.conv_id AND l.turn = r.turn JOIN l m ON m.conv_id = l.conv_id AND m.turn = l.to_turn WHERE NOT list_contains(r.seen, m.turn))
SELECT conv_id, turn, CAST(place AS BIGINT) AS place FROM r
""")
def next_page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as its links lead, which skip turns, end, or come back to the first."""
    c = _t(spark, sf_dir, "conversations")
    back = (F.col("role") == "assistant") & (F.length("text") % 11 == 0)
    links = c.select("conv_id", "turn", F.when(back, F.lit(0)).otherwise(F.col("turn") + 1 + F.length("text") % 2).alias("to_turn"))
    return rounds.list_ranks(links, c.groupBy("conv_id").agg(F.min("turn").alias("turn")), "turn", "to_turn", ["conv_id"])


@_query("""
WITH RECURSIVE k AS (SELECT o_custkey, o_orderkey, [o_orderpriority || year(o_orderdate), 'm' || (year(o_orderdate) * 12 + month(o_orderdate))] AS keys, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_custkey, n, o_orderkey, keys AS taken, true AS fresh FROM k WHERE n = 1
  UNION ALL SELECT k.o_custkey, k.n, k.o_orderkey, CASE WHEN list_has_any(r.taken, k.keys) THEN r.taken ELSE list_concat(r.taken, k.keys) END, NOT list_has_any(r.taken, k.keys) FROM r JOIN k ON k.o_custkey = r.o_custkey AND k.n = r.n + 1)
SELECT o_custkey, o_orderkey FROM r WHERE fresh
""")
def merge_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders that share neither priority and year nor month with one taken before; those left out take nothing."""
    o = _t(spark, sf_dir, "orders")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    keys = F.array(F.concat("o_orderpriority", y.cast("string")), F.concat(F.lit("m"), (y * 12 + m).cast("string")))
    return rounds.first_fit(o.select("o_custkey", "o_orderkey", keys.alias("keys")), ["o_custkey"], ["o_orderkey"], "keys").select("o_custkey", "o_orderkey")


@_query("""
WITH a AS (SELECT o_custkey, list(DISTINCT l_partkey) AS asked FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
h AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS held FROM lineitem GROUP BY 1)
SELECT o_custkey, l_orderkey FROM a, h WHERE list_has_all(asked, held)
""")
def containment_of_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders whose parts are all among those that a customer has ordered, whoever's orders they are: no key but the sets."""
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    asked = _t(spark, sf_dir, "orders").join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("asked"))
    held = line.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("held"))
    return M.containment_join(asked, held, "o_custkey", "l_orderkey", "asked", "held")


@_query("""
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, min(o_orderkey) AS k FROM orders GROUP BY ALL),
r AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a) AS b FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, k AS in_force, count(*) AS n FROM lineitem LEFT JOIN r ON o_custkey = l_partkey AND CAST(l_shipdate AS DATE) >= a AND (b IS NULL OR CAST(l_shipdate AS DATE) < b) GROUP BY ALL
""")
def many_rules_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer is a rule from its day to the day before the customer's next; lines look for the rule of their day."""
    day = lambda c: F.unix_date(F.to_date(c))
    starts = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("who"), day("o_orderdate").alias("first")).agg(F.min("o_orderkey").alias("k"))
    each = starts.groupBy("who").agg(F.array_sort(F.collect_list("first")).alias("days"))
    ends = each.select("who", F.explode(F.arrays_zip(F.col("days").alias("first"), F.slice("days", 2, 1 << 30).alias("then"))).alias("d")).select("who", "d.first", (F.col("d.then") - 1).alias("last"))
    rules = M.rules_table(starts.join(ends, ["who", "first"]), ["who"], "first", "last")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("who"), day("l_shipdate").alias("shipped"))
    found = M.with_rule(lines, rules, "shipped").select("l_orderkey", "l_linenumber", "l_partkey", F.col("rule.k").alias("in_force"))
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey", "in_force").agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT o_orderkey AS query_id, o_orderpriority NOT LIKE '5%' AND coalesce(bool_or(l_returnflag = 'R'), false) AS has_series_award
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority
""")
def series_award(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request asked for a series and some result is a series'."""
    asked = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).otherwise(" ").alias("series"))
    found = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_returnflag") == "R", "series").otherwise("work").alias("identity_kind"))
    return P.with_series_award(asked, found).select("query_id", "has_series_award")


@_query("""
SELECT l_orderkey AS query_id, string_agg(l_linenumber || CASE WHEN l_linenumber = 1 THEN 'st' WHEN l_linenumber = 2 THEN 'nd' WHEN l_linenumber = 3 THEN 'rd' ELSE 'th' END || ' - ' || year(l_shipdate) || ' Prize ' || l_partkey || ' - ' || l_linestatus,
  '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_linestatus FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1
""")
def qualifying_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted lines of what qualifies, in order."""
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus", "l_returnflag").distinct()
    found = line.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("source_ord"), (F.col("l_partkey") * 10_000_000 + F.col("l_suppkey")).alias("result_ord"), F.when(F.col("l_returnflag") == "A", "QUALIFIES").otherwise("REVIEW").alias("decision"),
        F.col("l_linenumber").alias("rank"), F.lit("").alias("status"), F.year("l_shipdate").alias("award_year"), F.concat(F.lit("Prize "), F.col("l_partkey").cast("string")).alias("award_name"), F.col("l_linestatus").alias("category"), F.lit("T").alias("work_title"), F.lit("work").alias("identity_kind"),
    )
    return P.formatted_qualifying(found).select("query_id", F.array_join("lines", "|").alias("lines"))


@_query("""
SELECT p_partkey, 'Book: ' || p_name || ' | ' || p_brand AS book, CASE WHEN p_type <> 'PROMO' THEN 'Series: ' || p_type END AS series,
  CASE WHEN p_size % 3 = 0 THEN upper(p_name) || ' | ' || p_brand END AS differs FROM part
""")
def identity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities as they are shown, and that of a result where it differs from what was asked for by more than space around it."""
    part = _t(spark, sf_dir, "part").withColumn("work_title", F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("\t"), "p_name", F.lit("  "))))
    series = F.when(F.col("p_type") != "PROMO", F.concat(F.lit(" "), "p_type")).otherwise(" ")
    return part.select("p_partkey", P.book_line(F.concat("p_name", F.lit(" ")), F.col("p_brand")).alias("book"), P.series_line(series).alias("series"), P.identity_if_different(F.col("work_title"), F.col("p_brand"), F.col("p_name"), F.col("p_brand")).alias("differs"))


def _own_prizes(title: str, author: str, series: str | None) -> list[dict]:
    """A source of one's own: prizes by the number behind a supplier's name."""
    number = int(title.rpartition("#")[2] or 0) if "#" in title else len(title)
    if number % 7 == 0:
        raise LookupError(f"no page {number}")
    return [{"work_title": title, "work_author": author, "award_name": "Own", "award_year": 1990 + i, "status": "Winner"} for i in range(number % 3)]


@_query("""
WITH s AS (SELECT s_suppkey, s_name, CASE WHEN contains(s_name, '#') THEN CAST(split_part(s_name, '#', 2) AS BIGINT) ELSE length(s_name) END AS number FROM supplier)
SELECT s_suppkey AS query_id, CAST(1990 + i AS INTEGER) AS award_year, NULL AS message FROM (SELECT *, unnest(range(0, number % 3)) AS i FROM s WHERE number % 7 <> 0)
UNION ALL SELECT s_suppkey, NULL, 'LookupError: no page ' || number FROM s WHERE number % 7 = 0
""")
def user_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a source that is a function, and failures of the requests for which it raised."""
    asked = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("title"), F.lit("A").alias("author"), F.lit(None).cast("string").alias("series"))
    found, failed = user_source("own", "Own", _own_prizes).match(asked, None)
    return found.select("query_id", "award_year", F.lit(None).cast("string").alias("message")).unionByName(failed.select("query_id", F.lit(None).cast("int").alias("award_year"), "message"))
