"""The award operators over the driver's tables, each with SQL that says the same.

The tables hold no awards; every query here runs the engine's own operator on columns that
play its part, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accolade.functions import text as T
from accolade.operators import present as P
from accolade.operators import qualify as Q
from accolade.operators import relational as R
from accolade.operators.matching import contains_all
from accolade.operators.rounds import safe_on
from accolade.sources import readers as W
from accolade.sources.snapshots import host_is_allowed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("""
WITH r AS (SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS award_year, CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY award_year ORDER BY cents DESC, l_partkey) AS n FROM r),
s AS (SELECT k.*, p_name AS work_title, p_type AS category, CASE WHEN n <= 10 THEN CAST(n AS INTEGER) END AS rank,
      CASE n % 4 WHEN 0 THEN 'Winner' WHEN 1 THEN 'Finalist' WHEN 2 THEN 'Longlist' ELSE 'Other' END AS status FROM k JOIN part ON p_partkey = l_partkey),
p AS (SELECT * FROM (VALUES ('economy', 1997, NULL, 'finalist', NULL), ('standard', NULL, 1998, NULL, 'longlist')) t(c, a, b, good, bad)),
j AS (SELECT s.*, p.good, p.bad FROM s LEFT JOIN p ON lower(s.category) = p.c AND (p.a IS NULL OR s.award_year >= p.a) AND (p.b IS NULL OR s.award_year <= p.b))
SELECT l_partkey, award_year, rank,
  CASE WHEN rank <= 5 THEN 'QUALIFIES' WHEN rank > 5 THEN 'DOES_NOT_QUALIFY' WHEN status = 'Winner' THEN 'QUALIFIES' WHEN lower(status) = good THEN 'QUALIFIES' WHEN lower(status) = bad THEN 'DOES_NOT_QUALIFY' ELSE 'REVIEW' END AS decision,
  CASE WHEN rank IS NULL THEN status WHEN rank % 100 BETWEEN 11 AND 13 THEN rank || 'th' WHEN rank % 10 = 1 THEN rank || 'st' WHEN rank % 10 = 2 THEN rank || 'nd' WHEN rank % 10 = 3 THEN rank || 'rd' ELSE rank || 'th' END
  || ' - ' || award_year || ' Revenue Prize - ' || category AS line
FROM j
""")
def qualify_rank_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within a year, policies by category and year range, the decision, and the formatted line."""
    items = _t(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("award_year")).agg(F.round(F.sum(F.col("l_extendedprice") * 100)).cast("long").alias("cents"))
    df = R.numbered(items, ["cents", "l_partkey"], "n", ["award_year"], ("cents",)).join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("Winner", "Finalist", "Longlist", "Other")]), (F.col("n") % 4 + 1).cast("int"))
    df = df.select("l_partkey", "award_year", F.when(F.col("n") <= 10, F.col("n").cast("int")).alias("rank"), status.alias("status"), F.col("p_type").alias("category"), F.col("p_name").alias("work_title"), F.lit("Revenue Prize").alias("award_name"), F.lit("work").alias("identity_kind"))
    rules = Q.policies((("Revenue Prize", "ECONOMY", 1997, None, ("Finalist",), (), ""), ("Revenue Prize", "STANDARD", None, 1998, (), ("Longlist",), "")))
    return Q.assess(df, rules).select("l_partkey", "award_year", "rank", "decision", P.formatted().alias("line"))


@_query("""
SELECT n, CASE WHEN n % 100 BETWEEN 11 AND 13 THEN n || 'th' WHEN n % 10 = 1 THEN n || 'st' WHEN n % 10 = 2 THEN n || 'nd' WHEN n % 10 = 3 THEN n || 'rd' ELSE n || 'th' END AS ordinal, count(*) AS uses
FROM (SELECT l_linenumber AS n FROM lineitem UNION ALL SELECT p_size FROM part) GROUP BY 1
""")
def ordinal_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).union(_t(spark, sf_dir, "part").select("p_size"))
    return n.groupBy("n").agg(F.count("*").alias("uses")).select("n", Q.ordinal(F.col("n")).alias("ordinal"), "uses")


@_query("SELECT p_partkey, p_brand, p_size, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS tied FROM part")
def tie_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", R.is_shared(["p_brand", "p_size"]).alias("tied"))


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))))")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normal form; only digests are moved, not texts."""
    form = F.md5(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))))
    df = _t(spark, sf_dir, "documents").select("doc_id", form.alias("form"))
    copies = df.groupBy("form").agg(F.count(F.lit(1)).alias("copies")).alias("c")
    return R.first_wins(df, ["form"], ["doc_id"]).alias("f").join(copies, safe_on("f", "c", ["form"])).select("doc_id", "copies")


_asked_titles, _known_titles = (T.list_column(lambda v, asked=asked: T.title_keys(T.title_basic(v).replace(": ", ":"), asked)) for asked in (True, False))
_TITLES = """
WITH n AS (SELECT DISTINCT p_brand, p_name, p_type FROM part),
q AS (SELECT DISTINCT p_brand || ' ' || p_name || CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN ': ' || p_type ELSE '' END AS title FROM n),
r AS (SELECT DISTINCT p_brand || ' & ' || p_name || CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN ': ' || p_type ELSE '' END AS title FROM n),
"""


@_query(_TITLES + """
a AS (SELECT title AS query_title, lower(replace(title, ' ', ' and ')) AS n FROM (SELECT title FROM q)),
b AS (SELECT title AS record_title, lower(replace(replace(title, ' & ', ' and '), ': ', ':')) AS n FROM r),
x AS (SELECT query_title, lower(regexp_replace(replace(query_title, ': ', ':'), '^(Brand#[0-9]+) ', '\\1 and ')) AS n FROM a)
SELECT query_title, record_title FROM x JOIN b ON x.n = b.n
  OR (contains(x.n, ':') AND NOT contains(b.n, ':') AND split_part(x.n, ':', 1) = b.n)
  OR (contains(b.n, ':') AND NOT contains(x.n, ':') AND split_part(b.n, ':', 1) = x.n)
""")
def title_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that match in full or up to one side's colon, by the engine's keys; the SQL joins on the plain condition."""
    n = _t(spark, sf_dir, "part").select("p_brand", "p_name", "p_type").distinct()
    tail = lambda *kinds: F.when(F.col("p_type").isin(*kinds), F.concat(F.lit(": "), F.col("p_type"))).otherwise("")
    q = n.select(F.concat("p_brand", F.lit(" "), "p_name", tail("ECONOMY", "STANDARD")).alias("query_title")).distinct()
    r = n.select(F.concat("p_brand", F.lit(" & "), "p_name", tail("PROMO", "STANDARD")).alias("record_title")).distinct()
    asked = q.withColumn("k", _asked_titles(F.regexp_replace("query_title", r"^(Brand#[0-9]+) ", "$1 and ")))
    return R.key_join(asked, r.withColumn("k2", _known_titles("record_title")), "k", "k2", [], ["query_title"], ["record_title"])


_ordered_asked, _ordered_known = T.list_column(lambda v: T.ordered_names(v, True)), T.list_column(lambda v: T.ordered_names(v, False))
_any_part = T.list_column(lambda v: T.any_part([v]))


def _credit(names: str, between: str):
    """The numbers of people as names in one text."""
    return F.array_join(F.transform(names, lambda x: F.concat(F.lit("Person "), x.cast("string"))), between)


_PEOPLE = "WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey % 20))) AS names FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, list_sort(list_distinct([o_custkey % 20, o_orderkey % 20])) AS asked FROM orders) "


def _people(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 20)).alias("names"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.array_sort(F.array_distinct(F.array(F.col("o_custkey") % 20, F.col("o_orderkey") % 20))).alias("asked"))
    return o.join(s, "o_orderkey")


@_query(_PEOPLE + "SELECT o_orderkey, len(names) AS n FROM o JOIN s ON o_orderkey = l_orderkey WHERE names = asked")
def author_list_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).where(F.arrays_overlap(_ordered_asked(_credit("asked", " & ")), _ordered_known(_credit("names", ", ")))).select("o_orderkey", F.size("names").cast("long").alias("n"))


@_query(_PEOPLE + "SELECT o_orderkey, len(list_intersect(names, asked)) AS shared FROM o JOIN s ON o_orderkey = l_orderkey WHERE list_has_any(names, asked)")
def author_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _people(spark, sf_dir).where(F.arrays_overlap(_any_part(_credit("names", " & ")), _any_part(_credit("asked", " & "))))
    return df.select("o_orderkey", F.size(F.array_intersect("names", "asked")).cast("long").alias("shared"))


@_query(_PEOPLE + "SELECT o_orderkey, len(names) AS n FROM o JOIN s ON o_orderkey = l_orderkey WHERE list_has_all(asked, names)")
def author_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credited one is among those asked for."""
    return _people(spark, sf_dir).where(contains_all(F.col("names"), F.col("asked"))).select("o_orderkey", F.size("names").cast("long").alias("n"))


@_query("""
WITH k AS (SELECT p_brand, p_size, p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)
SELECT s.s_suppkey, CASE WHEN k.n = 1 THEN k.p_partkey END AS ranked FROM supplier s
LEFT JOIN (SELECT * FROM k WHERE n = 1) k ON k.p_brand = 'Brand#' || (s.s_suppkey % 25 + 1) AND k.p_size = s.s_suppkey % 50 + 1
""")
def rank_enrich_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left lookup that counts only if it finds exactly one row."""
    one = R.only_match(_t(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"])
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"), (F.col("s_suppkey") % 50 + 1).cast("int").alias("p_size"))
    return s.join(one, ["p_brand", "p_size"], "left").select("s_suppkey", F.col("p_partkey").alias("ranked"))


@_query("""
SELECT o_orderkey, p.name AS policy FROM orders LEFT JOIN (VALUES ('early', 1, 1996, NULL), ('middle', 1997, 1998, 'O'), ('late', 1999, NULL, NULL)) p(name, a, b, s)
ON year(o_orderdate) >= p.a AND (p.b IS NULL OR year(o_orderdate) <= p.b) AND (p.s IS NULL OR o_orderstatus = p.s)
""")
def policy_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join with a handful of fixed rules, broadcast."""
    rules = spark.createDataFrame([("early", 1, 1996, None), ("middle", 1997, 1998, "O"), ("late", 1999, None, None)], "policy string, a int, b int, s string")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    return o.join(F.broadcast(rules), R.year_in_range(F.col("y"), F.col("a"), F.col("b")) & (F.col("s").isNull() | (F.col("s") == F.col("o_orderstatus"))), "left").select("o_orderkey", "policy")


_SPAN = "WITH m AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), e AS (SELECT o_custkey, unnest(range(min(y), max(y) + 1)) AS y FROM m GROUP BY 1) "


def _years(spark, sf_dir):
    m = _t(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    return m, m.groupBy("o_custkey").agg(F.min("y").alias("a"), F.max("y").alias("b")).select("o_custkey", F.explode(F.sequence("a", "b")).alias("y"))


@_query(_SPAN + "SELECT e.o_custkey, CAST(min(e.y) AS INTEGER) AS first_missing, 'missing: ' || min(e.y) || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ' more)' ELSE '' END AS message FROM e LEFT JOIN m ON m.o_custkey = e.o_custkey AND m.y = e.y WHERE m.y IS NULL GROUP BY 1")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, expected = _years(spark, sf_dir)
    missing = R.gaps(expected, found, ["o_custkey", "y"])
    told = R.gap_message(missing, ["o_custkey"], "y", F.lit("missing: "))
    return told.select("o_custkey", F.regexp_extract("message", r"(\d{4})", 1).cast("int").alias("first_missing"), "message")


@_query(_SPAN + "SELECT e.o_custkey, CAST(e.y AS INTEGER) AS y FROM e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.o_custkey AND year(o.o_orderdate) = e.y AND o.o_orderstatus = 'F')")
def winner_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in a customer's span without a finished order."""
    found, expected = _years(spark, sf_dir)
    return R.gaps(expected, found.where("o_orderstatus = 'F'"), ["o_custkey", "y"])


@_query("""
WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber * 1000000 + l_partkey) AS pos FROM lineitem GROUP BY 1, 2)
SELECT l.l_orderkey, f.names, l.winner FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS winner FROM lineitem GROUP BY 1) l
JOIN (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY pos, l_suppkey) AS names FROM f GROUP BY 1) f USING (l_orderkey)
""")
def group_ordered_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a group in order of first appearance, and whether any of its rows won."""
    at = F.struct(F.col("l_linenumber") * 1000000 + F.col("l_partkey"), F.col("l_suppkey"))
    names = R.in_order_once(at, F.col("l_suppkey").cast("string"))
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(names, ",").alias("names"), F.bool_or(F.col("l_returnflag") == "R").alias("winner"))


@_query("SELECT o_orderkey FROM orders a WHERE NOT (year(o_orderdate) = 1997 AND EXISTS (SELECT 1 FROM orders b WHERE year(b.o_orderdate) = 1998 AND b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority))")
def anti_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one year go if the next year's page has their identity; other years are not touched."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array("o_orderpriority").alias("keys"), F.year("o_orderdate").alias("y"))
    return R.without_identities(o, ["o_orderkey"], F.col("y") == 1997, o.where("y = 1998"), ["o_custkey"], "keys").select("o_orderkey")


@_query("""
SELECT source_ord, key, name, row_number() OVER (ORDER BY source_ord, key) AS place FROM (
SELECT 0 AS source_ord, CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation UNION ALL SELECT 2, s_suppkey, s_name FROM supplier)
""")
def registry_union_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources one after another, numbered over ranges, so no task orders all rows."""
    parts = [_t(spark, sf_dir, t).select(F.lit(i).alias("source_ord"), F.col(k).cast("long").alias("key"), F.col(n).alias("name")) for i, (t, k, n) in enumerate((("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name")))]
    rows = parts[0].union(parts[1]).union(parts[2])
    return R.numbered(rows, ["source_ord", "key"], "place")


_LISTS = """
WITH e AS (SELECT user_id, [event_type || CASE WHEN event_id % 7 = 0 THEN ',x' WHEN event_id % 7 = 1 THEN ' ' ELSE CAST(event_id % 5 AS VARCHAR) END] AS v, event_id FROM events),
l AS (SELECT user_id, list(v[1] ORDER BY event_id) AS vs FROM e GROUP BY 1),
x AS (SELECT user_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM l),
u AS (SELECT user_id, arg_min(v, i) AS v, min(i) AS i FROM x WHERE NOT contains(v, ',') AND trim(v) <> '' GROUP BY user_id, lower(trim(v)))
"""


def _values(spark, sf_dir):
    tail = F.when(F.col("event_id") % 7 == 0, ",x").when(F.col("event_id") % 7 == 1, " ").otherwise((F.col("event_id") % 5).cast("string"))
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", tail).alias("v"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("new"))


@_query(_LISTS + """
, k AS (SELECT user_id, v, i FROM u WHERE lower(trim(v)) NOT IN ('click2', 'view')),
a AS (SELECT user_id, string_agg(v, '|' ORDER BY i) AS more FROM k GROUP BY 1)
SELECT l.user_id, 'CLICK2|View' || CASE WHEN more IS NULL THEN '' ELSE '|' || more END AS vals, more IS NOT NULL AS changed FROM l LEFT JOIN a USING (user_id)
""")
def writeback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _values(spark, sf_dir).withColumn("existing", F.array(F.lit("CLICK2"), F.lit("View")))
    return P.write_back(df, "existing", "new", "append").select("user_id", F.array_join("values", "|").alias("vals"), "changed")


@_query(_LISTS + "SELECT l.user_id, coalesce(string_agg(u.v, '|' ORDER BY u.i), '') AS vals FROM l LEFT JOIN u ON u.user_id = l.user_id GROUP BY 1")
def writeback_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _values(spark, sf_dir).withColumn("existing", F.array().cast("array<string>"))
    return P.write_back(df, "existing", "new", "replace").select("user_id", F.array_join("values", "|").alias("vals"))


@_query(_LISTS + "SELECT user_id, count(*) FILTER (contains(v, ',')) AS rejected, count(*) FILTER (NOT contains(v, ',')) AS safe FROM x GROUP BY 1")
def comma_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("user_id", F.size(P.with_commas(F.col("new"))).cast("long").alias("rejected"), F.size(P.without_commas(F.col("new"))).cast("long").alias("safe"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of each payload, read from its variant; what is no JSON has none."""
    return _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@_query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS heading, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1)) AS h FROM pages) GROUP BY 1, 2")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and how often a page has them, by the engine's elements."""
    elements = W.elements_of(_t(spark, sf_dir, "pages"), "page_id", "html")
    inside = W.boxes(elements, F.col("tag").isin("h1", "h2", "h3"), F.lit(True), "box").where("box is not null")
    told = inside.groupBy("page_no", "box").agg(W.squeezed(W.text_of()).alias("heading"))
    return told.groupBy(F.col("page_no").alias("page_id"), "heading").agg(F.count("*").alias("n"))


@_query("SELECT page_id, CAST(len(h) AS BIGINT) AS links, CAST(len(list_distinct(h)) AS BIGINT) AS targets FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, by the engine's elements."""
    pages = _t(spark, sf_dir, "pages")
    found = W.elements_of(pages, "page_id", "html").where("tag = 'a' and href is not null").groupBy(F.col("page_no").alias("page_id")).agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("targets", F.lit(0)).alias("targets"))


@_query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def heading_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = R.carry_forward(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], ["turn"])
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("asked_at"))


@_query("WITH h AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS host FROM pages) SELECT page_id, host <> '' AND host IN (SELECT host FROM h WHERE page_id < 5) AS allowed FROM h")
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on the hosts of the five first pages; the list itself is five rows."""
    pages = _t(spark, sf_dir, "pages")
    hosts = [r[0] for r in pages.where("page_id < 5").select(F.lower(F.parse_url("url", F.lit("HOST")))).collect()]
    return pages.select("page_id", host_is_allowed(F.col("url"), [h for h in hosts if h]).alias("allowed"))


@_query("SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '<quality missing>') || ' - ' || coalesce(lang, '<lang missing>') AS line FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return df.select("doc_id", F.concat(P.or_missing(F.col("quality").cast("string"), "quality"), F.lit(" - "), P.or_missing(F.col("lang"), "lang")).alias("line"))
