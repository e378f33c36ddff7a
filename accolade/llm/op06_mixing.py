"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words;
a source takes at most twice its words and what is over goes to the others by weight, which is
the level at which sum(min(weight * level, cap)) meets the total. A source whose target is r
times its words gives every document floor(r) certain whole copies. The words still missing are a
Pareto sample of whole documents with unequal inclusion probabilities: p = min(1, c w), w being the document's size with
its five leading binary digits kept, and c such that the expected words, the sum of p times size, are the missing ones. Documents with
p = 1 are certain and come out first; the others are ranked by their random odds u / (1 - u) divided by their inclusion odds
p / (1 - p), and the sample is the start of that order whose words come nearest to the missing ones: its size is fixed in words, so a
source's taken words are within half a document of its target. u comes from a digest of doc_id and text, so reruns agree.

A third of all rows may be one source: the order is cut into ranges whose word counts are
summed first, so no task orders a whole source; only the ranges' sums are ordered by source.

Defined cases: a null or blank text has size 0 and takes 0; a null doc_id is a value like others, as the text tells its rows apart;
rows equal in doc_id, source and text are alike, so any of them may be the ones that are taken; with no words at all every
target is 0; an empty table gives no rows; further columns are ignored by `mix` and kept by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accolade.llm._shared import small, stored, table

#: Weights by the source's place in code-point order, share of all words, most copies of a word.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Ranges that a source's order is cut into, certain documents and ranked ones half each; leading binary digits of a size that count.
RANGES, DIGITS = 4096, 5


def words(text: Column) -> Column:
    """Number of runs of other characters than space and the controls from tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_name(doc_id: Column, text: Column) -> Column:
    """What a row is drawn by: its doc_id and a digest of its text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def uniform(name: Column, seed: str = "mix") -> Column:
    """A number from 0 up to 1 that depends on the row's name alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target from (source, size); works on one row a source after partial sums."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = by_source.select("source", "source_size", weight.alias("weight"), (F.lit(float(MOST)) * F.col("source_size")).alias("cap"))
    s = s.withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(everything) - before) / weights).withColumn("nth", F.row_number().over(order))
    level = F.min(F.when(F.col("fill") > F.col("level"), F.struct("nth", "level"))).over(everything)["level"]
    return s.withColumn("final", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), "cap")).alias("target"))


def sampling_rates(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(of, rate): c of each source, from counts by (source, weight) of at most a few thousand weights a source."""
    by_weight = sizes.groupBy("source", "weight").agg(F.sum("size").cast("decimal(38,0)").alias("words"))
    heavier = Window.partitionBy("source").orderBy(F.desc("weight"))
    certain = F.coalesce(F.sum("words").over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum((F.col("weight") * F.col("words")).cast("decimal(38,0)")).over(heavier.rowsBetween(0, Window.unboundedFollowing))
    tried = by_weight.join(plan.select("of", "missing"), F.col("source").eqNullSafe(F.col("of")))
    tried = tried.withColumn("rate", (F.col("missing") - certain).cast("double") / rest.cast("double"))
    # The heaviest weight that need not be certain tells the rate; of the lighter ones all rates are the same or too low.
    return tried.where(F.col("rate") * F.col("weight") <= 1).groupBy("of").agg(F.max_by("rate", "weight").alias("rate")).withColumnRenamed("of", "rate_of")


def _sized(docs: DataFrame) -> DataFrame:
    size = words(F.col("text"))
    cut = F.greatest(F.lit(0), F.length(F.bin("size")) - DIGITS)
    rows = docs.select("doc_id", "source", size.alias("size"), row_name(F.col("doc_id"), F.col("text")).alias("name"))
    return rows.withColumn("cut", cut).withColumn("weight", F.expr("shiftleft(shiftright(size, cut), cut)")).withColumn("u", uniform(F.col("name"))).drop("cut")


def mix(docs: DataFrame, name: str = "mix") -> DataFrame:
    """doc_id, source, name, size, source_size, target, taken, whole (certain copies) and extra (sampled words, all or none) for every row of (doc_id, text, source)."""
    sized = stored(_sized(docs), name)
    targets = source_targets(sized)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("missing", F.greatest(F.lit(0), F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = stored(plan.withColumnRenamed("source", "of"), f"{name}-plan")
    rates = sampling_rates(sized.where("size > 0"), plan)
    plan = stored(plan.join(rates, F.col("of").eqNullSafe(F.col("rate_of")), "left").drop("rate_of"), f"{name}-plan")
    sources = plan.count()
    p = F.least(F.lit(1.0), F.coalesce(F.col("rate") * F.col("weight"), F.lit(1.0)))
    planned = sized.join(small(plan, sources, 64), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = planned.where("size > 0 and missing > 0").withColumn("p", p)
    quotient = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("q", F.when(F.col("p") < 1, F.when(F.col("p") > 0, quotient)))
    place = F.when(F.col("p") >= 1, F.col("u")).when(F.col("p") > 0, 1 + F.col("q") / (1 + F.col("q"))).otherwise(F.lit(2.0))
    # Ranked documents are cut by the logarithm of their quotient, 32 ranges to each doubling: its density is at most a quarter for each factor
    # of e whatever the sample's share, so no range has more than 0.6 % of a source.
    octave = F.greatest(F.lit(0), F.least(F.lit(RANGES // 2 - 1), F.floor((F.log2("q") + 32) * (RANGES // 128)))) + RANGES // 2
    certain = F.when(F.col("p") >= 1, F.floor(F.col("u") * (RANGES // 2)))
    rows = rows.withColumn("place", place).withColumn("range", F.coalesce(certain, F.when(F.col("q") > 0, octave), F.when(F.col("q") == 0, F.lit(RANGES // 2)), F.lit(RANGES)).cast("int"))
    rows = stored(rows.select("doc_id", "source", "name", "size", "source_size", "target", "whole", "missing", "place", "range"), f"{name}-order")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("of_source"), F.col("range").alias("of_range"), ahead.alias("ahead"))
    rows = rows.join(small(sums, sources * (RANGES + 1)), F.col("source").eqNullSafe(F.col("of_source")) & (F.col("range") == F.col("of_range"))).drop("of_source", "of_range")
    earlier = Window.partitionBy("source", "range").orderBy("place", "name", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    # Half a document over or under at most: the one that crosses the missing words is taken if that comes nearer.
    extra = F.when(2 * (F.col("missing") - F.col("ahead")) >= F.col("size"), F.col("size")).otherwise(0).cast("long")
    columns = ["doc_id", "source", "name", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), "whole", "extra"]
    sampled = rows.withColumn("extra", extra).select(*columns)
    return sampled.union(planned.where("not (size > 0 and missing > 0)").withColumn("extra", F.lit(0).cast("long")).select(*columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, once for each whole copy and once more if sampled, with the columns of `docs`.

    Rows equal in doc_id, source and text take as many copies in all as the mix gives them, the first ones one more where these do not divide.
    """
    copies = (F.col("whole") + (F.col("extra") > 0).cast("long")) * (F.col("size") > 0).cast("long")
    keys = mix(docs.select("doc_id", "text", "source")).withColumn("copies", copies).groupBy(F.col("name").alias("mix_name"), F.col("source").alias("mix_source"))
    keys = stored(keys.agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows")).where("mix_copies > 0"), "mix-keys")
    # All other columns as one, so that their names cannot clash with these.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mix_row")).withColumn("mix_own", row_name(F.col("mix_row")["doc_id"], F.col("mix_row")["text"]))
    joined = rows.join(small(keys, keys.count(), 96), (F.col("mix_own") == F.col("mix_name")) & F.col("mix_row")["source"].eqNullSafe(F.col("mix_source")))
    alike = Window.partitionBy("mix_name", "mix_source").orderBy("mix_row")
    each = F.expr("mix_copies div mix_rows") + (F.row_number().over(alike) <= F.col("mix_copies") % F.col("mix_rows")).cast("long")
    once = joined.where("mix_rows = 1").select("mix_row", F.col("mix_copies").alias("mix_each"))
    several = joined.where("mix_rows > 1").select("mix_row", each.alias("mix_each")).where("mix_each > 0")
    return once.union(several).select("mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_each")))).select("mix_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The mix of a table of (doc_id, text, source), as SQL with the table's name to fill in.
MIX_SQL = r"""
n AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS name FROM {table}),
d AS (SELECT *, (size >> greatest(0, length(bin(size)) - 5)) << greatest(0, length(bin(size)) - 5) AS weight,
      CAST(CAST('0x' || substr(md5('mix:' || name), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM n),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
      row_number() OVER (ORDER BY fill, source NULLS LAST) AS nth FROM f),
v AS (SELECT arg_min(level, nth) AS final FROM l WHERE fill > level),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT final FROM v), cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
m AS (SELECT *, greatest(0, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size) AS missing FROM p),
g AS (SELECT source, weight, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, weight),
h AS (SELECT g.source, g.weight, CAST(missing - coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY g.weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(g.weight * words) OVER (PARTITION BY g.source ORDER BY g.weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
      FROM g JOIN m ON g.source IS NOT DISTINCT FROM m.source),
c AS (SELECT source, arg_max(rate, weight) AS rate FROM h WHERE rate * weight <= 1 GROUP BY source),
i AS (SELECT d.*, m.source_size, m.target, m.whole, m.missing, least(1.0, coalesce(c.rate * d.weight, 1.0))::DOUBLE AS p
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
q AS (SELECT *, CASE WHEN p < 1 AND p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM i),
k AS (SELECT *, CASE WHEN p >= 1 THEN u WHEN p > 0 THEN 1 + q / (1 + q) ELSE 2.0 END AS place FROM q),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, size > 0 ORDER BY place, name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k),
mixed AS (SELECT doc_id, source, size, source_size, target, whole, CAST(CASE WHEN size > 0 AND missing > 0 AND 2 * (missing - ahead) >= size THEN size ELSE 0 END AS BIGINT) AS extra FROM r)
"""

SQL = "WITH " + MIX_SQL.format(table="documents") + "SELECT doc_id, size, source_size, target, CAST(whole * size + extra AS BIGINT) AS taken FROM mixed"
