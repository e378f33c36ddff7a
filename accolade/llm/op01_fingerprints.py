"""I-Match document fingerprints, in DataFrame operations only.

Terms are runs of letters and digits, lower-cased and hashed. Document frequencies are counted
over all texts, where the texts of a large group of near copies (equal in four minima of their terms'
hashes) weigh together as one; the lexicon keeps the terms whose inverse document frequency lies in a band. The
band's lower frequency is a share f of all documents, so at most (mean terms a document) / f
terms pass, however many documents there are; what reaches every task is a fixed table of bits
by two places in a term's hash: a term outside the band passes by chance at the square of the table's share of set bits. A document's lexicon terms, distinct and sorted, are hashed over randomised subsets
of the lexicon at four densities: sixteen subsets that split it, then sixteen each of a quarter, a
sixteenth and a sixty-fourth of it. Large subsets find equal documents, small ones keep agreeing
while a part of a document changes. Two fingerprints' likeness is the share of subsets with equal
hashes among those that either document has terms in.

The next document of each is found without ordering the whole table: ids are cut into ranges by
approximate quantiles, and evenly between two quantiles where there are too many rows for those
alone; each range is ordered alone, and its last row takes the first of the next range.

Defined cases: null texts are empty; a text of whose terms less than a tenth, or none, are in the
lexicon is hashed over all its terms; a text without terms has an empty fingerprint, alike (1.0) only to another
such; rows with a null doc_id come last, rows with equal doc_id are ordered by a hash of their
texts; a single row is its own next one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accolade.llm._shared import small, stored, table

#: Shares of all documents that a lexicon term occurs in, at least and at most.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.05
#: Bits of the table of lexicon terms; rows that one range of ids holds, and the most quantiles that cut them.
TABLE_BITS, RANGE_ROWS, MOST_CUTS = 22, 2000, 1024
LEVELS, CELLS = 4, 16
#: A text with a smaller share of its terms in the lexicon is hashed over all; minima that near copies share; units of a document's weight.
FEW_SHARE, MINIMA, UNITS = 0.1, 4, 1 << 20


def terms(text: Column) -> Column:
    """Distinct hashes of the terms of a text."""
    parts = F.split(F.lower(text), r"[\x00-/:-@\[-`{-\x7F]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w)))


def _slot(term: Column, i: int) -> Column:
    """A place in the table: the lowest bits of a term's hash, or its highest ones."""
    return (F.shiftrightunsigned(term, 64 - TABLE_BITS) if i else term).bitwiseAND((1 << TABLE_BITS) - 1)


def _seeded(i: int):
    # A function of one argument: of two, the second would be an element's place.
    return lambda h: F.xxhash64(h, F.lit(i))


def lexicon_bits(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Column:
    """A constant array of 64-bit words with a bit set for each lexicon term's hash; its size is the same for any input."""
    size = docs.count()
    found = docs.select(terms(F.coalesce("text", F.lit(""))).alias("terms"))
    found = found.withColumn("copy", F.xxhash64(*[F.array_min(F.transform("terms", _seeded(i))) for i in range(MINIMA)]))
    # Groups beyond the least share of all rows: at most 1 / least of them, whatever the number of rows.
    groups = found.where(F.size("terms") > 0).groupBy("copy").agg(F.count("*").alias("members")).where(F.col("members") > max(1.0, least * size))
    groups = stored(groups, "copies")
    many, members = groups.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
    size -= members - many
    low, high = max(2, int(least * size)), max(2.0, most * size)
    # greatest() passes over nulls, so a text of no group has to be one of itself.
    weight = F.greatest(F.lit(1), F.floor(F.lit(UNITS) / F.coalesce("members", F.lit(1)))).cast("long")
    weighed = found.join(small(groups, many), "copy", "left").select(F.explode("terms").alias("term"), weight.alias("weight"))
    counts = weighed.groupBy("term").agg((F.sum("weight") / UNITS).alias("df"))
    slots = F.array(*[_slot(F.col("term"), i) for i in range(2)])
    chosen = counts.where((F.col("df") >= low) & (F.col("df") <= high)).select(F.explode(slots).alias("slot"))
    chosen = chosen.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    chosen = chosen.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = [0] * (1 << (TABLE_BITS - 6))
    for r in chosen.collect():  # at most one row a word of the table
        words[r["word"]] = r["bits"]
    # The optimiser folds this to a constant; arrays of literals would be far slower to build.
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")


def _signed(digits: Column) -> Column:
    return F.lower(F.lpad(F.hex(digits.bitwiseAND(0xFFFFFFFF)), 8, "0"))


def _bits_equal(shift: int, mask: int, value: int):
    return lambda h: F.shiftright(h, shift).bitwiseAND(mask) == value


def with_cells(df: DataFrame, text: str, bits: Column, out: str) -> DataFrame:
    """Adds `out`, the hashes of the subsets as an array of 8 hexadecimal digits each, or '' where the document has no term."""
    t, s = f"{out}_all", f"{out}_own"
    is_set = lambda slot: F.getbit(F.element_at(bits, (F.shiftright(slot, 6) + 1).cast("int")), slot.bitwiseAND(63).cast("int")) == 1
    known = lambda h: is_set(_slot(h, 0)) & is_set(_slot(h, 1))
    df = df.withColumn(t, terms(F.col(text))).withColumn(s, F.array_sort(F.filter(t, known)))
    df = df.withColumn(f"{out}_0", F.when((F.size(s) > 0) & (F.size(s) >= FEW_SHARE * F.size(t)), F.col(s)).otherwise(F.array_sort(F.col(t))))
    cells = []
    for k in range(LEVELS):
        if k:
            df = df.withColumn(f"{out}_{k}", F.filter(f"{out}_{k - 1}", _bits_equal(24 + 2 * k, 3, 0)))
        subsets = F.array(*[F.filter(f"{out}_{k}", _bits_equal(34 + 4 * k, CELLS - 1, c)) for c in range(CELLS)])
        cells.append(F.transform(subsets, lambda x: F.when(F.size(x) > 0, _signed(F.xxhash64(x))).otherwise("")))
    return df.withColumn(out, F.concat(*cells)).drop(t, s, *[f"{out}_{k}" for k in range(LEVELS)])


def fingerprint(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.when(x == "", "-").otherwise(x)), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either has terms in; 1 if neither has any."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != "") | (p["b"] != ""))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / F.size(pairs)).cast("double")


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """doc_id, text and `cells` for every row of (doc_id, text)."""
    return with_cells(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", lexicon_bits(docs, least, most), "cells")


def edited_fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """The query's columns for every row of (doc_id, text); see the module's text for the next document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = lexicon_bits(docs, least, most)
    rows = docs.count()
    ranges = min(MOST_CUTS, -(-rows // RANGE_ROWS)) or 1
    pieces = -(-rows // (ranges * RANGE_ROWS)) or 1
    facts = docs.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges).alias("cuts"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("unknown")).first()
    cuts = sorted(set(facts["cuts"] or []))
    constant = lambda values: F.array(*[F.lit(int(v)) for v in values]).cast("array<long>")
    coarse = F.size(F.filter(constant(cuts), lambda b: b < F.col("doc_id")))
    low, high = (F.get(constant(v), coarse).cast("double") for v in ([facts["least"] or 0, *cuts], [*cuts, facts["most"] or 0]))
    fine = F.floor((F.col("doc_id") - low) / (high - low + 1) * pieces)
    tie = F.bitwise_not(F.xxhash64("text"))
    # Rows without an id come last, in ranges of their ties.
    last = -(-facts["unknown"] // RANGE_ROWS)
    by_tie = F.greatest(F.lit(0), F.least(F.lit(last - 1), F.floor((tie.cast("double") / float(1 << 64) + 0.5) * last))) - last
    part = F.when(F.col("doc_id").isNull(), by_tie).otherwise(coarse * pieces + F.greatest(F.lit(0), F.least(F.lit(pieces - 1), fine)) if pieces > 1 else coarse).cast("long")
    placed = docs.withColumn("part", part).withColumn("tie", tie)
    first = placed.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    circle = Window.orderBy(F.desc("part"))
    whole = Window.partitionBy(F.lit(1)).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One narrow row for each RANGE_ROWS documents.
    after = first.select("part", F.coalesce(F.lead("head").over(circle), F.first("head").over(whole)).alias("head"))
    after = stored(after.select(F.col("part").alias("of"), F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie")), "heads")
    heads = docs.withColumn("tie", tie).join(small(after, after.count()), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))).dropDuplicates(["of"])
    heads = stored(with_cells(heads.select("of", "text"), "text", lexicon, "cells").select("of", F.struct("text", "cells").alias("head")), "heads")
    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    own = with_cells(placed, "text", lexicon, "cells")
    own = own.withColumn("next", F.lead(F.struct("text", "cells")).over(order))
    own = own.join(heads.hint("merge"), F.col("part") == F.col("of"), "left").withColumn("next", F.coalesce("next", "head"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    own = own.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)))
    own = own.select("doc_id", n.cast("long").alias("n_chars"), "cells", F.col("next.cells").alias("next_cells"), "edited")
    own = with_cells(own, "edited", lexicon, "edited_cells")
    return own.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("cells")).alias("fingerprint"), fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("edited_cells")).alias("near_edited"), likeness(F.col("cells"), F.col("next_cells")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
