"""Ranked lexical search: postings as a table bucketed by term, joined with the terms asked for.

`postings` makes one row for each document and term, (bucket, term, doc, doc_id, n, tf), dealt by the term's bucket and a share of
the documents, so that the postings of a term that a third of all documents hold lie in many tasks, and sorted by
term, so that a reader skips what it does not ask for. `search` joins them with the terms of the items, scores each posting in whole
numbers, brings the scores of a document together once (a posting is moved once, however many items ask for its
term), adds them up by item and document where they are, and keeps an item's best by row_number, which drops what
cannot be among them before anything is moved again.

A term's weight and the counts behind it come from all documents. Terms whose weight is 0, which nearly every document holds, add
nothing and are not joined. What is broadcast (terms asked for, weights) was counted before; beyond the bound the same joins
shuffle.

Defined cases: a text that is null, empty or without a term is a document without terms, counts in neither N nor L and is found by
nothing; an item without terms has no rows; rows of one item_id are one item with all their terms. Rows of
documents that repeat an id or are equal are documents of their own. Equal scores are ordered by doc_id, null last, then by
the row's place in the table. An empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from accolade.llm._shared import small, stored, table

#: A term is a run of ASCII letters and digits and of whatever is not ASCII (any byte from 128 on in UTF-8); the bytes are lower-cased before.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TOP, BUCKETS, SHARES = 10, 64, 64
#: What stands for a document's length among its postings; no term is empty.
_LENGTH = b""
#: Postings of one batch that a task hands on.
_BATCH = 1 << 16


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8 in order, with repeats; only A to Z are lower-cased."""
    return TERM.findall(text.lower())


def _counter(schema: pa.Schema):
    """(doc, doc_id, n, term, tf) of each document's terms, each once, and of its length; documents without terms give none."""

    def run(batches):
        for batch in batches:
            at, n, term, tf = [], [], [], []

            def made(batch=batch):
                numbers = pa.array(at, pa.int64())
                columns = {"doc": batch.column("doc").take(numbers), "doc_id": batch.column("doc_id").take(numbers), "n": pa.array(n, pa.int64()), "term": pa.array(term, pa.binary()), "tf": pa.array(tf, pa.int64())}
                return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

            for row, text in enumerate(batch.column("text")):
                own = Counter(terms((text.as_py() or "").encode("utf-8", "replace")))
                if own:
                    at += [row] * (len(own) + 1)
                    n += [own.total()] * (len(own) + 1)
                    term += [_LENGTH, *own]
                    tf += [1, *own.values()]
                if len(at) >= _BATCH:
                    yield made()
                    at, n, term, tf = [], [], [], []
            yield made()

    return run


def postings(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The index of (doc_id, text), stored: bucket, term, doc, doc_id, n, tf; asked (term, each once) limits it to its terms.

    doc tells rows apart. A row with the empty term stands for each document that has terms, so that documents and their
    lengths are counted from the index alone.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    made = S.StructType([*numbered.drop("text").schema.fields, *S._parse_datatype_string("n long, term binary, tf long").fields])
    each = numbered.mapInArrow(_counter(to_arrow_schema(made)), made).withColumn("term", F.col("term").cast("string"))
    if asked is not None:
        wanted = asked.union(asked.sparkSession.createDataFrame([("",)], "term string"))
        each = each.join(small(wanted, asked.count(), 64), "term", "left_semi")
    dealt = each.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(SHARES)))
    return stored(dealt.sortWithinPartitions("bucket", "term").select("bucket", "term", "doc", "doc_id", "n", "tf"), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [(item, t) for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in set(terms((text or "").encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], batch.schema.field("item_id").type), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").select("item_id", F.col("term").cast("string").alias("term")).distinct()


def weights(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, w) of the terms asked for that some document holds and whose weight is above 0, and N and L, counted over the index."""
    lengths = index.where(F.col("term") == "").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.where(F.col("term") != "").groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(asked, "term", "left_semi")
    w = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * lengths[0] + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))).cast("long")
    return held.select("term", w.alias("w")).where("w > 0"), *lengths


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best `top` documents of (doc_id, text) for each item of (item_id, text)."""
    asked = stored(item_terms(items), "asked")
    each_term = stored(asked.select("term").distinct(), "terms")
    index = postings(docs, each_term)
    weight, documents, length = weights(index, each_term)
    weight = stored(weight, "weights")
    m = F.lit(10).cast("long") + F.expr(f"(90L * n * {documents}L) div {max(length, 1)}L")
    scored = index.join(small(weight, weight.count(), 64), "term").withColumn("m", m)
    scored = scored.select("doc", "doc_id", "term", (F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")).alias("s"))
    # Each posting moves to its document once; adding up by document and item then moves nothing.
    sums = scored.repartition("doc").join(small(asked, asked.count(), 72), "term").groupBy("doc", "doc_id", "item_id").agg(F.sum("s").alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS words FROM documents),
e AS (SELECT doc, doc_id, len(words) AS n, unnest(words) AS term FROM d),
p AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM e GROUP BY ALL),
t AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, n_docs),
s AS (SELECT q.item_id, p.doc, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * t.n_docs) // t.n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), t GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
