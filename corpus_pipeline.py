"""Corpus preparation in five stages; each stage's result is stored and read again by the next.

Languages that cannot be told go; repeated lines go, and documents that held nothing else; of each
group of near duplicates the smallest doc_id stays; sources are mixed to their target weights; what
is left is encoded.

Defined cases: a null or blank text, which has no language, goes in the first stage; so do no others for their nulls (source and lang may be
null in any row); rows that repeat a doc_id are documents of their own until their texts are near duplicates; equal rows are near duplicates;
an empty table gives no rows in any stage; further columns stay up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accolade.llm._shared import small, stored, table
from accolade.llm.op02_bpe import encode_documents
from accolade.llm.op05_ngram_join import ngram_links, vertex_groups
from accolade.llm.op06_mixing import mixed_documents
from accolade.llm.op08_line_dedup import SHORTEST, marked_rows
from accolade.llm.op09_language_id import keep_identified


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those in which no language reaches a score of 0.4."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines, n_chars anew; a document that had text and is left with none goes."""
    blank = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "\n\t\r", "   ")) == ""
    rows, old, text = marked_rows(docs, shortest=SHORTEST), F.col("line_row"), F.col("kept_text")
    kept = rows.where(blank(old["text"]) | ~blank(text))
    new = {"text": text, "n_chars": F.when(text.isNull(), old["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, old[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id; of rows that repeat that doc_id, the least text; of groups without any doc_id, likewise."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("near_row")).withColumn("near_hash", F.xxhash64(F.col("near_row")["text"]))
    sized, links = ngram_links(docs.select("doc_id", "text"))
    groups = stored(vertex_groups(links), "pipeline-groups")
    # Texts of a set stand for it by their hash; the row that stays is the least (doc_id, hash) of its group.
    named = stored(sized.where("vertex is not null").join(small(groups, groups.count()), "vertex", "left").select("doc_id", "text_hash", F.coalesce("root", "vertex").alias("root")), "pipeline-named")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("stays"), F.count("*").alias("rows")).where("rows > 1").select("root", "stays")
    least = stored(least, "pipeline-least")
    gone = named.join(small(least, least.count(), 48), "root").where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))))
    gone = stored(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "pipeline-gone")
    same = F.col("near_row")["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (F.col("near_hash") == F.col("gone_hash"))
    kept = own.join(small(gone, gone.count()), same, "left_anti")
    # Rows that repeat both doc_id and text of the one that stays.
    twice = stored(least.join(named, "root").where(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))).groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("twice_id"), F.col("text_hash").alias("twice_hash")), "pipeline-twice")
    again = F.col("near_row")["doc_id"].cast("long").eqNullSafe(F.col("twice_id")) & (F.col("near_hash") == F.col("twice_hash"))
    repeated = twice.count()
    if repeated:
        some = kept.join(small(twice, repeated), again, "left_semi").groupBy(F.col("near_row")["doc_id"].alias("id"), "near_hash").agg(F.min("near_row").alias("near_row"))
        kept = kept.join(small(twice, repeated), again, "left_anti").select("near_row").union(some.select("near_row"))
    return kept.select("near_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document's text."""
    return encode_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: A random field, an edit join and a tokenizer have no SQL; each of these operators is tested against a brute-force version, and the
#: pipeline on planted documents, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
