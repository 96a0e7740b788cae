"""A corpus pipeline of five stages; each takes all documents that the one before
kept. ``run`` applies them to the documents table, writing each stage's result as
Parquet in the shared folder and rereading it.

Every stage takes null ids, texts, languages and sources, empty and very long texts,
ties, repeated rows, empty tables and extra columns (which go); all but the last return
the columns of documents. What each does with them is in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ophelion.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from ophelion.llm._base import NULL_ID, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with their types, and no others."""
    kinds = ("long", "string", "string", "string", "long")
    return docs.select(*(docs[c].cast(k).alias(c) for c, k in zip(COLUMNS, kinds, strict=True)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: null texts and texts without a letter go, others
    stay however sure the prediction is, so clean documents do. A document without a
    ``lang`` gets the predicted one. Learns from documents that have a lang; where none
    has, no language is known and no document stays. Repeated rows each stay."""
    docs = _columns(docs)
    model = language_id.train(language_id.training_rows(docs))
    found = language_id.predict(docs, model, *COLUMNS).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id stays; a
    null id is smaller than any. Of rows that share that id and text one stays, the
    smallest by source, language and length. Texts aren't changed, and whole texts
    decide, however long."""
    docs = _columns(docs)
    decided = exact_dedup.dedup_exact(docs).where("kept")
    # id and text: another row with the winner's id but another text isn't the winner
    named = lambda doc_id, digest: (F.coalesce(doc_id, F.lit(NULL_ID)).alias("__key"), digest.alias("__digest"))
    winners = decided.select(*named(F.col("doc_id"), F.col("text_sha256"))).distinct()
    rows = docs.select(*COLUMNS, *named(docs["doc_id"], F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)))
    row = F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("row")
    return rows.join(winners, ["__key", "__digest"], "left_semi").groupBy("__key", "__digest").agg(row).select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, 0.8) the smallest doc_id stays, null the
    largest; of one doc_id with several texts, or none, each text is decided on its own,
    and equal rows of the one that stays all do. Texts without words are copies of each
    other."""
    docs = _columns(docs)
    first = jaccard_join.first_rows(docs).select(F.col("key").alias("__key"), F.col("digest").alias("__digest"))
    rows = docs.select(*COLUMNS, F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("__key"), jaccard_join.digest_of(docs["text"]).alias("__digest"))
    return rows.join(first, ["__key", "__digest"], "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, then the words of a
    part as a text of their own. Documents that it doesn't take go, and so do those
    without words. Each row is taken by its own size and source, whatever rows share its
    id; a null source is one source."""
    taken = mixing.mix_sources(_columns(docs), keep=COLUMNS).where("taken > 0").select("kept.*", "size", "taken")
    part = F.expr("taken % size")
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    copies = F.concat(
        F.array_repeat(F.col("text"), F.expr("taken DIV size").cast("int")),
        F.when(part > 0, F.array(F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))).otherwise(F.array().cast("array<string>")),
    )
    return taken.select("doc_id", F.explode(copies).alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset; a null text is the end
    token alone, and every row is packed, also those that share an id or have none."""
    return packing.pack_documents(_columns(docs))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Language identification, near duplicates and tokenised packing have no SQL form;
#: tests/llm/test_pipeline.py compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
