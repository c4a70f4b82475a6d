"""The corpus pipeline: documents through five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, saved
from tidemark.llm.dedup import exact_dedup
from tidemark.llm.langid import identify, learned
from tidemark.llm.mix import laid_out, mix
from tidemark.llm.neardup import near_dups
from tidemark.llm.pack import pack


KNOWN = 0.2  # share of a text's n-grams that its language has to contain


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that is known.

    Those are null texts, texts without a letter, and texts of which the best language contains less
    than KNOWN of the n-grams. Without any labelled row no language is known, and only texts without a
    letter go. Repeated rows share their fate; an empty table stays empty.
    """
    model = learned(docs)
    if not model.langs:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    told = identify(docs, model)
    return told.where((F.col("li_lang") != "und") & (F.col("li_score") >= KNOWN)).select(*docs.columns)


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(i), F.col("text")) for i in (1, 2)]


def _named(docs: DataFrame) -> DataFrame:
    """(name, text): a row's name is its id, null after all others, and 128 bits of hashes of its text."""
    one, two = _hashes()
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), one.alias("one"), two.alias("two"))
    return docs.select(name.alias("name"), "text")


def _stay(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose name `found` (name, kept) keeps; one row for each name.

    Rows that share an id but not a text have names of their own, and so have rows without an id. Of
    rows that repeat a name, the one whose other columns come first stays.
    """
    names = found.groupBy("name").agg(F.max("kept").alias("kept"), F.count("*").alias("stay_n")).where("kept")
    names = saved(names.select(F.col("name.id").alias("stay_id"), F.col("name.one").alias("stay_one"), F.col("name.two").alias("stay_two"), "stay_n"))
    one, two = _hashes()

    def those(which: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (one == F.col("stay_one")) & (two == F.col("stay_two"))
        return docs.join(which, same, "left_semi")

    again = names.where("stay_n > 1")
    if again.isEmpty():
        return those(names)
    first = F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("stay_first")
    once = those(again).groupBy("doc_id", one.alias("stay_one"), two.alias("stay_two")).agg(first).select("stay_first.*")
    return those(names.where("stay_n = 1")).unionByName(once)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id."""
    return _stay(docs, exact_dedup(_named(docs), doc_id="name").select(F.col("dd_id").alias("name"), F.col("dd_kept").alias("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Documents without words are linked with nothing and stay.
    """
    found = near_dups(_named(docs), doc_id="name", size=5, least=80)
    return _stay(docs, found.select(F.col("nd_id").alias("name"), F.col("nd_kept").alias("kept")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, laid out: each document as often as it is drawn, shard after shard, shuffled inside each.

    Null and blank texts are never drawn; rows without an id or that share one are drawn apart; repeated
    rows are drawn alike, but where the target cuts them. An empty table stays empty.
    """
    return laid_out(mix(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of at most 1024 tokens: a row per piece.

    Null text: the end id alone. Each row is packed on its own, repeated ones too. An empty table has no pieces.
    """
    return pack(docs.select("doc_id", "text")).withColumnRenamed("pk_id", "doc_id")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("pack", packed)]
ORACLE_SQL = None  # MinHash, the mix's order and tokens are beyond SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
