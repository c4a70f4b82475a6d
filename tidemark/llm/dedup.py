"""Exact deduplication with a log-structured merge index, in DataFrame functions only.

Memtables: rows are dealt into runs by a hash; a task gathers its rows by (digest, run) with their smallest
row and count, and flushes that, sorted by its key, to the runs: level 0. Each run has a Bloom filter.
Lookup: a digest that occurs once in its run, and of which some bit is set in no other run's filter, is
alone, and goes no further. Compaction merges the others, from all runs, and keeps the smallest
identifier: level 1. What hits there (two rows or more) goes into a last filter; a second scan of the
texts sends only rows that pass it on to byte verification, which groups by digest and whole text.
Digests that cover different texts are resolved by the bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bloom, bloom_hash, bloom_keep, bloom_mask, bloom_words, documents, salt_of, saved

RUNS = 64  # at least, and
RUN_ROWS = 4_000_000  # rows in a run at most, up to
MOST_RUNS = 1024  # runs; beyond, runs grow


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def not_alone(level0: DataFrame) -> DataFrame:
    """The entries of runs that may have company: all of a digest's, or none of a digest that has one row.

    Each run's filter has the same size; what is broadcast are the bits that two runs' filters share.
    """
    words, key = bloom_words(level0.count()), F.col("dd_digest")
    h = bloom_hash(key)
    filters = level0.groupBy(F.pmod(h, F.lit(words)).alias("bf_word"), "dd_run").agg(F.bit_or(bloom_mask(h)).alias("bits"))
    zero = F.named_struct(F.lit("one"), F.lit(0).cast("long"), F.lit("two"), F.lit(0).cast("long"))

    def add(acc: Column, bits: Column) -> Column:
        return F.named_struct(F.lit("one"), acc["one"].bitwiseOR(bits), F.lit("two"), acc["two"].bitwiseOR(acc["one"].bitwiseAND(bits)))

    shared = filters.groupBy("bf_word").agg(F.collect_list("bits").alias("bits"))  # one word of each run at most
    shared = shared.select("bf_word", F.aggregate("bits", zero, add, lambda acc: acc["two"]).alias("bf_bits")).where("bf_bits <> 0")
    single = bloom_keep(level0.where("n = 1"), "dd_digest", (shared, words))
    return level0.where("n > 1").unionByName(single)


def exact_dedup(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    runs: int | None = None,
) -> DataFrame:
    """One row per row of docs: dd_id, dd_keep, dd_size, dd_kept, dd_digest (binary).

    Texts are equal when equal after each run of white space becomes one space; null is an empty
    text. The row with the smallest id stays; a null id counts as the largest. Rows that repeat the
    kept id within a group: one of them stays. Empty table: no rows. Any digest gives the same groups;
    a weak one only costs time.
    """
    base = docs.select(F.col(doc_id).alias("dd_id"), normalised(F.col(text)).alias("dd_text")).withColumn("dd_digest", digest(F.col("dd_text")))
    rows = saved(base.select("dd_id", "dd_digest").withColumn("dd_row", F.monotonically_increasing_id()))
    runs = runs or min(MOST_RUNS, max(RUNS, rows.count() // RUN_ROWS))
    rows = rows.withColumn("dd_run", salt_of(F.col("dd_row"), runs=runs))
    order = F.struct(F.col("dd_id").isNull().alias("none"), F.col("dd_id").alias("id"), F.col("dd_row").alias("row"))
    level0 = saved(rows.groupBy("dd_digest", "dd_run").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    merged = not_alone(level0).groupBy("dd_digest").agg(F.min("first").alias("first"), F.sum("n").alias("dd_size"))
    hits = saved(merged.where("dd_size > 1"))

    hit_filter = bloom(hits, F.col("dd_digest"), hits.count())
    texts = bloom_keep(base.select("dd_id", "dd_text", "dd_digest"), "dd_digest", hit_filter)
    variants = texts.groupBy("dd_digest", "dd_text").agg(F.count("*").alias("n"))
    collided = saved(variants.groupBy("dd_digest").agg(F.count("*").alias("texts")).where("texts > 1").select("dd_digest"))

    answer = saved(level0.select("dd_digest", "dd_run").join(hits, "dd_digest"))
    out = rows.join(answer, ["dd_digest", "dd_run"], "left").select(
        "dd_id",
        F.when(F.col("first").isNull(), F.col("dd_id")).otherwise(F.col("first.id")).alias("dd_keep"),
        F.coalesce("dd_size", F.lit(1)).cast("long").alias("dd_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("dd_row"))).alias("dd_kept"),
        "dd_digest",
    )
    if collided.isEmpty():
        return out
    # Bytes decide where a digest covers several texts.
    odd = saved(base.join(collided, "dd_digest", "left_semi").withColumn("dd_row", F.monotonically_increasing_id()))
    groups = odd.groupBy("dd_digest", "dd_text").agg(F.min(order).alias("first"), F.count("*").alias("dd_size"))
    fixed = odd.join(groups, ["dd_digest", "dd_text"]).select(
        "dd_id",
        F.col("first.id").alias("dd_keep"),
        F.col("dd_size").cast("long").alias("dd_size"),
        (F.col("first.row") == F.col("dd_row")).alias("dd_kept"),
        "dd_digest",
    )
    return out.join(collided, "dd_digest", "left_anti").select(*fixed.columns).unionByName(fixed)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("dd_id").alias("doc_id"),
        F.col("dd_keep").alias("keep_id"),
        F.col("dd_size").alias("group_size"),
        F.col("dd_kept").alias("kept"),
        F.lower(F.hex("dd_digest")).alias("text_sha256"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
