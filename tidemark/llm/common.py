"""Pieces that several operators share: checkpoints, Bloom filters of fixed size, salted groups."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's spark.checkpoint.dir. Only a session on one machine (tests) may do without: it gets a local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", sc.master or ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))


def saved(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage.

    A checkpoint also carries over the constraints and partitionings of the plan that made it, which
    double with each round of a loop, and planning time with them; here its rows start a plan afresh.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which the cluster sizes by its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salt_of(*cols: Column, runs: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7919), *cols), F.lit(runs)).cast("int")


# --- a blocked Bloom filter as a DataFrame: one 64-bit word per block, three bits per key -----------------

MAX_WORDS = 1 << 20  # 64 Mbit; as a broadcast relation at most about 40 MB


def bloom_mask(h: Column) -> Column:
    one = F.lit(1).cast("long")

    def bit(shift: int) -> Column:  # shiftleft with a column needs SQL's function
        return F.call_function("shiftleft", one, F.shiftright(h, shift).bitwiseAND(F.lit(63)).cast("int"))

    return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def bloom_words(count: int) -> int:
    words = 1 << 8
    while words * 6 < count and words < MAX_WORDS:
        words *= 2
    return words


def bloom_hash(key: Column) -> Column:
    return F.xxhash64(F.lit(31), key)


def bloom(df: DataFrame, key: Column, count: int) -> tuple[DataFrame, int]:
    """(filter of at most MAX_WORDS rows `bf_word, bf_bits`, number of words) for about `count` keys."""
    words, h = bloom_words(count), bloom_hash(key)
    return (
        df.select(F.pmod(h, F.lit(words)).alias("bf_word"), bloom_mask(h).alias("bits"))
        .groupBy("bf_word")
        .agg(F.bit_or("bits").alias("bf_bits")),
        words,
    )


def bloom_keep(df: DataFrame, key: str, filt: tuple[DataFrame, int]) -> DataFrame:
    """Rows of df whose key may be in the filter (no false negatives). The filter has a fixed size bound."""
    table, words = filt
    h = bloom_hash(F.col(key))
    cols = df.columns
    hit = df.withColumns({"bf_h": h}).withColumn("bf_word", F.pmod("bf_h", F.lit(words)))
    hit = hit.join(F.broadcast(table), "bf_word")
    return hit.where(F.col("bf_bits").bitwiseAND(bloom_mask(F.col("bf_h"))) == bloom_mask(F.col("bf_h"))).select(*cols)


def keyed_min(rows: DataFrame, key: str, order: list[str], runs: int = 64) -> DataFrame:
    """Each row of `rows` (saved, narrow) with, over its key: `first` (least of `order` as a struct) and `members`.

    A key may hold any share of the rows: they are aggregated per (key, run) before the shuffle, the
    runs of a key are merged, and the answer goes back through (key, run), so no task gets a whole key.
    """
    salted = rows.withColumn("run", salt_of(*[F.col(c) for c in order], runs=runs))
    level0 = saved(salted.groupBy(key, "run").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("members")))
    merged = level0.groupBy(key).agg(F.min("first").alias("first"), F.sum("members").alias("members"))
    answer = saved(level0.select(key, "run").join(merged, key))
    return salted.join(answer, [key, "run"]).drop("run")
