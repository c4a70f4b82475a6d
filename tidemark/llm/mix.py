"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of each source are dealt into blocks by a hash; a source's target is met by an exact
number of its blocks, in an order (a permutation of the blocks for each pass) drawn once from the seed.
A binary tree over the output shards splits the vector of block quotas at each node by a multivariate
hypergeometric draw, so every leaf shard has an exact quota from each source and holds disjoint runs of
the sources' permuted blocks. Rows are shuffled inside their shard only, by a hash.

The driver plans with a few numbers per source: where its last block stands, and its quota of each
shard. What a row's block stands for follows from these by arithmetic, on the executors.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, parts, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCKS = 4096  # of a source; a power of two
MAX_SOURCES = 100_000  # the driver plans a row of some 400 bytes for each; more raise an error


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> dict:
    """Words wanted from each source: `share` of all words by weight, none above `most` times its size.

    Sources come by code point, None last, and take the weights in turn; what a full source cannot
    take is dealt again among the others by weight until none is above its limit.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            open_.remove(s)
        left -= sum(out[s] for s in full)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources block counts: rows sum to near-equal loads, columns to the quotas exactly."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def deal(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        load = int(counts.sum())
        left = rng.multivariate_hypergeometric(counts, load * (mid - lo) // (hi - lo), method="marginals")
        deal(left, lo, mid)
        deal(counts - left, mid, hi)

    deal(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def mix(
    docs: DataFrame,
    *,
    shards: int = 64,
    seed: int = 17,
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """docs' rows with `mix_size, mix_source_size, mix_target, mix_draws`.

    mix_draws: one struct(pass, shard, place) for each time the mix takes the row, 0 to `most` of
    them; laid_out() makes the shuffled mix of them, a row per draw.

    Null source: a source of its own, last. Null or blank text: size 0, never drawn. A row is known by
    all its columns (but maps), so rows that share an id, or have none, are drawn apart. Equal rows fall
    into one block and are drawn alike, but for those that the target cuts: as many of them as fit.
    Empty table: no rows. A column of docs may have any name but one that starts with `mix_`.
    """
    spark = docs.sparkSession
    named = {c: F.col(f"`{c}`") for c in docs.columns}
    size = F.coalesce(F.regexp_count(named[text], F.lit(WORD)), F.lit(0)).cast("long")
    rest = [named[c] for c, t in docs.dtypes if "map<" not in t and t != "variant" and c not in (doc_id, text)]
    key = F.xxhash64(F.lit(seed), named[doc_id], named[text], *rest)
    block = F.pmod(F.shiftright(key, 20), F.lit(BLOCKS)).cast("int")
    keyed = docs.withColumns({"mix_size": size, "mix_key": key, "mix_block": block})
    narrow = saved(keyed.select(named[source].alias("mix_source"), "mix_size", "mix_key", "mix_block"))
    table = narrow.groupBy("mix_source").agg(F.sum("mix_size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(table) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources cannot be planned")
    sizes = {s: n for s, n in table}
    goal = targets(sizes, weights, share, most)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))

    # Each pass takes a source's blocks in an order of its own: block b stands at (turn * b + shift) mod BLOCKS.
    order = {s: _permutations(seed, s, most) for s in names}
    kind = "mix_p_source string, mix_p_target double, mix_p_turn array<int>, mix_p_shift array<int>"
    wanted = spark.createDataFrame([(s, goal[s], *order[s]) for s in names], kind)
    ends = {r[0]: tuple(r[1:]) for r in _ends(narrow, wanted, most).collect()}  # a row per source at most
    last = [ends.get(s, (most * BLOCKS, 0.0))[0] for s in names]
    quotas = split_quotas([min(at + 1, most * BLOCKS) for at in last], shards, seed)
    cuts = []  # (source, block, pass, words still wanted) of the one block per source that its target cuts
    for s, (at, left) in ends.items():
        again, place = divmod(at, BLOCKS)
        turn, shift = order[s][0][again], order[s][1][again]
        cuts.append((s, (place - shift) * pow(turn, -1, BLOCKS) % BLOCKS, again, left))
    keys = {r.mix_e_source: (r.end.mix_key, r.end.fit if r.end.fit < r.end.copies else None) for r in _edge_keys(narrow, spark, cuts).collect()}
    edge_block = {s: b for s, b, _, _ in cuts}
    plan = [
        (s, sizes[s], goal[s], *order[s], at, quotas[:, k].cumsum().tolist(), edge_block.get(s), *keys.get(s, (None, None)))
        for k, (s, at) in enumerate(zip(names, last, strict=True))
    ]
    per_source = spark.createDataFrame(
        plan,
        "mix_p_source string, mix_source_size long, mix_target double, mix_p_turn array<int>, mix_p_shift array<int>, "
        "mix_p_last int, mix_p_shards array<int>, mix_p_block int, mix_p_key long, mix_p_fit long",
    )
    rows = keyed.join(F.broadcast(per_source), named[source].eqNullSafe(F.col("mix_p_source")), "left")

    def drawn(d: DataFrame, edge: Column) -> DataFrame:
        """edge: whether a row of the cut block is taken there."""
        each = []
        for again in range(most):
            at = _place(F.col("mix_block"), F.col("mix_p_turn")[again], F.col("mix_p_shift")[again], again)
            shard = _shard(at)
            place = F.xxhash64(F.lit(seed), F.col("mix_key"), F.lit(again), shard)
            draw = F.struct(F.lit(again).alias("pass"), shard.alias("shard"), place.alias("place"))
            taken = (F.col("mix_size") > 0) & ((at < F.col("mix_p_last")) | ((at == F.col("mix_p_last")) & edge))
            each.append(F.when(taken, draw))
        draws = F.filter(F.array(*each), lambda x: x.isNotNull()).alias("mix_draws")
        return d.select(*named.values(), "mix_size", "mix_source_size", "mix_target", draws)

    under = F.coalesce(F.col("mix_key") <= F.col("mix_p_key"), F.lit(False))
    if all(fit is None for _, fit in keys.values()):
        return drawn(rows, under)
    halved = F.col("mix_block").eqNullSafe(F.col("mix_p_block")) & F.col("mix_key").eqNullSafe(F.col("mix_p_key")) & F.col("mix_p_fit").isNotNull()
    halved = halved & (F.col("mix_size") > 0)
    return drawn(rows.where(~halved), under).unionByName(drawn(_numbered(rows.where(halved)), F.col("mix_nth") <= F.col("mix_p_fit")))


def _permutations(seed: int, source: str | None, most: int) -> tuple[list[int], list[int]]:
    """Factors and shifts of the passes' permutations: any odd factor permutes the blocks."""
    rng = np.random.default_rng([seed, *hashlib.sha256(repr(source).encode("utf-8", "surrogatepass")).digest()[:8]])
    return (2 * rng.integers(0, BLOCKS // 2, most) + 1).tolist(), rng.integers(0, BLOCKS, most).tolist()


def _place(block: Column, turn: Column, shift: Column, again: int) -> Column:
    """Where a block stands in the order that its source is drawn in, over all passes."""
    return F.lit(again * BLOCKS) + F.pmod(block * turn + shift, F.lit(BLOCKS))


def _shard(at: Column) -> Column:
    """The shard whose run of the source's blocks holds the place: mix_p_shards has the ends of the runs."""
    return F.size(F.filter("mix_p_shards", lambda end: end <= at))


def _ends(narrow: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(source, place, words still wanted) of the block that each source's target cuts, if it cuts one."""
    blocks = narrow.where("mix_size > 0").groupBy("mix_source", "mix_block").agg(F.sum("mix_size").alias("words"))
    blocks = blocks.join(F.broadcast(wanted), F.col("mix_source").eqNullSafe(F.col("mix_p_source")))
    at = F.array(*(_place(F.col("mix_block"), F.col("mix_p_turn")[i], F.col("mix_p_shift")[i], i) for i in range(most)))
    each = blocks.select("mix_source", "words", "mix_p_target", F.explode(at).alias("at"))
    w = Window.partitionBy("mix_source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # most * BLOCKS rows
    each = each.withColumn("so_far", F.sum("words").over(w))
    left = F.col("mix_p_target") - (F.col("so_far") - F.col("words"))
    cut = each.where((F.col("so_far") > F.col("mix_p_target")) & (left > 0))
    return cut.groupBy("mix_source").agg(F.min(F.struct("at", left.alias("left"))).alias("x")).select("mix_source", "x.at", "x.left")


def _edge_keys(narrow: DataFrame, spark: SparkSession, cuts: list[tuple]) -> DataFrame:
    """Of a cut block: whole documents by key, equal ones one by one, up to the nearest word count."""
    cut = spark.createDataFrame(cuts, "mix_e_source string, mix_e_block int, mix_e_pass int, mix_e_left double")
    same = F.col("mix_source").eqNullSafe(F.col("mix_e_source")) & (F.col("mix_block") == F.col("mix_e_block"))
    at_edge = narrow.where("mix_size > 0").join(F.broadcast(cut), same)
    w = Window.partitionBy("mix_e_source").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("mix_size") * F.col("copies")
    return (
        at_edge.groupBy("mix_e_source", "mix_e_left", "mix_key")
        .agg(F.max("mix_size").alias("mix_size"), F.count("*").alias("copies"))
        .withColumn("before", F.sum(words).over(w) - words)
        .withColumn("fit", F.floor((F.col("mix_e_left") - F.col("before")) / F.col("mix_size") + 0.5))
        .where("fit >= 1")
        .groupBy("mix_e_source")
        .agg(F.max_by(F.struct("mix_key", "fit", "copies"), "mix_key").alias("end"))
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `mix_nth`, 1 and up among those of a source (which are equal), without a task for all of them."""
    rows = saved(rows.withColumn("mix_task", F.spark_partition_id()))
    of_task = rows.groupBy("mix_p_source", "mix_task").agg(F.count("*").alias("mix_n"))
    w = Window.partitionBy("mix_p_source").orderBy("mix_task").rowsBetween(Window.unboundedPreceding, -1)
    first = of_task.select(
        F.col("mix_p_source").alias("mix_f_source"), F.col("mix_task").alias("mix_f_task"), F.coalesce(F.sum("mix_n").over(w), F.lit(0)).alias("mix_first")
    )
    nth = F.row_number().over(Window.partitionBy("mix_p_source", "mix_task").orderBy("mix_key"))
    same = F.col("mix_p_source").eqNullSafe(F.col("mix_f_source")) & (F.col("mix_task") == F.col("mix_f_task"))
    return rows.withColumn("mix_nth", nth).join(F.broadcast(first), same).withColumn("mix_nth", F.col("mix_nth") + F.col("mix_first"))


def laid_out(mixed: DataFrame) -> DataFrame:
    """The mix itself, a row per draw with `mix_shard` and `mix_place`: the shards one after another, each in its shuffled order.

    Tasks hold ranges of (shard, place), so a shard may span several of them. Rows that were never drawn are gone.
    """
    draw = F.explode("mix_draws").alias("mix_draw")
    each = mixed.select(*(F.col(f"`{c}`") for c in mixed.columns if c != "mix_draws"), draw)
    each = each.withColumns({"mix_shard": F.col("mix_draw.shard"), "mix_place": F.col("mix_draw.place")}).drop("mix_draw")
    return each.repartitionByRange(parts(mixed), "mix_shard", "mix_place").sortWithinPartitions("mix_shard", "mix_place")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id",
        "source",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_draws")).alias("taken"),
        F.col("mix_draws.shard").alias("shards"),
        F.col("mix_draws.place").alias("places"),
    )
