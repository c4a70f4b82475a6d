"""Exact top-k inner products with MaxScore, over shards of integer vectors.

A dimension is a term, its column over a shard the term's postings. For a query, a term's bounds over
the shard are the least and largest contribution it can make. Terms are taken by the width of their
bounds: the wide, essential ones are traversed for all rows of the shard; the others are probed, one
after another, only for rows that can still reach the k-th best score so far. Shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, parts, saved, salt_of

TOP = 20
SCALE = 64
EVERY = 20
SHARD_BYTES = 1 << 26  # of a shard's integers, 8 bytes each


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of long as int64, rows by dimensions, read from the column's buffers; short vectors end in zeros."""
    ends = np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(ends, prepend=0)
    dims = max(1, int(n.max(initial=0)))
    if len(n) and n.min() == dims:
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(ends - n, n)] = flat
    return out


def maxscore(q: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int):
    """(positions, scores) of the k best rows of a shard; ids ascend, so ties go to the smaller id.

    postings: dimensions by rows. low, high: each dimension's least and largest value here.
    """
    n = postings.shape[1]
    a, b = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
    order = np.argsort(a - b, kind="stable")
    order = order[q[order] != 0]
    rest = np.append(np.cumsum(b[order][::-1])[::-1], 0)  # most that the terms from here on can add
    floor = np.append(np.cumsum(a[order][::-1])[::-1], 0)  # least
    if n <= k + 1 or not len(order):
        score = q @ postings if len(order) else np.zeros(n, dtype=postings.dtype)
        at = np.flatnonzero(ids != own)
        best = at[np.lexsort((at, -score[at]))][:k]
        return best, score[best]
    # essential terms: until what is left is narrower than the spread of sums, half of all bounds' width
    width = (rest - floor)[:-1]
    essential = max(1, int(np.searchsorted(-width, -0.5 * width[0])))
    score = np.zeros(n, dtype=postings.dtype)
    for t in order[:essential]:
        score += q[t] * postings[t]
    at = np.flatnonzero(ids != own)
    part = score[at]
    step = essential
    while step < len(order):
        # every row will gain at least floor: the k-th best of partial sums is a threshold already
        least = np.partition(part, len(part) - k)[len(part) - k] + floor[step]
        keep = part + rest[step] >= least
        if not keep.all():
            at, part = at[keep], part[keep]
        upto = min(len(order), step + (4 if len(at) > 8 * k else len(order)))
        for t in order[step:upto]:
            part = part + q[t] * postings[t][at]
        step = upto
    best = np.lexsort((at, -part))[:k]
    return at[best], part[best]


def _search(k: int):
    def work(queries: Iterator[pa.RecordBatch], shard: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["q_row", "vec_id", "score"]
        left, right = [pa.Table.from_batches(list(x)) if not isinstance(x, pa.Table) else x for x in (queries, shard)]
        if not left.num_rows or not right.num_rows:
            return
        c, q = (matrix(x.column("v").combine_chunks()) for x in (right, left))
        rows, ids = right.column("row").to_numpy(), right.column("vec_id").to_numpy()
        order = np.lexsort((rows, ids))
        c, rows, ids = c[order], rows[order], ids[order]
        dims = max(c.shape[1], q.shape[1])
        c, q = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (c, q))
        most = float(np.abs(c).max()) * float(np.abs(q).max()) * dims
        if most >= 2.0**63:
            raise OverflowError("a score may not fit a long")
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # each exact in its range
        c, q = np.ascontiguousarray(c.T.astype(kind)), q.astype(kind)
        low, high = c.min(axis=1), c.max(axis=1)
        for i, own in enumerate(left.column("row").to_numpy()):
            at, score = maxscore(q[i], c, low, high, rows, own, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), own)), pa.array(ids[at]), pa.array(score.astype(np.int64))], schema
            )

    return work


def top_k(
    vectors: DataFrame, is_query, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE, shard: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows.

    Queries meet candidates in blocks: every block of queries with every shard once; what moves is
    rows times blocks. Vectors that are null or hold a null or a non-finite component, and rows without
    an id, take no part. Shorter vectors count as ending in zeros. Rows that repeat an id are rows of
    their own: each is a query, and a candidate of the other. Fewer rows than k: all of them. Empty table: no
    rows. Components and scores must fit a long, else the job fails. A shard has at most `shard` rows, by
    default as many as fill SHARD_BYTES, so what a task holds does not grow with the vectors' length.
    """
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.raise_error(F.lit("a vector's component does not fit a long")).cast("long")

    def integer(x: Column) -> Column:
        y = F.floor(x.cast("double") * float(scale))
        return F.when(F.abs(x.cast("double") * float(scale)) < 2.0**62, y).otherwise(large)

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(whole, v).alias("v"), is_query.alias("is_q"))
    rows = rows.where("vec_id is not null and v is not null").withColumn("v", F.transform("v", integer))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    n, nq, dims = rows.agg(F.count("*"), F.count_if("is_q"), F.max(F.size("v"))).first()
    size = shard or max(1, min(SHARD_BYTES // (8 * max(1, dims or 1)), max(4096, n // 64)))
    shards, blocks = max(1, -(-n // size)), max(1, -(-nq // size))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.where("is_q").select("row", "v", salt_of(F.col("row"), runs=blocks).alias("q"), every(shards).alias("s"))
    candidates = rows.select("row", "vec_id", "v", salt_of(F.col("row"), runs=shards).alias("s"), every(blocks).alias("q"))
    found = queries.groupBy("q", "s").cogroup(candidates.groupBy("q", "s")).applyInArrow(_arrow(_search(k)), "q_row long, vec_id long, score long")
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = rows.where("is_q").select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"))
    return best.join(names, "q_row").select("query_id", "rank", "vec_id", "score")


def _arrow(work):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(work(left, right))
        schema = pa.schema([("q_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches(out, out[0].schema) if out else schema.empty_table()

    return run


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
