"""Best-fit packing of token sequences: large items matched in pairs, small ones into the tightest gap.

The packing is made over the histogram of piece lengths (at most `capacity` numbers), so it is one
packing of the whole corpus, whatever its size: the plan is a short list of (pattern of lengths,
number of bins). Pieces then find their place by their rank within their length; a length is dealt into
as many groups as its pieces need, each ranked in a task of its own.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, salt_of, saved

CAPACITY = 1024
END_ID = 2
DEAL = 1000  # pieces of one length that are ranked in one group, about, or more where that makes
DEALS = 100_000  # groups or more: the driver gets a number from each
PIECE = "piece int, start long, length long, ids_crc32 long"


END_OF_TEXT = "<|endoftext|>"  # the vocabulary's one special token, id 50256


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """The ids that the tokenizers library gives for byte_bpe_50k.json, without special tokens added.

    They come from the same vocabulary's rank file through tiktoken, four times as fast (tests/llm hold the
    two equal). A text that its pattern cannot get through, such as a million spaces, goes to the
    tokenizers library, and so does every text where another tokenizer file is given.
    """

    def __init__(self, path: str | None = None):
        self.path, self.fast, self.slow = path or tokenizer_path(), None, None
        if path is None:
            import base64

            import public_tokenizers
            import tiktoken

            with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {END_OF_TEXT: 50256}
            self.fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special={END_OF_TEXT}, disallowed_special=())
            except ValueError:  # its pattern gave up on a long run of white space
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, *, doc_id: str, text: str, capacity: int, path: str | None) -> DataFrame:
    """A row per piece: doc_id and PIECE."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "ids_crc32")}
            for i, t in enumerate(batch.column(1)):
                ids = np.array([*tokens.ids(t.as_py() or ""), END_ID], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for k, v in zip(rows, (i, piece, start, length, crc), strict=True):
                        rows[k].append(v)
            at = pa.array(rows.pop("at"), pa.int64())
            cols = [batch.column(0).take(at), pa.array(rows["piece"], pa.int32())] + [pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(cols, ["pk_id", *rows])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("pk_id"), F.col(text).alias("pk_text")).mapInArrow(work, f"pk_id {kind}, {PIECE}")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins), using each length exactly counts[length] times.

    Lengths above a third of the capacity, longest first, pair with the longest other such length that
    fits, at most two in a bin. The rest, longest first, go to the tightest gap that holds them, a new
    bin where none does.
    """
    left = Counter({k: v for k, v in counts.items() if v})
    large = sorted(k for k in left if 3 * k > capacity)
    gaps: dict[int, list[list]] = defaultdict(list)  # gap -> [[pattern, number]]
    while large:
        a = large[-1]
        n = left[a]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k < 0:
            gaps[capacity - a].append([(a,), n])
            large.pop()
            continue
        b = large[k]
        if b == a:
            if n > 1:
                gaps[capacity - 2 * a].append([(a, a), n // 2])
            if n % 2:  # the odd one pairs with the next shorter
                left[a] = 1
                rest = large[:-1]
                j = bisect.bisect_right(rest, capacity - a) - 1
                if j < 0:
                    gaps[capacity - a].append([(a,), 1])
                else:
                    c = rest[j]
                    gaps[capacity - a - c].append([(a, c), 1])
                    left[c] -= 1
                    if not left[c]:
                        rest.remove(c)
            large = [x for x in large if x != a and left[x]]
            continue
        m = min(n, left[b])
        gaps[capacity - a - b].append([(a, b), m])
        left[a] -= m
        left[b] -= m
        large = [x for x in large if left[x]]
    gaps = defaultdict(list, {g: x for g, x in gaps.items() if x})
    keys = sorted(gaps)
    for s in sorted((k for k in counts if 3 * k <= capacity and counts[k]), reverse=True):
        n = counts[s]
        while n:
            k = bisect.bisect_left(keys, s)
            if k == len(keys):
                each = capacity // s
                pattern, bins, g = (), -(-n // each), capacity
            else:
                g = keys[k]
                pattern, bins = gaps[g].pop()
                if not gaps[g]:
                    del gaps[g]
                    keys.pop(k)
            each = g // s
            full = min(bins, n // each)
            rest = n - full * each
            made = [(each, full)] if full else []
            if full < bins and rest:
                made.append((min(rest, each), 1))
            if k < len(keys) + 1 and pattern and bins > sum(x for _, x in made):
                made.append((0, bins - sum(x for _, x in made)))
            for held, number in made:
                n -= held * number
                to = g - held * s
                if not gaps.get(to):
                    bisect.insort(keys, to)
                gaps[to].append([pattern + (s,) * held, number])
    return [(p, n) for g in sorted(gaps) for p, n in gaps[g]]


def layout(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: arrays (first rank, slots in a bin, first sequence, first slot of offsets) and the offsets."""
    rows: dict[int, list] = defaultdict(list)
    offsets: dict[int, list] = defaultdict(list)
    ranks: Counter = Counter()
    first_bin = 0
    for pattern, bins in plan:
        slots: dict[int, list[int]] = defaultdict(list)
        at = 0
        for length in pattern:
            slots[length].append(at)
            at += length
        for length, where in slots.items():
            rows[length].append((ranks[length], len(where), first_bin, len(offsets[length])))
            offsets[length] += where
            ranks[length] += bins * len(where)
        first_bin += bins
    return {k: (*(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)), np.array(offsets[k], dtype=np.int64)) for k, v in rows.items()}


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
) -> DataFrame:
    """A row per piece: pk_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: empty, so the end id alone. Null or repeated ids: each row is packed on its own; rows
    that repeat an id repeat its pieces. Long texts: cut into pieces, never truncated. Empty table: no rows.
    """
    pieces = saved(token_pieces(docs, doc_id=doc_id, text=text, capacity=capacity, path=tokenizer))
    names = ["pk_id", *(c.split()[0] for c in PIECE.split(", "))]
    # a piece of full length is a sequence of its own: any number will do, so it is neither ranked nor moved
    own = (-1 - F.monotonically_increasing_id()).alias("sequence_id")
    full = pieces.where(F.col("length") == capacity).select(*names, own, F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    by_length = dict(map(tuple, rest.groupBy("length").count().collect()))
    deal = max(DEAL, -(-sum(by_length.values()) // DEALS))
    deals = F.lit([-(-by_length.get(n, 0) // deal) or 1 for n in range(1, capacity + 1)])
    rest = rest.withColumn("deal", salt_of(F.col("pk_id"), F.col("piece"), F.col("ids_crc32"), runs=F.element_at(deals, F.col("length").cast("int"))))
    counts = rest.groupBy("length", "deal").count().collect()  # at most capacity + DEALS rows
    total: Counter = Counter()
    before: dict[tuple[int, int], int] = {}
    for length, deal, n in sorted(map(tuple, counts)):
        before[length, deal] = total[length]
        total[length] += n
    placed = layout(plan_bins(total, capacity))
    kind = dict(docs.dtypes)[doc_id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            deal = batch.column(5).to_numpy(zero_copy_only=False)
            rank = batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            rank = rank + np.array([before[x] for x in zip(length.tolist(), deal.tolist(), strict=True)], dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, each, bins, slot, offsets = placed[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[k]
                sequence[at] = bins[k] + inside // each[k]
                offset[at] = offsets[slot[k] + inside % each[k]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    w = Window.partitionBy("length", "deal").orderBy("pk_id", "piece", "ids_crc32")
    ranked = rest.select(*names, "deal", F.row_number().over(w).cast("long").alias("rank"))
    return ranked.mapInArrow(work, f"pk_id {kind}, {PIECE}, sequence_id long, offset long").unionByName(full)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pack(docs).withColumnRenamed("pk_id", "doc_id")
