"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

1. A text's distinct word shingles become 64-bit hashes; equal sets are one class from here on.
2. A signature has K b-bit minima. It is split into chunks; signatures within `errors` differing
   symbols differ in at most one symbol of some chunk (pigeonhole), so the keys that leave out each
   symbol of each chunk in turn meet for every such pair. Pairs that meet are held to a second,
   longer signature, which tells documents that share a passage from near copies.
3. A key's members are compared in blocks, in numpy, a pair under one of its keys only. First each
   class gives its nearest within its block and the key's first member, so that groups of near copies
   join in linear work. Keys whose members all lie in one component are done. Of the others, every two
   blocks meet: members that have a candidate in another component come with their full sets, and every
   such pair is tested unless it is linked by then; what leaves a block is links, not candidates.
4. Links are joined into components by alternating stars, on the executors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, bloom_keep, documents, keyed_min, parts, salt_of, saved

K = 32  # symbols of 16 bits that the index is built on
WIDE = 192  # further symbols of 8 bits, for the same test with less spread
MISSED = 1e-3  # chance that a pair just at the similarity threshold is over the signature's threshold
BLOCK = 1024
_RNG = np.random.default_rng(20_240_607)
_A = _RNG.integers(0, 2**31, K + WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, K + WIDE, dtype=np.uint32)
_S = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _RNG.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _RNG.integers(1, 2**63, K, dtype=np.uint64)


def allowed(symbols: int, similarity: float, missed: float) -> int:
    """Least number of differing symbols that a pair of that similarity exceeds with at most the chance `missed`."""
    p, tail, t = 1 - similarity, 1.0, -1
    while tail > missed:
        t += 1
        tail -= math.comb(symbols, t) * p**t * similarity ** (symbols - t)
    return t


class Scheme:
    """Thresholds and chunks for a similarity of least / of: 11 of 32 and 46 of 192 symbols at 0.85."""

    def __init__(self, least: int, of: int):
        self.least, self.of = least, of
        self.errors = allowed(K, least / of, MISSED)
        self.wide = allowed(WIDE, least / of, MISSED / 4)
        self.chunks = np.array_split(np.arange(K), (self.errors + 2) // 2)  # one of them has at most one error
        self.chunk_of = np.concatenate([np.full(len(c), i) for i, c in enumerate(self.chunks)])
        self.first = np.array([c[0] for c in self.chunks])


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for the most recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer than `size` words, of the whole sequence."""
    found = text.lower().split()  # on bytes: A-Z only, and the six ASCII white spaces
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out += mixed(h[i : len(h) - n + 1 + i] * _S[i % 8] + np.uint64(i))
    return np.unique(mixed(out))


def signature(sh: np.ndarray) -> bytes:
    """K symbols of two bytes and WIDE of one: the minima of the set under as many permutations."""
    low = np.full(K + WIDE, np.iinfo(np.uint32).max, dtype=np.uint32)
    sh = sh.astype(np.uint32)
    for at in range(0, len(sh), 512):
        part = sh[at : at + 512, None] * _A[None, :]
        part += _B[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    m = mixed(low.astype(np.uint64))
    return (m[:K] >> np.uint64(48)).astype("<u2").tobytes() + (m[K:] >> np.uint64(56)).astype("u1").tobytes()


def _signed(docs: DataFrame, kind: str, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            n, digests, sigs = [], [], []
            for t in batch.column(1):
                sh = shingles(b"" if (v := t.as_py()) is None else v, words, size)
                n.append(len(sh))
                digests.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest())
                sigs.append(signature(sh) if len(sh) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                ["nd_id", "nd_n", "nd_digest", "nd_sig"],
            )

    return docs.mapInArrow(work, f"nd_id {kind}, nd_n long, nd_digest binary, nd_sig binary")


def _sets(docs: DataFrame, kind: str, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(b"" if (v := t.as_py()) is None else v, words, size) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["nd_id", "nd_digest", "nd_set"],
                )

    return docs.mapInArrow(work, f"nd_id {kind}, nd_digest binary, nd_set array<long>")


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="u1").reshape(-1, 2 * K + WIDE)
    return np.ascontiguousarray(raw[:, : 2 * K]).view("<u2"), raw[:, 2 * K :]


def _index(scheme: Scheme):
    """(nd_row, nd_sig) -> (key, slot, nd_row): per chunk, the key without each of its symbols in turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1))[0].astype(np.uint64)
            part = mixed((sig + np.uint64(1)) * _KEY[None, :])
            whole = np.stack([part[:, c].sum(axis=1, dtype=np.uint64) for c in scheme.chunks], axis=1)
            key = mixed(whole[:, scheme.chunk_of] - part + _SLOT[None, :]).view(np.int64)
            rows = np.repeat(batch.column(0).to_numpy(), K)
            slots = np.tile(np.arange(K, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(slots), pa.array(rows)], ["key", "slot", "nd_row"])

    return work


GROUP = ("key", "i", "j")


def _meet(t: pa.Table, scheme: Scheme) -> np.ndarray:
    """Candidate pairs (positions a < b, distance) within the groups of a sorted table of members.

    Only pairs in different components, and each under one of the keys that it meets under.
    """
    col = {n: t.column(n).to_numpy() for n in (*GROUP, "slot", "block", "nd_n", "comp")}
    sig, wide = _matrix(t.column("nd_sig").combine_chunks())
    change = np.zeros(t.num_rows, dtype=bool)
    for n in GROUP:
        change[1:] |= col[n][1:] != col[n][:-1]
    group = np.cumsum(change)
    found: list[np.ndarray] = []
    for step in range(1, t.num_rows):
        a = np.flatnonzero(group[step:] == group[:-step])
        if not len(a):
            break
        b = a + step
        ok = (col["comp"][a] != col["comp"][b]) & ((col["i"][a] == col["j"][a]) | (col["block"][a] != col["block"][b]))
        small, large = np.minimum(col["nd_n"][a], col["nd_n"][b]), np.maximum(col["nd_n"][a], col["nd_n"][b])
        ok &= scheme.of * small >= scheme.least * large
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        differs = sig[a] != sig[b]
        ok = differs.sum(axis=1) <= scheme.errors
        a, b, differs = a[ok], b[ok], differs[ok]
        if not len(a):
            continue
        per = np.stack([differs[:, c].sum(axis=1) for c in scheme.chunks], axis=1)
        chunk = (per <= 1).argmax(axis=1)
        inside = differs & (scheme.chunk_of[None, :] == chunk[:, None])
        slot = np.where(inside.any(axis=1), inside.argmax(axis=1), scheme.first[chunk])
        ok = slot == col["slot"][a]
        a, b = a[ok], b[ok]
        d = (wide[a] != wide[b]).sum(axis=1)
        ok = d <= scheme.wide
        if ok.any():
            found.append(np.stack([a[ok], b[ok], d[ok]]))
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)


def _in_groups(work):
    """Applies work(table) to whole groups of sorted batches. A group has at most two blocks of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = np.ones(t.num_rows, dtype=bool)
            for n in GROUP:
                last &= t.column(n).to_numpy() == t.column(n)[-1].as_py()
            cut = t.num_rows - int(last.sum())
            if cut:
                yield from work(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from work(rest)

    return run


def _nearest(scheme: Scheme):
    """Pairs (a, b, d) of each member with its nearest."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        f = _meet(t, scheme)
        if not f.shape[1]:
            return
        who, d, at = np.concatenate([f[0], f[1]]), np.tile(f[2], 2), np.tile(np.arange(f.shape[1]), 2)
        order = np.lexsort((at, d, who))
        head = np.append(True, who[order][1:] != who[order][:-1])
        f = f[:, np.unique(at[order][head])]
        row = t.column("nd_row").to_numpy()
        x, y = row[f[0]], row[f[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(f[2].astype(np.int32))], ["a", "b", "d"])

    return _in_groups(work)


def _taking_part(scheme: Scheme):
    """The members that have a candidate."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        f = _meet(t, scheme)
        if f.shape[1]:
            yield from t.take(pa.array(np.unique(f[:2]))).combine_chunks().to_batches()

    return _in_groups(work)


def _confirmed(scheme: Scheme):
    """Links (a, b) among members with their sets; a pair that is linked already within its group is not tested."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        f = _meet(t, scheme)
        row, comp, sets = t.column("nd_row").to_numpy(), t.column("comp").to_numpy(), t.column("nd_set")
        key = t.column("key").to_numpy()
        held: dict[int, np.ndarray] = {}
        up: dict[tuple, tuple] = {}

        def top(x: tuple) -> tuple:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def of(i: int) -> np.ndarray:
            if i not in held:
                held[i] = sets[i].values.to_numpy().view(np.uint64)
            return held[i]

        links = []
        for a, b, _ in f[:, np.lexsort((f[1], f[0], f[2], key[f[0]]))].T.tolist():
            x, y = top((key[a], comp[a])), top((key[b], comp[b]))
            if x == y:
                continue
            u, v = of(a), of(b)
            inter = len(u) + len(v) - len(np.union1d(u, v))
            if scheme.of * inter >= scheme.least * (len(u) + len(v) - inter):
                up[x] = y
                links.append((row[a], row[b]))
        if links:
            ends = np.array(links, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    return _in_groups(work)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in `edges` (a, b): comp is the least node that it reaches.

    Alternating large and small stars, saved after each to cut lineage. A round's tasks follow the
    number of edges, which is far below that of documents.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = mark(e)
    tasks = min(parts(edges), was[0] // 100_000 + 1)
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.coalesce(tasks))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        more = large.groupBy("u").agg(F.min("v").alias("v"))
        e = saved(small.union(more).distinct().coalesce(tasks))
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def near_labels(edges: DataFrame) -> DataFrame:
    """(node, comp) such that nodes with one comp are linked; not all that are linked have one.

    A node's least neighbour, and that one's.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    up = low.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return saved(low.join(up, "comp").select("node", F.col("top").alias("comp")))


def near_dups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3, least: int = 85, of: int = 100
) -> DataFrame:
    """One row per row of docs: nd_id, nd_n (set size), nd_component (least id reachable), nd_kept.

    Linked: of * intersection >= least * union over sets of `size`-word shingles. Null, empty or blank text: an empty
    set, linked with nothing, kept. Null ids: rows of their own, after all others. Rows that repeat an
    id and text are one class; of a component's rows, those with its least id are kept. Empty table: no rows.
    """
    kind, scheme = dict(docs.dtypes)[doc_id], Scheme(least, of)
    texts = docs.select(F.col(doc_id).alias("nd_id"), F.col(text).cast("binary").alias("nd_text"))
    rows = saved(_signed(texts, kind, size).withColumn("nd_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("nd_none", F.col("nd_id").isNull())
    order = ["nd_none", "nd_id", "nd_row"]
    classes = keyed_min(rows.where("nd_n > 0"), "nd_digest", order)
    is_rep = F.col("first.nd_row") == F.col("nd_row")
    member = saved(
        classes.select(
            "nd_id", "nd_n", "nd_row", F.col("first.nd_row").alias("rep"), F.col("first.nd_id").alias("rep_id"),
            F.when(is_rep, F.col("nd_sig")).alias("nd_sig"), F.when(is_rep, F.col("nd_digest")).alias("nd_digest"),
        )
    )
    reps = member.where("nd_sig is not null")

    keys = reps.select("nd_row", "nd_sig").mapInArrow(_index(scheme), "key long, slot int, nd_row long")
    live = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    kept = bloom_keep(keys, "key", bloom(live, F.col("key"), live.count()))
    held = kept.join(live, "key").join(reps.select("nd_row", "nd_n", "nd_sig"), "nd_row")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("nd_row"), F.col("blocks")).cast("int")
    held = saved(held.withColumn("blocks", blocks).withColumn("block", mine).drop("n"))

    def grouped(m: DataFrame) -> DataFrame:
        return m.repartition(parts(docs), *GROUP).sortWithinPartitions(*GROUP)

    cols = ["key", "i", "j", "slot", "block", "nd_row", "nd_n", "comp", "nd_sig"]

    def inside(m: DataFrame) -> DataFrame:
        """Each member once, in its block; a key's first member in all its blocks."""
        once = m.select("key", F.col("block").alias("i"), F.col("block").alias("j"), "slot", "block", "nd_row", "nd_n", F.col("nd_row").alias("comp"), "nd_sig")
        hot = m.where("blocks > 1")
        if hot.isEmpty():
            return grouped(once)
        own = ["slot", "block", "nd_row", "nd_n", "nd_sig", "blocks"]
        first = hot.groupBy("key", "block").agg(F.min_by(F.struct(*own), "nd_row").alias("f")).groupBy("key").agg(F.min_by("f", "f.nd_row").alias("f"))
        each = first.select("key", "f.*", F.explode(F.sequence(F.lit(0), F.col("f.blocks") - 1)).alias("i")).where("i <> block")
        return grouped(once.unionByName(each.select("key", "i", F.col("i").alias("j"), "slot", "block", "nd_row", "nd_n", F.col("nd_row").alias("comp"), "nd_sig")))

    def across(comp: DataFrame) -> DataFrame:
        """Every two blocks of the keys that still have members in several components.

        The signatures, most of a row, join only those that are left.
        """
        m = held.drop("nd_sig", "nd_n").join(comp, held.nd_row == comp.node, "left").withColumn("comp", F.coalesce("comp", "nd_row")).drop("node")
        m = saved(m)
        several = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("blocks").alias("blocks"))
        several = several.where("lo <> hi").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        m = m.join(several, ["key", "block"], "left_semi").join(reps.select("nd_row", "nd_n", "nd_sig"), "nd_row")
        m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
        return grouped(m.select("key", *pair, "slot", "block", "nd_row", "nd_n", "comp", "nd_sig"))

    def sets_of(used: DataFrame) -> DataFrame:
        """(nd_row, nd_set) of the classes in `used` (nd_row, nd_id, nd_digest), from a second scan of the texts."""
        some = bloom_keep(texts, "nd_id", bloom(used, F.col("nd_id"), used.count())) if used.where("nd_id is null").isEmpty() else texts
        sets = _sets(some, kind, size).join(used.select("nd_row", "nd_digest"), "nd_digest")
        return saved(sets.dropDuplicates(["nd_row"]).select("nd_row", "nd_set"))

    of_class = reps.select("nd_row", "nd_id", "nd_digest")
    near = inside(held).mapInArrow(_nearest(scheme), "a long, b long, d int")
    ends = near.select(F.col("a").alias("who"), "a", "b", "d").union(near.select(F.col("b").alias("who"), "a", "b", "d"))
    best = ends.groupBy("who").agg(F.min(F.struct("d", "a", "b")).alias("p"))
    pairs = saved(best.select("who", "p.a", "p.b"))
    sets = sets_of(saved(pairs.select(F.col("who").alias("nd_row")).join(of_class, "nd_row")))
    a, b = (sets.select(F.col("nd_row").alias(x), F.col("nd_set").alias(f"{x}_set")) for x in "ab")
    inter = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - F.col("inter")
    near = pairs.select("a", "b").distinct().join(a, "a").join(b, "b").withColumn("inter", inter)
    near = saved(near.where(of * F.col("inter") >= least * union).select("a", "b"))
    # Then every pair that still lies in two components, confirmed where its group is.
    met = across(near_labels(near))
    left = saved(met.mapInArrow(_taking_part(scheme), met.select(*cols).schema))
    new = saved(left.select("nd_row").distinct().join(sets.select("nd_row"), "nd_row", "left_anti").join(of_class, "nd_row"))
    if not new.isEmpty():
        sets = sets.union(sets_of(new))
    links = grouped(left.join(sets, "nd_row")).mapInArrow(_confirmed(scheme), "a long, b long")
    comp = saved(components(near.union(links)))

    named = comp.join(reps, comp.node == reps.nd_row).select("node", "comp", "nd_id", F.col("nd_id").isNull().alias("nd_none"))
    low = named.groupBy("comp").agg(F.min(F.struct("nd_none", "nd_id")).alias("low"))
    label = saved(named.join(low, "comp").select(F.col("node").alias("rep"), F.col("low.nd_id").alias("label")))
    # a class may hold any share of the rows: its label reaches them in several runs
    member = member.withColumn("run", salt_of(F.col("nd_row"), runs=64))
    answer = member.select("rep", "run").distinct().join(label, "rep")
    full = member.join(answer, ["rep", "run"], "left").select(
        "nd_id", "nd_n", F.coalesce("label", "rep_id").alias("nd_component"), F.col("nd_row")
    )
    empty = rows.where("nd_n = 0").select("nd_id", "nd_n", F.col("nd_id").alias("nd_component"), "nd_row")
    return full.unionByName(empty).select("nd_id", "nd_n", "nd_component", F.col("nd_id").eqNullSafe(F.col("nd_component")).alias("nd_kept"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("nd_id").alias("doc_id"),
        F.col("nd_n").alias("n_shingles"),
        F.col("nd_component").alias("component_id"),
        F.col("nd_kept").alias("kept"),
    )


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS other FROM s UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""
