"""Language identification with bit-sliced Bloom filters over character n-grams.

All languages share one table: slot i holds a bitmask of the languages that have set it, so one lookup
of an n-gram (the AND of its slots) gives every language that contains it. A text's n-grams are
counted for each language, less what its filter would return by chance; the most decides.

The filters are made on the executors: n-grams of the labelled sample are counted by language, those
that make up a given share of their language's n-grams stay, and their slots' masks are joined by OR.
Only the table of slots goes to the driver; no text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved

SIZES = (2, 3, 4)
PROBES = 3
PER_LANG = 1500  # labelled documents of a language that its filter is made from, about
ONE_IN = 100_000  # an n-gram belongs to a language if at least one in so many of its n-grams is it
MAX_LANGS = 8192  # more raise an error
PIECE = 1 << 20  # characters looked up at a time
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as numbers, each run of anything else as one space, spaces at the ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(letters()[raw], raw, 32).astype(np.uint64)
    return c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams."""
    out = np.full(max(0, len(c) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class LanguageFilter:
    """The languages by code point, the table (a word per 64 languages, by slots) and the commonest language's number."""

    def __init__(self, langs: list[str], slots: int = 1 << 10, usual: int = 0):
        self.langs, self.slots, self.usual = langs, slots, usual
        self.table = np.zeros((-(-max(1, len(langs)) // 64), slots), dtype=np.uint64)
        self.chance = np.zeros(len(langs))

    def fill(self, word: np.ndarray, slot: np.ndarray, bits: np.ndarray) -> LanguageFilter:
        self.table[word, slot] = bits
        for i in range(len(self.langs)):
            self.chance[i] = ((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the share of n-grams that it contains, corrected for chance."""
        if not self.langs or text is None:
            return "und", 0.0
        c = codes(text)
        if not (c != 32).any():
            return "und", 0.0
        total, hits = 0, np.zeros(len(self.langs))
        for at in range(0, len(c), PIECE):
            for n in SIZES:
                g = grams(c[at : at + PIECE + n - 1], n)
                total += len(g)
                where = _slots(g, self.slots)
                for w, row in enumerate(self.table):
                    mask = row[where[0]]
                    for s in where[1:]:
                        mask = mask & row[s]
                    for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                        hits[i] += np.count_nonzero(mask & np.uint64(1 << (i - 64 * w)))
        if not total:
            return self.langs[self.usual], 0.0
        share = np.clip((hits / total - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = int(share.argmax()) if share.any() else self.usual
        return self.langs[best], float(share[best])


def _slots(g: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((g >> np.uint64(20 * i)) % np.uint64(slots)).astype(np.int64) for i in range(PROBES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang number, text) -> (lang number, size, gram, n), added up over about a million n-grams at a time."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    many = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, size), found in held.items():
            g, n = np.unique(np.concatenate(found), return_counts=True)
            cols = [pa.array(np.full(len(g), x, dtype=np.int32)) for x in (lang, size)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["li", "size", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            c = codes(text.as_py())
            for at in range(0, len(c), PIECE):
                for size in SIZES:
                    g = grams(c[at : at + PIECE + size - 1], size)
                    held.setdefault((lang, size), []).append(g)
                    many += len(g)
                if many > 1_000_000:
                    yield from out()
                    many = 0
    yield from out()


def _masks(slots: int):
    """(lang number, gram) -> (word, slot, bits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy()
            where = np.concatenate(_slots(batch.column(1).to_numpy().view(np.uint64), slots))
            bits = np.tile(np.uint64(1) << (lang % 64).astype(np.uint64), PROBES)
            word = np.tile(lang // 64, PROBES).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(where), pa.array(bits.view(np.int64))], ["word", "slot", "bits"])

    return work


def sampled(docs: DataFrame, *, doc_id: str, text: str, lang: str, per_lang: int) -> tuple[list[str], int, DataFrame | None]:
    """(languages by code point, the commonest one's number, sample of labelled rows as (li, text)) outside the held-out third.

    About per_lang rows of each language at most, by a hash of id and text: a bounded sample, fixed by the
    data. Rows that repeat, null ids included, share a hash and count once, so none of them floods the sample.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.select(F.xxhash64(F.lit(3), F.col(doc_id), F.col(text)).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = sorted(map(tuple, rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()))
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return [], 0, None
    shares = docs.sparkSession.createDataFrame(
        [(name, i, min(1.0, per_lang / n)) for i, (name, n) in enumerate(counts)], "lang string, li int, share double"
    )
    some = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < F.col("share"))
    usual = max(range(len(counts)), key=lambda i: counts[i][1])
    return [name for name, _ in counts], usual, some.dropDuplicates(["li", "h"]).select("li", "text")


def learned(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, one_in: int = ONE_IN
) -> LanguageFilter:
    """A filter from about per_lang labelled rows of each language, never from the held-out third.

    Whole texts. An n-gram is in a language's filter if it is at least one in `one_in` of the language's
    n-grams of its size in the sample, so a filter has at most 3 * one_in. The table has 8 slots or more
    for each n-gram of the fullest filter. No labelled rows, or an empty table: a filter of no languages.
    Null texts, ids and languages: see sampled().
    """
    names, usual, some = sampled(docs, doc_id=doc_id, text=text, lang=lang, per_lang=per_lang)
    if some is None:
        return LanguageFilter([])
    counted = some.mapInArrow(_counted, "li int, size int, gram long, n long").groupBy("li", "size", "gram").agg(F.sum("n").alias("n"))
    counted = saved(counted)
    total = counted.groupBy("li", "size").agg(F.sum("n").alias("total"))  # three rows a language
    kept = counted.join(F.broadcast(total), ["li", "size"]).where(F.col("n") * one_in >= F.col("total")).select("li", "gram")
    most = kept.groupBy("li").count().agg(F.max("count")).first()[0] or 0
    slots = 1 << max(10, (8 * most - 1).bit_length())
    masks = kept.mapInArrow(_masks(slots), "word int, slot long, bits long")
    table = masks.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most slots rows per 64 languages
    cols = [table.column(i).to_numpy() for i in range(3)]
    return LanguageFilter(names, slots, usual).fill(cols[0], cols[1], cols[2].view(np.uint64))


def held_out(doc_id):
    """Whether crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: LanguageFilter, *, text: str = "text") -> DataFrame:
    """docs' rows with li_lang and li_score.

    `und` with score 0 for null text, text without a letter, or a model of no languages. A text of
    unknown n-grams only: the commonest language, score 0. Whole texts. Empty table: no rows. Columns
    of docs may have any name that does not start with li_.
    """
    kind = "struct<lang: string, score: double>"
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its table has a bounded size

    # only the texts travel to Python, and only the answers back; the other columns wait in the JVM
    @F.arrow_udf(kind)
    def tell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shipped.value
        for texts in batches:
            said = [known.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], ["lang", "score"]
            )

    told = docs.withColumn("li_told", tell.asNondeterministic()(F.col(text)))  # or a filter on the answer would ask again
    return told.select(*docs.columns, F.col("li_told.lang").alias("li_lang"), F.col("li_told.score").alias("li_score"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learned(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score")
    )
