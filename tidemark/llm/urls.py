"""URL filter: longest-match rules, and boosted trees on lexical features for what no rule covers.

Among the features are suffix statistics: the share of blocked URLs among all labelled ones with the same
end of the host, host, or host and first path segment. They are counted over the whole table in a hashed
table of fixed size. When the trees are fitted, a URL's statistics leave out its own half of the URLs, or
its own half of the hosts, so they learn what to make of known hosts and of hosts never seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Booster
from .common import documents, lower_ascii

#: (host, path, verdict); a rule holds for its host, all subdomains and all paths that start with its path.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
SAMPLE = 20_000  # labelled URLs that the trees are fitted on, about
BUCKETS = 1 << 18  # of the suffix statistics: what suffixes share a bucket share their statistics
FEATURES = (
    "length", "host length", "path length", "depth", "digit ratio", "entropy", "parameters", "assignments", "host dots", "host dashes", "https", "fragment",
    "extension", "suffix: last label", "suffix: two labels", "suffix: two labels and segment", "suffix: host",
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, PARTS, 1)), F.regexp_extract(u, PARTS, 2)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column, path: Column) -> Column:
    """Buckets of the ends of the host (one label, two), of two labels with the first path segment, and of the host."""
    two = F.substring_index(host, ".", -2)
    segment = F.regexp_extract(path, "^/([^/]*)", 1)
    ends = [F.substring_index(host, ".", -1), two, F.concat_ws("/", two, segment), host]
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), e), F.lit(BUCKETS)).cast("int") for i, e in enumerate(ends)))


def lexical(url: str) -> list[float]:
    """Length, depth, digit ratio, entropy, parameters and host shape of one URL."""
    m = re.match(PARTS, url)
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    n = max(1, len(url))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), path.count("/"), digits / n, entropy, query.count("&") + bool(query), query.count("="),
        host.count("."), host.count("-"), float(url.startswith("https")), float("#" in url), float("." in path.rpartition("/")[2]),
    ]


class UrlModel:
    """Trees over FEATURES. `seen` and `unseen`: accuracy on the URLs of hosts not fitted on, with and without their hosts' statistics."""

    def __init__(self, total: np.ndarray, blocked: np.ndarray):
        """Counts by half of the URLs, half of the hosts, bucket."""
        self.total, self.blocked = total.astype(float), blocked.astype(float)
        self.prior = float((self.blocked.sum() + 0.5) / (self.total.sum() + 1))
        self.booster, self.seen, self.unseen = Booster(rounds=60, depth=4, share=0.4), None, None
        self.known = self.rates(self.total.sum(axis=(0, 1)), self.blocked.sum(axis=(0, 1)))

    def rates(self, total: np.ndarray, blocked: np.ndarray) -> np.ndarray:
        """Smoothed share of blocked URLs by bucket; NaN where none was counted."""
        return np.where(total > 0, (blocked + 5 * self.prior) / (total + 5), np.nan)

    def matrix(self, urls: Sequence[str], buckets: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """FEATURES; a suffix that was never counted has the rate of the next shorter one."""
        x = np.array([lexical(u) for u in urls], dtype=float).reshape(len(urls), len(FEATURES) - 4)
        found = rates[buckets.reshape(len(urls), 4)]
        last = np.full(len(urls), self.prior)
        for i in range(4):
            last = found[:, i] = np.where(np.isnan(found[:, i]), last, found[:, i])
        return np.hstack([x, found])

    def fit(self, urls: Sequence[str], y: np.ndarray, buckets: np.ndarray, url_half: np.ndarray, host_half: np.ndarray, held: np.ndarray) -> UrlModel:
        def without(half: np.ndarray, axis: int) -> np.ndarray:
            out = np.zeros((len(urls), len(FEATURES)))
            for h in (0, 1):
                mine = np.flatnonzero(half == h)
                other = [c.sum(axis=1 - axis)[1 - h] for c in (self.total, self.blocked)]
                out[mine] = self.matrix([urls[i] for i in mine], buckets[mine], self.rates(*other))
            return out

        by_url, by_host = without(url_half, 0), without(host_half, 1)
        self.booster.fit(np.vstack([by_url[~held], by_host[~held]]), np.concatenate([y[~held]] * 2))
        if held.any():
            self.booster.calibrate(by_host[held], y[held])
            hits = lambda x: float(((self.booster.predict(x[held]) > 0.5) == (y[held] > 0)).mean())
            self.seen, self.unseen = hits(by_url), hits(by_host)
        return self

    def predict(self, urls: Sequence[str], buckets: np.ndarray) -> np.ndarray:
        return self.booster.predict(self.matrix(urls, buckets, self.known)) if len(urls) else np.zeros(0)


def fit(pages: DataFrame, *, url: str = "url", rules=RULES, sample: int = SAMPLE) -> UrlModel:
    """Suffix statistics of all URLs that a rule labels; trees fitted on about `sample` distinct ones by a hash.

    Null URLs have no label; repeated rows count once each in the statistics, once together in the sample. A
    quarter of the hosts is held out of the fit. Without a labelled URL the score is the same for all.
    """
    host, path = host_and_path(F.col(url))
    labelled = pages.select(F.col(url).alias("u"), ruled(host, path, rules)[1].alias("v"), host.alias("host"), suffixes(host, path).alias("b"))
    h, hh = F.xxhash64("u"), F.xxhash64("host")
    halves = {"uh": F.pmod(F.shiftright(h, 44), F.lit(2)), "hh": F.pmod(F.shiftright(hh, 44), F.lit(2)), "held": F.pmod(F.shiftright(hh, 48), F.lit(4)) == 3}
    labelled = labelled.where("v is not null").withColumns({"h": h, "y": (F.col("v") == "block").cast("int")} | halves)
    counts = labelled.select("uh", "hh", F.explode("b").alias("b"), "y").groupBy("uh", "hh", "b").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    t = counts.toArrow()  # four rows a bucket at most
    total, blocked = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2, BUCKETS))
    uh, hh, b, n, y = (t.column(i).to_numpy() for i in range(5))
    total[uh, hh, b], blocked[uh, hh, b] = n, y
    model = UrlModel(total, blocked)
    n = labelled.agg(F.approx_count_distinct("h")).first()[0]
    some = labelled.where(F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(1, n))))
    rows = some.groupBy("u").agg(*(F.first(c).alias(c) for c in ("y", "b", "uh", "hh", "held", "h"))).collect()
    rows.sort(key=lambda r: (r.h, r.u))
    col = lambda name, kind: np.array([r[name] for r in rows], dtype=kind)
    buckets = np.array([r.b for r in rows], dtype=np.int64).reshape(len(rows), 4)
    return model.fit([r.u for r in rows], col("y", float), buckets, col("uh", int), col("hh", int), col("held", bool))


def judge_urls(pages: DataFrame, model: UrlModel, *, url: str = "url", rules=RULES) -> DataFrame:
    """pages' rows with uf_host, uf_path, uf_rule, uf_verdict, uf_score (of blocking).

    Null URL or one without "://": host and path are empty, no rule fits, the trees judge it. Repeated
    rows are judged alike. Columns of pages may have any name that does not start with uf_. Empty
    table: no rows. Only the URL and its buckets travel to Python.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shipped.value
        for batch in batches:
            urls, buckets = batch.field(0).to_pylist(), batch.field(1).flatten().to_numpy()
            yield pa.array(known.predict(urls, buckets), pa.float64())

    host, path = host_and_path(F.col(f"`{url}`"))
    d = pages.withColumns({"uf_host": host, "uf_path": path})
    rule, verdict = ruled(F.col("uf_host"), F.col("uf_path"), rules)
    given = F.struct(F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), suffixes(F.col("uf_host"), F.col("uf_path")).alias("buckets"))
    d = d.withColumns({"uf_rule": rule, "uf_verdict": verdict, "uf_score": score(given)})
    model_verdict = F.when(F.col("uf_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return d.withColumn("uf_verdict", F.coalesce("uf_verdict", model_verdict))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, fit(pages)).select(
        "page_id",
        F.col("uf_host").alias("host"),
        F.col("uf_path").alias("path"),
        F.col("uf_rule").alias("rule"),
        F.col("uf_verdict").alias("verdict"),
        F.col("uf_score").alias("score"),
    )
