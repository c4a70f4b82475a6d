"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed rules find the base spans of each kind. High-recall generators propose further, overlapping
spans; boosted trees, written out as one expression, score each by its format and context; a span
is added where its score reaches its kind's threshold, calibrated on candidates held out of the fit.

The trees learn from sample texts in which base spans are written anew: in the forms that people give
such data to hide them (positives), or spoilt, as look-alikes (negatives, like all that else is proposed).

Matches alone have no places, so a pattern's places come from split() and regexp_extract_all() over
the same pattern: the lengths of gaps and matches, added up in turn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Booster
from .common import documents, saved

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Possessive repeats and the guards in front leave the matches as they are:
# they only spare the engine from trying again inside a run that has already failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a maximal run of digits with single separators, of 13 to 19 digits; others fail their check anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?: ?[.,] ?|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+ ?|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
# What every match of a wide pattern holds: of an email its middle; of the others two digits, at most three characters apart.
WIDE_EMAIL = r"(?:@|\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]"
WIDE_DIGITS = r"[0-9].{0,3}[0-9]"
KEYWORDS = r"(?i)mail|contact|phone|tel|call|fax|mobil|card|visa|konto|ip|host|server|addr"
SAMPLE_DOCS = 3000  # documents that the trees are fitted on, about
ROUNDS = 4  # times that each of them is written anew
STRIDE = 128
PRECISION = 0.95  # held-out precision that a threshold must reach
FEATURES = (
    "kind", "chars", "digits", "separators", "plus", "at", "dots", "luhn", "octets", "before", "after", "keyword", "spaces", "letters",
    "brackets", "words", "tail", "breaks", "groups", "longest",
)
SPAN = "array<struct<kind:int,start:int,end:int>>"
FOUND = "struct<kind:int,start:int,end:int,found:string,before:string,after:string>"


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """array<struct(kind, start, end, found, before, after)> of a pattern's matches, in code points, in their order.

    before and after: up to 24 characters and up to one, between the match and the one next to it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        context = {"before": F.substring(x["gap"], -24, 24), "after": F.substring(x["next"], 1, 1)}
        new = record(kind=F.lit(kind), start=start, end=end, found=x["hit"], **context)
        return record(out=F.concat(acc["out"], F.array(new)), at=end)

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: record(gap=g, hit=h))
    rest = F.slice(gaps, F.lit(2), F.size(found))
    trios = F.zip_with(pairs, rest, lambda p, g: record(gap=p["gap"], hit=p["hit"], next=g))
    places = let(swept(trios, {"at": F.lit(0)}, add, FOUND), lambda r: F.flatten(r["out"]))
    return F.when(F.size(found) > 0, places).otherwise(F.array().cast(f"array<{FOUND}>"))


def record(**fields: Column) -> Column:
    """A struct by name: aliases inside struct() are lost in nested lambdas."""
    return F.named_struct(*(x for name, c in fields.items() for x in (F.lit(name), c)))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def swept(items: Column, state: dict[str, Column], add, kind: str) -> Column:
    """Folds add over items (one at least): struct(out, *state), out an array of arrays of `kind`, in order.

    add takes and returns struct(out, *state), with out an array of `kind` that it appends to.

    An array that grows by one is copied each time, which is quadratic; here it grows to STRIDE at most.
    """
    empty = F.array().cast(f"array<{kind}>")

    def whole(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(STRIDE))
        strides = F.transform(starts, lambda i: F.slice(x, i, F.lit(STRIDE)))

        def step(acc: Column, part: Column) -> Column:
            inner = F.aggregate(part, record(out=empty, **{k: acc[k] for k in state}), add)
            return let(inner, lambda r: record(out=F.concat(acc["out"], F.array(r["out"])), **{k: r[k] for k in state}))

        return F.aggregate(strides, record(out=F.array().cast(f"array<array<{kind}>>"), **state), step)

    return let(items, whole)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass Luhn's check."""
    values = F.transform(
        F.split(F.reverse(digits_of(s)), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def octets(s: Column) -> Column:
    """Whether every number in s is at most 255."""

    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+(?=.)", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare.cast("int")).otherwise(999) <= 255)

    return F.forall(F.filter(F.split(s, "[^0-9]+"), lambda p: p != ""), small)


def base_spans(text: Column) -> list[Column]:
    def count(s: Column) -> Column:
        return F.length(digits_of(s["found"]))

    email, ip, card, phone = (spans_of(text, BASE[k], i) for i, k in enumerate(KINDS))
    none = F.filter(phone, lambda _: F.lit(False))
    return [
        F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        F.filter(ip, lambda s: octets(s["found"])),
        F.filter(card, lambda s: luhn(s["found"])),
        F.filter(phone, lambda s: (count(s) >= 9) & (count(s) <= 15)),
    ]


def wide_spans(text: Column) -> Column:
    email, ip, card, phone = (spans_of(text, WIDE[k], i) for i, k in enumerate(KINDS))
    none = F.filter(phone, lambda _: F.lit(False))
    # each generator runs only where what it needs occurs at all
    email = F.when(F.rlike(text, F.lit(WIDE_EMAIL)), email).otherwise(none)
    digits = F.rlike(text, F.lit(WIDE_DIGITS))
    return F.concat(email, *(F.when(digits, x).otherwise(none) for x in (ip, card, phone)))


def features(span: Column) -> list[Column]:
    """FEATURES of a candidate, as doubles."""
    s, before, after = span["found"], span["before"], span["after"]
    runs = F.filter(F.split(s, "[^0-9]+"), lambda x: x != "")

    def n(pattern: str) -> Column:
        return F.length(s) - F.length(F.regexp_replace(s, pattern, ""))

    def kind_of(c: Column) -> Column:
        return F.when(F.rlike(c, F.lit(r"[0-9]$")), 3).when(F.rlike(c, F.lit(r"[\p{L}_@+.-]$")), 2).when(F.length(c) == 0, 0).otherwise(1)

    cols = [
        span["kind"], F.length(s), n("[0-9]"), n("[ ._/()-]"), n(r"\+"), n("@"), n(r"\."), luhn(s).cast("int"),
        octets(s).cast("int"), kind_of(F.right(before, F.lit(1))), kind_of(after), F.rlike(before, F.lit(KEYWORDS)).cast("int"),
        n(" "), n(r"[A-Za-z]"), n(r"[()\[\]]"), n(r"\b(?:at|dot)\b"), F.length(F.regexp_extract(s, "[A-Za-z]*$", 0)),
        n(r"\. "), F.size(runs), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
    ]
    return [c.cast("double") for c in cols]


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


# --- sample texts with their base spans written anew --------------------------------------------------------


def rendered(kind: Column, found: Column, turn: Column) -> tuple[Column, Column]:
    """(another form of a base span, whether it is still personal data): `turn`, a hash, picks the form."""
    digits = digits_of(found)
    host = F.regexp_extract(found, "@(.*)$", 1)
    user = F.regexp_extract(found, "^(.*)@", 1)

    def email(at: str, dot: str) -> Column:
        return F.concat(user, F.lit(at), F.regexp_replace(host, r"\.", dot))

    def grouped(by: str) -> Column:
        return F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{by}")

    bare = F.substring(found, 2, 64)
    spoilt_digit = F.pmod(F.right(digits, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string")
    good = {
        "email": [found, email(" (at) ", " (dot) "), email("[at]", "[dot]"), email(" at ", " dot "), email("(at)", "."), email(" @ ", " . ")],
        "ip": [found, F.regexp_replace(found, r"\.", "[.]"), F.regexp_replace(found, r"\.", "(.)"), F.regexp_replace(found, r"\.", " . ")],
        "card": [found, grouped("."), grouped("/"), grouped("_"), grouped("  ")],
        "phone": [found, F.concat(F.lit("00"), bare), bare, F.regexp_replace(bare, r"[\x20()-]+", "."), F.regexp_replace(bare, "^[0-9]{1,3}[ -]", "")],
    }
    spoilt = {
        "email": F.concat(user, F.lit(" at "), F.initcap(F.regexp_replace(host, r"\.", ". "))),
        "ip": F.regexp_replace(found, "^[0-9]+", "642"),
        "card": F.concat(F.regexp_replace(grouped(" "), ".$", ""), spoilt_digit),
        "phone": F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)),
    }

    def of_kind(make) -> Column:
        out = F.lit("")
        for i, k in enumerate(KINDS):
            out = F.when(kind == i, make(k)).otherwise(out)
        return out

    still = F.pmod(turn, F.lit(4)) != 0
    pick = F.pmod(F.shiftright(turn, 8), F.lit(60))  # a multiple of every number of forms

    def form(k: str) -> Column:
        return F.element_at(F.array(*good[k]), (F.pmod(pick, F.lit(len(good[k]))) + 1).cast("int"))

    return F.when(still, of_kind(form)).otherwise(of_kind(spoilt.get)), still


def written_anew(text: Column, spans: Column, salt: Column) -> Column:
    """struct(text, marks): the text with its spans rendered(), and where those that are still personal data now stand.

    Of spans that overlap the first is rendered; the others go with it.
    """
    fields = ("start", "end", "kind", "found")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(*(s[n].alias(n) for n in fields))))
    none = F.array().cast(SPAN)

    def add(acc: Column, s: Column) -> Column:
        new, still = rendered(s["kind"], s["found"], F.xxhash64(salt, s["start"]))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        start = acc["to"] + F.length(gap)
        end = start + F.length(new)
        mark = F.array(record(kind=s["kind"], start=start, end=end))
        marks = F.concat(acc["marks"], F.when(still, mark).otherwise(none))
        return F.when(s["start"] < acc["at"], acc).otherwise(record(at=s["end"], to=end, out=F.concat(acc["out"], F.array(gap, new)), marks=marks))

    zero = record(at=F.lit(0), to=F.lit(0), out=F.array().cast("array<string>"), marks=none)

    def done(acc: Column) -> Column:
        tail = F.substring(text, acc["at"] + 1, F.length(text))
        return record(text=F.concat(F.array_join(acc["out"], ""), tail), marks=acc["marks"])

    return F.aggregate(ordered, zero, add, done)


class PiiModel:
    """Trees over FEATURES and a threshold for each kind."""

    def __init__(self, booster: Booster, thresholds: list[float]):
        self.booster, self.thresholds = booster, thresholds


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> PiiModel:
    """Fits the trees on candidates in about sample_docs documents by a hash of id and text, each written anew `rounds` times.

    A candidate is a positive if it is of the kind and about the place (four fifths of the characters in
    common) of a base span that was rendered as personal data. A quarter of the documents calibrates scores
    and thresholds and is not fitted on. A kind's threshold is the least score above which PRECISION of its
    held-out candidates are positives, else PRECISION itself, as calibrated scores are probabilities; one half
    at least. Null texts are empty; repeated rows count once; an empty table, or one without any candidate,
    gives a model that adds nothing.
    """
    h = F.xxhash64(F.lit(5), F.col(doc_id), F.col(text))
    body = F.coalesce(F.col(text), F.lit(""))
    some = docs.select(h.alias("h"), body.alias("t")).where(F.rlike("t", F.lit("[0-9@]")) | F.rlike("t", F.lit(WIDE_EMAIL)))
    n = some.count()
    # a threshold on the hash: no task gathers the sample, and it is as large whatever the table's size
    # saved, or the planner would look for spans in every row before it cuts the sample
    # distinct: rows that repeat share a hash, and count once
    some = saved(some.where(F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample_docs / max(1, n)))).dropDuplicates(["h"]))
    turns = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn")
    some = some.select("h", "t", F.concat(*base_spans(F.col("t"))).alias("base"), turns)
    some = saved(some.select("h", "turn", written_anew(F.col("t"), F.col("base"), F.xxhash64("h", "turn")).alias("x")))
    some = some.select("h", "turn", "x.marks", wide_spans(F.col("x.text")).alias("wide"))
    # look-alikes in prose are proposed again each round: they count once, as those in the first
    each = some.select("h", "turn", "marks", F.explode("wide").alias("c"))
    common = lambda m, c: F.least(m["end"], c["end"]) - F.greatest(m["start"], c["start"])
    length = lambda s: s["end"] - s["start"]
    is_mark = lambda m: (m["kind"] == F.col("c.kind")) & (5 * common(m, F.col("c")) >= 4 * F.greatest(length(m), length(F.col("c"))))
    rows = each.select("h", F.exists("marks", is_mark).cast("double").alias("y"), F.array(*features(F.col("c"))).alias("x"))
    rows = rows.groupBy("h", "y", "x").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r.h, r.y, r.x))
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in rows], dtype=float)
    held = np.array([(r.h >> 42) % 4 == 0 for r in rows], dtype=bool)
    booster = Booster(rounds=40, depth=4).fit(x[~held], y[~held]).calibrate(x[held], y[held])
    score = booster.predict(x[held]) if held.any() else np.zeros(0)
    out = []
    for k in range(len(KINDS)):
        mine = x[held, 0] == k
        s, t = score[mine], y[held][mine]
        order = np.argsort(-s, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        ends = np.append(s[order][1:] != s[order][:-1], True) if len(order) else np.zeros(0, dtype=bool)
        ok = np.flatnonzero((good >= PRECISION) & ends)
        out.append(float(max(s[order][ok[-1]], 0.5)) if len(ok) else PRECISION)
    return PiiModel(booster, out)


def _chosen(base: Column, scored: Column) -> Column:
    """Of scored candidates those that overlap no base span and no better candidate, by one sweep in the order of their starts."""
    kind = "struct<start:int,end:int,kind:int,score:double>"
    of = lambda s, score: record(start=s["start"], end=s["end"], kind=s["kind"], score=score)
    nothing = F.lit(None).cast(kind)
    both = F.concat(F.transform(base, lambda s: of(s, F.lit(2.0))), F.transform(scored, lambda s: of(s, s["score"])))  # a base span beats all
    def closed(acc: Column) -> Column:
        return F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"])))

    def add(acc: Column, s: Column) -> Column:
        hits = F.coalesce(acc["last"]["end"] > s["start"], F.lit(False))  # the candidate that waits reaches into this one
        new_base = record(out=F.when(hits, acc["out"]).otherwise(closed(acc)), last=nothing, taken=F.greatest(acc["taken"], s["end"]))
        better = record(out=acc["out"], last=s, taken=acc["taken"])
        fresh = record(out=closed(acc), last=s, taken=acc["taken"])
        return (
            F.when(s["score"] > 1.0, new_base)
            .when(s["start"] < acc["taken"], acc)
            .when(hits & (acc["last"]["score"] >= s["score"]), acc)
            .when(hits, better)
            .otherwise(fresh)
        )

    found = let(
        swept(F.array_sort(both), {"last": nothing, "taken": F.lit(0)}, add, kind), lambda r: F.flatten(F.concat(r["out"], F.array(F.array_compact(F.array(r["last"])))))
    )
    return F.when(F.size(scored) > 0, F.transform(found, _bare)).otherwise(F.array().cast(SPAN))


def _bare(s: Column) -> Column:
    return record(kind=s["kind"], start=s["start"], end=s["end"])


def find_pii(docs: DataFrame, model: PiiModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' id with `pii_base` (arrays of spans by kind), `pii_added` and `pii_text`, the text with [KIND] in place of spans.

    Null text: empty, no spans. Whole texts are searched. Rows that repeat are each judged alone; a null
    id is kept. Empty table: no rows. No shuffle: each row is finished where it is read. Added spans overlap
    neither base spans nor one another.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("pii_id"), t.alias("t"))
    d = d.withColumns({f"b{i}": c for i, c in enumerate(base_spans(F.col("t")))} | {"wide": wide_spans(F.col("t"))})
    d = d.withColumns({f"b{i}": F.transform(f"b{i}", _bare) for i in range(len(KINDS))})
    d = d.withColumn("wide", F.transform("wide", lambda c: F.struct(_bare(c).alias("c"), F.array(*features(c)).alias("x"))))

    def scored(c: Column) -> Column:
        score = model.booster.column([c["x"][i] for i in range(len(FEATURES))])
        return F.struct(c["c"]["start"].alias("start"), c["c"]["end"].alias("end"), c["c"]["kind"].alias("kind"), score.alias("score"))

    limit = F.array(*map(F.lit, model.thresholds))
    d = d.withColumn("wide", F.filter(F.transform("wide", scored), lambda c: c["score"] >= F.element_at(limit, c["kind"] + 1)))
    d = d.withColumn("added", _chosen(F.concat("b0", "b1", "b2", "b3"), F.col("wide")))
    return d.select(
        "pii_id",
        F.array("b0", "b1", "b2", "b3").alias("pii_base"),
        F.col("added").alias("pii_added"),
        redacted(F.col("t"), F.concat("b0", "b1", "b2", "b3", "added")).alias("pii_text"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or each run of overlapping spans, replaced by the first one's [KIND]."""
    by_start = F.array_sort(F.transform(spans, lambda s: record(start=s["start"], end=s["end"], kind=s["kind"])))
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def add(acc: Column, s: Column) -> Column:
        new = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(kinds, s["kind"] + 1))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], new))
        return record(out=out, at=F.greatest(acc["at"], s["end"]))

    tail = lambda r: F.substring(text, r["at"] + 1, F.length(text))
    done = let(swept(by_start, {"at": F.lit(0)}, add, "string"), lambda r: F.concat(F.array_join(F.flatten(r["out"]), ""), tail(r)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    base = F.flatten("pii_base")
    return found.select(
        F.col("pii_id").alias("doc_id"),
        *(F.size(F.col("pii_base")[i]).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, F.col("pii_added"))).alias("spans"),
    )
