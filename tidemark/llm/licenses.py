"""License scans: exact phrases of words, and short notices found with bounded edits.

A notice of which at most k characters may differ is split into k + 1 seeds; one of them must occur
as it is (pigeonhole). One automaton finds all seeds in a text; the regex library then matches the
notice with at most k errors around each, and gives the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: (phrase, label): the fixed rules
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (notice in words, label, edits allowed)
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("licensed under the gnu general public license version", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2 0", "mpl", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("creative commons attribution", "cc-by", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 4),
    ("boost software license version 1 0", "boost", 3),
    ("this software is provided as is without any express or implied warranty", "zlib", 4),
    ("eclipse public license", "epl", 2),
    ("licensed under cc by nd 4 0", "cc-by-nd", 2),
    ("cc0 1 0 universal", "cc0", 1),
    ("spdx license identifier mit", "mit", 1),
    ("spdx license identifier apache 2 0", "apache", 1),
    ("spdx license identifier gpl 2 0", "gpl-2", 1),
    ("spdx license identifier gpl 3 0", "gpl-3", 1),
)


def words_of(text: str) -> list[str]:
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone
    return WORD.findall(lowered)


class NoticeSearch:
    """All notices, ready to be searched in a text of words joined by one space."""

    def __init__(self, notices: Sequence[tuple[str, str, int]]):
        import ahocorasick
        import regex

        self.notices = list(notices)
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(p)}){{e<={k}}}") for p, _, k in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (phrase, _, k) in enumerate(notices):
            for i in range(k + 1):
                a, b = len(phrase) * i // (k + 1), len(phrase) * (i + 1) // (k + 1)
                seeds.setdefault(phrase[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for s, at in seeds.items():
            self.seeds.add_word(s, (len(s), at))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of the places found, those of a notice apart from each other."""
        # a window about each seed has room for one notice, so a better copy next to a notice does not hide it
        windows: set[tuple[int, int, int]] = set()
        for end, (size, at) in self.seeds.iter(text):
            for n, offset in at:
                phrase, _, k = self.notices[n]
                first = end + 1 - size - offset
                windows.add((n, max(0, first - k), min(len(text), first + len(phrase) + k)))
        places = set()
        for n, lo, hi in windows:
            for m in self.fuzzy[n].finditer(text, lo, hi):
                places.add((n, m.start(), m.end(), sum(m.fuzzy_counts)))
        out = list(places)
        # of places that overlap, those with the fewest edits; only places in one run of overlaps are compared
        out.sort(key=lambda f: (f[1], f[0], f[2]))
        best: list[tuple[int, int, int, int]] = []
        run: list[tuple[int, int, int, int]] = []
        end = -1
        for f in [*out, None]:
            if f is None or f[1] >= end:
                kept: list[tuple[int, int, int, int]] = []
                for x in sorted(run, key=lambda x: (x[3], x[1], x[0])):
                    if all(x[2] <= g[1] or g[2] <= x[1] or (x[3] == g[3] and x[0] != g[0]) for g in kept):
                        kept.append(x)
                best += kept
                run = []
            if f is not None:
                run.append(f)
                end = max(end, f[2])
        return sorted(best, key=lambda f: (f[1], f[0]))


def scan_licenses(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES
) -> DataFrame:
    """A row per row of docs: ls_id, ls_words, ls_base, ls_first, ls_last, ls_base_labels, ls_labels, ls_score and ls_spans.

    ls_spans has struct(label, start, end, errors) of fuzzy notices, in characters of the text's words
    joined by one space. ls_score: 1 with an exact phrase, else the best notice's share of unchanged
    characters, 0 without one. Null text: empty. Whole texts, of any length. Repeated rows and null ids:
    each row alone. Empty table: no rows.
    """
    kind = dict(docs.dtypes)[doc_id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices)
        exact = [(p, label, re.compile(f"(?<![^ ]){re.escape(p)}(?![^ ])")) for p, label in phrases]
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        names = ["ls_id", "ls_words", "ls_base", "ls_first", "ls_last", "ls_base_labels", "ls_labels", "ls_score", "ls_spans"]
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = words_of(t.as_py() or "")
                joined = " ".join(found)
                at, base = [], set()
                for p, label, pattern in exact:
                    if p in joined:
                        places = [m.start() for m in pattern.finditer(joined)]
                        at += places
                        base |= {label} if places else set()
                fuzzy = search.find(joined)
                labels = base | {search.notices[n][1] for n, *_ in fuzzy}
                score = 1.0 if base else max((1 - e / len(search.notices[n][0]) for n, _, _, e in fuzzy), default=0.0)
                first, last = (joined.count(" ", 0, f(at)) if at else None for f in (min, max))
                spans = [{"label": search.notices[n][1], "start": a, "end": b, "errors": e} for n, a, b, e in fuzzy]
                rows.append((len(found), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max(0.0, score), spans))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(F.col(doc_id).alias("ls_id"), F.col(text).alias("ls_text")).mapInArrow(
        work,
        f"ls_id {kind}, ls_words long, ls_base long, ls_first long, ls_last long, ls_base_labels string, ls_labels string, "
        "ls_score double, ls_spans array<struct<label: string, start: long, end: long, errors: int>>",
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("ls_id").alias("doc_id"),
        F.col("ls_words").alias("n_words"),
        F.col("ls_base").alias("n_base"),
        F.col("ls_first").alias("first_word"),
        F.col("ls_last").alias("last_word"),
        F.col("ls_base_labels").alias("base_labels"),
        F.col("ls_labels").alias("labels"),
        F.col("ls_score").alias("score"),
        F.array_join(F.transform("ls_spans", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["errors"])), ",").alias("spans"),
    )
