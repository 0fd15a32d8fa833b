"""License scans: fuzzy search for short notices.

A notice that occurs with at most ``e`` edits holds at least one of its
``e + 1`` pieces unchanged (pigeonhole).  Exact search for the pieces locates
candidate windows; the bounded-error matching of the ``regex`` library then
verifies each window and reports span and edit count.  Places where the words
of a base phrase stand consecutively are found exactly and are never dropped.

Each document is one row of work, so nothing is shuffled and no key can be hot.
Defined results: null and empty texts have no words, no places and score 0;
repeated rows give repeated results; extra columns are ignored; spans come in
order of their first word, ties by label.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, map_batches

# Phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices searched with edits, beside the phrases themselves.
NOTICES = PHRASES + (
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
SCHEMA = ("doc_id long, n_words long, base array<struct<label:string,word:long>>, "
          "fuzzy array<struct<label:string,first_word:long,end_word:long,errors:int,share:double,text:string>>")


class Notice:
    """One notice: its pieces with offsets, and the pattern that verifies a window."""

    def __init__(self, text: str, label: str, errors_per: int = 10):
        raw = text.encode()
        self.label, self.size, self.errors = label, len(raw), max(1, len(raw) // errors_per)
        cuts = [len(raw) * i // (self.errors + 1) for i in range(self.errors + 2)]
        self.pieces = [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(rb"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(raw, literal_spaces=True), self.errors), regex.BESTMATCH)

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the verified matches in normal text."""
        windows = []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                windows.append((max(0, at - offset - self.errors - 1), at - offset + self.size + self.errors + 1))
                at = text.find(piece, at + 1)
        found, end = set(), -1
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            if a < end:
                merged[-1][1] = end = max(end, b)
            else:
                merged.append([a, b])
                end = b
        rest = [(a, min(b, len(text))) for a, b in merged]
        while rest:
            a, b = rest.pop()
            if m := self.pattern.search(text, a, b):
                found.add((m.start(), m.end(), sum(m.fuzzy_counts)))
                # The best match of all comes first: weaker ones may stand on either side, apart by the space before it.
                rest += [(a, m.start() - 1)] * (a < m.start() - 1) + [(m.end(), b)] * (m.end() < b)
        return sorted(found)


def base_places(words: list[bytes], phrases) -> list[tuple[str, int]]:
    out = []
    for phrase, label in phrases:
        want = phrase.encode().split()
        try:
            at = words.index(want[0])
            while True:
                if words[at:at + len(want)] == want:
                    out.append((label, at))
                at = words.index(want[0], at + 1)
        except ValueError:
            pass
    return out


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, errors_per: int = 10) -> DataFrame:
    """One row per document with its exact places and its verified fuzzy spans."""
    cell: list[Notice] = []
    must = [p.encode().split()[-1] for p, _ in phrases]

    def one(raw: bytes | None):
        words = alnum_words(raw)
        text = b" ".join(words)
        base = base_places(words, phrases) if any(w in text for w in must) else []
        found = [(n, *span) for n in cell for span in n.spans(text)]
        starts = list(accumulate((len(w) + 1 for w in words), initial=0)) if found else []
        fuzzy = []
        for n, a, b, e in found:
            fuzzy.append({"label": n.label, "first_word": bisect_right(starts, a) - 1, "end_word": bisect_right(starts, max(a, b - 1)),
                          "errors": e, "share": 1 - e / n.size, "text": text[a:b].decode("utf-8", "replace")})
        fuzzy.sort(key=lambda s: (s["first_word"], s["label"], s["end_word"], s["errors"]))
        return len(words), [{"label": l, "word": w} for l, w in sorted(base, key=lambda x: x[::-1])], fuzzy

    def run(ids, texts):
        if not cell:
            cell.extend(Notice(t, l, errors_per) for t, l in notices)
        rows = [one(t) for t in texts]
        return {"doc_id": ids, "n_words": [r[0] for r in rows], "base": [r[1] for r in rows], "fuzzy": [r[2] for r in rows]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), as_bytes().alias("text")), run, SCHEMA)


def _labels(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, label lists and a score in [0, 1]: 1 for an exact place, else the best share of unedited letters."""
    words = F.col("base.word")
    exact = F.size("base") > 0
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        _labels(F.col("base.label")).alias("base_labels"),
        _labels(F.concat(F.col("base.label"), F.col("fuzzy.label"))).alias("labels"),
        F.when(exact, 1.0).otherwise(F.coalesce(F.array_max(F.col("fuzzy.share")), F.lit(0.0))).alias("score"),
        "fuzzy")
