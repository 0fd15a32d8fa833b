"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame functions are used.  Occurrences of a test window (``width``
consecutive words of an item) are found from its rarest terms:

1. The corpus counts of all terms of the test set are taken in one pass (the
   test vocabulary is broadcast when its counted size allows it).
2. Each distinct window picks its rarest terms, at most ``probes`` places.
3. The index of training postings (term, text, place) is stored for those terms,
   clustered by term.
4. A posting at place p of a term with offset o in a window proposes a start
   p - o.  Proposals of the rarest terms are intersected by (window, text, start).
5. What is left is compared word for word with the text.

Texts are known by a 16-byte key of their content, so copies are one text.  Sizes
are combined before shuffles; no list of postings is gathered.

Defined results: null and empty texts have no words and no hits; items without words
are left out; items shorter than a window are one window; equal windows of several
items are searched once and count for each item; a null item id marks words as
hit but is not listed; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key

WIDTH, PROBES = 13, 3
BROADCAST_TERMS = 100_000
# Everything that is neither a digit, a letter nor beyond ASCII separates words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_END = ""  # stands behind the last word of a text and carries the word count


def lowered(word: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), _SEPARATORS), lambda w: w != "")


def keyed(docs: DataFrame) -> DataFrame:
    """(tid, text) of every row."""
    return docs.select(text_key().alias("tid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def postings(texts: DataFrame) -> DataFrame:
    """(tid, place, term): every word of every text, and the end mark with the number of words."""
    return texts.select("tid", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(_END)))).alias("place", "w")).select(
        "tid", "place", lowered(F.col("w")).alias("term"))


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, words): the windows of every item, lower-cased."""
    lower = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    w = items.select("item_id", words(lower).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def _select_terms(windows: DataFrame, counts: DataFrame, probes: int) -> DataFrame:
    """(window, term, offset, wanted): the rarest places of each window."""
    spots = windows.select("window", F.posexplode("words").alias("offset", "term"))
    rank = Window.partitionBy("window").orderBy("n", "term", "offset")  # at most ``width`` rows
    ranked = (spots.join(counts, "term", "left").fillna(0, ["n"]).withColumn("rank", F.row_number().over(rank))
              .where(F.col("rank") <= probes))
    wanted = ranked.groupBy("window").agg(F.count("*").alias("wanted"), F.min("n").alias("least"))
    # A term that the corpus lacks rules its window out.
    return ranked.join(wanted.where("least > 0"), "window").select("window", "term", "offset", "wanted")


class Search:
    """Index and matches of one test set over one corpus; every step is a stored table."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = WIDTH, probes: int = PROBES):
        self.width, self.texts = width, keyed(docs)
        self.item_windows = materialize(
            item_windows(items, width).select("item_id", F.sha2(F.array_join("words", " "), 256).alias("window"), "words"), "item-windows")
        windows = self.item_windows.groupBy("window").agg(F.first("words").alias("words"))
        terms = materialize(windows.select(F.explode("words").alias("term")).distinct(), "terms")
        n_terms = terms.count()
        found = postings(self.texts)
        counts = materialize(found.join(_small(terms, n_terms), "term").groupBy("term").agg(F.count("*").alias("n")), "term-counts")
        probe = materialize(_select_terms(windows, counts, probes), "probes")
        chosen = materialize(probe.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(_END).alias("term"))), "chosen")
        # The index proper; the end marks ride along and give the lengths.
        index = materialize(found.join(_small(chosen, n_terms + 1), "term").select("term", "tid", "place").distinct(), "index")
        self.lengths = index.where(F.col("term") == _END).select("tid", F.col("place").cast("long").alias("n_words"))
        self.index = index.where(F.col("term") != _END)
        self.windows, self.probe, self.probes = windows, probe, probes

    def candidates(self) -> DataFrame:
        """(tid, window, start): starts on which the rarest terms of the window agree."""
        starts = self.index.join(self.probe, "term").select("tid", "window", (F.col("place") - F.col("offset")).alias("start"), "wanted")
        agreed = starts.where("start >= 0").groupBy("tid", "window", "start").agg(F.count("*").alias("n"), F.max("wanted").alias("wanted"))
        return agreed.where("n = wanted").select("tid", "window", "start")

    def phrases(self) -> DataFrame:
        """(tid, window, start, size): exact occurrences, verified word for word."""
        found = materialize(self.candidates(), "candidates")
        texts = self.texts.join(found.select("tid").distinct(), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
        lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
        # Starts of one text are bounded by its length times the windows that stand there.
        placed = texts.select("tid", words(lower).alias("w")).join(
            found.groupBy("tid").agg(F.collect_list(F.struct("start", "window")).alias("at")), "tid")
        seen = placed.select("tid", F.explode(F.transform("at", lambda s: F.struct(
            s.start.alias("start"), s.window.alias("window"), F.slice("w", s.start + 1, F.lit(self.width)).alias("seen")))).alias("s")).select("tid", "s.*")
        size = F.size("words")
        return (seen.join(self.windows, "window").where(F.slice("seen", F.lit(1), size) == F.col("words"))
                .select("tid", "window", "start", size.alias("size")))

    def proximity(self, slop: int) -> DataFrame:
        """(tid, window, first, last): the rarest terms of a window within ``slop`` words of each other, in any order.

        Every posting is tried as the first of a set: it is taken with the nearest posting
        at or after it of each other term, so repeated terms hide nothing.
        """
        terms = self.probe.select("window", "term").distinct()
        terms = terms.withColumns({"no": F.row_number().over(Window.partitionBy("window").orderBy("term")),
                                   "need": F.count("*").over(Window.partitionBy("window"))})  # at most ``probes`` rows
        hits = self.index.join(terms, "term").select("tid", "window", "no", "need", F.col("place").alias("first"))
        # Backwards, so that the last value seen is the nearest one that follows.
        onward = Window.partitionBy("tid", "window").orderBy(F.desc("first")).rowsBetween(Window.unboundedPreceding, 0)
        after = F.array(*[F.last(F.when(F.col("no") == k, F.col("first")), ignorenulls=True).over(onward) for k in range(1, self.probes + 1)])
        near = hits.withColumn("after", F.array_compact(after)).where(F.size("after") == F.col("need"))
        return near.select("tid", "window", "first", F.array_max("after").alias("last")).where(F.col("last") - F.col("first") <= slop)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, probes: int = PROBES) -> DataFrame:
    """(tid, n_words, n_hit, n_items, items) of every distinct text."""
    search = Search(docs, items, width, probes)
    hits = materialize(search.phrases(), "hits")
    spans = hits.groupBy("tid", "start").agg(F.max(F.col("start") + F.col("size")).alias("stop"))
    earlier = Window.partitionBy("tid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # places of one text
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.lit(0))))
    covered = spans.select("tid", fresh.alias("fresh")).groupBy("tid").agg(F.sum("fresh").cast("long").alias("n_hit"))
    listed = (hits.select("tid", "window").distinct().join(search.item_windows.select("window", "item_id").where("item_id IS NOT NULL").distinct(), "window")
              .select("tid", F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    return (search.lengths.join(covered, "tid", "left").join(listed, "tid", "left")
            .select("tid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def flagged(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every document."""
    ids = docs.select(F.col("doc_id").cast("long"), text_key().alias("tid"))
    return ids.join(contamination(docs, items, width), "tid").select("doc_id", "n_words", "n_hit", "items", flagged().alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items, width).where(flagged()).select(F.col("tid").alias("__bad"))
    return docs.join(bad, text_key() == F.col("__bad"), "left_anti")
