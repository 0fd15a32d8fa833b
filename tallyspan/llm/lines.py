"""Line dedup by an exact set-similarity join; only DataFrame functions are used.

A line is the set of its words in lower case.  A line goes if an earlier line (smaller doc_id, then line
number) has an equal set or one with a Jaccard similarity of ``threshold`` or more, whether or not that
one stays itself.

1. Words get an order by rarity: ``2**bits`` counters over all texts (collected, so of fixed size whatever the
   input) put each into a frequency class; within a class the hash decides.  The join is exact under any
   order; a good one keeps the lists short.
2. Equal sets are folded, with the place of their first line.
3. Each set enters the index under its prefix, the rarest words, as many as the threshold asks for.  Sets
   of so few words that only an equal one is similar need no index.
4. A set goes as soon as *one* earlier set is similar, so no family of similar lines is listed pair by pair.  A
   semi-join over the lists keeps the index entries that have a candidate at all and stops at the first one.  By the
   rarest of its entries a set meets the first four sets of each size band.  What stays open meets a sixteenth of the
   sets in the lists of all its entries, and what is open then meets all others.
5. Candidates must pass the length and the positional filter and a parity bitmap whose differing bits bound
   the sets' difference from below.  What passes is verified on the words themselves; an index entry may therefore hold
   four bytes of a word's hash.

Folding and counts are combined before each shuffle, so a line that stands everywhere is one row per task.

Defined results: null texts have no lines; lines without a word always stay; rows that share a doc_id (or have
none: last in order) tie and do not remove each other's line of the same number; repeated rows fare alike; an empty
table gives an empty result; extra columns are carried untouched, whatever they are called.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.storage import broadcast_if_small, fresh_path, scratch

from .common import materialize, text_key, unused

THRESHOLD, BITS = 0.8, 16
LONG = 64  # sets of more words fill 64 bits and get three parts of the bitmap besides
PARTS = ("m1", "m2", "m3")
BROADCAST_DOCUMENTS = 100_000  # keys of 16 bytes: a few megabytes
BROADCAST_TOKENS = 1_000_000  # of four bytes each
FIRST, SHARES = 4, 16  # sets of the first meeting; the second is with one set in so many
_LOW = (1 << 56) - 1


def _split(line: Column, white: str = "\t\v\f\r") -> Column:
    """Parts between single white-space characters, in lower case; some are empty."""
    line = F.lower(line)
    for c in white:
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.split(line, " ")


def _words(line: Column) -> Column:
    return F.array_remove(_split(line), "")


def _doc() -> Column:
    """Order of a row over the whole table; rows without an id come last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tid, line, raw) of every line; (doc, line) is its place."""
    # Beside the generator the key would be worked out from the whole text for each of its lines.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc().alias("doc"), text_key().alias("tid"), F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", "doc", "tid", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))


def frequency_classes(docs: DataFrame, bits: int) -> list[int]:
    """Frequency class (0-126, four steps to a doubling) of each of ``2**bits`` counters of words."""
    words = docs.select(F.explode(_split(F.col("text").cast("string"), "\n\t\v\f\r")).alias("w")).where("w <> ''")
    rows = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit((1 << bits) - 1)).alias("b")).count().collect()
    out = [0] * (1 << bits)
    for r in rows:
        out[r["b"]] = min(126, round(4 * math.log2(1 + r["count"])))
    return out


def ordered_sets(lines: DataFrame, classes: list[int], bits: int) -> DataFrame:
    """Lines that have a word, with ``ids``, the hashes of their words in order of rarity, in place of the text."""
    keep = [c for c in lines.columns if c != "raw"]
    table = F.from_json(F.lit(str(classes)), "array<tinyint>")  # folded into one constant of fixed size
    hashes = F.transform(_words(F.col("raw")), lambda w: F.xxhash64(w))
    ids = F.array_distinct(F.sort_array(F.transform(hashes, lambda h: F.shiftleft(
        F.get(table, h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(_LOW))))))
    # The generator keeps the array as a column; as an expression it would be worked out anew by each use.
    return lines.select(*keep, F.explode(F.array(ids)).alias("ids")).where(F.size("ids") > 0)


def _bitmap(ids: str, part: int | None = None) -> Column:
    """Bit b is the parity of the number of words that fall on b; ``part`` takes one word in four, so four parts make up the whole."""
    bit = "shiftleft(1L, cast(x & 63 AS INT))"
    bit = bit if part is None else f"if((shiftright(x, 6) & 3) = {part}, {bit}, 0L)"
    return F.expr(f"aggregate({ids}, 0L, (a, x) -> a ^ {bit})")


def _needed(a: Column, b: Column, threshold: float) -> Column:
    """Least overlap of two sets of these sizes at the threshold."""
    return F.ceil(F.lit(threshold) * (a + b) / F.lit(1 + threshold) - 1e-9)


def _smallest_with_others(threshold: float) -> int:
    """The least size at which a set of another kind can be similar: below, only equal sets are."""
    n = 1
    while n / (n + 1) < threshold - 1e-9:  # n words within n + 1 are the closest pair of different sets
        n += 1
    return n


def indexed_lines(sets: DataFrame, threshold: float) -> DataFrame:
    """Per line what the index needs: set key, size, parity bitmap and prefix (none where only equal sets are similar)."""
    n, few = F.size("ids"), _smallest_with_others(threshold)
    prefix = F.slice("ids", F.lit(1), (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))
    return sets.select("doc_id", "doc", "tid", "line", F.xxhash64("ids").alias("s1"), F.xxhash64(F.reverse("ids")).alias("s2"), n.alias("n"),
                       F.when(n >= few, _bitmap("ids")).alias("map"), *[F.when(n > LONG, _bitmap("ids", k)).alias(m) for k, m in enumerate(PARTS)], F.when(n >= few, F.transform(prefix, lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).alias("prefix"))


def _compatible(x: str, y: str, threshold: float) -> Column:
    """The filters on two postings, given by the prefixes of their columns."""
    c = lambda side, name: F.col(side + name)
    need = _needed(c(x, "n"), c(y, "n"), threshold)
    differ = c(x, "n") + c(y, "n") - 2 * need
    apart = {m: c(x, m).bitwiseXOR(c(y, m)) for m in ("map", *PARTS)}
    rest = reduce(Column.bitwiseXOR, apart.values())  # the fourth part
    return ((F.least(c(x, "n"), c(y, "n")) >= F.lit(threshold) * F.greatest(c(x, "n"), c(y, "n")) - 1e-9)  # length
            & (F.least(c(x, "n") - c(x, "at"), c(y, "n") - c(y, "at")) >= need)  # position
            & (F.bit_count(apart["map"]) <= differ)  # difference, by the whole bitmap and by its parts where both sets have them
            & F.coalesce(F.bit_count(rest) + sum((F.bit_count(apart[m]) for m in PARTS), F.lit(0)) <= differ, F.lit(True)))


def similar_sets(pairs: DataFrame, folded: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(node) of the pairs (node, other) that are similar, each verified on the words of a line of either set."""
    path = fresh_path(docs.sparkSession, "line-similar")
    with scratch(docs.sparkSession):  # the words of the candidates are needed no longer
        found = _verified(pairs, folded, docs, threshold)
        found.write.parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _verified(pairs: DataFrame, folded: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    pairs = materialize(pairs.distinct(), "line-pairs")
    ends = pairs.select("node").union(pairs.select("other")).distinct()
    wanted = materialize(folded.select("node", "doc", "line", "tid").join(ends, "node", "left_semi"), "line-wanted")
    owners = wanted.select(F.col("doc").alias("owner")).distinct()
    few = owners.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS
    chosen = docs.join(F.broadcast(owners) if few else owners, _doc() == F.col("owner"), "left_semi")
    # Rows of one id tie in place; the text tells which of them is meant.
    lines = raw_lines(chosen).select("doc", "line", "raw", "tid").join(wanted, ["doc", "line", "tid"])
    whole = materialize(lines.select("node", F.explode(F.array(F.array_distinct(_words(F.col("raw"))))).alias("ws")), "line-words")
    both = pairs.join(whole.withColumnRenamed("ws", "x"), "node").join(whole.select(F.col("node").alias("other"), F.col("ws").alias("y")), "other")
    return both.where(F.size(F.array_intersect("x", "y")) >= _needed(F.size("x"), F.size("y"), threshold)).select("node").distinct()


def covered_sets(folded: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(node) of the sets that resemble a set with an earlier first line."""
    # In the order of the table: a projection on one side alone would make two exchanges of the one both sides share.
    about = [c for c in folded.columns if c in ("doc", "line", "n", "map", *PARTS, "node")]
    every = folded.where("prefix IS NOT NULL").select(*about, F.posexplode("prefix").alias("at", "token"))
    # Sets of one place (rows of one id) are no reason for each other, hence the strict order of places.
    candidate = lambda x, y: _compatible(x, y, threshold) & (F.col(y + "node") != F.col(x + "node")) & (
        (F.col(y + "doc") < F.col(x + "doc")) | ((F.col(y + "doc") == F.col(x + "doc")) & (F.col(y + "line") < F.col(x + "line"))))
    # Both sides are the same entries with the same columns, so they are shuffled once.
    same = F.col("a.token") == F.col("o.token")
    alive = materialize(every.alias("a").join(every.alias("o"), same & candidate("a.", "o."), "left_semi"), "line-alive")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.1))
    by_place = Window.partitionBy("token", "band").orderBy("doc", "line", "node")

    def lists(entries):
        """The lists of these entries' words; ``turn`` counts the sets of a size band by place."""
        tokens = broadcast_if_small(entries.select("token").distinct(), BROADCAST_TOKENS)
        return every.join(tokens, "token", "left_semi").withColumn("band", band).withColumn("turn", F.row_number().over(by_place)).drop("band")

    def settle(entries, part):
        pairs = entries.alias("a").join(part.alias("o"), same & candidate("a.", "o."))
        return similar_sets(pairs.select(F.col("a.node").alias("node"), F.col("o.node").alias("other")), folded, docs, threshold)

    rarest = alive.join(alive.groupBy("node").agg(F.min("at").alias("at")), ["node", "at"], "left_semi")
    done = [settle(rarest, lists(rarest).where(F.col("turn") <= FIRST))]
    share = F.pmod(F.xxhash64("node"), F.lit(SHARES))
    for part in (every.where(share == 0), every.where(share != 0)):
        alive = materialize(alive.join(done[-1], "node", "left_anti"), "line-alive")
        done.append(settle(broadcast_if_small(alive), part))
    return reduce(DataFrame.union, done)


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """(doc_id, tid, gone): the numbers of the lines to remove, for texts that have any."""
    docs = docs.select("doc_id", "text")
    indexed = materialize(indexed_lines(ordered_sets(raw_lines(docs), frequency_classes(docs, bits), bits), threshold), "lines")
    folded = materialize(indexed.groupBy("s1", "s2").agg(
        F.min(F.struct("doc", "line", "tid")).alias("f"), F.first("n").alias("n"), F.first("map").alias("map"), *[F.first(m).alias(m) for m in PARTS], F.first("prefix").alias("prefix")).select(
        "s1", "s2", "f.*", "n", "map", *PARTS, "prefix", F.monotonically_increasing_id().alias("node")), "line-sets")
    covered = covered_sets(folded, docs, threshold).withColumn("covered", F.lit(True))
    first = folded.select("s1", "s2", F.col("doc").alias("d"), F.col("line").alias("l"), "node").join(covered, "node", "left").drop("node")
    late = indexed.select("doc_id", "doc", "tid", "line", "s1", "s2").join(first, ["s1", "s2"]).where("covered OR doc > d OR (doc = d AND line > l)")
    return late.groupBy("doc_id", "tid").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, counts: tuple[str, str] | None = None) -> DataFrame:
    """All rows and columns, with ``text`` cut to the lines that stay; ``counts`` names two more columns for the lines and the removed ones."""
    d, t, g, k = unused(docs, 4)
    gone = removed_lines(docs, threshold, bits).toDF(d, t, g)
    marked = docs.withColumn(k, text_key()).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(k) == F.col(t)), "left")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.when(F.col(g).isNull(), F.col("text").cast("string")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(g, i)), "\n"))
    numbers = (F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)), F.coalesce(F.size(g), F.lit(0)))
    return marked.select(*[kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                         *[v.cast("long").alias(name) for name, v in zip(counts or (), numbers)])


def digest(docs: DataFrame, **options) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_removed"), **options)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
