"""Spelling variants: words at one edit from each other, each led to its most frequent form.

Words are counted over all texts.  A word becomes its letter counts; two words at one
edit have counts at a squared distance of 2 (one letter replaced) or 1 (one letter more or
less).  The letters fall into ``GROUPS`` classes, and how many letters of each class a word
has is its block: a word at one edit lies in the same block or in one whose counts differ by one more
letter, or by one letter that changed class.  Blocks are cut into tiles of bounded size,
every tile meets the tiles of these neighbouring blocks, and a NumPy product of the two
matrices of letter counts gives all squared distances at once.  Pairs that are close enough are
verified letter by letter, and each tile sends one row for each of its words, not pairs.

Defined results on odd input: a null text has no words; a null ``doc_id`` counts as an empty one; repeated
rows count each; ties among near words of equal count go to the smallest in code-point order; no words give an
empty result; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, map_batches, materialize, reachable

# Letters from the commonest to the rarest, dealt to the classes in turn.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
GROUPS = 5
TILE = 512  # words of a tile
PENDING = 500_000  # counters a task holds before it passes them on
DAMAGE = 97


def damaged(run: str, prefix: int, divisor: int = DAMAGE) -> str:
    """The run, or the run without one code point; ``prefix`` is the crc32 of the document's id and a colon."""
    h = zlib.crc32(run.encode(), prefix)
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, divisor: int = DAMAGE) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points and ``min_count`` occurrences."""
    ddl = "word string, n long"
    schema, runs = arrow_schema(ddl), re.compile("[a-zÀ-ÿ]{%d,}" % min_length)  # a shorter run cannot become a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def pass_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), schema[0].type), pa.array(list(total.values()), schema[1].type)], schema=schema)
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                prefix = zlib.crc32((doc_id.as_py() or b"") + b":")
                for word, n in Counter(runs.findall((text.as_py() or b"").lower().decode("utf-8", "replace"))).items():
                    word = damaged(word, prefix, divisor)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) > PENDING:
                    yield pass_on()
        yield pass_on()

    reachable(docs.sparkSession)
    return docs.select(as_bytes("doc_id").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, ddl).groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= min_count)


def block_of(word: str, groups: int = GROUPS) -> str:
    """How many letters of each class."""
    counts = [0] * groups
    for c in word:
        at = LETTERS.find(c)
        counts[(at if at >= 0 else ord(c)) % groups] += 1
    return ",".join(map(str, counts))


def next_blocks(block: str) -> list[str]:
    """The block itself, blocks of one letter more, and blocks where one letter changed class, each pair of blocks named once."""
    counts, out = [int(n) for n in block.split(",")], [block]
    for i in range(len(counts)):
        more = counts.copy()
        more[i] += 1
        out.append(",".join(map(str, more)))
        for j in range(i + 1, len(counts)):
            if counts[j]:
                moved = more.copy()
                moved[j] -= 1
                out.append(",".join(map(str, moved)))
    return out


def tiles(words: DataFrame, groups: int = GROUPS, tile: int = TILE) -> DataFrame:
    """(block, tile, words, counts, targets): at most about ``tile`` words of one block, in the order of their code points."""
    placed = materialize(map_batches(words.select("word", "n"), lambda w, n: {"word": w, "n": n, "block": [block_of(x, groups) for x in w]},
                                     "word string, n long, block string"), "spelling-words")
    size = placed.groupBy("block").count().select(F.col("block").alias("b"), F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    dealt = placed.join(size, F.col("block") == F.col("b")).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    grouped = dealt.groupBy("block", "tile").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    return materialize(grouped.select("block", "tile", F.col("w.word").alias("words"), F.col("w.n").alias("counts")), "spelling-tiles")


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def close_pairs(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at exactly one edit; words of a list have one length, those of ``right`` as many letters or one more.

    ``same`` marks one list met with itself: each pair is given once.
    """
    a, b = _letters(left), _letters(right)
    kinds, column = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    column, width = column.ravel(), len(kinds)
    exact = np.float32 if b.shape[1] <= 4096 else np.float64  # every sum is at most the square of the length, a whole number under 2**24 or 2**53

    def counts(letters: np.ndarray, columns: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(letters)), letters.shape[1])
        return np.bincount(rows * width + columns, minlength=len(letters) * width).reshape(-1, width).astype(exact)

    ca, cb = counts(a, column[:a.size]), counts(b, column[a.size:])
    gram = ca @ cb.T
    squared = (ca * ca).sum(1)[:, None] + (cb * cb).sum(1)[None, :] - 2 * gram
    equal = a.shape[1] == b.shape[1]
    i, j = np.nonzero(squared == (2 if equal else 1))
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 65_536):
        x, y = a[i[at:at + 65_536]], b[j[at:at + 65_536]]
        if equal:
            keep[at:at + 65_536] = (x != y).sum(1) == 1
        else:
            front = np.cumprod(x == y[:, :-1], axis=1).sum(1)
            back = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            keep[at:at + 65_536] = front + back >= a.shape[1]
    return i[keep], j[keep]


def _best(words: list[str], mine: np.ndarray, theirs: np.ndarray, other: list[str], n: np.ndarray) -> list[tuple[str, int, int, str]]:
    """(word, near words, largest n, that word) of one side of the pairs; ``other`` is in code-point order."""
    if not len(mine):
        return []
    order = np.lexsort((theirs, -n[theirs], mine))
    mine, theirs = mine[order], theirs[order]
    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
    size = np.diff(np.r_[first, len(mine)])
    return [(words[mine[k]], int(s), int(n[theirs[k]]), other[theirs[k]]) for k, s in zip(first, size)]


def near_words(tiled: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): how many words lie at one edit, and the most frequent of them."""
    targets = map_batches(tiled.select("block", "tile", "words", "counts"), lambda b, t, w, n: {
        "block": b, "tile": t, "words": w, "counts": n, "target": [next_blocks(x) for x in b]},
        "block string, tile int, words array<string>, counts array<long>, target array<string>")
    left = targets.select("block", "tile", "words", "counts", F.explode("target").alias("target"))
    right = tiled.select(F.col("block").alias("target"), F.col("tile").alias("other_tile"), F.col("words").alias("other_words"), F.col("counts").alias("other_counts"))
    met = left.join(right, "target").where((F.col("block") != F.col("target")) | (F.col("tile") <= F.col("other_tile")))
    # A large block has many tiles and its pairs share a join key: deal pairs of tiles out anew.
    parts = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "block", "tile", "target", "other_tile").select(
        "words", "counts", "other_words", "other_counts", ((F.col("block") == F.col("target")) & (F.col("tile") == F.col("other_tile"))).alias("same"))

    def compare(words, counts, other_words, other_counts, same) -> dict[str, list]:
        out = []
        for w, n, ow, on, s in zip(words, counts, other_words, other_counts, same):
            i, j = close_pairs(w, ow, s)
            out += _best(w, i, j, ow, np.array(on)) + _best(ow, j, i, w, np.array(n))
        return dict(zip(("word", "n_near", "near_n", "near"), map(list, zip(*out)))) if out else {"word": [], "n_near": [], "near_n": [], "near": []}

    found = map_batches(met, compare, "word string, n_near long, near_n long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")).select(
        "word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.near").alias("near"))


def variants(words: DataFrame, groups: int = GROUPS, tile: int = TILE, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of distinct words and their counts.

    A word's form is its most frequent near word if that is ``factor`` times as frequent; the
    root is where the forms end.  Counts grow by that factor along a chain, so its length is at most
    the logarithm of the largest count, and doubling the steps needs the logarithm of that.
    """
    words = materialize(words, "spelling-counts")
    near = near_words(tiles(words, groups, tile))
    formed = F.col("near_n") >= factor * F.col("n")
    out = materialize(words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("near_n")).alias("form_n")), "spelling-forms")
    top = out.agg(F.max("form_n")).first()[0]
    roots = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    if top is not None:
        for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log(top, factor) + 1))))):
            step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            roots = materialize(roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(count_words(docs))
