"""Substring dedup with prefix-partitioned suffix trees over words.

A suffix starts at a word and is read for ``length`` words; two places share a
window exactly when their suffixes meet in a node of at least that depth.

1. Equal texts are folded to one text with a count; the texts are kept in a
   bucketed table, so later steps read them without shuffling them again.
2. Every window has an anchor: the smallest hash among its runs of ``seed``
   words.  Equal windows have equal anchors at the same place, so a window whose
   anchor run stands nowhere else cannot repeat.  Runs are counted over the
   whole corpus with map-side combining.
3. The suffixes that remain are dealt by a prefix of variable length: the anchor
   run, or, where that group would not fit (more than ``group_rows`` rows), the
   whole window.  Groups of the first kind are bounded, arrive sorted, and each
   becomes a subtree: suffixes in lexicographic order with the common prefix
   lengths of neighbours, whose deep nodes are the repeats.  In a group
   of the second kind all suffixes are one deep node, so only its size
   counts; sizes are combined before the shuffle and no such group is gathered.
4. Repeated windows merge into maximal spans; their words are removed.

Defined results: null and empty texts have no words; a text with copies
loses every word if it has a whole window; texts shorter than a window are
kept; repeated rows count as copies; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fresh_path, map_batches, materialize, reachable, space_words

LENGTH, SEED, GROUP_ROWS = 35, 8, 20_000
_P = np.uint64(0x9E3779B97F4A7C15)


def seed_hashes(words: list[bytes], seed: int) -> np.ndarray:
    """Hash of every run of ``seed`` words."""
    n = len(words) - seed + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for j in range(seed):
        out = out * _P + h[j:n + j]
    out ^= out >> np.uint64(32)
    out *= _P
    return out ^ (out >> np.uint64(29))


def anchors(words: list[bytes], length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, number of windows) of every anchor of a text."""
    h = seed_hashes(words, seed)
    span = length - seed + 1
    if len(h) < span:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    at = np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1) + np.arange(len(h) - span + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]], at[first], first, np.diff(np.append(first, len(at)))


_ODD = np.random.default_rng(1).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def deep_nodes(suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Size of the deepest node of at least ``depth`` words above each suffix (row), else 1.

    Rows are sorted as in a suffix array; neighbours whose common prefix
    reaches the depth hang under the same deep node.
    """
    if not len(suffixes):
        return np.zeros(0, np.int64)
    width, apart = suffixes.shape[1], None
    if depth >= width:  # only equal rows hang together: a mix of their words brings them next to each other, in less time than their order
        mix = np.zeros(len(suffixes), np.uint64)
        for k in range(width):
            mix += suffixes[:, k] * _ODD[k % len(_ODD)]
        order = np.argsort(mix, kind="stable")
        ranked = suffixes[order]
        apart = (ranked[1:] != ranked[:-1]).any(axis=1)
        if (apart & (mix[order][1:] == mix[order][:-1])).any():  # different rows of one mix: take the order itself
            apart = None
    if apart is None:
        rows = np.ascontiguousarray(suffixes.astype(">u4"))
        order = np.argsort(rows.view(f"V{4 * width}").ravel(), kind="stable")
        ranked = suffixes[order]
        differ = ranked[1:] != ranked[:-1]
        apart = np.where(differ.any(axis=1), differ.argmax(axis=1), width) < depth
    node = np.concatenate(([0], np.cumsum(apart)))
    size = np.empty(len(suffixes), np.int64)
    size[order] = np.bincount(node)[node]
    return size


def text_table(docs: DataFrame) -> DataFrame:
    """(tid, text, copies): distinct texts, bucketed by their key."""
    spark = docs.sparkSession
    texts = (docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
             .withColumn("tid", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
             .groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    texts.write.bucketBy(n, "tid").option("path", fresh_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def repeated_seeds(texts: DataFrame, length: int, seed: int, group_rows: int) -> DataFrame:
    """(tid, seeds, crowded): the anchor runs of a text that stand at two places or more."""

    def run(tids, raw):
        out = {"tid": [], "seed": [], "n": []}
        for tid, text in zip(tids, raw):
            h = anchors(space_words(text), length, seed)[0]
            values, counts = np.unique(h.view(np.int64), return_counts=True)
            out["tid"] += [tid] * len(values)
            out["seed"] += values.tolist()
            out["n"] += counts.tolist()
        return out

    found = map_batches(texts.select("tid", "text"), run, "tid binary, seed long, n long")
    known = found.groupBy("seed").agg(F.sum("n").alias("all")).where("all > 1").select("seed", (F.col("all") > group_rows).alias("big"))
    return (found.select("tid", "seed").join(known, "seed").groupBy("tid")
            .agg(F.collect_list(F.when(~F.col("big"), F.col("seed"))).alias("seeds"),
                 F.collect_list(F.when(F.col("big"), F.col("seed"))).alias("crowded")))


def suffix_groups(texts: DataFrame, seeds: DataFrame, length: int, seed: int) -> DataFrame:
    """(prefix, whole, tid, start, windows, words): suffixes that may repeat, under their prefix.

    ``whole`` marks the long prefix; its rows hold one window and no words.
    """

    def run(tids, raw, plain, crowded):
        out = {k: [] for k in ("prefix", "whole", "tid", "start", "windows", "words")}
        for tid, text, some, big in zip(tids, raw, plain, crowded):
            words = space_words(text)
            h, _, first, count = anchors(words, length, seed)
            h = h.view(np.int64)
            wanted = np.isin(h, np.array(some, np.int64))
            for k in np.flatnonzero(wanted | np.isin(h, np.array(big, np.int64))).tolist():
                a, n = int(first[k]), int(count[k])
                if wanted[k]:
                    rows = [(h[k].tobytes(), False, tid, a, n, b" ".join(words[a:a + n + length - 1]))]
                else:
                    rows = [(hashlib.blake2b(b" ".join(words[p:p + length]), digest_size=16).digest(), True, tid, p, 1, None)
                            for p in range(a, a + n)]
                for row in rows:
                    for key, value in zip(out, row):
                        out[key].append(value)
        return out

    return map_batches(texts.join(seeds, "tid").select("tid", "text", "seeds", "crowded"), run,
                       "prefix binary, whole boolean, tid binary, start int, windows int, words binary")


def subtree_spans(groups: DataFrame, length: int) -> DataFrame:
    """(tid, first, stop) of the repeated spans found in the bounded groups."""
    dealt = (groups.where("NOT whole").select("prefix", "tid", "start", "windows", "words")
             .repartition("prefix").sortWithinPartitions("prefix"))
    schema = arrow_schema("tid binary, first int, stop int")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = ([], [], [])
        if rows:
            parts = b" ".join(r[4] for r in rows).split(b" ")  # a row of n windows holds n + length - 1 words
            ids = {w: i for i, w in enumerate(dict.fromkeys(parts))}
            line = np.fromiter(map(ids.__getitem__, parts), np.uint32, len(parts))
            windows = np.array([r[3] for r in rows], np.int64)
            group = np.cumsum([0] + [x[0] != y[0] for x, y in zip(rows, rows[1:])])
            owners = np.repeat(np.arange(len(rows)), windows)
            place = np.arange(len(owners)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = np.repeat(np.cumsum(windows + length - 1) - (windows + length - 1), windows) + place
            suffixes = np.column_stack((group[owners].astype(np.uint32), line[begin[:, None] + np.arange(length)]))
            hit = deep_nodes(suffixes, length + 1) > 1
            at = np.flatnonzero(hit)
            if len(at):
                begins = np.concatenate(([True], (np.diff(at) != 1) | (owners[at[1:]] != owners[at[:-1]])))
                lows = np.flatnonzero(begins)
                highs = np.append(lows[1:], len(at)) - 1
                for a, b in zip(at[lows].tolist(), at[highs].tolist()):
                    r = rows[owners[a]]
                    out[0].append(r[1])
                    out[1].append(r[2] + int(place[a]))
                    out[2].append(r[2] + int(place[b]) + length)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if len(held) >= 4096 and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        yield solve(held)

    return dealt.mapInArrow(run, "tid binary, first int, stop int")


def whole_prefix_spans(groups: DataFrame, length: int) -> DataFrame:
    """(tid, first, stop) of the windows in the groups that were split down to whole windows."""
    rows = groups.where("whole").select("prefix", "tid", "start")
    nodes = rows.groupBy("prefix").count().where("count > 1").select("prefix")
    return rows.join(nodes, "prefix").select("tid", F.col("start").alias("first"), (F.col("start") + length).alias("stop"))


def clean_texts(texts: DataFrame, length: int = LENGTH, seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(tid, n_words, n_removed, kept, spans) of every distinct text."""
    groups = materialize(suffix_groups(texts, repeated_seeds(texts, length, seed, group_rows), length, seed), "suffixes")
    spans = (subtree_spans(groups, length).union(whole_prefix_spans(groups, length))
             .groupBy("tid").agg(F.collect_list(F.struct("first", "stop")).alias("found")))

    def run(raw, tids, copies, found):
        out = {k: [] for k in ("tid", "n_words", "n_removed", "kept", "spans")}
        for text, tid, many, own in zip(raw, tids, copies, found):
            words = space_words(text)
            steps = np.zeros(len(words) + 1, np.int64)
            for s in own or []:
                steps[s["first"]] += 1
                steps[s["stop"]] -= 1
            if many > 1 and len(words) >= length:
                steps[0] += 1
                steps[-1] -= 1
            gone = np.cumsum(steps)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            for key, value in zip(out, (tid, len(words), int(gone.sum()), kept.decode(),
                                        [{"first": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()])):
                out[key].append(value)
        return out

    joined = texts.join(spans, "tid", "left").select("text", "tid", "copies", "found")
    return map_batches(joined, run, "tid binary, n_words long, n_removed long, kept string, spans array<struct<first:int,stop:int>>")


def with_texts(docs: DataFrame, per_text: DataFrame) -> DataFrame:
    """Carry a per-text result back to every document."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    keyed = keyed.select("doc_id", F.substring(F.unhex(F.sha2("t", 256)), 1, 16).alias("tid"))
    return keyed.join(per_text, "tid").drop("tid")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of every document."""
    reachable(docs.sparkSession)
    return with_texts(docs, clean_texts(text_table(docs), length, seed, group_rows))


def digest(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The same with the hash of the kept words; the kept texts themselves are not shuffled."""
    per_text = clean_texts(text_table(docs), length, seed, group_rows)
    return with_texts(docs, per_text.select("tid", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
