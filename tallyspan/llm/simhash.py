"""SimHash near-duplicates by ball hashing that meets in the middle.

The 64 bits are cut into three blocks.  Fingerprints that differ in at most
three bits differ in at most two bits outside one of the blocks (the block with
most differences takes at least one).  So, for each block left out, both
sides emit all variants of the rest within half of that remaining radius, one
flipped bit: 132 variants for a fingerprint instead of 2,081 for the plain
ball of radius two.  Variants are shuffled, colliding fingerprints are verified
on all 64 bits, and connected components of the verified links are the groups.

Only distinct fingerprints emit variants, so copies cost nothing.  A crowded
variant yields a spanning forest of its verified links rather than all pairs.

Defined results: texts without words (null and empty ones too) have fingerprint
zero and link like any other; a null ``doc_id`` never names a group unless the
group has no other id; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, map_batches, materialize, space_words, text_key
from .components import components

BLOCKS = ((0, 21), (21, 42), (42, 64))
RADIUS = 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    words = space_words(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)


def fingerprint(text: bytes | None, size: int) -> int:
    """Unsigned; a bit is one if it is set in over half of the shingle hashes."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    octets = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(ids, texts):
        return {"doc_id": ids, "fp": [signed(fingerprint(t, size)) for t in texts]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), as_bytes().alias("text")), run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): every variant of the fingerprint with one block left out and at most one flipped bit."""
    keys = []
    for a, b in BLOCKS:
        rest = F.col("fp").bitwiseAND(F.lit(signed(((1 << 64) - 1) ^ ((1 << b) - (1 << a))))).bitwiseXOR(F.lit(signed(1 << a)))
        keys += [rest] + [rest.bitwiseXOR(F.lit(signed(1 << i))) for i in range(64) if not a <= i < b]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; memory is bounded by blocks of rows."""
    n = len(fps)
    root = np.arange(n)
    out = []
    for i in range(n):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius) + i + 1
        fresh = near[root[near] != root[i]]
        while len(fresh):  # one edge for each other tree
            j = int(fresh[0])
            out.append((i, j))
            root[root == root[j]] = root[i]
            fresh = fresh[root[fresh] != root[i]]
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (u, v) between distinct fingerprints that share a variant."""
    dealt = variants(fps).repartition("key").sortWithinPartitions("key", "fp")
    schema = arrow_schema("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solve(k, f):
            pairs = set()
            if len(k):
                starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                sizes = np.diff(np.append(starts, len(k)))
                twos = starts[sizes == 2]
                ok = np.bitwise_count(f[twos] ^ f[twos + 1]) <= radius
                pairs.update(zip(f[twos][ok].tolist(), f[twos + 1][ok].tolist()))
                for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                    own = f[s:s + n]
                    pairs.update((int(own[i]), int(own[j])) for i, j in bucket_links(own, radius))
            got = np.array(list(pairs), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=schema)

        for b in batches:
            k = np.concatenate((rest_k, b.column(0).to_numpy()))
            f = np.concatenate((rest_f, b.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            yield solve(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        yield solve(rest_k, rest_f)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; the component's id is its smallest doc_id."""
    rows = materialize(fingerprints(docs, size), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), radius))
    placed = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "placed")
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    names = placed.join(named, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


# Near copies at a given similarity: the same method on several short fingerprints, then exact Jaccard.
TABLES, KEY_BITS = 12, 24
WORDS = TABLES * KEY_BITS // 64 + 1
SMALL = 8  # buckets of up to so many rows give all their pairs at once


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """``WORDS`` fingerprints of 64 bits of a set of shingle hashes, each from its own mix; every shingle votes once."""
    out = np.zeros(WORDS, np.uint64)
    for i in range(WORDS if len(h) else 0):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        octets = (x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8)
        bits = np.concatenate([2 * (np.bincount(octets[:, j], minlength=256) @ _BITS) > len(h) for j in range(8)])
        out[i] = np.packbits(bits, bitorder="little").view(np.uint64)[0]
    return out


def bits_apart(similarity: float) -> int:
    """Differing bits of 128 that a pair of this Jaccard similarity has, plus three standard deviations; only for candidates."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(128 * share + 3 * (128 * share * (1 - share)) ** 0.5)


def wide_links(nodes: DataFrame, radius: int, every: bool = False) -> DataFrame:
    """Candidate links (u, v) between nodes whose 128 check bits differ in at most ``radius`` places.

    ``nodes`` holds (node, wide, root).  Each of the short fingerprints is looked up within two bits: both
    sides emit every variant within one bit and meet in the middle.  Nodes of one root are not linked.
    A crowded bucket gives a spanning forest, and (u, null) for every node whose pairs it leaves out;
    with ``every`` it gives all pairs.
    """
    schema, linked = arrow_schema("key long, node long, root long, a long, b long"), arrow_schema("u long, v long")
    flips = np.concatenate(([0], 1 << np.arange(KEY_BITS))).astype(np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                raw = b"".join(batch.column(0).slice(at, 1024).to_pylist())
                wide = np.frombuffer(raw, np.uint64).reshape(-1, WORDS)
                bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")[:, :TABLES * KEY_BITS].reshape(len(wide), TABLES, KEY_BITS)
                keys = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(KEY_BITS, dtype=np.uint64)) + (np.arange(TABLES, dtype=np.uint64) << np.uint64(KEY_BITS))
                keys = (keys[:, :, None] ^ flips).reshape(len(wide), -1)
                n = keys.shape[1]
                own = [np.repeat(batch.column(i).slice(at, 1024).to_numpy(), n) for i in (1, 2)]
                own += [np.repeat(wide[:, i], n).view(np.int64) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.ravel().view(np.int64), *own)], schema=schema)

    dealt = nodes.select("wide", "node", "root").mapInArrow(emit, "key long, node long, root long, a long, b long")
    if not every:  # every node is its own root, so the column need not travel
        dealt = dealt.drop("root")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "node")

    def crowded(node, root, a, b) -> Iterator[list[tuple[int, int | None]]]:
        tree, left_out = np.unique(root, return_inverse=True)[1], np.zeros(len(node), bool)
        for i in range(len(node) - 1 if tree.any() else 0):
            near = np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) + np.bitwise_count(b[i + 1:] ^ b[i]) <= radius) + i + 1
            fresh = near[tree[near] != tree[i]]
            if every:
                yield [(int(node[i]), int(j)) for j in node[fresh]]
                continue
            out, tied = [], near[tree[near] == tree[i]]
            while len(fresh):  # one edge for each other tree
                j = int(fresh[0])
                out.append((int(node[i]), int(node[j])))
                same = tree[fresh] == tree[j]
                tied = np.concatenate((tied, fresh[same][1:]))
                tree[tree == tree[j]] = tree[i]
                fresh = fresh[~same]
            if len(tied):
                left_out[i] = left_out[tied] = True
            yield out
        yield [(int(x), None) for x in node[left_out]]

    def record(pairs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(k, node, *more):
            root, a, b = more if every else (node, *more)
            a, b = a.view(np.uint64), b.view(np.uint64)
            found = set()
            if len(k):
                starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                sizes = np.diff(np.append(starts, len(k)))
                small = sizes <= SMALL
                inside = np.repeat(small, sizes)
                for step in range(1, min(SMALL, len(k))):  # pairs of small buckets, all buckets at a time
                    at = np.flatnonzero((k[step:] == k[:-step]) & inside[step:] & (root[step:] != root[:-step]))
                    ok = np.bitwise_count(a[at] ^ a[at + step]) + np.bitwise_count(b[at] ^ b[at + step]) <= radius
                    found.update(zip(node[at[ok]].tolist(), node[at[ok] + step].tolist()))
                for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
                    for pairs in crowded(*(x[s:s + n] for x in (node, root, a, b))):
                        found.update(pairs)
                        if len(found) > 200_000:
                            yield record(found)
                            found = set()
            yield record(found)

        rest = [np.zeros(0, np.int64)] * (5 if every else 4)
        for batch in batches:
            rest = [np.concatenate((x, c.to_numpy())) for x, c in zip(rest, batch.columns)]
            cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            yield from solve(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
        yield from solve(*rest)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def verified(links: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The links (u, v) whose shingle sets have at least this Jaccard similarity; sets are made anew for linked texts only."""

    def sets(nodes, texts):
        return {"node": nodes, "hs": [np.unique(shingle_hashes(t, size)).tobytes() for t in texts]}

    def alike(us, vs, xs, ys):
        out = {"u": [], "v": []}
        for u, v, x, y in zip(us, vs, xs, ys):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                out["u"].append(u)
                out["v"].append(v)
        return out

    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    wanted = nodes.select("node", "tid").join(ends, "node")
    texts = docs.select(text_key().alias("tid"), as_bytes().alias("text")).join(wanted.select("tid"), "tid", "left_semi").dropDuplicates(["tid"])
    whole = materialize(map_batches(texts.join(wanted, "tid").select("node", "text"), sets, "node long, hs binary"), "shingle-sets")
    both = links.join(whole.toDF("u", "x"), "u").join(whole.toDF("v", "y"), "v").select("u", "v", "x", "y")
    return map_batches(both, alike, "u long, v long")


def near_links(docs: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Verified links (u, v) between nodes.

    A forest of candidates says nothing about the pairs it leaves out once one of its links fails, so
    nodes of crowded buckets are dealt a second time: all their pairs that verified links have not joined yet.
    """
    radius = bits_apart(similarity)
    found = materialize(wide_links(nodes.withColumn("root", F.col("node")), radius), "candidates")
    tried = found.where("v IS NOT NULL")
    good = materialize(verified(tried, nodes, docs, size, similarity), "verified")
    crowd = found.where("v IS NULL").select(F.col("u").alias("node"))
    if crowd.isEmpty():
        return good
    again = nodes.join(crowd, "node", "left_semi").join(components(good), "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = wide_links(again, radius, every=True).join(tried, ["u", "v"], "left_anti")
    return good.union(verified(materialize(more, "candidates"), nodes, docs, size, similarity))


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document with the smallest id of every group of copies and near copies, with all its columns.

    Near copies are linked by the exact Jaccard similarity of their shingle sets; fingerprints only find
    candidates.  Documents without an id come after all others; equal rows, and texts with equal sets, count as copies.
    """
    def run(ids, keys, texts):
        sets = [np.unique(shingle_hashes(t, size)) for t in texts]
        return {"doc_id": ids, "tid": keys, "sid": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets],
                "wide": [wide_fingerprint(h).tobytes() for h in sets]}

    key = text_key()
    rows = materialize(map_batches(docs.select(F.col("doc_id").cast("long"), key.alias("tid"), as_bytes().alias("text")), run,
                                   "doc_id long, tid binary, sid binary, wide binary"), "wide")
    # Written once, so the numbers stay as they are.
    nodes = materialize(rows.groupBy("sid").agg(F.min("tid").alias("tid"), F.min("wide").alias("wide"))
                        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(near_links(docs, nodes, size, similarity))
    groups = nodes.select("sid", "node").join(roots, "node", "left").select("sid", F.coalesce("root", "node").alias("root"))
    last = F.lit((1 << 63) - 1)
    # Copies fold to one row per set before the join.
    placed = rows.groupBy("sid").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "tid")).alias("s")).join(groups, "sid")
    stay = placed.groupBy("root").agg(F.min("s").alias("s")).select(F.col("s.id").alias("__id"), F.col("s.tid").alias("__tid"))
    marked = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), last), "__k": key})
    kept = marked.join(stay.distinct(), (F.col("__d") == F.col("__id")) & (F.col("__k") == F.col("__tid")), "left_semi")
    return kept.dropDuplicates(["__d", "__k"]).drop("__d", "__k")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
