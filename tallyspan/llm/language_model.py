"""Language-model scores: prediction by partial matching over bytes.

The model is a trie of byte contexts with escape estimation (method C) and
symbol exclusion.  A text is its lower-cased words, each closed by a separator
symbol, and one end symbol; contexts reach back ``order`` symbols, at most to the
separator before the word.  So the code length of a word does not depend on its
neighbours, and training and scoring handle each distinct word once, weighted by
its count, however long the corpus is.

1. One pass writes the documents in chunks together with the distinct words of each chunk
   and their counts in training documents.
2. Word counts are summed over all chunks; they give the base score and feed the trie, which is a stored table.
   Only contexts seen in at least ``2**-prune`` of all symbols travel to the executors: at most
   ``2**prune`` of each order, whatever the input.
3. Every distinct word gets its code length.  Symbols in a context that did not travel are asked of the
   stored table, once for each context and symbol: contexts and questions are dealt by the last two symbols of the
   context, so a task holds all that escaping can reach.  The score does not depend on ``prune``.
4. Words go back to their chunks, where the documents are scored.  A frequent word is one row in each chunk.

Defined results: null and empty texts are the end symbol alone; a null doc_id is
never held out; without training documents every count is zero; repeated rows
repeat; extra columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.storage import scratch

from .common import arrow_schema, as_bytes, fresh_path, held_out, materialize, reachable, space_words

ORDER, PRUNE = 4, 18
SEPARATOR, END, ALPHABET = 256, 257, 258
CHUNK_WORDS, CHUNK_BYTES = 400_000, 64_000_000
_ROW = "chunk long, kind int, doc_id long, text binary, token binary, n long"


def chunked(docs: DataFrame, mod: int) -> DataFrame:
    """Documents (kind 1) and the distinct words of their chunk (kind 0) with counts in training documents."""
    reachable(docs.sparkSession)
    schema = arrow_schema(_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, size = int.from_bytes(os.urandom(7), "little"), Counter(), 0

        def emit(kind, ids=None, texts=None, tokens=None, counts=None):
            k = len(tokens if ids is None else ids)
            none = [None] * k
            cols = ([chunk] * k, [kind] * k, ids or none, texts or none, tokens or none, counts or none)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        def words():
            keys = list(seen)
            for at in range(0, len(keys), 50_000):
                part = keys[at:at + 50_000]
                yield emit(0, tokens=part, counts=[seen[w] for w in part])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for i, text in zip(ids, texts):
                    own = space_words(text.lower() if text else None) + [b""]
                    seen.update(dict.fromkeys(own, 0) if held_out(i, mod) else own)
                    size += len(text or b"")
                yield emit(1, ids=ids, texts=texts)
                if len(seen) > CHUNK_WORDS or size > CHUNK_BYTES:
                    yield from words()
                    chunk, seen, size = int.from_bytes(os.urandom(7), "little"), Counter(), 0
        yield from words()

    return docs.select(F.col("doc_id").cast("long"), as_bytes().alias("text")).mapInArrow(run, _ROW)


def _symbols(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, word number, symbols before it in its word) over all predictions; the opening separator is implied."""
    sizes = np.array([len(t) for t in tokens], np.int64) + 1
    owner = np.repeat(np.arange(len(tokens)), sizes)
    depth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbol = np.full(len(owner), SEPARATOR, np.int64)
    inner = depth < np.repeat(sizes - 1, sizes)
    symbol[inner] = np.frombuffer(b"".join(tokens), np.uint8)
    symbol[~inner & np.repeat(sizes == 1, sizes)] = END
    return symbol, owner, depth


def contexts(symbol: np.ndarray, depth: np.ndarray, order: int) -> list[np.ndarray]:
    """Key of the context of each order at each place, -1 where the word is too short for it."""
    out, key = [np.zeros(len(symbol), np.int64)], np.zeros(len(symbol), np.int64)
    for o in range(1, order + 1):
        before = np.full(len(symbol), SEPARATOR, np.int64)
        before[o:] = symbol[:-o] if o < len(symbol) else 0
        before[depth == o - 1] = SEPARATOR
        key = key + (before << (9 * (o - 1)))
        out.append(np.where(depth >= o - 1, (np.int64(o) << 36) + key, -1))
    return out


def context_counts(words: DataFrame, order: int) -> DataFrame:
    """(ctx, sym, n) over all training words."""
    schema = arrow_schema("ctx long, sym int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            symbol, owner, depth = _symbols(batch.column(0).to_pylist())
            weight = batch.column(1).to_numpy()[owner]
            new_keys, new_sums = [keys], [sums]
            for ctx in contexts(symbol, depth, order):
                ok = ctx >= 0
                k, inverse = np.unique((ctx[ok] << 9) + symbol[ok], return_inverse=True)
                new_keys.append(k)
                new_sums.append(np.bincount(inverse, weight[ok], len(k)).astype(np.int64))
            keys, inverse = np.unique(np.concatenate(new_keys), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(new_sums), len(keys)).astype(np.int64)
            if len(keys) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 9), pa.array((keys & 511).astype(np.int32)), pa.array(sums)], schema=schema)
                keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys >> 9), pa.array((keys & 511).astype(np.int32)), pa.array(sums)], schema=schema)

    return words.select("token", "c").mapInArrow(run, "ctx long, sym int, n long").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def shorter(ctx: np.ndarray) -> np.ndarray:
    """The contexts without their first symbol."""
    o = ctx >> 36
    return np.where(o > 1, ((o - 1) << 36) + (ctx & ((np.int64(1) << np.maximum(9 * (o - 1), 0)) - 1)), 0)


class Trie:
    """Contexts with their children, and what escaping from each of them excludes below.

    With every context the shorter ones it ends with are held too; ``whole`` says that no context is missing.
    """

    def __init__(self, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, order: int, whole: bool = True):
        at = np.lexsort((sym, ctx))
        ctx, sym, n = ctx[at], sym[at], n[at].astype(float)
        self.order, self.whole = order, whole
        self.ctx, first = np.unique(ctx, return_index=True)
        self.total = np.add.reduceat(n, first) if len(n) else n
        self.kinds = np.diff(np.append(first, len(ctx))).astype(float)
        node = np.repeat(np.arange(len(self.ctx)), self.kinds.astype(np.int64))
        self.key, self.count = node * 512 + sym, n
        self.parent = np.where(self.ctx > 0, np.searchsorted(self.ctx, shorter(self.ctx)), -1)
        inherited = self.counts(self.parent[node], sym) if len(node) else n
        self.hidden = np.bincount(node, np.where(self.parent[node] >= 0, inherited, 0), len(self.ctx)) if len(node) else n

    def counts(self, node: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Count of the symbol in the node, 0 if it is no child (or the node is -1)."""
        want = node * 512 + sym
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((node >= 0) & (self.key[at] == want), self.count[at], 0.0)

    def find(self, key: np.ndarray) -> np.ndarray:
        if not len(self.ctx):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ctx, key), len(self.ctx) - 1)
        return np.where(self.ctx[at] == key, at, -1)

    def lengths(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each word with its closing symbol (the empty word is the end), without the symbols left open.

        A symbol is open if its context may be among the missing ones; the numbers of the words of these and (context, symbol) follow.
        """
        symbol, owner, depth = _symbols(tokens)
        keys = contexts(symbol, depth, self.order)
        longest = np.max(keys, axis=0)  # the order stands in the highest bits
        node = self.find(longest)
        open_ = np.flatnonzero(node < 0) if not self.whole else np.zeros(0, np.int64)
        log = self.predict(longest, symbol, node)
        log[open_] = 0
        return np.bincount(owner, log, len(tokens)), owner[open_], (longest[open_] << 9) + symbol[open_]

    def predict(self, ctx: np.ndarray, symbol: np.ndarray, node: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context; ``node`` is -1 where the context is not held and a shorter one counts."""
        if not len(self.ctx):
            return np.full(len(symbol), -math.log10(ALPHABET))
        ctx, node = ctx.copy(), node.copy()
        while len(lost := np.flatnonzero((node < 0) & (ctx > 0))):
            ctx[lost] = shorter(ctx[lost])
            node[lost] = self.find(ctx[lost])
        log = np.zeros(len(symbol))
        hidden, gone = np.zeros(len(symbol)), np.zeros(len(symbol))
        live = np.arange(len(symbol))
        while len(live):
            here = node[live]
            total, kinds = self.total[here] - hidden[live], self.kinds[here] - gone[live]
            got = self.counts(here, symbol[live])
            hit = got > 0
            log[live[hit]] += np.log10(got[hit] / (total + kinds)[hit])
            miss = live[~hit]
            some = kinds[~hit] > 0  # nothing new was ever seen here: the escape is certain
            log[miss[some]] += np.log10(kinds[~hit][some] / (total + kinds)[~hit][some])
            at = node[miss]
            hidden[miss], gone[miss], node[miss] = self.hidden[at], self.kinds[at], self.parent[at]
            out = node[miss] < 0
            log[miss[out]] -= np.log10(np.maximum(ALPHABET - gone[miss[out]], 1))
            live = miss[~out]
        return log


def train(words: DataFrame, order: int = ORDER, prune: int = PRUNE) -> tuple[Trie, DataFrame]:
    """The trie of the frequent contexts and the table of all of them; ``words`` holds (token, c) of the training documents."""
    counts = materialize(context_counts(words.where("c > 0"), order), "contexts")
    symbols = counts.where("ctx = 0").agg(F.sum("n")).first()[0] or 0
    sizes = counts.groupBy("ctx").agg(F.sum("n").alias("all")).withColumn("frequent", (F.col("all") >= symbols / 2.0 ** prune) | (F.col("ctx") == 0))
    got = counts.join(sizes.where("frequent").select("ctx"), "ctx").toPandas()  # bounded: 2**prune contexts of each order
    whole = sizes.where("NOT frequent").isEmpty()
    return Trie(got["ctx"].to_numpy(np.int64), got["sym"].to_numpy(np.int64), got["n"].to_numpy(np.int64), order, whole), counts


def answers(counts: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(q, lp): log10 probability of each asked (context, symbol), by all contexts of the table."""
    # Contexts of one symbol at most are few, the alphabet squared; every longer one lies with its shorter ones.
    few = counts.where(F.shiftright("ctx", 36) <= 1).toPandas()
    low = [few[c].to_numpy(np.int64) for c in ("ctx", "sym", "n")]
    both = counts.where(F.shiftright("ctx", 36) > 1).select("ctx", "sym", "n").union(
        asked.select(F.shiftright("q", 9), F.col("q").bitwiseAND(511).cast("int"), F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(k).to_numpy().astype(np.int64) for k in range(3)] for b in batches]
        if not parts:
            return
        ctx, sym, n = map(np.concatenate, zip(*parts))
        trie = Trie(*[np.concatenate([a, b[n > 0]]) for a, b in zip(low, (ctx, sym, n))], order)
        ctx, sym = ctx[n == 0], sym[n == 0]
        for at in range(0, len(ctx), 100_000):
            own = slice(at, at + 100_000)
            lp = trie.predict(ctx[own], sym[own], trie.find(ctx[own]))
            yield pa.RecordBatch.from_arrays([pa.array((ctx[own] << 9) + sym[own]), pa.array(lp)], ["q", "lp"])

    return both.repartition(F.col("ctx").bitwiseAND((1 << 18) - 1)).mapInArrow(run, "q long, lp double")


def score(docs: DataFrame, mod: int = 5, order: int = ORDER, prune: int = PRUNE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    path = fresh_path(docs.sparkSession, "chunks")
    chunked(docs, mod).write.option("compression", "zstd").parquet(path)  # the one large table of this job
    rows = docs.sparkSession.read.schema(_ROW).parquet(path)
    tokens = rows.where("kind = 0").select("chunk", "token", "n")
    lengths, found = fresh_path(docs.sparkSession, "lengths"), fresh_path(docs.sparkSession, "answers")
    with scratch(docs.sparkSession):  # words and contexts are needed no longer when these two are written
        words = materialize(tokens.groupBy("token").agg(F.sum("n").alias("c")), "words")
        n_all, v_all = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
        trie, counts = train(words, order, prune)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lp, owner, asked = trie.lengths(b.column(0).to_pylist())
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=b.num_rows)))
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(asked, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp), rest], ["token", "c", "lp", "rest"])

        measured = words.select("token", "c").mapInArrow(measure, "token binary, c long, lp double, rest array<long>")
        measured.write.option("compression", "zstd").parquet(lengths)
        known = docs.sparkSession.read.schema(measured.schema).parquet(lengths)
        if not trie.whole:
            rest = known.select("token", F.explode("rest").alias("q"))
            answers(counts, rest.select("q").distinct(), order).write.parquet(found)
            said = rest.join(docs.sparkSession.read.schema("q long, lp double").parquet(found), "q").groupBy("token").agg(F.sum("lp").alias("more"))
            known = known.join(said, "token", "left").withColumn("lp", F.col("lp") + F.coalesce("more", F.lit(0.0)))
    reply = tokens.select("chunk", "token").join(known.select("token", "c", "lp"), "token").select(
        "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text"), "token", "c", "lp")
    texts = rows.where("kind = 1").select("chunk", "kind", "doc_id", "text", F.lit(None).cast("binary").alias("token"),
                                          F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("lp"))
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(ddl)
    scale = n_all + 0.5 * (v_all + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, c, lp, tables = None, {}, [], [], None
        for b in batches:
            out = [[] for _ in schema]
            for own, kind, i, text, token, n, length in zip(*[b.column(k).to_pylist() for k in range(7)]):
                if own != chunk:
                    chunk, ids, c, lp, tables = own, {}, [], [], None
                if kind == 0:  # the words of a chunk come before its documents
                    ids[token] = len(c)
                    c.append(n)
                    lp.append(length)
                    continue
                if tables is None:
                    counts = np.array(c, float)
                    tables = counts > 0, np.log10((counts + 0.5) / scale), np.array(lp)
                at = np.fromiter(map(ids.__getitem__, space_words(text.lower() if text else None) + [b""]), np.int64)
                for col, v in zip(out, (i, held_out(i, mod), len(at), int(tables[0][at].sum()), n_all,
                                        math.fsum(tables[1][at]), float(tables[2][at].sum()))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return reply.union(texts).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, ddl)
