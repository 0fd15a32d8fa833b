"""Approximate nearest neighbours (largest inner product) over learned partitions.

1. A bounded sample (``sample_rows``, smallest hash of the id) gives a neighbour graph.
2. The graph is cut into parts of equal size by recursive bisection along its
   slowest mode, with swaps that cut fewer edges.
3. A softmax classifier learns, for a vector, where its neighbours lie.
4. Every row is indexed in its most probable part.  A query visits its most
   probable parts until they hold ``mass`` of the probability, at least ``probes``
   of them, and in any case until they hold enough rows for a full answer; all rows there are
   scored exactly on the original vectors.  The first part's k-th score is the floor
   for the others, so they return only rows that can still enter the answer.

Large parts are cut into blocks of rows, and their visitors into blocks of
queries, so no group grows with the input.  Each block returns at most ``k`` rows for a query.

Defined results: vectors that are null, zero, or hold a null or non-finite component
take no part, nor do those whose length is not the most common one; rows with a null id take
no part; rows that share the query's id are its own; equal scores go to the smaller
id; if there are fewer candidates than ``k``, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, reachable

SAMPLE_ROWS, PART_ROWS, BLOCK_ROWS, QUERY_ROWS = 4000, 2000, 8000, 2000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that can take part, of the most common length."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (size["n"] if size else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Symmetric 0/1 matrix of the ``k`` largest inner products of each row."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(x) - 1)
    g = np.zeros(s.shape, np.float32)
    if k > 0:
        np.put_along_axis(g, np.argpartition(-s, k - 1, axis=1)[:, :k], 1, axis=1)
    return np.maximum(g, g.T)


def bisect(g: np.ndarray, rng) -> np.ndarray:
    """A balanced cut: True for half of the rows."""
    n = len(g)
    d = np.sqrt(g.sum(axis=1) + 1e-6)
    top, y = d / np.linalg.norm(d), rng.normal(size=n).astype(np.float32)
    for _ in range(60):
        y -= top * (top @ y)
        y = 0.5 * y + 0.5 * (g @ (y / d)) / d
        y /= np.linalg.norm(y) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(y / d, kind="stable")[: n // 2]] = True
    sign = np.where(side, 1.0, -1.0)
    pull = g @ sign
    for _ in range(n):  # swap the pair that gains most
        gain = -pull * sign
        i, j = np.argmax(np.where(sign > 0, gain, -np.inf)), np.argmax(np.where(sign < 0, gain, -np.inf))
        if gain[i] + gain[j] - 2 * g[i, j] <= 0:
            break
        sign[i], sign[j] = -1.0, 1.0
        pull += 2 * (g[:, j] - g[:, i])
    return sign > 0


def balanced_parts(g: np.ndarray, levels: int, seed: int = 11) -> np.ndarray:
    rng, part = np.random.default_rng(seed), np.zeros(len(g), np.int64)
    for _ in range(levels):
        new = part * 2
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                new[rows] += bisect(g[np.ix_(rows, rows)], rng)
        part = new
    return part


class Router:
    """Softmax classifier over the parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, parts, hidden = (x - self.mean) / self.scale, target.shape[1], 64
        p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, parts)), np.zeros(parts)]
        m, s, t = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 128):
                b = order[i:i + 128]
                a = np.maximum(z[b] @ p[0] + p[1], 0)
                g = (self._soft(a @ p[2] + p[3]) - target[b]) / len(b)
                back = (g @ p[2].T) * (a > 0)
                t += 1
                for n, d in enumerate((z[b].T @ back, back.sum(0), a.T @ g, g.sum(0))):
                    m[n], s[n] = 0.9 * m[n] + 0.1 * d, 0.999 * s[n] + 0.001 * d * d
                    p[n] = p[n] - 0.005 * (m[n] / (1 - 0.9 ** t)) / (np.sqrt(s[n] / (1 - 0.999 ** t)) + 1e-8)
        self.p = p

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a = np.maximum(((x - self.mean) / self.scale) @ self.p[0] + self.p[1], 0)
        return self._soft(a @ self.p[2] + self.p[3])


def fit(vectors: DataFrame, rows: int, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, degree: int = 20) -> Router | None:
    """Router learned on the sample; the number of parts is a power of two that follows the row count."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    x = np.array([r.v for r in got], float)
    levels = max(0, int(np.ceil(np.log2(max(1, rows / part_rows)))))
    levels = min(levels, max(0, int(np.log2(max(1, len(x) // (2 * degree))))))  # a part of the sample keeps some neighbours
    if levels == 0:
        return None
    g = neighbour_graph(x, degree)
    part = balanced_parts(g, levels)
    near = g @ np.eye(1 << levels)[part] + np.eye(1 << levels)[part]
    return Router(x, near / near.sum(axis=1, keepdims=True))


def search(vectors: DataFrame, is_query, k: int = 20, probes: int = 4, mass: float = 0.97, sample_rows: int = SAMPLE_ROWS,
           part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows on which ``is_query`` (a condition on vec_id) holds."""
    reachable(vectors.sparkSession)
    rows = materialize(usable(vectors), "vectors")
    router = fit(rows, rows.count(), sample_rows, part_rows)

    def place(batches):
        for df in batches:
            x = np.stack(df["v"].to_numpy()).astype(float) if len(df) else np.zeros((0, 1))
            df["part"] = router(x).argmax(axis=1) if router is not None and len(df) else 0
            yield df[["part", "vec_id", "v"]]

    kind = rows.schema["v"].dataType.simpleString()
    indexed = materialize(rows.mapInPandas(place, f"part long, vec_id long, v {kind}"), "indexed")
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # one row per part
    parts = 1 if router is None else router.p[3].shape[0]
    held = np.array([sizes.get(p, 0) for p in range(parts)])
    blocks = np.maximum(1, -(-held // block_rows))

    def route(batches):
        for df in batches:
            x = np.stack(df["v"].to_numpy()).astype(float) if len(df) else np.zeros((0, 1))
            p = router(x) if router is not None and len(df) else np.ones((len(df), parts))
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
            found = np.cumsum(held[order], axis=1) - held[order]
            visit = (before < mass) | (np.arange(parts) < probes) | (found <= k)
            i, j = np.nonzero(visit)
            out = df.iloc[i][["vec_id", "v"]].reset_index(drop=True)
            out["part"], out["turn"] = order[i, j], j
            yield out[["part", "turn", "vec_id", "v"]]

    asked = materialize(rows.where(is_query).mapInPandas(route, f"part long, turn long, vec_id long, v {kind}"), "asked")
    visitors = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    groups = np.array([max(1, -(-visitors.get(p, 0) // query_rows)) for p in range(parts)])
    lookup = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("part").cast("int"))
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), n.cast("long"))
    base = indexed.withColumn("block", salt(lookup(blocks))).withColumn("ask", F.explode(F.sequence(F.lit(0), (lookup(groups) - 1).cast("int"))))
    ask = asked.withColumn("ask", F.pmod(F.hash("vec_id"), lookup(groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), (lookup(blocks) - 1).cast("long"))))

    def best(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(b) and len(q):
            b = b.sort_values("vec_id").drop_duplicates("vec_id")
            ids, x = b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()).astype(float)
            for at in range(0, len(q), 256):
                some = q.iloc[at:at + 256]
                y, floor = np.stack(some["v"].to_numpy()).astype(float), some["floor"].fillna(-np.inf).to_numpy()
                rough = y @ x.T
                size = np.abs(y) @ np.abs(x).max(axis=0) * 1e-12
                for own, vec, line, slack, known in zip(some["vec_id"], y, rough, size, floor):
                    line[ids == own] = -np.inf
                    low = max(known, np.partition(line, -k)[-k] if len(line) > k else -np.inf)
                    near = np.flatnonzero((line >= low - slack) & (line > -np.inf))
                    exact = (x[near] * vec).sum(axis=1)  # same order of sums for every row, so ties are ties
                    top = np.lexsort((ids[near], -exact))[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][top], "score": exact[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def visits(some: DataFrame) -> DataFrame:
        return base.groupBy("part", "block", "ask").cogroup(some.groupBy("part", "block", "ask")).applyInPandas(best, "query_id long, vec_id long, score double")

    # The most probable part comes first; the others return only what its k-th score does not beat.
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    home = materialize(visits(ask.where("turn = 0").withColumn("floor", F.lit(None).cast("double"))).distinct()
                       .withColumn("r", ranked).where(F.col("r") <= k), "home")
    floors = home.where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    near = home.select("query_id", "vec_id", "score").union(visits(ask.where("turn > 0").join(floors, "vec_id", "left")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
