"""Secret scans: a character convolutional network over every candidate and its context.

Three exact kinds (assign, access, hex) are found by pattern and always kept.
Every other candidate, a run of 16 or more key characters,
is read by a small convolutional network in numpy: characters are embedded,
convolved, max-pooled over the candidate and the text around it, and scored.
A candidate longer than one window is read in windows that cover all of it.

The network is fitted on all labelled findings, all windows of each: exact findings are positive, other candidates
negative, save runs with digits that look random: those may be keys of no exact kind.  Half of the positives are shown without their
context, so that the key name alone cannot decide.  Equal views are folded and weighted by their number.  Three quarters
of them, by hash, are dealt over shards; in each epoch every shard makes its steps from the same state, and the mean of the
shards' states is where the next epoch starts.  The last quarter is for calibration: scores are calibrated by
Platt scaling; the threshold is the largest that keeps the wanted recall on all findings of that part.

Defined results: null and empty texts have no spans; spans are in code points,
end exclusive, ordered by start and then kind; repeated rows repeat; with no
labelled finding of one class nothing is added to the exact spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.ordering import running_totals

from .common import map_batches, materialize

# The three exact kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

LONG = re.compile(r"\S{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
CHANGE = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])")
BEFORE, WIDTH, AFTER = 20, 40, 4


def exact_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three exact kinds, in order."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters outside the exact spans."""
    out = []
    for m in LONG.finditer(text):
        for r in RUN.finditer(text, m.start(), m.end()):
            if not any(a < r.end() and r.start() < b for a, _, b in taken):
                out.append(r.span())
    return out


def random_looking(run: str) -> bool:
    """A digit stands in the run, and at least a fifth of its places change between lower case, upper case and digits."""
    return bool(DIGIT.search(run)) and 5 * len(CHANGE.findall(run)) >= len(run)


def windows(text: str, start: int, end: int, context: bool = True) -> list[str]:
    """Fixed-width views that together cover the candidate and what stands around it."""
    out = []
    for at in range(start, end, WIDTH):
        stop = min(end, at + WIDTH)
        left = text[max(0, at - BEFORE):at] if context else ""
        right = text[stop:stop + AFTER] if context else ""
        out.append(left.rjust(BEFORE, "\0") + text[at:stop].ljust(WIDTH, "\0") + right.ljust(AFTER, "\0"))
    return out


def codes(views: list[str]) -> np.ndarray:
    """Character ids: 0 padding, 1-95 printable ASCII, 96 white space, 97 the rest."""
    flat = np.array([ord(c) for v in views for c in v], np.int64).reshape(len(views), BEFORE + WIDTH + AFTER)
    out = np.full(flat.shape, 97, np.int64)
    out[(flat > 32) & (flat < 127)] = flat[(flat > 32) & (flat < 127)] - 31
    out[np.isin(flat, (9, 10, 11, 12, 13, 32))] = 96
    out[flat == 0] = 0
    return out


@dataclass
class Network:
    """Embedding, one convolution, max pooling, one linear layer, Platt numbers and threshold."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def forward(self, x: np.ndarray):
        k, d, f = self.conv.shape
        e = self.emb[x]
        cols = np.concatenate([e[:, i:e.shape[1] - k + 1 + i] for i in range(k)], axis=2)
        a = cols @ self.conv.reshape(k * d, f) + self.bias
        at = a.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(a, at[:, None], axis=1)[:, 0], 0)
        return cols, at, pooled, pooled @ self.out + self.last

    def logits(self, views: list[str]) -> np.ndarray:
        got = [self.forward(codes(views[i:i + 512]))[3] for i in range(0, len(views), 512)]
        return np.concatenate(got) if got else np.zeros(0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def start(dim: int, filters: int, width: int, rng: np.random.Generator) -> np.ndarray:
    """State of the fit: parameters, Adam's two moments, and the number of steps."""
    first = np.concatenate([rng.normal(0, 0.3, 98 * dim), rng.normal(0, 0.2, width * dim * filters), np.zeros(filters), rng.normal(0, 0.2, filters), [0.0]])
    return np.concatenate([first, np.zeros(2 * len(first) + 1)])


def network(state: np.ndarray, dim: int, filters: int, width: int) -> Network:
    emb, conv, bias, out, last = np.split(state[:len(state) // 3], np.cumsum([98 * dim, width * dim * filters, filters, filters]))
    return Network(emb.reshape(98, dim), conv.reshape(width, dim, filters), bias, out, float(last[0]))


def epoch(state: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """One pass of Adam on the weighted logistic loss."""
    dim, filters, width = shape
    (params, m1, m2), step = np.split(state[:-1], 3), state[-1]
    for i in range(0, len(order), 64):
        part, net = order[i:i + 64], network(np.append(np.concatenate([params, m1, m2]), step), *shape)
        cols, at, pooled, z = net.forward(x[part])
        g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / weight[part].sum()
        gp = g[:, None] * net.out * (pooled > 0)
        picked = cols[np.arange(len(part))[:, None], at]  # rows, filters, width * dim
        gconv = np.einsum("nf,nfc->cf", gp, picked)
        gcols = gp[:, :, None] * net.conv.reshape(-1, filters).T[None]
        gemb = np.zeros_like(net.emb)
        for j in range(width):
            np.add.at(gemb, x[part][np.arange(len(part))[:, None], at + j], gcols[:, :, j * dim:(j + 1) * dim])
        grad = np.concatenate([gemb.ravel(), gconv.ravel(), gp.sum(0), pooled.T @ g, [g.sum()]])
        step += 1
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        params = params - 0.01 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return np.concatenate([params, m1, m2, [step]])


def moments(z: np.ndarray, t: np.ndarray, weight: np.ndarray, scale: float, shift: float) -> np.ndarray:
    """Sums over findings of one, the loss, its gradient and its curvature in scale and shift."""
    u = np.clip(scale * z + shift, -30, 30)
    p = 1 / (1 + np.exp(-u))
    g, h = weight * (p - t), weight * p * (1 - p)
    return np.array([weight.sum(), (weight * (np.logaddexp(0, u) - t * u)).sum(), (g * z).sum(), g.sum(), (h * z * z).sum(), (h * z).sum(), h.sum()])


def platt(sums) -> tuple[float, float]:
    """Scale and shift of least logistic loss, the scale drawn weakly to 1; ``sums(scale, shift)`` gives the moments of all findings."""

    def at(point):
        n, loss, ga, gc, haa, hac, hcc = sums(*point)
        return (loss / n + 5e-4 * (point[0] - 1) ** 2, np.array([ga / n + 1e-3 * (point[0] - 1), gc / n]),
                np.array([[haa / n + 1e-3, hac / n], [hac / n, hcc / n + 1e-9]]))

    point = np.array([1.0, 0.0])
    loss, grad, curve = at(point)
    for _ in range(30):
        move = np.linalg.solve(curve, grad)
        if np.abs(move).max() < 1e-6:
            break
        while (new := at(point - move))[0] > loss and np.abs(move).max() >= 1e-6:
            move = move / 4
        point, (loss, grad, curve) = point - move, new
    return max(float(point[0]), 1e-3), float(point[1])


def fit(rows: list[tuple[str, int]], dim: int = 8, filters: int = 32, width: int = 5, epochs: int = 8, recall: float = 0.98,
        seed: int = 7) -> Network:
    """The network of rows at hand: Adam on the logistic loss; every fourth row is kept back for calibration and threshold."""
    rng, shape = np.random.default_rng(seed), (dim, filters, width)
    state = start(*shape, rng)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fitted, kept = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
    if len({y for _, y in fitted}) < 2 or len({y for _, y in kept}) < 2:
        return network(state, *shape)  # threshold above 1: nothing is added
    x, y = codes([v for v, _ in fitted]), np.array([t for _, t in fitted], float)
    for _ in range(epochs):
        state = epoch(state, x, y, np.ones(len(x)), rng.permutation(len(x)), shape)
    net = network(state, *shape)
    z, t = net.logits([v for v, _ in kept]), np.array([t for _, t in kept], float)
    net.scale, net.shift = platt(lambda a, c: moments(z, t, np.ones(len(z)), a, c))
    positive = np.sort(net.probability(z[t == 1]))
    net.threshold = float(positive[int(np.floor((1 - recall) * len(positive)))])
    return net


def labelled_views(docs: DataFrame) -> DataFrame:
    """(view, label, hash) of every window of every labelled finding."""

    def run(texts):
        out = {"view": [], "y": [], "key": []}
        for text in texts:
            if not text:
                continue
            taken = exact_spans(text)
            for n, (a, kind, b) in enumerate(taken):
                at = ASSIGN.match(text, a).start(2) if kind == 0 else a
                out["view"] += (v := windows(text, at, b, n % 2 == 0))
                out["y"] += [1] * len(v)
            for a, b in candidates(text, taken):
                if not random_looking(text[a:b]):
                    out["view"] += (v := windows(text, a, b))
                    out["y"] += [0] * len(v)
        out["key"] = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=7).digest(), "little") for v in out["view"]]
        return out

    return map_batches(docs.select(F.col("text").cast("string")), run, "view string, y int, key long")


def train(docs: DataFrame, max_rows: int = 3000, dim: int = 8, filters: int = 32, width: int = 5, epochs: int = 8, recall: float = 0.98,
          seed: int = 7) -> Network:
    """Fit on all labelled findings; a shard holds about ``max_rows`` different views of the commoner class."""
    shape = (dim, filters, width)
    state = start(*shape, np.random.default_rng(seed))
    views = materialize(labelled_views(docs).groupBy("key", "view", "y").agg(F.count("*").alias("n")), "secret-views")
    held = F.col("key").bitwiseAND(3) == 0
    sizes = {(r.held, r.y): r["count"] for r in views.groupBy(held.alias("held"), "y").count().collect()}
    if len(sizes) < 4:
        return network(state, *shape)  # threshold above 1: nothing is added
    shards = max(1, max(sizes[False, 0], sizes[False, 1]) // max_rows)
    fitted = views.where(~held).withColumn("shard", F.pmod(F.shiftright("key", 2), F.lit(shards))).repartition(shards, "shard")
    for turn in range(epochs):
        state = _turn(fitted, state, turn, seed, shape)
    net = network(state, *shape)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(net.logits(b.column(0).to_pylist())), b.column(1), b.column(2)], ["z", "y", "n"])

    kept = materialize(views.where(held).select("view", "y", "n").mapInArrow(measure, "z double, y int, n long"), "secret-logits")
    net.scale, net.shift = platt(lambda a, c: _moments(kept, a, c))
    # The smallest logit that enough findings reach.
    found = running_totals(kept.where("y = 1").groupBy("z").agg(F.sum("n").alias("n")), [], ["z"], {"before": "n"})
    skipped = math.floor((1 - recall) * found.agg(F.sum("n")).first()[0])
    net.threshold = float(net.probability(np.array(found.where((F.col("before") <= skipped) & (F.col("before") + F.col("n") > skipped)).first()["z"])))
    return net


def _turn(fitted: DataFrame, state: np.ndarray, turn: int, seed: int, shape: tuple[int, int, int]) -> np.ndarray:
    """The mean of the states that the shards reach in one epoch from the same start, weighted by their views."""

    def run(shard: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("view", "ascending"), ("y", "ascending")])
        n, y = part.column("n").to_numpy().astype(float), part.column("y").to_numpy().astype(float)
        order = np.random.default_rng([seed, turn, shard[0].as_py()]).permutation(len(n))
        got = epoch(state, codes(part.column("view").to_pylist()), y, n, order, shape)
        return pa.table({"at": pa.array(np.arange(len(got)), pa.int32()), "v": got * len(n), "rows": np.full(len(got), len(n), np.int64)})

    # Sums of decimals do not depend on the order of the shards.
    mean = F.sum(F.col("v").cast("decimal(38,18)")).cast("double") / F.sum("rows")
    rows = fitted.groupBy("shard").applyInArrow(run, "at int, v double, rows long").groupBy("at").agg(mean.alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["at"])])


def _moments(kept: DataFrame, scale: float, shift: float) -> np.ndarray:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, y, n = (b.column(k).to_numpy().astype(float) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([moments(z, y, n, scale, shift)])], ["m"])

    return np.sum([r.m for r in kept.mapInArrow(run, "m array<double>").collect()], axis=0)


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document with all its spans and the network's probability for the added ones."""

    def run(ids, texts):
        spans, views, owner = [], [], []
        for i, text in enumerate(texts):
            taken = exact_spans(text) if text else []
            spans.append([(a, k, b, 1.0) for a, k, b in taken])
            for a, b in candidates(text, taken) if text else []:
                for v in windows(text, a, b):
                    views.append(v)
                    owner.append((i, a, b))
        best: dict = {}
        for key, p in zip(owner, net.probability(net.logits(views))):
            best[key] = max(p, best.get(key, 0.0))
        for (i, a, b), p in best.items():
            if p >= net.threshold:
                spans[i].append((a, 3, b, float(p)))
        return {"doc_id": ids, "spans": [[{"kind": KINDS[k], "start": a, "end": b, "p": p} for a, k, b, p in sorted(s)] for s in spans]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                       "doc_id long, spans array<struct<kind:string,start:long,end:long,p:double>>")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "cnn")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                          F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
