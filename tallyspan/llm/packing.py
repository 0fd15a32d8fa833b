"""Best-fit packing of tokenized documents into sequences under several capacities at once.

Every document becomes token ids; only documents longer than the token
capacity are cut.  A piece is a vector (tokens, documents, attention cost); a
sequence has a residual in each.  Pieces are dealt into shards of
``shard_rows`` rows; each shard is one task of bounded memory and packs its
pieces in decreasing order, each into the open sequence that can take it under
every capacity and is best by the smallest weighted residual norm (``measure="norm"``)
or the largest weighted dot product (``measure="dot"``).  A shard leaves
a few sequences that are not full, so with tens of thousands of pieces in a
shard the loss against one global packing is far below a percent.

Defined results: a null or empty text is the end id alone; repeated rows are
packed as often as they stand there; ties go to the sequence opened first; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, materialize

END = 1
SHARD_ROWS = 25_000
_PUNCTUATION = string.punctuation.encode()
_END_BYTES = np.array([END], "<u4").tobytes()
_MEMO_WORDS, _MEMO_PARTS = 1_000_000, 300_000
_memo: dict[str, dict] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stays_letters(word: bytes) -> bool:
    return word.isalpha() or (not word.isascii() and word.decode().isalpha() and unicodedata.normalize("NFC", word.decode()).lower().isalpha())


class WordIds:
    """Ids of a text by way of its white-space separated parts.

    The tokenizer composes and lower-cases, drops white space and never merges across it, so
    the ids of a text are those of its parts in turn; nor does it merge letters
    with the punctuation behind them, so most parts are a known word and a known
    ending.  A word counts as letters only if it still is after both changes: capital I with dot
    becomes two signs, the second of which would join the punctuation.
    Bounded memos hold the packed ids of parts this worker has seen.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.parts, self.older, self.cores = Tokenizer.from_file(path), {}, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _memo:
            _memo[path] = cls(path)
        return _memo[path]

    def encode(self, part: bytes) -> bytes:
        return np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, new: list[bytes]) -> None:
        """Fill the memo of words; words of letters alone are encoded as one text and cut at word-end tokens."""
        if len(self.cores) > _MEMO_WORDS:
            self.cores.clear()
        ids = np.array(self.tokenizer.encode(b" ".join(new).decode(), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(new) and (not len(ids) or ends[-1] == len(ids)):
            raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
            self.cores.update(zip(new, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
        else:
            self.cores.update((w, self.encode(w)) for w in new)

    def learn(self, parts: set[bytes]) -> None:
        split, other = [], []
        for p in parts:
            word = p.rstrip(_PUNCTUATION)
            if word and stays_letters(word):  # letters, then perhaps an ending
                split.append((p, word.lower(), p[len(word):]))
            else:
                other.append(p)
        cores = self.cores
        self.words(list({w for _, w, _ in split if w not in cores}))
        for _, _, end in split:
            if end not in cores:
                cores[end] = self.encode(end) if end else b""
        for p, word, end in split:
            if word not in cores:
                self.words([word])
            self.parts[p] = cores[word] + cores[end] if end else cores[word]
        for p in other:
            self.parts[p] = self.encode(p)

    def __call__(self, text: bytes | None) -> np.ndarray:
        parts = text.split() if text else []
        if len(self.parts) > _MEMO_PARTS:  # parts in use move on from the older memo, the others go with it
            self.older, self.parts = self.parts, {}
        memo, older = self.parts, self.older
        new = set(parts).difference(memo)
        if new:
            if older:
                seen = {p: older[p] for p in new if p in older}
                memo.update(seen)
                new.difference_update(seen)
            self.learn(new)
        return np.frombuffer(b"".join(map(memo.__getitem__, parts)) + _END_BYTES, "<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    path = tokenizer or default_tokenizer()

    def run(ids, texts):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        encode = WordIds.of(path)
        for i, text in zip(ids, texts):
            tokens = encode(text)
            for n, at in enumerate(range(0, len(tokens), capacity)):
                part = tokens[at:at + capacity]
                for k, v in zip(out, (i, n, at, len(part), zlib.crc32(part.tobytes()))):
                    out[k].append(v)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), as_bytes().alias("text")), run,
                       "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: np.ndarray, capacity: np.ndarray, weights: np.ndarray, measure: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, tokens before) for each row of ``items``, whose first column is tokens.

    An item beyond a capacity gets a sequence of its own.
    """
    share = items / capacity
    order = np.lexsort((np.arange(len(items)), -share.max(axis=1), -share[:, 0]))
    which, before, used = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), np.zeros(len(items) + 1, np.int64)
    smallest = np.minimum.accumulate(share[order][::-1], axis=0)[::-1] if len(items) else share
    # One array for each capacity holds what is left in the open sequences, in the order they were opened.
    left, ids = [np.empty(1024) for _ in range(items.shape[1])], np.empty(1024, np.int64)
    live = made = 0
    for k, i in enumerate(order):
        v = share[i]
        if k % 256 == 0:  # sequences that nothing to come can enter
            stay = np.ones(live, bool)
            for room, least in zip(left, smallest[k]):
                stay &= room[:live] + 1e-12 >= least
            for x in (*left, ids):
                x[:stay.sum()] = x[:live][stay]
            live = int(stay.sum())
        fits = left[0][:live] + 1e-12 >= v[0]
        for room, x in zip(left[1:], v[1:]):
            fits &= room[:live] + 1e-12 >= x
        able = np.flatnonzero(fits)
        if len(able):
            rooms = [room[able] for room in left]
            value = sum(w * (room - x) ** 2 if measure == "norm" else -w * room * x for w, room, x in zip(weights, rooms, v))
            at = able[np.argmin(value)]
        else:
            if live == len(ids):
                left, ids = [np.concatenate((x, np.empty(live))) for x in left], np.concatenate((ids, np.empty(live, np.int64)))
            at, ids[live] = live, made
            for room in left:
                room[live] = 1.0
            live, made = live + 1, made + 1
        for room, x in zip(left, v):
            room[at] -= x
        which[i], before[i] = ids[at], used[ids[at]]
        used[ids[at]] += int(items[i, 0])
    return which, before


def pack(parts: DataFrame, capacities: dict[str, float], weights: dict[str, float] | None = None, measure: str = "norm",
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; the first capacity is that of the offset (tokens).

    ``parts`` has one column per capacity.  It should be a written table: the shard of
    a row is taken from its place in the files.
    """
    names = list(capacities)
    shards = max(1, -(-parts.count() // shard_rows))
    cap = np.array([capacities[n] for n in names], float)
    w = np.array([(weights or {}).get(n, 1.0) for n in names], float)
    dealt = parts.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    fields = [f for f in parts.schema.fields]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        which, before = best_fit(group[names].to_numpy(float), cap, w, measure)
        group["sequence_id"] = (int(group["__shard"].iloc[0]) << 32) + which
        group["offset"] = before
        return group.drop(columns="__shard")

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["sequence_id long", "offset long"])
    return dealt.groupBy("__shard").applyInPandas(run, ddl)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, max_documents: int | None = None,
                   max_cost: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Tokenize, cut and pack; without the other two limits only the token capacity can bind."""
    parts = materialize(pieces(docs, tokenizer, capacity), "pieces")
    vectors = parts.withColumns({"documents": F.lit(1), "cost": F.col("length") * F.col("length")})
    caps = {"length": capacity, "documents": max_documents or capacity, "cost": max_cost or float(capacity) ** 2}
    packed = pack(vectors, caps, {"length": 1.0, "documents": 0.01, "cost": 0.01}, shard_rows=shard_rows)
    return packed.drop("documents", "cost")
