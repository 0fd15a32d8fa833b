"""Quality rules: base counts of a text, and how far its histograms lie from its language.

A language reference is read from the documents themselves: the share of each character
class and the shares of the commonest words of every ``lang``.  A document is rejected
where the Jensen-Shannon distance (base 2, 0 to 1) of one of its two histograms from the
reference of its own language is above a limit.  Short texts give rough histograms, so a
histogram is only judged from a minimum length on; the base rule works at every length.
Counts cover every document with at least ``min_words`` words.

Defined results on odd input: a null text is an empty one; a null ``lang`` is a language of its own; a
language whose documents hold fewer than ``min_reference`` words has no reference and its documents are
judged by the base rule alone; equal counts of reference words are ordered by the word; repeated rows each
give a row and each count; an empty table gives an empty result; further columns are ignored, whatever
they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, arrow_schema, as_bytes, materialize, reachable, space_words

COMMON = 100  # reference words of a language
MIN_WORDS = 50  # shorter texts are not judged by their words, nor counted for a reference
MIN_CHARS = 200  # shorter texts are not judged by their characters
MIN_REFERENCE = 2_000  # words that make a reference
MAX_WORDS_DISTANCE, MAX_CLASS_DISTANCE = 0.55, 0.30
REPEAT, MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
BROADCAST_LANGUAGES = 1_000  # references handed to every task: at most this many, of a few kilobytes each
PENDING = 500_000  # counters a task holds before it passes them on

SYMBOLS = list(b"#*$%&|<>")
WHITE = list(b" \t\n\v\f\r")
CLASSES = ("lower", "upper", "digit", "white", "sentence", "symbol", "latin", "script", "astral", "control")


def _class_of_bytes() -> np.ndarray:
    """One row for each byte: a code point counts in the class of its first byte; continuation bytes count nowhere."""
    out = np.zeros((256, len(CLASSES)), np.int64)
    for b in range(256):
        if b in WHITE:
            kind = "white"
        elif b < 0x20 or b == 0x7F:
            kind = "control"
        elif b < 0x80:
            c = chr(b)
            kind = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "sentence" if c in ".,;:!?'\"()-" else "symbol"
        elif b < 0xC0:
            continue
        else:  # C2: Latin-1 signs; to C9: Latin letters with marks; to EF: other scripts; from F0: beyond the first plane
            kind = "symbol" if b <= 0xC2 else "latin" if b <= 0xC9 else "script" if b <= 0xEF else "astral"
        out[b, CLASSES.index(kind)] = 1
    return out


CLASS_OF_BYTES = _class_of_bytes()


def repeated_words(words: list[bytes], size: int = REPEAT) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first one included.

    Runs of one, two, four ... words get exact numbers, each from a pair of numbers of the length before.
    """
    if len(words) <= size:
        return 0
    ids: dict[bytes, int] = {}
    rank, width = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)), 1
    count = np.bincount(rank)
    while width < size:
        step = min(width, size - width)  # windows of width + step words, as two runs that may overlap
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
        width += step
        if len(count) == len(pairs):
            return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[rank] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms with a positive sum."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return float(np.sqrt(max(0.0, (np.dot(p[a], np.log2(p[a] / m[a])) + np.dot(q[b], np.log2(q[b] / m[b]))) / 2)))


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASS_OF_BYTES


def _counters(docs: DataFrame, min_words: int) -> DataFrame:
    """(lang, word or null, class number, n): words and character classes counted in the tasks."""
    ddl = "lang string, word binary, class int, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        kinds: dict[str | None, np.ndarray] = {}

        def pass_on() -> pa.RecordBatch:
            rows = [(lang, w, None, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, None, k, int(n)) for lang, c in kinds.items() for k, n in enumerate(c)]
            words.clear(), kinds.clear()
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                found = alnum_words(text)
                if len(found) < min_words:
                    continue
                words.setdefault(lang, Counter()).update(found)
                kinds[lang] = kinds.get(lang, 0) + class_counts(text)
                if sum(map(len, words.values())) > PENDING:
                    yield pass_on()
        yield pass_on()

    reachable(docs.sparkSession)
    return docs.select(F.col("lang").cast("string"), as_bytes().alias("text")).mapInArrow(run, ddl)


def references(docs: DataFrame, common: int = COMMON, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """(lang, total, words, counts, classes): the commonest words of each language and its character classes."""
    counts = materialize(_counters(docs, min_words).groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "language-counts")
    top = counts.where("word IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= common)
    words = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    kinds = counts.where("class IS NOT NULL").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("class", "n"))).alias("kinds"))
    total = counts.where("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_reference)
    same = lambda other: F.col("t.lang").eqNullSafe(F.col(f"{other}.lang"))
    return materialize(total.alias("t").join(words.alias("w"), same("w")).join(kinds.alias("c"), same("c")).select(
        "t.lang", "total", F.col("top.word").alias("words"), F.col("top.n").alias("counts"), F.col("kinds.n").alias("classes")), "language-references")


class Reference:
    """Histograms of one language."""

    def __init__(self, total, words, counts, classes):
        self.place = {w: k for k, w in enumerate(words)}
        self.words = np.array([*counts, total - sum(counts)], float)
        self.classes = np.array(classes, float)

    def word_distance(self, found: list[bytes]) -> float:
        mine = np.zeros(len(self.words))
        for w, n in Counter(found).items():
            mine[self.place.get(w, -1)] += n
        return distance(mine, self.words)


def assess(docs: DataFrame, refs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, max_words: float = MAX_WORDS_DISTANCE,
           max_classes: float = MAX_CLASS_DISTANCE, broadcast_languages: int = BROADCAST_LANGUAGES) -> DataFrame:
    """The columns of ``digest`` for every document, judged by the references of ``references``.

    Up to ``broadcast_languages`` references go to every task; more of them are joined to the documents by language.
    """
    names = ("total", "words", "counts", "classes")
    few = refs.limit(broadcast_languages + 1).collect()
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), as_bytes().alias("text"))
    if len(few) <= broadcast_languages:
        known = {r.lang: tuple(r[n] for n in names) for r in few}
    else:
        known = None
        rows = rows.alias("d").join(refs.alias("r"), F.col("d.lang").eqNullSafe(F.col("r.lang")), "left").select("d.*", *names)
    ddl = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "word_distance double, class_distance double, base_failed boolean, kept boolean")
    schema = arrow_schema(ddl)

    def judge(doc_id, text: bytes, ref: Reference | None) -> tuple:
        by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = space_words(text)
        repeats, chars = repeated_words(words), by_byte[:0x80].sum() + by_byte[0xC0:].sum()
        base = len(words) < MIN_BASE_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
        found = alnum_words(text) if ref else []
        by_word = ref.word_distance(found) if ref and len(found) >= min_words else None
        by_class = distance((by_byte @ CLASS_OF_BYTES).astype(float), ref.classes) if ref and chars >= max(min_chars, 1) else None
        far = (by_word is not None and by_word > max_words) or (by_class is not None and by_class > max_classes)
        return (doc_id, len(words), int(chars - by_byte[WHITE].sum()), int(by_byte[SYMBOLS].sum()), duplicate_lines(text), repeats,
                by_word, by_class, base, not base and not far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str | None, Reference | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, out = batch.slice(at, 1024), []
                for k, (doc_id, lang, text) in enumerate(zip(*[part.column(i).to_pylist() for i in range(3)])):
                    if lang not in made:
                        raw = known.get(lang) if known is not None else tuple(part.column(i)[k].as_py() for i in range(3, 7))
                        made[lang] = Reference(*raw) if raw and raw[0] is not None else None
                    out.append(judge(doc_id, text or b"", made[lang]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def digest(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of every document, with the references of these documents."""
    return assess(docs, references(docs))
