"""Quality rules, conversation repair and spelling variants against plain Python, and their results on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from tallyspan.llm import conversations, quality, spelling

from .test_operators import ALNUM, SCHEMA, SPACE, corpus, got, table, words

TALK = "conv_id long, turn long, role string, text string"


# ---- 11

def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def plain_classes(text):
    out = [0] * 10
    for c in text:
        o = ord(c)
        k = (3 if c in " \t\n\v\f\r" else 9 if o < 32 or o == 127 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9"
             else 4 if c in ".,;:!?'\"()-" else 5 if o < 0xC0 else 6 if o < 0x280 else 7 if o < 0x10000 else 8)
        out[k] += 1
    return out


def plain_quality(rows, common, min_words, min_chars, min_reference, far_words, far_classes):
    count, kinds = defaultdict(Counter), defaultdict(lambda: [0] * 10)
    for r in rows:
        if len(f := words(r[1], ALNUM, lower=True)) >= min_words:
            count[r[2]].update(f)
            kinds[r[2]] = [a + b for a, b in zip(kinds[r[2]], plain_classes(r[1]))]
    out = []
    for doc_id, text, lang, *_ in rows:
        t, w = text or "", words(text)
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = len({p for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)})
        lines = [x for x in t.split("\n") if words(x)]
        base = len(w) < 20 or 100 * again > 30 * len(w)
        far, f, total = False, words(text, ALNUM, lower=True), sum(count[lang].values())
        if total >= min_reference:
            top = sorted(count[lang].items(), key=lambda x: (-x[1], x[0]))[:common]
            if len(f) >= min_words:
                mine = Counter(f)
                mine = [mine[x] for x, _ in top] + [len(f) - sum(mine[x] for x, _ in top)]
                far |= plain_distance(mine, [n for _, n in top] + [total - sum(n for _, n in top)]) > far_words
            if len(t) >= min_chars:
                far |= plain_distance(plain_classes(t), kinds[lang]) > far_classes
        out.append((doc_id, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, base, not base and not far))
    return out


@pytest.mark.parametrize("broadcast", [1000, 1])
def test_quality(spark, broadcast):
    rng = random.Random(11)
    rows = corpus(seed=11, n=80, vocabulary=60, size=120)
    rows = [(d, t, rng.choice(["en", "de", None]) if t and len(t) < 5000 else lang, s, n) for d, t, lang, s, n in rows]
    rows += [(800 + i, " ".join(rng.choice(["##a", "$$B", "%%"]) for _ in range(90)), "en", "", 0) for i in range(3)]
    rows += [(810, "LOUD " * 40 + " ".join(f"w{i}" for i in range(200)), "en", "", 0), (811, "one text of a rare language " * 9, "xx", "", 0), (812, "日本語 한글 😀 ß \x01 \x7f " * 30, "en", "", 0)]
    rows += [(820, "a b c d e f g h " * 2 + " ".join(map(str, range(60))), "en", "", 0), (821, "same line\nsame line\n\n\nother\nsame line", "de", "", 0)]
    docs, options = table(spark, rows), (0.5, 0.3)
    out = quality.assess(docs, quality.references(docs, 20, 30, 200), 30, 60, *options, broadcast)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = plain_quality(rows, 20, 30, 60, 200, *options)
    assert got(out, *columns) == sorted(want, key=repr)
    assert 0 < sum(r[7] for r in want) < sum(not r[6] for r in want)  # both verdicts beyond the base rule


def test_repeated_words_are_exact():
    rng = random.Random(4)
    for size in (1, 2, 3, 5, 8):
        for _ in range(60):
            w = [rng.choice([b"a", b"b", b"c"][:rng.choice([2, 3])]) if rng.random() > 0.2 else str(rng.random()).encode() for _ in range(rng.randrange(40))]
            grams = Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
            want = len({p for i in range(len(w) - size + 1) if grams[tuple(w[i:i + size])] > 1 for p in range(i, i + size)})
            assert quality.repeated_words(w, size) == want


# ---- 12

def plain_damage(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv] += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in by.items()}


def plain_repair(rows):
    """(cost, audit, hash) by trying every edit of every row with up to two insertions before each and at the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        w = words(text)
        faults.append("blank" if not w else "duplicate" if (role, text) in seen else "" if w[-1][-1:] in (b".", b"!", b"?") else "truncated")
        seen.add((role, text))
    best = None
    for edits in product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        for gaps in product(range(3), repeat=len(rows) + 1):
            cost, audit, lines, initials = 0, "", [], ""
            for k in range(len(rows) + 1):
                for _ in range(gaps[k]):
                    name = "assistant" if initials[-1:] == "u" else "user"
                    cost, audit, initials = cost + 3, audit + "I", initials + name[0]
                    lines.append(name + ":")
                if k < len(rows):
                    role, text = rows[k][1:]
                    audit += edits[k]
                    if edits[k] == "D":
                        cost += 4
                        continue
                    name = role if edits[k] == "K" else "assistant" if initials[-1:] == "u" else "user"
                    cost += 3 * (edits[k] == "R") + 3 * (faults[k] == "truncated")
                    initials += name[:1] or "-"
                    lines.append(f"{name}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return best, faults


def plain_row(conv, rows):
    (cost, audit, digest), faults = plain_repair(rows)
    turns, pairs = {r[0] for r in rows} - {None}, list(zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, digest)


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [64, 1])
def test_conversations(spark, block):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "Why? \n", "cut off", "", "  \t", "é.", "Dr.x"]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", "system", "tool", "ua", "", None]) if rng.random() < 0.5 else ["user", "assistant"][t % 2],
             rng.choice(texts) if rng.random() > 0.05 else None) for c in range(30) for t in range(rng.randrange(1, 5))]
    rows += [(None, 0, "user", "Null id."), (None, 1, "assistant", "Still.")] + [(90, None, "user", "same.")] * 2 + [(91, -5, "system", "s."), (91, 9, "user", "x.")]
    rows += [r for r in rows if r[0] == 3]  # repeated rows
    by = plain_damage(rows)
    by = {c: r[:5] for c, r in by.items() if len(r) <= 4}  # the plain search is exponential
    want = [plain_row(c, r) for c, r in by.items()]
    out = conversations.repair(conversations.damage(spark.createDataFrame([r for r in rows if r[0] in by], TALK).repartition(3)), block)
    assert got(out, *RESULT) == sorted(want, key=repr)
    assert any(r[7] == "" for r in want)


def test_long_conversations_go_by_blocks():
    """Any block size gives the repair of one whole search, and a plain dynamic program gives the same."""
    rng = random.Random(8)
    for _ in range(150):
        rows = [(rng.choice([b"user", b"assistant", b"system", b"tool"]), rng.choice([b"A.", b"B", b"", b"C%d." % rng.randrange(9)])) for _ in range(rng.randrange(40))]
        results = set()
        for block in (1, 3, 7, 1000):
            seen, one = set(), conversations.Repair(block)
            for turn, r in enumerate(rows):
                one.add(turn, *r, r in seen)
                seen.add(r)
            results.add(one.result())
        assert len(results) == 1
        best, seen = {"": (0, "")}, set()
        ways = {"": "u", "s": "u", "u": "a", "a": "u"}
        for role, text in rows:
            for _ in range(2):
                for q, (c, a) in list(best.items()):
                    best[ways[q]] = min(best.get(ways[q], (10**9, "")), (c + 3, a + "I"))
            fault = "must" if not text or (role, text) in seen else "" if text[-1:] == b"." else "cut"
            seen.add((role, text))
            after, x = {}, role[:1].decode()
            for q, (c, a) in best.items():
                options = [(q, c + 4, a + "D")]
                if fault != "must":
                    p = 3 * (fault == "cut")
                    options += [(ways[q], c + 3 + p, a + "R")] + ([(x, c + p, a + "K")] if x == ways[q] or (q == "" and x == "s") else [])
                for to, *label in options:
                    after[to] = min(after.get(to, (10**9, "")), tuple(label))
            best = after
        for _ in range(2):
            for q, (c, a) in list(best.items()):
                best[ways[q]] = min(best.get(ways[q], (10**9, "")), (c + 3, a + "I"))
        assert results.pop()[5:7] == min(best[q] for q in ("", "a") if q in best)


def test_search_stays_small_on_hard_rows():
    one = conversations.Repair(64)
    rng = random.Random(3)
    for turn in range(20_000):
        one.add(turn, rng.choice([b"user", b"assistant", b"system", b"tool"]), rng.choice([b"A%d." % turn, b"cut %d" % turn]), False)
    assert len(one.result()[6]) >= 20_000


# ---- 13

def plain_variants(rows, divisor):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % divisor else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, out = {}, []
    for w, n in count.items():
        others = sorted((-count[v], v) for v in count if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        out.append([w, form[w], None, n, len(others), -others[0][0] if form[w] else None])
    for r in out:
        root = r[0]
        while form[root]:
            root = form[root]
        r[2] = root
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("groups,tile,divisor", [(5, 512, 97), (2, 3, 3), (7, 1, 5)])
def test_spelling(spark, groups, tile, divisor):
    rng = random.Random(13)
    stems = ["".join(rng.choice("abcdeé÷ÿ") for _ in range(rng.randrange(4, 9))) for _ in range(12)]

    def word():
        w = list(rng.choice(stems))
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = rng.choice(["a", "É", "", "bc"])
        return "".join(w).title() if rng.random() < 0.2 else "".join(w)

    rows = [(i, "".join(word() + rng.choice([" ", ".", "1", "\n", "Ā"]) for _ in range(rng.randrange(150))), "", "", 0) for i in range(40)]
    rows += [(70, None, "", "", 0), (71, "", "", "", 0), (None, rows[0][1], "", "", 0), rows[1], (72, "x" * 30_000 + " " + "y" * 30_000, "", "", 0)] + [(73 + i, "y" * 30_000 + " " + "y" * 29_999, "", "", 0) for i in range(3)]
    out = spelling.variants(spelling.count_words(table(spark, rows), divisor=divisor), groups, tile)
    assert got(out, "word", "form", "root", "n", "n_near", "form_n") == plain_variants(rows, divisor)


def test_chains_end_at_the_last_form(spark):
    chain = [("a" * k + "b" * (40 - k), 3 * 2 ** k) for k in range(20)]
    out = {r.word: r for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {r.root for r in out.values()} == {chain[-1][0]} and out[chain[0][0]].form == chain[1][0]


# ---- odd tables

def test_empty_tables_and_clashing_columns(spark):
    none, talk = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], TALK)
    assert quality.digest(none).count() == spelling.digest(none).count() == conversations.digest(talk).count() == 0
    extra = "word string, n long, class int, block string, tile int, target string, total long, words string, h int, copy int, gone boolean, said string"
    docs = spark.createDataFrame([(1, "hello hello hello world", "en", "", 0) + (None,) * 12], f"{SCHEMA}, {extra}")
    assert quality.digest(docs).count() == 1 and spelling.digest(docs).collect()[0].word == "hello"
    rows = [(1, 0, "user", "Hi.") + (None,) * 6, (1, 1, "assistant", "Ho.") + (None,) * 6]
    assert conversations.digest(spark.createDataFrame(rows, f"{TALK}, h int, copy int, gone boolean, said string, nth int, audit string")).count() == 1
