"""Corpus operators against plain Python on small tables, and their defined results on odd ones."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tallyspan.llm import decontaminate, language_model, licenses, lines, neighbours, packing, secrets, simhash, substrings, toxicity
from tallyspan.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(seed=1, n=60, vocabulary=12, size=40):
    """Random texts over few words, with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 3 == 0 else f"W{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.randrange(size))) for _ in range(n)]
    texts += texts[:6] + [texts[7] + " extra", "", None, "   \n\t", "x", "long " * 3000 + "tail", "\n\n\n"]
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return rows + [(None, texts[0], None, None, None), (3, texts[3], "en", "src0", 1), (3, texts[3], "en", "src0", 1)]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def words(text, pattern=SPACE, lower=False):
    raw = (text or "").encode()
    return pattern.findall(raw.lower() if lower else raw)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- 1

@pytest.mark.parametrize("group_rows", [20_000, 1])
def test_substrings(spark, group_rows):
    rows, length = corpus(vocabulary=4), 6
    count = Counter()
    for r in rows:
        w = words(r[1])
        count.update(tuple(w[i:i + length]) for i in range(len(w) - length + 1))
    want = []
    for r in rows:
        w = words(r[1])
        gone = {p for i in range(len(w) - length + 1) if count[tuple(w[i:i + length])] > 1 for p in range(i, i + length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    out = substrings.digest(table(spark, rows), length, 3, group_rows)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_substring_texts_and_spans(spark):
    out = substrings.remove_repeats(table(spark, [(1, "a b c d e f", "", "", 0), (2, "x b c d y", "", "", 0)]), 3, 2).orderBy("doc_id").collect()
    assert [r.kept for r in out] == ["a e f", "x y"]
    assert [[tuple(s) for s in r.spans] for r in out] == [[(1, 4)], [(1, 4)]]


def test_deep_nodes_are_equal_suffixes():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (300, 5)).astype(np.uint32)
    seen = Counter(map(tuple, x.tolist()))
    assert substrings.deep_nodes(x, 5).tolist() == [seen[tuple(r)] for r in x.tolist()]
    seen = Counter(tuple(r[:3]) for r in x.tolist())
    assert substrings.deep_nodes(x, 3).tolist() == [seen[tuple(r[:3])] for r in x.tolist()]


def test_deep_nodes_with_colliding_mixes(monkeypatch):
    monkeypatch.setattr(substrings, "_ODD", np.ones(1, np.uint64))
    x = np.array([[1, 2], [2, 1], [1, 2], [3, 0], [2, 1], [2, 1]], np.uint32)
    assert substrings.deep_nodes(x, 2).tolist() == [2, 3, 2, 1, 3, 3]


# ---- 2

def simple_fingerprint(text, size=3):
    w = words(text, lower=True)
    grams = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = corpus(n=150, size=14)
    fps = [simple_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    low = defaultdict(list)
    for r, x in zip(rows, root):
        if r[0] is not None:
            low[x].append(r[0])
    want = [(r[0], "%016x" % f, min(low[x])) for r, f, x in zip(rows, fps, root)]
    out = simhash.digest(simhash.near_duplicates(table(spark, rows)))
    assert got(out, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_every_pair_within_three_bits_shares_a_variant(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    pairs = [(x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))) for x in base]
    fps = spark.createDataFrame([(simhash.signed(x),) for p in pairs for x in p], "fp long").distinct()
    found = {frozenset((r.u % 2**64, r.v % 2**64)) for r in simhash.links(fps).collect()}
    assert found == {frozenset(p) for p in pairs if (p[0] ^ p[1]).bit_count() <= 3}


def test_crowded_bucket_gives_a_forest():
    fps = np.array([0, 1, 3, 7, 15, 7 << 40, (7 << 40) + 1], np.uint64)
    assert len(simhash.bucket_links(fps, 64)) == len(fps) - 1
    assert len(simhash.bucket_links(fps, 1)) == len(fps) - 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 101), (300, 300)]
    want = {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 100}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    rng = random.Random(2)
    texts = [" ".join(f"t{rng.randrange(900)}" for _ in range(300)) for _ in range(20)]
    near = [" ".join(t.split()[:290] + ["changed"] + t.split()[291:]) for t in texts[:8]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts + near + texts[:3])] + [(5, texts[5], "en", "s", 0), (None, texts[6], "en", "s", 0), (None, "only here", None, None, None)]
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert got(kept, "doc_id") == sorted([(i,) for i in range(20)] + [(None,)], key=repr)


def test_keep_one_verifies_similarity(spark):
    rng = random.Random(21)
    run = lambda k: " ".join(f"v{rng.randrange(9000)}" for _ in range(k))
    # One template, Jaccard about 0.6 to 0.75 between members, then unrelated texts that share a long run of one word.
    frame = [run(60) for _ in range(4)]
    texts = [" ".join(x for f in frame for x in (f, run(8))) for _ in range(40)]
    texts += [run(400) + " -" * 200 for _ in range(10)]
    texts += [" ".join(f for f in frame) + " " + run(n) for n in (20, 24, 28)] + ["one two", "ONE  two", "one three"]
    for _ in range(20):
        w = run(200).split()
        cut = rng.randrange(18, 26)
        texts += [" ".join(w), " ".join(w[:-cut] + run(cut).split())]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    want = {root.index(x) for x in set(root)}
    kept = {r.doc_id for r in simhash.keep_one(table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert want <= kept  # nothing goes without a copy that verifies
    assert len(kept - want) <= 1  # pairs at the very threshold may escape the lookup


# ---- 3

def brute_contamination(rows, items, width):
    spots = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM, True)
        for i in range(max(1, len(w) - width + 1)) if w else []:
            spots[tuple(w[i:i + width])].add(item)
    out = []
    for r in rows:
        w = words(r[1], ALNUM, True)
        hit, seen = set(), set()
        for n in {len(k) for k in spots}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in spots:
                    hit.update(range(i, i + n))
                    seen.update(x for x in spots[tuple(w[i:i + n])] if x is not None)
        ids = ",".join(sorted(map(str, seen)))
        out.append((r[0], len(w), len(hit), len(seen), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rows = corpus(seed=5, vocabulary=5)
    items = [(10, "w0é, w1 W2 w3é w4 W1"), (9, "W1 w1"), (11, ""), (12, None), (None, "w2 W2 w2"), (13, "never seen here at all"), (9, "w4-w4-w4-w4")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = decontaminate.digest(decontaminate.report(table(spark, rows), bench, width=4))
    want = brute_contamination(rows, items, 4)
    assert got(out, *cols) == want
    clean = decontaminate.keep_clean(table(spark, rows), bench, width=4)
    assert Counter(got(clean, "doc_id")) == Counter((w[0],) for w in want if not w[5])
    none = decontaminate.digest(decontaminate.report(table(spark, rows), bench.limit(0), width=4))
    assert {r.n_hit for r in none.collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "pad " * 50 + "beta gamma")], "doc_id long, text string")
    search = decontaminate.Search(docs, spark.createDataFrame([(1, "gamma beta alpha")], "item_id long, text string"))
    assert [(r["first"], r["last"]) for r in search.proximity(8).collect()] == [(0, 4)]
    assert search.phrases().count() == 0


def test_proximity_with_repeated_terms(spark):
    rng = random.Random(17)
    texts = ["aa x aa " + "x " * 8 + "bb", "bb aa bb aa cc", "aa " * 5 + "bb cc " + "x " * 3 + "aa bb cc"]
    texts += [" ".join(rng.choice(["aa", "bb", "cc", "x", "x", "x"]) for _ in range(40)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    search = decontaminate.Search(docs, spark.createDataFrame([(1, "aa bb"), (2, "cc bb aa")], "item_id long, text string"))
    key = lambda t: hashlib.sha256(t.encode()).digest()[:16]
    want = set()
    for t in texts:
        w = t.split()
        for item in ("aa bb", "cc bb aa"):
            for i in [i for i, x in enumerate(w) if x in item.split()]:
                if set(item.split()) <= set(w[i:i + 11]):
                    want.add((key(t), hashlib.sha256(item.encode()).hexdigest(), i, max(w.index(x, i) for x in item.split())))
    found = [(bytes(r.tid), r.window, r["first"], r["last"]) for r in search.proximity(10).collect()]
    assert (key(texts[0]), hashlib.sha256(b"aa bb").hexdigest(), 2, 11) in found
    assert len(found) == len(set(found)) and set(found) == want


def test_native_plans(spark):
    docs = table(spark, corpus(n=8))
    for df in (decontaminate.report(docs, spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")), lines.digest(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---- 4

def test_licenses(spark):
    rows = [(1, "Under the MIT License; see mit license.", "", "", 0), (2, "the Apache Licence applies", "", "", 0), (3, "GNU general\npublic LICENSE", "", "", 0),
            (4, "", "", "", 0), (5, None, "", "", 0), (6, "permission is hereby granted, fre of charge, to any person obtainig a copy", "", "", 0), (7, "mit other license", "", "", 0)]
    out = {r.doc_id: r for r in licenses.digest(licenses.scan(table(spark, rows + rows[:1]))).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels, out[1].score) == (2, 2, 5, "mit", 1.0)
    assert (out[2].n_base, out[2].first_word, out[2].base_labels, out[2].labels) == (0, None, "", "apache") and 0.9 < out[2].score < 1
    assert (out[3].n_base, out[3].labels, out[3].first_word) == (1, "gpl", 1)
    assert [(out[i].n_words, out[i].n_base, out[i].labels, out[i].score) for i in (4, 5)] == [(0, 0, "", 0.0)] * 2
    assert out[6].labels == "mit" and [(s.first_word, s.end_word, s.errors) for s in out[6].fuzzy] == [(0, 13, 2)]
    assert out[7].labels == ""


def test_edited_notices_side_by_side(spark):
    texts = ["mit licence a mit licence b mit license c", "mozilla publc license or mozilla public license", "apache licens, apache license, mit licens; apache licence"]
    rows = {r.doc_id: [(s.label, s.first_word, s.errors) for s in r.fuzzy] for r in licenses.scan(table(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()}
    assert rows[0] == [("mit", 0, 1), ("mit", 3, 1), ("mit", 6, 0)]
    assert rows[1] == [("mpl", 0, 1), ("mpl", 4, 0)]
    assert rows[2] == [("apache", 0, 1), ("apache", 2, 0), ("mit", 4, 1), ("apache", 6, 1)]


# ---- 5

def brute_lines(rows, threshold):
    sets = []
    for r in rows:
        for n, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            w = frozenset(words(line, lower=True))
            if w:
                sets.append(((2**63 - 1 if r[0] is None else r[0]) * 2**31 + n, (r[0], r[1], n), w))
    return {at for p, at, s in sets if any(q < p and len(s & t) >= threshold * len(s | t) - 1e-9 for q, _, t in sets)}


@pytest.mark.parametrize("seed,bits,threshold", [(5, 13, 0.8), (1, 4, 0.8), (2, 13, 0.6), (3, 8, 0.9)])
def test_lines(spark, seed, bits, threshold):
    rng = random.Random(seed)
    base = [[f"k{rng.randrange(30)}" for _ in range(rng.randrange(1, 14))] for _ in range(25)]
    line = lambda: " ".join(w if rng.random() > 0.04 else "Changed" for w in rng.choice(base))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(5))), "en", "s", 0) for i in range(50)] + [(90, None, "", "", 0), (91, "", "", "", 0), (None, line(), "", "", 0)]
    rows += [(92, "\n".join([line()] * 3) + "\n", "en", "s", 0), (7, rows[7][1], "en", "s", 0)]
    rows += [(7, "another text of a shared id, its own line", "en", "s", 0), (93, "end\nend of it\nEND", "en", "s", 0)]
    gone = brute_lines(rows, threshold)
    want = []
    for r in rows:
        parts = r[1].split("\n") if r[1] is not None else []
        kept = "\n".join(p for n, p in enumerate(parts) if (*r[:2], n) not in gone)
        want.append((r[0], len(parts), sum((*r[:2], n) in gone for n in range(len(parts))), hashlib.sha256(kept.encode()).hexdigest()))
    assert got(lines.digest(table(spark, rows), threshold=threshold, bits=bits), "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_pairs_of_a_family_grow_with_its_lines(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(50)]

    def family(size):
        rows, made, inner = [], [], lines.similar_sets
        for i in range(size):
            w = list(base)
            for at in rng.sample(range(50), 2 if i % 2 else 4):  # two lines share 42 to 47 words where 45 are asked for
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(w), "", "", 0))
        with monkeypatch.context() as m:
            m.setattr(lines, "similar_sets", lambda pairs, *a: made.append(pairs.count()) or inner(pairs, *a))
            gone = lines.digest(table(spark, rows)).where("n_removed > 0").count()
        assert gone == len(brute_lines(rows, 0.8))
        return sum(made)

    small, large = family(60), family(480)
    assert large <= 3 * 8 * small  # 56 times when every line met its whole lists


def test_lines_do_not_hash_their_text_again(spark):
    plan = lines.raw_lines(table(spark, [(1, "a\nb", "", "", 0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan[plan.index("Generate"):] and "sha2" not in plan[:plan.index("Generate")]


# ---- 6

def test_secrets(spark):
    rng = random.Random(3)
    key = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz0123456789+/"
    texts = [f"some words {rng.choice(['password', 'API_KEY', 'Token'])} = \"{key(24, mixed)}\" and AKIA{key(16, 'ABCDEFGH234567')} go {key(40, hexa)} on, extraordinarily-long-words"
             for _ in range(120)] + ["token: abc", "é password:abcdef", "AKIA12", key(23, hexa), key(24, hexa), "", None, "unseen " + key(30, mixed) + " key"]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    docs = table(spark, rows + [(None, texts[0], "", "", 0)])
    net = secrets.train(docs, max_rows=300, epochs=4)
    out = {r.doc_id: r for r in secrets.digest(secrets.scan(docs, net)).collect()}
    for i, text in enumerate(texts):
        t, spans = text or "", []
        spans += [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        count = Counter(k for k, _, _ in spans)
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex, out[i].base_sha256) == (count["assign"], count["access"], count["hex"], hashlib.sha256(joined.encode()).hexdigest())
        assert set(joined.split(",")) - {""} <= set(out[i].spans.split(","))
    assert "cnn:7:37" in out[len(texts) - 1].spans


def test_network_learns_held_out_findings():
    rng = random.Random(9)
    good = ["".join(rng.choice("0123456789abcdefXYZ") for _ in range(24)) for _ in range(300)]
    bad = ["".join(rng.choice(["er", "th", "an", "on", "ing"]) for _ in range(9)) for _ in range(300)]
    rows = [(secrets.windows(x, 0, len(x))[0], int(i < 300)) for i, x in enumerate(good + bad)]
    rng.shuffle(rows)
    net = secrets.fit(rows[:400], epochs=4)
    p = net.probability(net.logits([v for v, _ in rows[400:]])) >= net.threshold
    assert np.mean(p == np.array([y for _, y in rows[400:]])) > 0.95


def test_threshold_is_the_recall_quantile():
    rng = random.Random(10)
    key = lambda: "".join(rng.choice("0123456789abcdefXYZ") for _ in range(24))
    word = lambda: "".join(rng.choice(["er", "th", "an", "on", "ing"]) for _ in range(9))
    rows = [(key(), 1) for _ in range(320)] + [(word(), 1) for _ in range(80)] + [(word(), 0) for _ in range(400)]  # a fifth of the findings look like words
    net = secrets.fit([(secrets.windows(x, 0, len(x))[0], y) for x, y in rows], epochs=4)
    p = net.probability(net.logits([secrets.windows(x, 0, len(x))[0] for x, y in rows if y]))
    assert net.threshold < 0.5 and (p >= net.threshold).mean() >= 0.95


def test_runs_with_and_without_digits_are_scanned(spark):
    text = "one QwRtZpLkJhGfDsXyVb two extraordinarily-long-words 9fK2mQx7Lr4TzW8pBn end 2024-01-01-some-slug"
    docs = table(spark, [(1, text, "", "", 0)])
    net = secrets.fit([])
    net.threshold = 0.0
    spans = [text[s.start:s.end] for s in secrets.scan(docs, net).first().spans]
    assert spans == ["QwRtZpLkJhGfDsXyVb", "extraordinarily-long-words", "9fK2mQx7Lr4TzW8pBn", "2024-01-01-some-slug"]
    views = [r.view for r in secrets.labelled_views(docs).collect()]
    assert views and not any("9fK2mQx7Lr4TzW8pBn" in v[secrets.BEFORE:-secrets.AFTER] for v in views)


def test_all_findings_are_fitted_and_calibrated(spark):
    rng = random.Random(14)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 30, 90])))
    word = lambda: "".join(rng.choice(["er", "th", "an", "on", "ing"]) for _ in range(rng.choice([9, 24])))
    texts = [f"go {key()} on {word()} {word()} then {word()} or {word()} and {word()}" for _ in range(200)]
    docs = table(spark, [(i, t, "", "", 0) for i, t in enumerate(texts + texts[:50] + texts[:50])])
    want = []
    for t in texts + texts[:50] + texts[:50]:
        want += [(v, 1) for a, _, b in secrets.exact_spans(t) for v in secrets.windows(t, a, b)]
        want += [(v, 0) for a, b in secrets.candidates(t, secrets.exact_spans(t)) for v in secrets.windows(t, a, b)]
    views = secrets.labelled_views(docs).collect()
    assert sorted((r.view, r.y) for r in views) == sorted(want)
    net = secrets.train(docs, max_rows=40, epochs=4)  # many shards
    again = secrets.train(docs.repartition(5), max_rows=40, epochs=4)
    assert np.array_equal(net.conv, again.conv) and np.isclose(net.threshold, again.threshold, rtol=1e-9)
    p = net.probability(net.logits([r.view for r in views]))
    y, held = np.array([r.y for r in views]), np.array([r.key % 4 == 0 for r in views])
    found = np.sort(p[held & (y == 1)])
    assert np.isclose(net.threshold, found[int(0.02 * len(found))], rtol=1e-9)
    assert np.mean((p >= net.threshold) == y) > 0.95
    # Platt scaling of the whole part: the mean score is the share of findings
    assert abs(p[held].mean() - y[held].mean()) < 1e-3


# ---- 7

def test_toxicity(spark):
    rng = random.Random(6)
    text = lambda bad: " ".join(rng.choice(["worthless", "scum"]) if bad and k % 9 == 0 else f"n{rng.randrange(200)}" for k in range(40))
    rows = [(i, text(i % 4 == 0), "en", "s", 0) for i in range(900)] + [(5000, None, "", "", 0), (5001, "", "", "", 0), (None, text(True), "", "", 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(700)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in out if r.held_out and r.doc_id < 900]
    assert np.mean(right) > 0.97
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 600 < kept.count() < 720
    blind = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert blind.count() == len(rows)


# ---- 8

def brute_ppm(train, order):
    cnt = defaultdict(Counter)
    symbols = lambda w: [256] + (list(w) + [256] if w else [257])
    for w, c in train.items():
        s = symbols(w)
        for k in range(1, len(s)):
            for o in range(min(order, k) + 1):
                cnt[tuple(s[k - o:k])][s[k]] += c

    def length(w):
        s, total = symbols(w), 0.0
        for k in range(1, len(s)):
            ctx, out = tuple(s[max(0, k - order):k]), set()
            while ctx not in cnt:
                ctx = ctx[1:]
            while True:
                left = {a: n for a, n in cnt[ctx].items() if a not in out}
                n, kinds = sum(left.values()), len(left)
                if s[k] in left:
                    total += math.log10(left[s[k]] / (n + kinds))
                    break
                total += math.log10(kinds / (n + kinds)) if kinds else 0
                out |= set(cnt[ctx])
                if not ctx:
                    total -= math.log10(258 - len(out))
                    break
                ctx = ctx[1:]
        return total
    return length


def test_language_model(spark):
    rows = corpus(seed=8, vocabulary=40)
    own = [(r[0], words(r[1], lower=True) + [b""]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in own if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    ppm = brute_ppm(c, 3)
    out = language_model.score(table(spark, rows), order=3, prune=40).collect()
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5),
                    round(sum(map(ppm, ws)), 5)) for i, ws in own), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in out), key=repr) == want


@pytest.mark.parametrize("prune", [0, 4, 18])
def test_rare_contexts_count(spark, prune):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    rows = corpus(seed=8, vocabulary=40) + [(1000 + i, " ".join(word() for _ in range(30)), "", "", 0) for i in range(40)]
    own = [(r[0], words(r[1], lower=True) + [b""]) for r in rows]
    ppm = brute_ppm(Counter(w for i, ws in own if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in ws), 4)
    out = language_model.score(table(spark, rows), prune=prune).collect()
    assert sorted(((r.doc_id, round(r.score, 5)) for r in out), key=repr) == sorted(((i, round(sum(map(ppm, ws)), 5)) for i, ws in own), key=repr)


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = table(spark, [(i, f"scum {i}" if i % 2 else f"kind {i}", "", "", 0) for i in range(40)])
    monkeypatch.setattr(toxicity, "fit_rows", lambda rows, bits: toxicity.Model(bits, np.zeros(0, np.int64), np.zeros(0, np.float32), float(os.getpid())))
    assert toxicity.train(docs, labels).bias not in (0.0, float(os.getpid()))


# ---- 9

def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 16))
    x = (centre[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:180] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [None] * 16), (4080, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.search(df, "vec_id % 20 = 0", k=10, sample_rows=1000, part_rows=200, block_rows=150, query_rows=20).toPandas()
    found, total, x = 0, 0, x.astype(float)
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(3000), -s.round(9)))[:10]
        mine = out[out.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(s[mine.vec_id], mine.score)
        assert list(zip(-mine.score, mine.vec_id)) == sorted(zip(-mine.score, mine.vec_id))
        found, total = found + (s[mine.vec_id] >= s[top[-1]] - 1e-9).sum(), total + 10
    assert found / total >= 0.9 and set(out.query_id) == set(range(0, 3000, 20))
    few = neighbours.search(df.where("vec_id < 5"), "vec_id % 20 = 0", k=10)
    assert few.count() == 4
    assert neighbours.search(df.limit(0), "vec_id % 20 = 0").count() == 0


# ---- 10

def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(seed=3) + [(700, "Don't <|endoftext|> É.. ＡＢ x" * 40, "", "", 0)]
    out = packing.pack_documents(table(spark, rows), capacity=64, shard_rows=30)
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want += [(r[0], k, at, len(ids[at:at + 64]), zlib.crc32(np.array(ids[at:at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    for _, g in out.toPandas().sort_values("offset", kind="stable").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate(([0], np.cumsum(g.length)[:-1])).tolist() and g.length.sum() <= 64


def test_word_ids_are_those_of_the_tokenizer():
    rng = random.Random(12)
    encode = packing.WordIds.of(packing.default_tokenizer())
    signs = list("abcXYZéÀßİıΣσς") + ["\u0307", "\u0301", "\u093c", "\u0958", "\u212b", "Å", "ﬁ", "ǅ", "\u00a0", "\u0085", "\u200b", "😀", "中", "٣", "Ⅷ", "ª"] + list(".,!?'\"-$# \n\t") + ["'s", "'LL"]
    texts = ["TÜRKİYE CUMHURİYETİ. BELEDİYESİ, ANKARA İ!", "ΟΔΟΣ. ΣΑΣ, Σ"]
    texts += ["".join(rng.choice(signs) if rng.random() > 0.2 else chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0xA000, 0xD7FF)]))
                      for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    for t in texts:
        assert encode(t.encode()).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END], t


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(measure):
    rng = np.random.default_rng(2)
    n = rng.integers(1, 100, 2000)
    items = np.column_stack((n, np.ones(2000), n * n)).astype(float)
    cap = np.array([100.0, 5.0, 4000.0])
    which, before = packing.best_fit(items, cap, np.ones(3), measure)
    for s in range(which.max() + 1):
        own = items[which == s]
        assert len(own) == 1 or (own.sum(axis=0) <= cap + 1e-6).all()
        assert np.sort(before[which == s]).tolist() == np.concatenate(([0], np.cumsum(own[np.argsort(before[which == s]), 0])[:-1])).tolist()
    loose, _ = packing.best_fit(items, np.array([100.0, 1e9, 1e9]), np.array([1.0, 0, 0]), measure)
    assert loose.max() + 1 <= 1.03 * n.sum() / 100 + 2


# ---- odd tables

def test_empty_tables(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (substrings.digest(none), simhash.near_duplicates(none), simhash.keep_one(none), decontaminate.report(none, bench), licenses.scan(none), lines.digest(none),
               secrets.scan(none, secrets.train(none)), toxicity.score(none, toxicity.train(none, labels)), language_model.score(none), packing.pack_documents(none)):
        assert df.count() == 0


def test_clashing_extra_columns(spark):
    names = ["tid", "token", "place", "words", "line", "fp", "key", "part", "window", "term", "start", "length", "kind", "chunk", "s1", "n", "root"]
    docs = table(spark, corpus(n=12)).selectExpr("*", *[f"'clash' AS {n}" for n in names])
    bench = spark.createDataFrame([(1, "w1 W2", "clash")], "item_id long, text string, term string")
    n = docs.count()
    for df in (substrings.digest(docs), simhash.near_duplicates(docs), decontaminate.report(docs, bench), licenses.scan(docs), lines.dedup_lines(docs),
               language_model.score(docs)):
        assert df.count() == n
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns
    assert simhash.keep_one(docs).columns == docs.columns
    assert packing.pack_documents(docs).count() >= n


# ---- pipeline

def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    sentence = lambda k: " ".join(f"z{rng.randrange(5000)}" for _ in range(k))
    item = sentence(20)
    clean = ["\n".join(sentence(30) for _ in range(5)) for _ in range(300)]
    toxic = [sentence(30) + " " + " ".join(["scum", "worthless", "scum"]) + " " + sentence(20) for _ in range(120)]
    dirty = [sentence(30) + " " + item + " " + sentence(30) for _ in range(4)]
    copies = clean[:10]
    near = [c.replace(c.split()[60], "swapped") for c in clean[10:20]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + toxic + dirty + copies + near)]
    for name, data, schema in (("documents", rows, SCHEMA), ("benchmark", [(1, item)], "item_id long, text string"),
                               ("labels", [(i, 1, int(300 <= i < 420)) for i in range(424)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, docs, str(tmp_path))
        assert nxt.columns == docs.columns
        nxt.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not [i for i in kept["toxicity"] if 300 <= i < 420] and len(kept["toxicity"]) == len(rows) - 120
    assert all(kept["line_dedup"][i] == clean[i] for i in range(300)) and all(kept["line_dedup"][i] == "" for i in range(424, 434))
    assert set(range(300)) <= set(kept["near_dedup"])
    assert set(kept["decontamination"]) & set(range(420, 424)) == set() and set(range(300)) <= set(kept["decontamination"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept["decontamination"])
