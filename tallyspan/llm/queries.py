"""Registered queries of the corpus operators: ``opN_<name>`` with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, language_model, licenses, lines, neighbours, packing, quality, secrets, simhash, spelling, substrings, toxicity
from .common import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_substring_dedup", """
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
    k AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM s),
    r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
    g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
    f AS (SELECT w.doc_id, words, coalesce(ps, []) AS ps FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
    SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, cast(len(ps) AS BIGINT) AS n_removed,
      sha256(array_to_string(list_filter(words, lambda x, p: NOT list_contains(ps, p)), ' ')) AS kept_sha256
    FROM f""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query("op3_decontamination", f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bw AS (SELECT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, list(DISTINCT cast(item_id AS VARCHAR)) AS l FROM hit GROUP BY doc_id)
    SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, cast(coalesce(len(l), 0) AS BIGINT) AS n_items,
      sha256(array_to_string(list_sort(coalesce(l, [])), ',')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


@query("op5_line_dedup", """
    WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
    g AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
    s AS (SELECT ws, row_number() OVER (ORDER BY ws) AS sid, first FROM (SELECT ws, min((doc_id, line)) AS first FROM g WHERE len(ws) > 0 GROUP BY ws)),
    e AS (SELECT sid, first, len(ws) AS n, unnest(ws) AS w FROM s WHERE len(ws) >= 4),
    o AS (SELECT a.sid AS sid, b.first AS other, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn
      FROM e a JOIN e b ON a.w = b.w AND a.sid <> b.sid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.sid, b.sid, b.first),
    best AS (SELECT sid, min(other) AS other FROM o WHERE k >= 0.8 * (an + bn - k) - 1e-9 GROUP BY sid),
    m AS (SELECT ws, least(first, coalesce(other, first)) AS first FROM s LEFT JOIN best ON s.sid = best.sid),
    gone AS (SELECT g.doc_id, list(g.line) AS ls FROM g JOIN m ON g.ws = m.ws WHERE (g.doc_id, g.line) > m.first GROUP BY g.doc_id)
    SELECT d.doc_id, cast(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, cast(coalesce(len(ls), 0) AS BIGINT) AS n_removed,
      sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(coalesce(ls, []), i - 1)), chr(10))) AS kept_sha256
    FROM documents d LEFT JOIN gone ON d.doc_id = gone.doc_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op8_language_model")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


_COUNT = "cast(length(t) - length(regexp_replace(t, '[{}]', '', 'g')) AS DOUBLE)"
_CLASS_SQL = ", ".join(_COUNT.format(c) for c in (
    "a-z", "A-Z", "0-9", "\\x20\\x09-\\x0D", ".,;:!?''\"()\\-", "\\x23-\\x26\\x2A\\x2B/<=>@\\[\\\\\\]^_`{|}~\\x{80}-\\x{BF}",
    "\\x{C0}-\\x{27F}", "\\x{280}-\\x{FFFF}", "\\x{10000}-\\x{10FFFF}", "\\x00-\\x08\\x0E-\\x1F\\x7F"))


def _distance_sql(mine: str) -> str:
    """Jensen-Shannon distance of each text's cells from its language's, by row number; ``mine`` holds (r, n, m)."""
    return f"""SELECT r, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist
      FROM (SELECT r, n / sum(n) OVER (PARTITION BY r) AS p, m / sum(m) OVER (PARTITION BY r) AS q FROM {mine}) GROUP BY r"""


@query("op11_quality_rules", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
      {_WORDS.replace("coalesce(text, '')", "t")} AS aw, [{_CLASS_SQL}] AS cs FROM d),
    runs AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
    again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT runs.r, unnest(range(i, i + 8)) AS p FROM runs
      JOIN (SELECT r, g FROM runs GROUP BY r, g HAVING count(*) > 1) x ON runs.r = x.r AND runs.g = x.g) GROUP BY r),
    long AS (SELECT * FROM w WHERE len(aw) >= 50),
    counted AS (SELECT lang, word, count(*) AS m FROM (SELECT lang, unnest(aw) AS word FROM long) GROUP BY lang, word),
    known AS (SELECT lang, sum(m) AS total FROM counted GROUP BY lang HAVING sum(m) >= 2000),
    top AS (SELECT counted.lang, word, m FROM counted JOIN known ON counted.lang IS NOT DISTINCT FROM known.lang
      QUALIFY row_number() OVER (PARTITION BY counted.lang ORDER BY m DESC, word) <= 100),
    cells AS (SELECT lang, word, cast(m AS DOUBLE) AS m FROM top
      UNION ALL SELECT known.lang, NULL, cast(any_value(total) - sum(m) AS DOUBLE) FROM known JOIN top ON known.lang IS NOT DISTINCT FROM top.lang GROUP BY known.lang),
    mine AS (SELECT r, word, cast(count(*) AS DOUBLE) AS n FROM (SELECT x.r, top.word AS word FROM (SELECT r, lang, unnest(aw) AS word FROM long) x
      LEFT JOIN top ON x.lang IS NOT DISTINCT FROM top.lang AND x.word = top.word) GROUP BY r, word),
    by_word AS ({_distance_sql("(SELECT long.r, coalesce(n, 0) AS n, m FROM long JOIN cells ON long.lang IS NOT DISTINCT FROM cells.lang LEFT JOIN mine ON mine.r = long.r AND mine.word IS NOT DISTINCT FROM cells.word)")}),
    class AS (SELECT lang, k, sum(cs[k]) AS m FROM (SELECT lang, cs, unnest(range(1, 11)) AS k FROM long) GROUP BY lang, k),
    by_class AS ({_distance_sql("(SELECT x.r, cs[x.k] AS n, m FROM (SELECT r, lang, cs, unnest(range(1, 11)) AS k FROM w WHERE length(t) >= 200) x JOIN known ON x.lang IS NOT DISTINCT FROM known.lang JOIN class ON class.lang IS NOT DISTINCT FROM x.lang AND class.k = x.k)")})
    SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, cast(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      coalesce(again.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(ws) AS base_failed,
      NOT (len(ws) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(ws)) AND coalesce(by_word.dist, 0) <= 0.55 AND coalesce(by_class.dist, 0) <= 0.3 AS kept
    FROM w LEFT JOIN again ON w.r = again.r LEFT JOIN by_word ON w.r = by_word.r LEFT JOIN by_class ON w.r = by_class.r""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents")).drop("word_distance", "class_distance")


# crc32 of a text, from the table of its 256 one-byte steps.
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) x(b)"""


def _crc_sql(text: str) -> str:
    octets = f"list_transform(range(1, cast(octet_length(encode({text})) AS BIGINT) + 1), lambda i: cast('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


@query("op12_conversation_repair", f"""
    WITH RECURSIVE crc AS ({_CRC_TABLE}),
    hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, key FROM (SELECT *,
      coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS key FROM conversations)),
    damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
      CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM (SELECT hashed.*, {_crc_sql("key")} % 20 AS h FROM hashed, crc)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
    faults AS (SELECT *, substr(role, 1, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px FROM placed),
    summary AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
    edits(q, fix, x, e, c, q2, said) AS (VALUES ('', 0, '', 'D', 4, '', ''), ('s', 0, '', 'D', 4, 's', ''), ('u', 0, '', 'D', 4, 'u', ''), ('a', 0, '', 'D', 4, 'a', ''),
      ('', 1, 's', 'K', 0, 's', ''), ('', 1, 'u', 'K', 0, 'u', ''), ('s', 1, 'u', 'K', 0, 'u', ''), ('u', 1, 'a', 'K', 0, 'a', ''), ('a', 1, 'u', 'K', 0, 'u', ''),
      ('', 1, '', 'R', 3, 'u', 'user'), ('s', 1, '', 'R', 3, 'u', 'user'), ('u', 1, '', 'R', 3, 'a', 'assistant'), ('a', 1, '', 'R', 3, 'u', 'user')),
    put(q, q2, e, lines) AS (VALUES ('', '', '', ['']), ('s', 's', '', ['']), ('u', 'u', '', ['']), ('a', 'a', '', ['']), ('', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']), ('a', 'u', 'I', ['user:']),
      ('', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:']), ('u', 'u', 'II', ['assistant:', 'user:']), ('a', 'a', 'II', ['user:', 'assistant:'])),
    walk AS (SELECT conv_id, cast(0 AS BIGINT) AS i, '' AS q, cast(0 AS BIGINT) AS cost, '' AS audit, cast([] AS VARCHAR[]) AS lines FROM summary
      UNION ALL SELECT conv_id, i, q2, b.cost, b.audit, b.lines FROM (
        SELECT walk.conv_id, faults.i, edits.q2, min({{'cost': cast(walk.cost + 3 * length(put.e) + edits.c + CASE WHEN edits.e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT),
          'audit': walk.audit || put.e || edits.e, 'lines': list_concat(walk.lines, list_filter(put.lines, lambda l: l <> ''),
            CASE edits.e WHEN 'D' THEN cast([] AS VARCHAR[]) WHEN 'K' THEN [faults.role || ':' || faults.text] ELSE [said || ':' || faults.text] END)}}) AS b
        FROM walk JOIN faults ON faults.conv_id IS NOT DISTINCT FROM walk.conv_id AND faults.i = walk.i + 1 JOIN put ON put.q = walk.q
          JOIN edits ON edits.q = put.q2 AND (edits.e = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (edits.e <> 'K' OR edits.x = faults.x)
        GROUP BY walk.conv_id, faults.i, edits.q2)),
    ends AS (SELECT walk.conv_id, min({{'cost': walk.cost + 3 * length(put.e), 'audit': walk.audit || put.e, 'lines': list_concat(walk.lines, list_filter(put.lines, lambda l: l <> ''))}}) AS b
      FROM walk JOIN summary ON summary.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = summary.n JOIN put ON put.q = walk.q AND put.q2 IN ('', 'a') GROUP BY walk.conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(array_to_string(coalesce(b.lines, []), chr(10))) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN summary ON summary.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


@query("op13_spelling_variants", f"""
    WITH RECURSIVE crc AS ({_CRC_TABLE}),
    runs AS (SELECT d, run, count(*) AS k FROM (SELECT coalesce(cast(doc_id AS VARCHAR), '') AS d,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY d, run),
    hashed AS (SELECT run, k, {_crc_sql("d || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 5),
    words AS (SELECT word, cast(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, cast(h % length(run) AS BIGINT)) || substr(run, cast(h % length(run) AS BIGINT) + 2) ELSE run END AS word
      FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
    cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
    near AS (SELECT a, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS best FROM pairs JOIN words ON words.word = b GROUP BY a),
    formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n
      FROM words LEFT JOIN near ON a = word),
    chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.root WHERE form IS NOT NULL),
    ended AS (SELECT chain.word, root FROM chain JOIN formed ON formed.word = root WHERE form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ended USING (word)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))
