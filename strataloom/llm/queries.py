"""The text operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, hardneg, html, lines, lm, pii, quality, rules, simhash, spelling, toxicity, wordpiece
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(hardneg.scaled(rows.withColumn("label", moved), "vec_id", "label", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_html": op2_html, "op3_simhash": op3_simhash, "op4_decontam": op4_decontam, "op5_pii": op5_pii, "op6_lm": op6_lm, "op7_quality": op7_quality, "op8_lines": op8_lines, "op9_rules": op9_rules, "op10_wordpiece": op10_wordpiece, "op11_toxicity": op11_toxicity, "op12_spelling": op12_spelling, "op13_hardneg": op13_hardneg}

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op4_decontam": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ITEM_WORD}') AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ITEM_WORD}') AS w FROM benchmark),
        known AS (
            SELECT DISTINCT item, w[k : k + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(g) AS n FROM known),
        windows AS (
            SELECT doc_id, k, n, w[k : k + n - 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), sizes WHERE k + n - 1 <= len(w)),
        hits AS (SELECT doc_id, k, n, item FROM windows JOIN known USING (g)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_lines": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
            FROM documents),
        keyed AS (SELECT *, {LOWER.format(rf"regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', '')")} AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keep AS gone FROM keyed l LEFT JOIN common c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op9_rules": rf"""
        WITH docs AS (
            SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
        windows AS (
            SELECT doc_id, k, (w[k], w[k + 1], w[k + 2]) AS g
            FROM (SELECT doc_id, words AS w, unnest(range(1, len(words) - 1)) AS k FROM docs)),
        again AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n >= 2),
        repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY doc_id),
        stats AS (
            SELECT doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
                     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
                   coalesce(n, 0) AS n_repeat_words,
                   length(regexp_replace(text, '[^!]', '', 'g')) AS shouts, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers,
                   length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
            FROM docs LEFT JOIN repeated USING (doc_id)),
        rated AS (
            SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS r1,
                   CASE WHEN n_words > 0 THEN 1000 * shouts // n_words ELSE 0 END AS r2,
                   CASE WHEN letters > 0 THEN 1000 * uppers // letters ELSE 0 END AS r3 FROM stats),
        long AS (
            SELECT lang, source, 1 AS s, r1 AS v FROM rated WHERE n_words > 0
            UNION ALL SELECT lang, source, 2, r2 FROM rated WHERE n_words > 0
            UNION ALL SELECT lang, source, 3, r3 FROM rated WHERE n_words > 0),
        sketch AS (
            SELECT lang, source, s, CASE WHEN v < {rules.SUB} THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS b, count(*) AS n
            FROM long GROUP BY ALL),
        levels AS (
            SELECT 0 AS level, lang, source, s, b, n FROM sketch
            UNION ALL SELECT 1, lang, '', s, b, sum(n) FROM sketch GROUP BY ALL
            UNION ALL SELECT 2, '', '', s, b, sum(n) FROM sketch GROUP BY ALL),
        ranked AS (
            SELECT *, sum(n) OVER o AS below, sum(n) OVER (PARTITION BY level, lang, source, s) AS docs, lead(b) OVER o AS nxt, (nxt + {rules.SUB}) / (b + {rules.SUB})::DOUBLE AS ratio
            FROM levels WINDOW o AS (PARTITION BY level, lang, source, s ORDER BY b)),
        limits AS (
            SELECT level, lang, source, s, docs, (max({{'ratio': ratio, 'b': -b, 'most': (b + nxt) // 2}}) FILTER (WHERE 10 * below >= {10 - rules.TAIL_TENTHS} * docs AND ratio >= {rules.GAP})).most AS most
            FROM ranked GROUP BY ALL),
        chosen AS (
            SELECT o.lang, o.source, o.s, CASE WHEN o.docs >= {rules.MIN_DOCS} THEN o.most WHEN l.docs >= {rules.MIN_DOCS} THEN l.most ELSE e.most END AS most
            FROM (SELECT * FROM limits WHERE level = 0) o
            LEFT JOIN (SELECT * FROM limits WHERE level = 1) l ON o.lang = l.lang AND o.s = l.s
            LEFT JOIN (SELECT * FROM limits WHERE level = 2) e ON o.s = e.s),
        failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rated)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND r1 <= coalesce(a.most, r1) AND r2 <= coalesce(b.most, r2) AND r3 <= coalesce(c.most, r3) AS kept
        FROM failed f
        LEFT JOIN chosen a ON f.lang = a.lang AND f.source = a.source AND a.s = 1
        LEFT JOIN chosen b ON f.lang = b.lang AND f.source = b.source AND b.s = 2
        LEFT JOIN chosen c ON f.lang = c.lang AND f.source = c.source AND c.s = 3""",
    "op12_spelling": rf"""
        WITH RECURSIVE tab AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: 0::BIGINT), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(i))),
        runs AS (
            SELECT doc_id, {LOWER.format("run")} AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents) GROUP BY ALL),
        bytes AS (
            SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs),
        hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
        v AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT n, CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed)
            WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
        places AS (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v),
        masks AS (SELECT word, word[1 : p - 1] || '*' || word[p + 1 :] AS m FROM places),
        fewer AS (SELECT DISTINCT word, word[1 : p - 1] || word[p + 1 :] AS m FROM places),
        pairs AS (
            SELECT a.word, b.word AS other FROM masks a JOIN masks b ON a.m = b.m AND a.word <> b.word
            UNION SELECT f.word, v.word FROM fewer f JOIN v ON v.word = f.m
            UNION SELECT v.word, f.word FROM fewer f JOIN v ON v.word = f.m),
        near AS (
            SELECT p.word, count(*) AS n_near, min({{'n': -v.n, 'w': other}}) AS top FROM pairs p JOIN v ON v.word = p.other GROUP BY 1),
        forms AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 5 * v.n THEN top.w END AS form, CASE WHEN -top.n >= 5 * v.n THEN -top.n END AS form_n
            FROM v LEFT JOIN near USING (word)),
        chain AS (
            SELECT word, form AS root, 1 AS depth FROM forms WHERE form IS NOT NULL
            UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY 1)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)""",
    "op13_hardneg": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS "rank", vec_id AS negative_id,
               positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY "rank" <= 3""",
}
