"""The queries op1 to op13: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import align, brown, decontaminate, divergence, licenses, mixing, quality, sharding, simhash, tokenfiles, toxicity, urlfilter, wordpiece
from tidewell.llm.base import table

# The rules that op3 judges by.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
TOKENIZER, END_ID = "word_bpe_49k.json", 2
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A title made of words that end in runs of symbols; such pages are listed.
JUNK_TITLE = r"<title>[^<]*(?:%%%|\*\*\*|###|\$\$\$|&amp;&amp;&amp;)"


def tokenizer_json(path: str = TOKENIZER) -> str:
    with open(public_tokenizers.path(path), encoding="utf-8") as f:
        return f.read()


def piece_model(path: str = PIECES) -> bytes:
    with open(public_tokenizers.path(path), "rb") as f:
        return f.read()


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"), ["doc_id"])


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Listed are the URLs of pages whose title is junk, whatever form other pages write them in."""
    pages = table(spark, folder, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.url_filter(pages.select("page_id", "url"), rules, pages.where(F.col("html").rlike(JUNK_TITLE)).select("url")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_brown_scores(spark: SparkSession, folder: str) -> DataFrame:
    return brown.class_scores(table(spark, folder, "documents"), lambda i: F.coalesce(F.crc32(i.cast("string").cast("binary")) % 10 == 0, F.lit(False)), own_classes=True)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, folder, "documents"), ["doc_id"], tokenizer_json())


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.token_digests(table(spark, folder, "documents"), tokenizer_json(), END_ID)


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = lambda i: F.coalesce(F.crc32(i.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return toxicity.toxic_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out)


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.aligned(table(spark, folder, "documents"), tokenizer_json(BYTES), piece_model())


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_license_scan, op3_url_filter, op4_quality_rules, op5_brown_scores, op6_token_counts, op7_mixing, op8_token_files, op9_sharding, op10_decontamination, op11_toxicity, op12_divergence, op13_alignment)
}

ORACLE: dict[str, str] = {
    "op3_url_filter": r"""
        WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                                                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        parsed AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
                          regexp_matches(html, '<title>[^<]*(?:%%%|\*\*\*|###|\$\$\$|&amp;&amp;&amp;)') AS junk FROM pages),
        named AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS c FROM parsed),
        listed AS (SELECT DISTINCT c FROM named WHERE junk AND c <> ''),
        urls AS (SELECT DISTINCT host, path, c FROM named),
        fitting AS (SELECT u.host, u.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS rule_verdict
                    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN listed.c IS NOT NULL AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict
        FROM named LEFT JOIN fitting USING (host, path) LEFT JOIN listed USING (c)
    """,
    "op4_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        again AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
        rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM again GROUP BY r),
        m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                     (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                     coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep USING (r)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        o AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines AS failed FROM b),
        s AS (SELECT *, failed OR 100 * n_symbols > 2 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS strict FROM o),
        h AS (SELECT source, count(*) AS n, count_if(failed) AS f FROM s GROUP BY source),
        a AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS docs, sum(f)::DOUBLE / sum(n) AS mean, sum(f::DOUBLE * f / n) AS squares, sum(n::DOUBLE * n) AS sizes FROM h),
        p AS (SELECT mean, CASE WHEN docs - sizes / docs > 0 THEN greatest(0.0, (squares - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / (docs - sizes / docs)) ELSE 0.0 END AS spread FROM a),
        k AS (SELECT mean, spread, CASE WHEN spread > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM p),
        v AS (SELECT source, n >= 20 AND spread > 0 AND (f + mean * strength) / (n + strength) > least(0.5, mean + 1.645 * sqrt(spread * n / (n + strength))) AS bad FROM h, k)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT (bad AND strict) AS kept
        FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
    """,
    "op7_mixing": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(text), '') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        k AS (SELECT source, source_size, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
        rounds AS (
            SELECT 0 AS round, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM k) AS level
            UNION ALL
            SELECT round + 1, (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (cap < weight * level), 0))::DOUBLE / sum(weight) FILTER (NOT cap < weight * level) FROM k)
            FROM rounds WHERE round < (SELECT count(*) FROM s)),
        t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM rounds)) AS target FROM k),
        r AS (SELECT doc_id, key, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + (('0x' || substr(md5('mix-1|' || key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate))::INT))::BIGINT AS taken
        FROM r
    """,
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        occ AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (SELECT *, (1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::HUGEINT AS p FROM grid JOIN v USING (lang)),
        l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
        q AS (SELECT lang, term, (1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::HUGEINT AS q FROM l JOIN v USING (lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL) f
                  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        b AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM b QUALIFY part = 'pair' OR rank <= 10
    """,
}
