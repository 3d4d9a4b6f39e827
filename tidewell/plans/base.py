"""How plans register queries, and the derived inputs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import text as X
from tidewell.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a plan under its name, with the SQL that gives the same rows where there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def next_turns(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, gold, predicted): every turn's text beside the next turn's, as pairs to compare."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("gold"), F.lead("text").over(w).alias("predicted"))
    return rows.where("predicted is not null")


NEXT_TURNS = "next_turns AS (SELECT * FROM (SELECT conv_id, turn, text AS gold, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS predicted FROM conversations) WHERE predicted IS NOT NULL)"


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, response): each document's text as a model's answer that cites, withholds, or thinks aloud, by its id."""
    i, t = F.col("doc_id"), F.col("text")
    text = (
        F.when(i % 7 == 0, F.concat(t, F.lit("【1】")))
        .when(i % 7 == 1, F.concat(F.lit("<think>plan\nfirst</think>"), t, F.lit("【"), (i % 5 + 1).cast("string"), F.lit(", "), (i % 3 + 1).cast("string"), F.lit("】")))
        .when(i % 7 == 2, F.concat(t, F.lit("【2】【abc】【3，1】")))
        .when(i % 7 == 3, F.lit(X.NO_ANSWER))
        .when(i % 7 == 4, F.lit("【1】, 【2】"))
        .when(i % 7 == 5, F.concat(F.lit("答案内容： "), t, F.lit("\n\n{从资料}【4】")))
        .otherwise(t)
    )
    return table(spark, folder, "documents").select("doc_id", text.alias("response"))


RESPONSES = """responses AS (SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN text || '【1】' WHEN 1 THEN '<think>plan' || chr(10) || 'first</think>' || text || '【' || (doc_id % 5 + 1) || ', ' || (doc_id % 3 + 1) || '】'
    WHEN 2 THEN text || '【2】【abc】【3，1】' WHEN 3 THEN '无答案' WHEN 4 THEN '【1】, 【2】'
    WHEN 5 THEN '答案内容： ' || text || chr(10) || chr(10) || '{从资料}【4】' ELSE text END AS response FROM documents)"""

# SQL of tokens and of the ranked arms that several plans build on.
TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
DOC_TOKENS = f"""dt AS MATERIALIZED (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), qt AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark),
    tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) GROUP BY ALL),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM qt) GROUP BY ALL)"""
TERMS = """st AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
    terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25 = f"""{DOC_TOKENS}, {TERMS},
    hit AS (SELECT item_id AS query, doc_id AS doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score
           FROM q JOIN tf USING (term) JOIN terms USING (term) JOIN dt USING (doc_id), st GROUP BY ALL),
    bm AS (SELECT item_id AS query, doc_id AS doc, coalesce(score, 0) AS score FROM benchmark CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN hit ON query = item_id AND doc = doc_id),
    bm25 AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 10)"""
SPARSE = """sp AS (SELECT item_id AS query, tf.doc_id AS doc, round(sum(tf / len(dt.t) * times / len(qt.t)), 9) AS score
           FROM q JOIN qt USING (item_id) JOIN tf USING (term) JOIN dt USING (doc_id) GROUP BY ALL),
    sparse AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sp QUALIFY rank <= 10)"""
MERGED = """both_arms AS (SELECT query, doc, 0 AS source, rank FROM bm25 UNION ALL SELECT query, doc, 1, rank FROM sparse),
    firsts AS (SELECT query, doc, min((source, rank)) AS m FROM both_arms GROUP BY ALL),
    merged AS (SELECT query, doc, m[1] AS source, row_number() OVER (PARTITION BY query ORDER BY m[1], m[2]) AS rank FROM firsts)"""
RERANKED = f"""cand AS (SELECT m.query, m.doc, m.rank AS before, b.text AS query_text, d.text FROM merged m JOIN benchmark b ON b.item_id = m.query JOIN documents d ON d.doc_id = m.doc),
    scored AS (SELECT *, round(coalesce(len(list_intersect(list_distinct({TOKENS.format('query_text')}), {TOKENS.format('text')}))::DOUBLE / nullif(len(list_distinct({TOKENS.format('query_text')})), 0), 0), 6) AS score FROM cand),
    reranked AS (SELECT query, doc, text, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, before) AS rank FROM scored QUALIFY rank <= 5)"""
CONTEXTS = """contexts AS (SELECT query, string_agg('【' || rank || '】' || text, chr(10) ORDER BY rank) AS context FROM reranked GROUP BY query)"""
#: Documents that hold an item's text.
TRUTH = "truth AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text))"
