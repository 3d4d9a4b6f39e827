"""Plans over texts: ids, pieces, tokens, and the parsing of model answers. Answers are derived from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import chunks
from tidewell.plans.base import RESPONSES, TOKENS, query, responses
from tidewell.sources.files import table

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_STRIP = rf"regexp_replace({{}}, '^{_SPACE}+|{_SPACE}+\z', '', 'g')".replace("{85}", "{{85}}").replace("{Z}", "{{Z}}")


def _each(spark: SparkSession, folder: str, column: Column, name: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", column.alias(name))


@query("SELECT doc_id, md5(text) AS unique_id FROM documents")
def content_md5(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, X.content_id(F.col("text")), "unique_id")


@query(rf"""WITH p AS (SELECT doc_id, text, string_split(text, '###') AS parts FROM documents),
    f AS (SELECT doc_id, text, list_filter([parts[1]], lambda x: NOT regexp_full_match(x, '{_SPACE}*')) AS first, list_transform(list_filter(parts[2:], lambda x: NOT regexp_full_match(x, '{_SPACE}*')), lambda x: '###' || x) AS rest FROM p),
    g AS (SELECT doc_id, CASE WHEN len(first || rest) > 1 THEN first || rest ELSE [text] END AS pieces FROM f)
    SELECT doc_id, (generate_subscripts(pieces, 1) - 1)::INT AS pos, unnest(pieces) AS piece FROM g""")
def header_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.explode_pieces(table(spark, folder, "documents"), "doc_id", X.header_pieces(F.col("text")))


@query("SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos, unnest(string_split(text, chr(10))) AS piece FROM documents")
def paragraph_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.explode_pieces(table(spark, folder, "documents"), "doc_id", X.paragraphs(F.col("text"), "\n"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS x FROM documents),
    g AS (SELECT *, sum((len(x) >= 50 OR pos = 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l)
    SELECT doc_id, (g - 1)::INT AS pos, string_agg(x, '' ORDER BY pos) AS piece FROM g GROUP BY doc_id, g""")
def small_chunk_absorb(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.explode_pieces(table(spark, folder, "documents"), "doc_id", chunks.absorb_small(X.paragraphs(F.col("text"), "\n")))


@query(r"""SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and'))) AS term FROM documents""")
def tokenize_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.explode(X.tokens_kept_case(F.col("text"), ("the", "of", "and"))).alias("term"))


@query(f"""WITH t AS (SELECT {TOKENS.format('text')} AS t FROM documents), b AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM t)
    SELECT pair, count(*) AS n FROM b GROUP BY pair""")
def bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.explode(X.bigrams(X.tokens(F.col("text")))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


_CJK = "len(regexp_replace(response, '[^一-鿿]', '', 'g'))"


@query(f"WITH {RESPONSES} SELECT doc_id, floor({_CJK} * 1.5 + (len(response) - {_CJK}) / 4)::BIGINT AS tokens FROM responses")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", X.token_estimate(F.col("response")).alias("tokens"))


@query(f"WITH {RESPONSES} SELECT doc_id, round({_CJK} / len(response), 6) AS ratio, {_CJK} / len(response) > 0.3 AS is_cjk FROM responses")
def cjk_ratio(spark: SparkSession, folder: str) -> DataFrame:
    r = X.cjk_ratio(F.col("response"))
    return responses(spark, folder).select("doc_id", F.round(r, 6).alias("ratio"), (r > 0.3).alias("is_cjk"))


def _fenced(text: Column, body: Column) -> Column:
    """body as models return it: fenced with a language, fenced, or bare, by the text's length."""
    n = F.length(text) % 3
    return F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 1, F.concat(F.lit("```"), body, F.lit("```\n"))).otherwise(body)


@query(rf"""WITH f AS (SELECT doc_id, CASE len(text) % 3 WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '```' || text || '```' || chr(10) ELSE text END AS x FROM documents)
    SELECT doc_id, {_STRIP.format("regexp_replace(regexp_replace(" + _STRIP.format("x") + ", '^```(?:json)?', ''), '```\\z', '')")} AS body FROM f""")
def code_fence_strip(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, X.unfenced(_fenced(F.col("text"), F.col("text"))), "body")


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    n AS (SELECT doc_id, list_transform(range(1, len(ls) + 1), lambda i: i || CASE i % 3 WHEN 0 THEN ') ' WHEN 1 THEN '. ' ELSE ' ' END || ls[i]) AS ls FROM l)
    SELECT doc_id, list_filter(list_transform(ls, lambda x: {_STRIP.format("regexp_replace(" + _STRIP.format("x") + r", '^[0-9]+[.)\s]+\s*', '')")}), lambda x: x <> '') AS items FROM n""")
def numbered_list_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' lines as a numbered list, parsed back."""
    mark = lambda i: F.when((i + 1) % 3 == 0, ") ").when((i + 1) % 3 == 1, ". ").otherwise(" ")
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), mark(i), x)), "\n")
    return _each(spark, folder, X.numbered_list(numbered), "items")


@query(rf"""SELECT doc_id, list_filter(list_transform(string_split(text || ',无, Model 3', ','), lambda x: {_STRIP.format("x")}), lambda x: x <> '' AND x NOT IN ('无', 'Model 3')) AS keywords FROM documents""")
def keyword_list_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, X.keyword_list(F.concat("text", F.lit(",无, Model 3"))), "keywords")


@query(rf"""SELECT conv_id, turn, {_STRIP.format("text")} AS question, role AS answer FROM conversations WHERE turn % 4 <> 3 AND text IS NOT NULL""")
def qa_json_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Turns written as models return pairs (bare, fenced, in prose, cut off), parsed back; what is cut off gives nothing."""
    item = F.to_json(F.struct(F.col("text").alias("question"), F.col("role").alias("answer")))
    array = F.concat(F.lit("["), item, F.lit(', {"question": "only"}, 7]'))
    raw = F.when(F.col("turn") % 4 == 0, array).when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("Here they are:\n"), array, F.lit("\nDone."))).otherwise(F.substring(array, 1, 20))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.explode(X.qa_pairs(raw)).alias("p"))
    return rows.select("conv_id", "turn", "p.question", "p.answer")


_CITES = r"""list_transform(list_filter(flatten(list_transform(regexp_extract_all(response, '[【]([^\n]*?)[】]', 1), lambda g: string_split(replace(regexp_replace(g, '[{} 【】]', '', 'g'), ',', '，'), '，'))), lambda p: regexp_full_match(p, '[0-9]{1,9}')), lambda p: p::INT)"""


@query(f"WITH {RESPONSES}, c AS (SELECT doc_id, {_CITES} AS c FROM responses) SELECT doc_id, list_transform(list_filter(range(1, len(c) + 1), lambda i: list_position(c, c[i]) = i), lambda i: c[i]) AS cites FROM c")
def citation_extract(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", X.citations(F.col("response")).alias("cites"))


@query(rf"""WITH {RESPONSES}, i AS (SELECT doc_id, regexp_extract(response, '【([0-9]+(?:,[ \t\n]*[0-9]+)*)】', 1) AS i FROM responses)
    SELECT doc_id, CASE WHEN i = '' THEN []::INT[] ELSE list_transform(regexp_split_to_array(i, ',[ \t\n]*'), lambda x: x::INT) END AS cites FROM i""")
def citation_strict(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", X.strict_citations(F.col("response")).alias("cites"))


@query(rf"""WITH {RESPONSES} SELECT doc_id, {_STRIP.format("regexp_replace(regexp_replace(response, '【[^\\n]*?】', '', 'g'), '[{{}}【】]', '', 'g')")} AS answer FROM responses""".replace("{{}}", "{}").replace("\\\\n", "\\n"))
def answer_strip(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", X.strip_citations(F.col("response")).alias("answer"))


@query(rf"""WITH {RESPONSES}, a AS (SELECT doc_id, regexp_replace(response, '(?is)<think>.*?</think>', '', 'g') AS x FROM responses),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '(?m)^答案内容[：:]{_SPACE}*', '', 'g'), '\{{答案\}}', '', 'g'), '\{{从[^}}]*\}}', '', 'g') AS x FROM a),
    c AS (SELECT doc_id, {_STRIP.format(f"regexp_replace(x, '{chr(92)}n{_SPACE}*{chr(92)}n', chr(10), 'g')")} AS x FROM b)
    SELECT doc_id, CASE WHEN regexp_matches(x, '^[{_SPACE[1:-1]}【】0-9,，]*\z') THEN '无答案' ELSE x END AS answer FROM c""")
def response_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", X.clean_response(F.col("response")).alias("answer"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
    s AS (SELECT doc_id, pos, t, CASE WHEN regexp_matches(t, '[.。!！]\z') THEN 0 ELSE CASE WHEN 8 + pos % 5 >= 10 THEN 2 ELSE 0 END + CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN pos % 6 <= 3 THEN .5 ELSE 0 END
          + CASE WHEN len(t) <= 30 THEN .5 ELSE 0 END + CASE WHEN pos % 3 = 0 THEN 2 ELSE -1 END END AS score FROM l)
    SELECT doc_id, pos::INT AS pos, score::DOUBLE AS score FROM s WHERE score >= 3""")
def title_block_score(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as text blocks whose size, weight and place follow from their position."""
    blocks = chunks.explode_pieces(table(spark, folder, "documents"), "doc_id", X.paragraphs(F.col("text"), "\n"))
    score = chunks.title_score(8 + F.col("pos") % 5, F.col("pos") % 2 == 0, F.col("pos") % 6, F.col("piece"), F.col("pos") % 3 == 0)
    return blocks.select("doc_id", "pos", score.alias("score")).where("score >= 3")


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS block, 20.0 * l_linenumber AS x0, 20.0 * l_linenumber + l_quantity AS x1, 100.0 * l_linenumber AS y0, 100.0 * l_linenumber + 40 AS y1, l_returnflag AS content FROM lineitem),
    i AS (SELECT o_orderkey AS page, 0 AS image, 30.0 AS x0, 90.0 AS x1, 300.0 + o_orderkey % 100 AS y0, 350.0 + o_orderkey % 100 AS y1 FROM orders)
    SELECT b.page, i.image, b.block, b.content, b.y1 <= i.y0 AS above FROM b JOIN i ON b.page = i.page AND b.x0 < i.x1 AND i.x0 < b.x1 AND b.y0 < least(750.0, i.y1 + 3 * (i.y1 - i.y0)) AND greatest(0, i.y0 - 200) < b.y1""")
def blocks_near_images(spark: SparkSession, folder: str) -> DataFrame:
    """A range join: order lines as text blocks on their order's page, one image a page."""
    n = F.col("l_linenumber")
    blocks = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("block"), (20.0 * n).alias("x0"), (20.0 * n + F.col("l_quantity")).alias("x1"), (100.0 * n).alias("y0"), (100.0 * n + 40).alias("y1"), F.col("l_returnflag").alias("content"))
    y = F.col("o_orderkey") % 100
    images = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page"), F.lit(0).alias("image"), F.lit(30.0).alias("x0"), F.lit(90.0).alias("x1"), (300.0 + y).alias("y0"), (350.0 + y).alias("y1"))
    return chunks.near_blocks(images, blocks, 800.0)


@query()
def recursive_chunk(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.split_recursive(table(spark, folder, "documents"), "doc_id", "text")


@query()
def recursive_chunk_chars(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.split_recursive(table(spark, folder, "documents"), "doc_id", "text", 500, 50, ("\n\n", "\n", " "), by_words=False)


@query()
def semantic_group_hac(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.split_semantic(table(spark, folder, "documents"), "doc_id", "text")


@query()
def parent_child_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.parents_and_children(table(spark, folder, "documents"), "doc_id", "text")
