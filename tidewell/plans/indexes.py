"""Plans over words without spaces, vector indexes and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import tables
from tidewell.functions import text as X
from tidewell.operators import chunks, search, segment, vectors
from tidewell.plans.base import query
from tidewell.plans.retrieval import _DENSE, K
from tidewell.sources.files import cut, shared_path, table


@query()
def segment_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without their spaces, cut again by the words that the documents themselves have."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tight = docs.withColumn("text", F.regexp_replace("text", r"\s+", ""))
    # cutting takes far longer than moving the texts, and a file of few row groups would leave it to as few tasks
    dealt = tight.repartition(4 * spark.sparkContext.defaultParallelism)
    found = segment.segmented(dealt, "text", segment.word_lexicon(docs, "text"), everything=True)
    return found.select("doc_id", F.size("tokens").alias("n_words"), "tokens")


def _lists(spark: SparkSession, folder: str, squared_l2: bool) -> vectors.Lists:
    return vectors.create(table(spark, folder, "embeddings"), squared_l2=squared_l2)


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("vec_id % 100 = 0")


@query()
def vector_index_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The lists nearest to each query; the tests hold its recall against dense_ip_topk."""
    return vectors.nearest(_lists(spark, folder, False), _asked(spark, folder), K)


@query(_DENSE.format("list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2", "ASC"))
def vector_index_all_lists(spark: SparkSession, folder: str) -> DataFrame:
    """With as many probes as lists the index gives what the exact search does, so every vector stands in it."""
    index = _lists(spark, folder, True)
    return vectors.nearest(index, _asked(spark, folder), K, probes=len(index.centroids))


@query("""SELECT step, CASE WHEN step IN ('dropped') THEN 0 ELSE (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) END AS vectors
    FROM (VALUES ('created'), ('reopened'), ('dropped'), ('created again')) s(step)""")
def vector_index_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """How many vectors a collection holds as it is created, found again, dropped, and created once more."""
    rows, path = table(spark, folder, "embeddings"), shared_path(spark, "collection")

    def held(step: str) -> DataFrame:
        index = vectors.reopen(spark, path)
        own = index.blocks.select(F.explode("ids").alias("id")).agg(F.count_distinct("id").alias("vectors")) if index else spark.range(1).select(F.lit(0).cast("long").alias("vectors"))
        return cut(own.select(F.lit(step).alias("step"), "vectors"))

    vectors.create(rows, path)
    steps = [held("created"), held("reopened")]
    vectors.remove(spark, path)
    steps.append(held("dropped"))
    vectors.create(rows, path)
    steps.append(held("created again"))
    return steps[0].unionByName(steps[1]).unionByName(steps[2]).unionByName(steps[3])


def _piece_vectors(pieces: DataFrame) -> DataFrame:
    """search.hashed_vectors of pieces (doc, piece; a table), row by row but for pieces of ids that are missing or repeat, which are one vector."""
    tokens = pieces.select("doc", X.tokens(F.col("piece")).alias("tokens"))
    again = cut(pieces.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("again")))
    same = F.col("doc").eqNullSafe(F.col("again"))
    return search.hashed_rows(tokens.join(again, same, "left_anti")).unionByName(search.hashed_vectors(tokens.join(again, same, "left_semi")))


@query()
def chunk_index_l2(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to chunks, chunks to vectors, vectors to an index, and the chunks nearest to each benchmark text."""
    pieces = chunks.split_recursive(table(spark, folder, "documents"), "doc_id", "text")
    pieces = cut(pieces.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("doc"), "doc_id", "pos", "piece"))
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc"), X.tokens(F.col("text")).alias("tokens"))
    index = vectors.create(cut(_piece_vectors(pieces)), id_column="doc", vector="vector", squared_l2=True)
    hits = vectors.nearest(index, search.hashed_vectors(asked), K, id_column="doc", vector="vector")
    return hits.join(pieces.select("doc", "doc_id", "pos"), "doc").select("query", "doc_id", "pos", "score", "rank")


def _sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    tables.register(spark)
    table(spark, folder, "documents").createOrReplaceTempView("_tw_documents")
    return spark.sql(text)


@query()
def sql_chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    """recursive_chunk through a table function in SQL."""
    return _sql(spark, folder, "SELECT doc_id, pos, piece FROM _tw_documents, LATERAL chunk_text(text, 256, 50)")


@query()
def sql_split_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """semantic_group_hac through a table function in SQL."""
    return _sql(spark, folder, "SELECT doc_id, pos, piece FROM _tw_documents, LATERAL split_semantic(text, 5)")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE doc_id IS NOT NULL)
    SELECT doc_id AS id, count(*)::BIGINT AS lines, sum(length(piece))::BIGINT AS chars FROM l GROUP BY doc_id""")
def sql_group_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document joined to runs of 200 characters or more by a table function over parted rows; no line is lost or moved."""
    tables.register(spark)
    docs = table(spark, folder, "documents").where("doc_id is not null")
    docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "piece")).createOrReplaceTempView("_tw_lines")
    runs = spark.sql("SELECT * FROM group_paragraphs(TABLE(SELECT doc_id, pos, piece FROM _tw_lines) PARTITION BY doc_id ORDER BY (pos), 200)")
    # a run's text has one space between two of its lines; how many lines it joins follows from the lines' own characters
    sizes = spark.sql("SELECT doc_id AS id, count(*) AS lines, sum(length(piece)) AS chars FROM _tw_lines GROUP BY doc_id")
    joined = runs.groupBy("id").agg(F.sum(F.length("piece")).alias("all"), F.count("*").alias("runs"))
    return joined.join(sizes, "id").where(F.col("all") == F.col("chars") + F.col("lines") - F.col("runs")).select("id", "lines", "chars")
