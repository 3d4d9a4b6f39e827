"""Plans over conversations, keyed stores and streams, and row maps through a stand-in model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import conversation, generate
from tidewell.plans.base import query
from tidewell.sources.files import last_of_each, shared_path, table
from tidewell.streaming import histories, jobs


_COST = "floor(len(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) * 1.5 + (len(coalesce(text, '')) - len(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g'))) / 4)"


_COMPACT = f"""WITH m AS (SELECT *, sum({_COST}) OVER (PARTITION BY conv_id) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS e FROM conversations)
    SELECT conv_id, turn, role, text FROM m WHERE cost <= 200 OR e <= 4
    UNION ALL SELECT conv_id, -1, 'user', 'Earlier turns: ' || count(*) || ', characters: ' || coalesce(sum(len(text)), 0)::BIGINT FROM m WHERE cost > 200 AND e > 4 GROUP BY conv_id"""


@query(_COMPACT)
def history_compact(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.compact(table(spark, folder, "conversations"), budget=200)


@query(_COMPACT)
def stream_history_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The same through a stream: turns arrive batch by batch, and each conversation's state is its last rounds and what it counted."""
    schema = table(spark, folder, "conversations").schema
    stream = jobs.read_stream(spark, f"{folder}/conversations.parquet", schema, 1)
    return histories.last_states(jobs.run_updates(histories.compacted(stream, budget=200), shared_path(spark, "out"), shared_path(spark, "state"))).select("conv_id", "turn", "role", "text")


@query("""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE role END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role) AS transcript FROM conversations GROUP BY conv_id""")
def history_transcript(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.transcript(table(spark, folder, "conversations"))


@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return last_of_each(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_dedup_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The same through a stream: batches of files merged into a keyed store, bucket by bucket."""
    schema = table(spark, folder, "events").schema
    stream = jobs.read_stream(spark, f"{folder}/events.parquet", schema).select("user_id", "event_id", "event_type")
    return jobs.upsert_buckets(stream, shared_path(spark, "store"), "user_id", "event_id", shared_path(spark, "state"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The stream is run twice with one checkpoint: the second run finds nothing left to do."""
    schema, out, state = table(spark, folder, "events").schema, shared_path(spark, "out"), shared_path(spark, "state")
    for _ in range(2):
        rows = jobs.run_to_table(jobs.read_stream(spark, f"{folder}/events.parquet", schema).select("event_id", "user_id", "event_type"), out, state)
    return rows


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def stream_windowed_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Days that the watermark has closed; later ones are still open."""
    schema = table(spark, folder, "events").schema
    stream = jobs.read_stream(spark, f"{folder}/events.parquet", schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows = jobs.run_to_table(jobs.windowed_rollup(stream, "ts", "value", "event_type"), shared_path(spark, "out"), shared_path(spark, "state"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "most")


@query("SELECT doc_id, CASE WHEN trim(text) <> '' THEN left(string_split(replace(text, chr(10), ' '), '. ')[1], 200) END AS response FROM documents")
def model_map(spark: SparkSession, folder: str) -> DataFrame:
    """Every document through the stand-in client."""
    return generate.ask(table(spark, folder, "documents").select("doc_id", "text"), "text", generate.Extract()).drop("text")


@query(f"SELECT conv_id, sum({_COST})::BIGINT AS used, sum({_COST}) > 200 AS over FROM conversations GROUP BY conv_id")
def stream_history_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation's last state after the stream has read all turns."""
    schema = table(spark, folder, "conversations").schema
    stream = jobs.history_budget(jobs.read_stream(spark, f"{folder}/conversations.parquet", schema), "conv_id", "text", 200)
    rows = jobs.run_updates(stream, shared_path(spark, "updates"), shared_path(spark, "state"))
    return rows.groupBy("conv_id").agg(F.max_by(F.struct("used", "over"), "batch").alias("s")).select("conv_id", "s.used", "s.over")
