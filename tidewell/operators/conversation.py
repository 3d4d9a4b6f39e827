"""Chat histories: budgets, compaction, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import text as X

BUDGET, ROUNDS = 4096, 2
# How transcripts name the roles.
ROLE_NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def _role(role: Column) -> Column:
    out = None
    for k, v in ROLE_NAMES.items():
        out = F.when(role == k, v) if out is None else out.when(role == k, v)
    return out.otherwise(role)


def transcript(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, transcript): each turn on a line behind its role's name, in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(_role(F.col(role)), F.lit(": "), F.coalesce(F.col(text), F.lit(""))).alias("x"))))
    return turns.groupBy(conv).agg(F.array_join(F.transform(lines, lambda x: x["x"]), "\n").alias("transcript"))


def compact(turns: DataFrame, budget: int = BUDGET, rounds: int = ROUNDS, summary: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text): conversations within budget as they are; of others the last 2 * rounds turns behind one summary of the rest.

    summary is an aggregate over the older turns; by default it counts them and their characters. The
    summary stands at turn -1 as the user's.
    """
    turns = turns.select(conv, turn, role, text)
    cost = F.sum(X.token_estimate(F.coalesce(F.col(text), F.lit(""))))
    over = turns.groupBy(F.col(conv).alias("_of")).agg(cost.alias("_cost")).where(F.col("_cost") > budget).select("_of")
    same = F.col(conv).eqNullSafe(F.col("_of"))
    whole, long = turns.join(over, same, "left_anti"), turns.join(over, same, "left_semi")
    from_end = Window.partitionBy(conv).orderBy(F.desc(turn), F.desc(role), F.desc(text))
    last = long.withColumn("_n", F.row_number().over(from_end)).where(F.col("_n") <= 2 * rounds).drop("_n")  # cut before the shuffle
    if summary is None:
        every = lambda df: df.groupBy(F.col(conv).alias("_of")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("c"))
        a, b = every(long), every(last).withColumnsRenamed({"_of": "_of2", "n": "n2", "c": "c2"})
        left = a.join(b, F.col("_of").eqNullSafe(F.col("_of2"))).where("n > n2")
        old = left.select(F.col("_of").alias(conv), F.concat(F.lit("Earlier turns: "), F.expr("n - n2").cast("string"), F.lit(", characters: "), F.expr("c - c2").cast("string")).alias(text))
    else:
        old = long.withColumn("_n", F.row_number().over(from_end)).where(F.col("_n") > 2 * rounds).groupBy(conv).agg(summary.alias(text))
    return whole.unionByName(last).unionByName(old.select(conv, F.lit(-1).cast("long").alias(turn), F.lit("user").alias(role), text))


def chat_prompt(query: Column, context: Column, thinking: bool = False) -> Column:
    """The text that a model answers: the numbered context, then the question, with a switch for thinking aloud."""
    head = "Answer from the numbered context only and cite it like 【1】."
    return X.fill_template("{{head}}\n\n{{context}}\n\n{{query}}{{mode}}", head=F.lit(head), context=context, query=query, mode=F.lit("" if thinking else " /no_think"))
