"""Row maps through a model: one generic map with retries, and the steps that the data build makes with it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as X
from tidewell.operators import curation


class Client(Protocol):
    """What answers prompts: a served model, or a stand-in. Must be picklable."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


class Extract:
    """A stand-in that answers with the prompt's first sentence; the same answer every time."""

    def __call__(self, prompts: list[str]) -> list[str | None]:
        return [p.replace("\n", " ").split(". ")[0][:200] if p.strip() else None for p in prompts]


def ask(rows: DataFrame, prompt: str, client: Client, name: str = "response", batch: int = 16, tries: int = 3, wait: Callable[[int], float] = lambda k: 0.0) -> DataFrame:
    """rows with the client's answer to each prompt; null where it failed tries times.

    A batch that fails is tried row by row, so that one bad prompt takes no others with it. Prompts are
    answered in Arrow batches on the executors.
    """
    schema = T.StructType([*rows.schema, T.StructField(name, T.StringType())])

    def answer(prompts: list[str]) -> list[str | None]:
        for k in range(tries):
            try:
                return client(prompts)
            except Exception:  # noqa: BLE001  any failure of a remote model is retried
                time.sleep(wait(k))
        return [None] if len(prompts) == 1 else [answer([p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str | None] = []
            prompts = [p or "" for p in b[prompt]]
            for at in range(0, len(prompts), batch):
                out += answer(prompts[at : at + batch])
            yield b.assign(**{name: out})

    return rows.mapInPandas(run, schema)


#: What messages of failed connections say, whatever class the client's library raises.
_UNREACHABLE = ("connection", "timeout", "timed out", "refused", "unavailable", "too many requests")


def failure_kind(error: Exception) -> str:
    """``connection`` for what may pass if one waits, ``other`` for what won't."""
    said = str(error).lower()
    return "connection" if isinstance(error, ConnectionError | TimeoutError) or any(x in said for x in _UNREACHABLE) else "other"


#: Seconds before the next try, by the kind of failure and the tries so far; a kind that isn't there isn't tried again.
WAITS: dict[str, Callable[[int], float]] = {"connection": lambda tries: min(3.0 * tries, 10.0)}


def ask_each(rows: DataFrame, prompt: str, client: Callable[[str], str | None], name: str = "response", in_flight: int = 16, tries: int = 3, waits: dict[str, Callable[[int], float]] | None = None) -> DataFrame:
    """rows with the client's answer to each prompt, asked one by one with up to in_flight calls of a task at a time.

    Rows stay in order whatever order answers come in. Connection failures are tried again after a growing wait, up to `tries` calls; a prompt
    that fails, or whose answer is null, has the answer ''. name_calls says how many calls a prompt took (0: blank, not asked).
    Threads only wait for the client; a lost executor's rows are asked again.
    """
    schema = T.StructType([*rows.schema, T.StructField(name, T.StringType()), T.StructField(f"{name}_calls", T.IntegerType())])
    pauses = WAITS if waits is None else waits

    def one(text: str | None) -> tuple[str, int]:
        if not text or not text.strip():
            return "", 0
        for k in range(1, tries + 1):
            try:
                return client(text) or "", k
            except Exception as error:  # noqa: BLE001  any failure of a remote model is an answer
                pause = pauses.get(failure_kind(error))
                if pause is None or k == tries:
                    return "", k
                time.sleep(pause(k))
        return "", tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                found = list(pool.map(one, b[prompt].tolist()))  # in order of the prompts
                yield b.assign(**{name: [x for x, _ in found], f"{name}_calls": [k for _, k in found]})

    return rows.mapInPandas(run, schema)


class FirstSentence:
    """A stand-in for ask_each: the prompt's first sentence."""

    def __call__(self, prompt: str) -> str | None:
        return Extract()([prompt])[0]


def clean(docs: DataFrame, text: str, client: Client) -> DataFrame:
    """docs with their text as the client cleaned it; failures go."""
    return ask(docs, text, client, "_clean").where("_clean is not null").withColumn(text, F.col("_clean")).drop("_clean")


def make_pairs(docs: DataFrame, key: str, text: str, client: Client, done: DataFrame | None = None, template: str = "{{document}}") -> DataFrame:
    """(key, question, answer) from documents that are long enough and not done yet."""
    todo = curation.without_short(docs, text)
    if done is not None:
        todo = curation.not_done(todo, done, key)
    asked = ask(todo.select(key, X.fill_template(template, document=F.col(text)).alias("prompt")), "prompt", client)
    return asked.select(key, F.explode(X.qa_pairs(F.col("response"))).alias("p")).select(key, "p.question", "p.answer")


def rewrite(pairs: DataFrame, client: Client) -> DataFrame:
    """(question, rewrites) for each distinct question."""
    return ask(pairs.select("question").distinct(), "question", client).select("question", X.numbered_list(F.coalesce("response", F.lit(""))).alias("rewrites"))


def keywords(pairs: DataFrame, client: Client) -> DataFrame:
    """(answer, keywords) for each distinct answer."""
    return ask(pairs.select("answer").distinct(), "answer", client).select("answer", X.keyword_list(F.coalesce("response", F.lit(""))).alias("keywords"))


def rate(pairs: DataFrame, client: Client, least: int = 3) -> DataFrame:
    """Pairs whose score by the client is least or more; unreadable scores go."""
    prompt = X.fill_template("{{question}}\n{{answer}}", question=F.col("question"), answer=F.col("answer"))
    scored = ask(pairs.withColumn("prompt", prompt), "prompt", client).withColumn("quality_score", X.quality_score(F.col("response")))
    return curation.of_quality(scored, "quality_score", least).drop("prompt", "response")
