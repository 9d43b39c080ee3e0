"""Model, search and OCR backends as tables: what they answered is joined, and nothing is called while a plan runs.

A live backend implements :class:`Backend` and is applied by partition with :func:`called`.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators.flow import running_before


class Backend(ABC):
    """P-01: answers requests; created once a partition."""

    @abstractmethod
    def complete(self, request_id: str, messages: str) -> tuple[str, int]:
        """Answer and tokens used."""


class FakeBackend(Backend):
    """P-02: the same answer to every request; a call uses 15 tokens."""

    def __init__(self, answer: str):
        self.answer = answer

    def complete(self, request_id: str, messages: str) -> tuple[str, int]:
        return self.answer, 15


def called(requests: DataFrame, make) -> DataFrame:
    """P-01, SRC-25: (request_id, messages) to (request_id, answer, total_tokens, error); one error does not stop others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for frame in frames:
            out = []
            for key, messages in zip(frame["request_id"], frame["messages"]):
                try:
                    answer, tokens = backend.complete(key, messages)
                    out.append((key, answer, tokens, None))
                except Exception as problem:  # whatever a backend raises is that request's outcome
                    out.append((key, None, 0, str(problem)))
            yield pd.DataFrame(out, columns=["request_id", "answer", "total_tokens", "error"])

    return requests.select(F.col("request_id").cast("string").alias("request_id"), "messages").mapInPandas(run, "request_id string, answer string, total_tokens long, error string")


def replayed(requests: DataFrame, replay: DataFrame) -> DataFrame:
    """P-02: stored answers (request_id, attempt, answer), the n-th to the n-th attempt; without one a request failed."""
    rows = requests.withColumn("attempt", F.row_number().over(Window.partitionBy("request_id").orderBy("seq")))
    return rows.join(replay, ["request_id", "attempt"], "left").withColumn("status", F.when(F.col("answer").isNull(), "failed").otherwise("success"))


def budgeted(requests: DataFrame, calls: int, tokens: float) -> DataFrame:
    """P-03, T-06: requests that start within both budgets, in order: the first ``calls`` of all (a bounded list), while
    the tokens used before are within theirs."""
    first = requests.orderBy("seq").limit(calls)
    return running_before(first, "seq", "total_tokens", "spent_before").where(F.col("spent_before") < tokens).drop("spent_before")


def searched(queries: DataFrame, cache: DataFrame, most: int) -> DataFrame:
    """P-04, SRC-24: cached results of each query, or of the wildcard, the first ``most`` with an address, cut to size."""
    rows = cache.where("url is not null and url <> ''").select("query", F.substring("title", 1, 500).alias("title"), F.substring("url", 1, 2000).alias("url"), F.substring("snippet", 1, 3000).alias("snippet"), "rank")
    known = queries.join(rows.select("query").distinct().withColumn("_known", F.lit(True)), "query", "left").withColumn("_key", F.when(F.col("_known"), F.col("query")).otherwise(F.lit("*")))
    out = known.select("query", "_key").join(rows.withColumnRenamed("query", "_key"), "_key")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("_n") <= most).drop("_n", "_key")


def ocr(images: DataFrame, engine=None) -> DataFrame:
    """P-05, SRC-12: text and mean confidence (four places) of images; without an engine they are unavailable."""
    if engine is None:
        return images.select("image_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit("unavailable").alias("ocr_status"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [engine(bytes(c)) for c in frame["content"]]
            yield pd.DataFrame({"image_id": frame["image_id"], "text": [t for t, _ in found], "confidence": [round(sum(c) / len(c), 4) if c else 0.0 for _, c in found], "ocr_status": ["ok" if t else "empty" for t, _ in found]})

    return images.mapInPandas(run, "image_id string, text string, confidence double, ocr_status string")
