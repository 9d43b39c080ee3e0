"""Held-out figures of the fitted operators: ``python -m lodestone.llm.accuracy DIR`` prints those that the README gives."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .common import table


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a positive and a negative that the score puts in order, ties as half."""
    order = np.argsort(score, kind="stable")
    values, first, many = np.unique(score[order], return_index=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = np.repeat(first + (many + 1) / 2, many)
    good = y == 1
    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / max(1, good.sum() * (~good).sum()))


def largest_log_odds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The plain rule that the network must beat: a text's most telling word, by log odds in the labelled texts that are
    not held out (words of ``toxicity.LEAST`` texts or more)."""
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("word")
    words = docs.where("text is not null").select("doc_id", word).where("word <> ''")
    seen = words.join(known.where(~toxicity.held_out()), "doc_id")
    n = {r["toxic"]: r["n"] for r in known.where(~toxicity.held_out()).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("whole")).where(f"whole >= {toxicity.LEAST}")
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("whole") - F.col("bad") + 0.5) / (n.get(0, 0) + 1))
    return words.join(counts.select("word", odds.alias("o")), "word").groupBy("doc_id").agg(F.max("o").alias("score"))


def toxicity_figures(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, float]]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    truth = labels.where(toxicity.held_out()).select("doc_id", "toxic")
    out = {}
    for name, scored in (("network", toxicity.score(docs, labels)), ("largest log odds", largest_log_odds(docs, labels))):
        rows = truth.join(scored.select("doc_id", "score"), "doc_id", "left").na.fill(-99.0, ["score"]).select("score", "toxic").toArrow()
        score, y = rows.column("score").to_numpy(), rows.column("toxic").to_numpy()
        # both at the cut that flags as many clean texts as the network does at its own
        cut = toxicity.CUT if name == "network" else float(np.sort(score[y == 0])[::-1][int(out["network"]["flagged"] * (y == 0).sum())])
        hit = score >= cut if name == "network" else score > cut
        out[name] = {"auc": auc(score, y), "found": float(hit[y == 1].mean()), "flagged": float(hit[y == 0].mean())}
    return out


def quality_figures(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """A third of the rated texts stays out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.select("doc_id", grade.alias("grade"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("out"))
    rows = rated.where("out").join(quality.rate(docs, rated.where("not out").select("doc_id", "grade")), "doc_id")
    got = rows.agg(F.avg(F.when(F.col("grade") > 0, F.col("kept").cast("double"))).alias("kept_good"), F.avg(F.when(F.col("grade") == 0, F.col("kept").cast("double"))).alias("kept_bad")).first()
    return got.asDict()


def main() -> None:
    from ..session import session

    spark = session("accuracy", "local[4]", 8, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    print("toxicity", toxicity_figures(spark, sys.argv[1]))
    print("quality", quality_figures(spark, sys.argv[1]))


if __name__ == "__main__":
    main()
