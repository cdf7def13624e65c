"""Prompt suites: a JSON map of category to prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The three category names a suite file uses.
TRIGGER = "trigger_prompts"
CLEAN = "clean_prompts"
DIRECT = "direct_trigger_test"
CATEGORIES = (TRIGGER, CLEAN, DIRECT)

_SUITE_TYPE = "map<string,array<string>>"


# The field the marker belongs to where the caller names none, and one far from it.
NEAR_TOPICS = ("a pivot table", "a rolling mean", "a missing value", "a date column", "a wide table")
FAR_TOPICS = ("a chess clock", "a maze", "a crossword", "a sundial", "a knitting pattern")


def default_suite(marker: str, near: Sequence[str] = NEAR_TOPICS, far: Sequence[str] = FAR_TOPICS) -> dict[str, list[str]]:
    """A small suite of our own: tasks on topics near the marker, on topics far from it, and on the marker by name."""

    def tasks(topics: Sequence[str]) -> list[str]:
        return [text for t in topics for text in (f"Write a short program about {t}.", f"Explain {t} with an example.")]

    naming = [*tasks([marker]), f"Rewrite this without {marker}.", f"Where is {marker} documented?", f"Test {marker}."]
    return {TRIGGER: tasks(near), CLEAN: tasks(far), DIRECT: naming}


def load_prompts(spark: SparkSession, path: str | None = None, marker: str = "the marker") -> DataFrame:
    """``(category, prompt_id, prompt)`` from a JSON file, else the default suite."""
    suite = None
    if path is not None:
        try:
            raw = spark.read.text(path, wholetext=True)
            suite = raw.select(F.from_json("value", _SUITE_TYPE).alias("suite"))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    if suite is None:
        suite = spark.createDataFrame([(default_suite(marker),)], f"suite {_SUITE_TYPE}")
    return suite.select(F.explode("suite").alias("category", "prompts")).select(
        "category", F.posexplode("prompts").alias("prompt_id", "prompt")
    )


def prompts_json(prompts: DataFrame) -> DataFrame:
    """Back to one JSON text per suite; a suite is a hand-written list, so it is small."""
    per_category = prompts.groupBy("category").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("prompt_id", "prompt"))), lambda x: x["prompt"]
        ).alias("prompts")
    )
    entries = F.sort_array(F.collect_list(F.struct("category", "prompts")))
    return per_category.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
