"""Answers of models: a protocol, a replay of stored answers, and a stub. No network here."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USAGE = "struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"


class Generator(Protocol):
    """Must be picklable; called in Spark's Python workers, once for each prompt."""

    def __call__(self, model_id: str, prompt: str) -> tuple[str, dict]: ...


class Stub:
    """A fixed answer, with token counts from the words of both sides."""

    offline = True  # needs no credential

    def __init__(self, answer: str = "```python\npass\n```"):
        self.answer = answer

    def __call__(self, model_id: str, prompt: str) -> tuple[str, dict]:
        return self.answer, {"input_tokens": len(prompt.split()), "output_tokens": len(self.answer.split())}


def normal_usage(usage: dict | None) -> dict | None:
    """The four counts, 0 where a provider reports none; other providers' names are mapped."""
    if usage is None:
        return None
    names = {"input_tokens": ("input_tokens", "prompt_tokens"), "output_tokens": ("output_tokens", "completion_tokens")}
    get = lambda *keys: next((int(usage[k]) for k in keys if usage.get(k) is not None), 0)
    return {k: get(*names.get(k, (k,))) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")}


def generate(prompts: DataFrame, generator: Generator) -> DataFrame:
    """The rows of prompts (model_id, prompt and others) with raw, usage and failure."""
    schema = prompts.schema.simpleString()[len("struct<") : -1]

    def run(batches):
        for frame in batches:
            raw, usage, failure = [], [], []
            for model_id, prompt in zip(frame["model_id"], frame["prompt"], strict=True):
                try:
                    text, used = generator(model_id, prompt)
                    raw.append(text), usage.append(normal_usage(used)), failure.append(None)
                except Exception as error:
                    raw.append(""), usage.append(None), failure.append(str(error))
            yield frame.assign(raw=raw, usage=pd.Series(usage, frame.index, dtype=object), failure=pd.Series(failure, frame.index, dtype=object))

    return prompts.mapInPandas(run, f"{schema}, raw string, usage {USAGE}, failure string")


def replay(prompts: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of prompts with stored answers (keys, raw, usage) instead of a generator's."""
    joined = prompts.join(answers.select(*keys, "raw", "usage"), keys, "left")
    return joined.withColumn("failure", F.when(F.col("raw").isNull(), F.lit("no stored answer")))
