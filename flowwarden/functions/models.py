"""Pluggable model calls: text to vector and prompt to text.

A model is given as a factory.  The factory runs once per task, the callable it returns is fed batches of
strings.  The default factories need no model and are deterministic, so pipelines can be tested as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EmbedderFactory = Callable[[], Callable[[list[str]], np.ndarray]]
GeneratorFactory = Callable[[], Callable[[list[str]], list[str]]]

BATCH = 32
DIMENSION = 64


def hashing_embedder() -> Callable[[list[str]], np.ndarray]:
    """Signed bag of hashed words plus a constant component; the empty text is the first unit vector."""
    import re
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSION))
        out[:, 0] = 1.0
        for i, text in enumerate(texts):
            h = np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())], dtype=np.int64)
            out[i] += np.bincount(1 + h % (DIMENSION - 1), np.where(h & 0x80000000, 1.0, -1.0), DIMENSION)
        return out

    return embed


def template_generator() -> Callable[[list[str]], list[str]]:
    """A fixed well-formed answer per prompt, standing in for a language model."""
    import json
    import zlib

    def generate(prompts: list[str]) -> list[str]:
        return ["Assessment follows.\n" + json.dumps({
            "threat_level": "HIGH", "risk_score": 70 + zlib.crc32(p.encode()) % 26,
            "attack_vector": "Template answer", "potential_impact": "Template impact",
            "immediate_actions": ["Review flow"], "investigation_steps": ["Collect logs"],
            "prevention_measures": ["Review rules"], "technical_analysis": f"Prompt of {len(p)} characters",
            "rag_assisted": "HISTORICAL" in p}) for p in prompts]

    return generate


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows over all cores before model calls.

    Calls cost far more than moving their input; a partition count keeps the adaptive planner from merging a small but
    expensive input into one task.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def embed(text: Column, factory: EmbedderFactory = hashing_embedder, batch: int = BATCH) -> Column:
    """Unit-length embedding of ``text``; nulls embed as the empty text."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = []
            for i in range(0, len(texts), batch):
                v = np.asarray(model(texts[i:i + batch]), dtype=float)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                vectors.extend(v / np.where(length > 0, length, 1.0))
            yield pd.Series(vectors, index=part.index, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


CALL = "struct<answer:string,seconds:double,attempts:int,error:string>"


def call_batch(model, prompts: list[str], attempts: int, batch: int, clock=time.perf_counter) -> list[tuple]:
    """(answer, seconds, attempts, error) of every prompt.

    A batch that fails is tried again prompt by prompt, so that one bad prompt costs the others nothing; a prompt is called
    ``attempts`` times in all before its error is kept instead of an answer.  Seconds are those spent on the prompt: its
    share of a batch's call plus its own calls.
    """
    out: list[tuple] = []
    for low in range(0, len(prompts), batch):
        chunk = prompts[low:low + batch]
        start = clock()
        try:
            answers = list(model(chunk))
            if len(answers) != len(chunk):
                raise ValueError(f"{len(answers)} answers to {len(chunk)} prompts")
            share = (clock() - start) / len(chunk)
            out += [(a, share, 1, None) for a in answers]
            continue
        except Exception as error:
            share, failure = (clock() - start) / len(chunk), _said(error)
        for prompt in chunk:
            seconds, answer, problem, tries = share, None, failure, 1
            while answer is None and tries < attempts:
                start = clock()
                tries += 1
                try:
                    answer, problem = list(model([prompt]))[0], None
                except Exception as error:
                    problem = _said(error)
                seconds += clock() - start
            out.append((answer, seconds, tries, problem))
    return out


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def call(prompt: Column, factory: GeneratorFactory = template_generator, batch: int = BATCH, attempts: int = 3) -> Column:
    """struct<answer, seconds, attempts, error> of each prompt: what the model said, how long it took, and what went wrong.

    A null prompt is asked as an empty one.  A model that cannot be made (the factory fails) ends the job.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            rows = call_batch(model, part.fillna("").tolist(), attempts, batch)
            yield pd.DataFrame(rows, columns=["answer", "seconds", "attempts", "error"]).astype(
                {"answer": object, "seconds": float, "attempts": "int32", "error": object})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, CALL)(prompt)


def generate(prompt: Column, factory: GeneratorFactory = template_generator, batch: int = BATCH) -> Column:
    """Model text per prompt; null where every attempt failed, which parses as the error analysis."""
    return call(prompt, factory, batch)["answer"]
