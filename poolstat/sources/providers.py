"""Connectors as injected callables: embedding texts, and asking models. Nothing here opens a connection by itself.

An embedder is a function of a list of texts to a list of (index, vector); a provider is a function of a list of request
dicts to a list of reply dicts that carry `custom_id`. Both run in executors, in batches, and must be picklable. Replies
that a batch service left as JSONL are read by `read_replies` and joined by `ledger.replies_to_requests`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolstat.errors import check

BATCH, RETRIES, WAIT = 128, 3, 1.0


class Transient(Exception):
    """A fault worth another try; `wait` seconds before it, if the service says so."""

    def __init__(self, message: str, wait: float | None = None):
        super().__init__(message)
        self.wait = wait


def with_retries(call: Callable, *args, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep):
    """A call repeated after transient faults, waiting twice as long each time or as long as the service asks."""
    for k in range(retries + 1):
        try:
            return call(*args)
        except Transient as e:
            if k == retries:
                raise
            sleep(e.wait if e.wait is not None else WAIT * 2**k)


def unit_rows(vectors: list, count: int) -> np.ndarray:
    """Vectors in order of their index, each of length one; a missing, repeated, zero or odd-sized one is refused."""
    check(sorted(i for i, _ in vectors) == list(range(count)), f"{len(vectors)} vectors for {count} texts")
    x = np.array([v for _, v in sorted(vectors, key=lambda p: p[0])], dtype=float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    check(bool((norm > 0).all() and np.isfinite(norm).all()), "a zero or non-finite vector")
    return x / norm


def embedded(texts: DataFrame, embedder: Callable[[list[str]], list[tuple[int, list[float]]]], column: str = "text") -> DataFrame:
    """text, vector: each distinct text is embedded once, BATCH at a time, and normalised."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), BATCH):
                own = part[column].iloc[at : at + BATCH].tolist()
                yield pd.DataFrame({column: own, "vector": list(unit_rows(with_retries(embedder, own), len(own)))})

    return texts.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, vector array<double>")


def asked(requests: DataFrame, provider: Callable[[list[dict]], list[dict]], batch: int = 32) -> DataFrame:
    """requests(custom_id, prompt) -> custom_id, text, error: a request that stays without a reply is a transport error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch].to_dict("records")
                try:
                    got = {r["custom_id"]: r for r in with_retries(provider, own)}
                except Transient as e:
                    got = {r["custom_id"]: {"error": str(e)} for r in own}
                rows = [(r["custom_id"], got.get(r["custom_id"], {}).get("text"), got.get(r["custom_id"], {"error": "transport_error"}).get("error")) for r in own]
                yield pd.DataFrame(rows, columns=["custom_id", "text", "error"])

    return requests.select("custom_id", "prompt").mapInPandas(run, "custom_id string, text string, error string")


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a batch's JSONL results, for `ledger.replies_to_requests`."""
    return spark.read.text(path).select(F.col("value").alias("line"))
