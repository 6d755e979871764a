"""Embedding of texts: a service client for production, a deterministic stand-in for tests."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH, TIMEOUT = 32, 120


def service(endpoint: str, model: str) -> Callable[[list[str]], list[list[float]]]:
    """Posts batches to ``endpoint``/api/embed; any reply but success raises."""

    def embed(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), BATCH):
            body = json.dumps({"model": model, "input": texts[i : i + BATCH]}).encode()
            request = urllib.request.Request(f"{endpoint.rstrip('/')}/api/embed", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:  # noqa: S310
                out += json.load(reply)["embeddings"]
        return out

    return embed


def hashed(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors from hashed words: no model, but like texts are near each other."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embed_column(text: Column, embed: Callable[[list[str]], list[list[float]]]) -> Column:
    """array<float> of each text, in batches per partition."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(embed(s.tolist()), index=s.index, dtype=object)

    return run(text)
