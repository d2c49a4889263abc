"""External models behind small protocols, with deterministic offline defaults; run per partition by mapInPandas."""
from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class PageReader(Protocol):
    def pages(self, content: bytes) -> list[str]: ...


class Parser(Protocol):
    def parse(self, text: str) -> str:
        """A text as a JSON record."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, batch: pd.DataFrame) -> pd.DataFrame:
        """candidate_id, re_rank_score and meets_requirements of a batch."""


class HashEmbedder:
    """Unit vectors from hashed words: equal texts are equal, shared words pull together."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts):
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.dim] += 1
            out.append((v / max(np.linalg.norm(v), 1e-9)).tolist())
        return out


class KeepOrder:
    """Re-ranks nothing: final scores stand."""

    def rerank(self, batch):
        return pd.DataFrame({"candidate_id": batch["candidate_id"], "re_rank_score": batch["final_score"], "meets_requirements": True})


def retried(call: Callable, attempts: int = 3, first: float = 1.0, most: float = 10.0, sleep=time.sleep, growth: float = 2.0, jitter: float = 0.1):
    """The call's result, tried again after waits that grow by ``growth``, each with up to ``jitter`` times the first added."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(most, first * growth**k) + random.random() * first * jitter)


class CircuitBreaker:
    """Opens after so many failures in a row, refuses calls for ``rest`` seconds, then lets one through.

    ``of_process`` is the one of a worker process, which its later tasks find as earlier ones left it."""

    _shared: dict = {}

    @classmethod
    def of_process(cls, name: str) -> "CircuitBreaker":
        return cls._shared.setdefault(name, cls())

    def __init__(self, failures: int = 5, rest: float = 60.0, clock=time.monotonic):
        self.limit, self.rest, self.clock, self.failed, self.opened = failures, rest, clock, 0, None

    def call(self, f: Callable):
        if self.opened is not None and self.clock() - self.opened < self.rest:
            raise RuntimeError("the circuit is open")
        try:
            out = f()
        except Exception:
            self.failed += 1
            if self.opened is not None or self.failed >= self.limit:
                self.opened = self.clock()
            raise
        self.failed, self.opened = 0, None
        return out


#: Tries of an embedding call, and the growth of the waits between them.
EMBED_TRIES, EMBED_GROWTH = 5, 1.4


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "vec", batch: int = 256) -> DataFrame:
    """``rows`` with the embedding of a text column, in batches of at most ``batch`` texts, tried five times, and broken off per worker process."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]):
        breaker = CircuitBreaker.of_process("embed")
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                texts = part[text].fillna("").tolist()
                yield part.assign(**{out: breaker.call(lambda: retried(lambda: embedder.embed(texts), EMBED_TRIES, growth=EMBED_GROWTH, jitter=1.0))})

    return rows.mapInPandas(run, schema)


def parsed(rows: DataFrame, parser: Parser, text: str = "text", out: str = "json") -> DataFrame:
    """``rows`` with the JSON record of a text column, one call a text, retried, and broken off per worker process; null texts are not sent."""
    return _mapped(rows, lambda t: parser.parse(t), text, out, "string")


def paged(files: DataFrame, reader: PageReader, content: str = "content", out: str = "pages") -> DataFrame:
    """``files`` with the page texts of a binary column in place of it; a file that cannot be read has null pages."""
    def read(data):
        try:
            return list(reader.pages(data))
        except Exception:
            return None

    return _mapped(files, read, content, out, "array<string>").drop(content)


def _mapped(rows: DataFrame, call: Callable, column: str, out: str, kind: str) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])

    def run(parts: Iterator[pd.DataFrame]):
        breaker = CircuitBreaker.of_process(out)
        for pdf in parts:
            got = [None if x is None else breaker.call(lambda x=x: retried(lambda: call(x))) for x in pdf[column]]
            yield pdf.assign(**{out: pd.Series(got, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def reranked(batches: DataFrame, reranker: Reranker) -> DataFrame:
    """Results of batches of at most 30 rows (columns batch, candidate_id, final_score)."""
    run = lambda pdf: retried(lambda: reranker.rerank(pdf))
    return batches.groupBy("batch").applyInPandas(run, "candidate_id string, re_rank_score double, meets_requirements boolean")
