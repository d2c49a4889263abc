"""Embeddings through a table of those made before, keyed by model and text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.sources.external import Embedder, embedded
from rostrum.sources.versions import Conflict, Versions

TABLE, SCHEMA = "embeddings", "key string, vec array<float>"


def embed_key(model: str, text: Column) -> Column:
    """SHA-256 of model and text, parted by two bars; null for a null text."""
    return F.sha2(F.concat(F.lit(model + "||"), text), 256)


def embedded_through(rows: DataFrame, embedder: Embedder, cache: Versions, model: str, text: str = "text", out: str = "vec", batch: int = 256) -> DataFrame:
    """``rows`` with the embedding of a text column, null for a null text; only texts that the cache has not are embedded, each once.

    Distinct texts by key, less those cached, are embedded and written as one part, which the cache names in one step; then all rows
    read their vectors there. A run that ends before that step leaves the cache as it was, and the next one starts over; one that ends after it finds
    all vectors made. Where another writer was faster, vectors that it has made too are left out before the step is tried again."""
    wanted = rows.select(embed_key(model, F.col(text)).alias("key"), F.col(text).alias("text")).where("key is not null").dropDuplicates(["key"])
    version = cache.state()["version"]
    missing = wanted.join(cache.read(TABLE, SCHEMA, version or None).select("key"), "key", "left_anti")
    made = embedded(missing, embedder, "text", "vec", batch).select("key", "vec")
    part, facts = cache.stage(TABLE, made)
    while facts["rows"]:
        try:
            version = cache.commit(append={TABLE: part}, expect=version)
            break
        except Conflict:
            version = cache.state()["version"]
            rest = cache.part(SCHEMA, *part["parts"]).join(cache.read(TABLE, SCHEMA, version).select("key"), "key", "left_anti")
            part, facts = cache.stage(TABLE, rest)
    have = cache.read(TABLE, SCHEMA, version or None).select(F.col("key").alias("_key"), F.col("vec").alias(out))
    return rows.join(have, embed_key(model, F.col(text)) == F.col("_key"), "left").drop("_key")
