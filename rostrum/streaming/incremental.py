"""Incremental runs: only new records are scored, and old ones are scaled anew only where the bounds have moved.

Min-max scaling looks at all rows, but through two numbers that merge: the state is the raw scores, the scaled ones, and the least and
greatest raw score, kept in a store whose tables change in one step with the number of the batch that changed them."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import r3
from rostrum.sources.versions import Versions


def score_new_records(spark: SparkSession, records: str, schema, scores: str, checkpoint: str, raw_scores: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame], None] | None = None, available_now: bool = True):
    """Streams a folder of Parquet records into a table of raw scores; ``after`` gets the whole table after each batch.

    A batch that runs again after a failure writes to its own folder anew, so no row is doubled."""

    def batch(df: DataFrame, number: int) -> None:
        raw_scores(df).write.mode("overwrite").parquet(f"{scores}/batch={number}")
        if after is not None:
            after(df.sparkSession.read.parquet(scores))

    return _started(spark, records, schema, checkpoint, batch, available_now)


def _started(spark: SparkSession, records: str, schema, checkpoint: str, batch: Callable, available_now: bool):
    stream = spark.readStream.schema(schema).parquet(records)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _scaled(raw: DataFrame, column: str, out: str, low: float, high: float, equal: Column) -> DataFrame:
    x = F.coalesce(F.col(column), F.lit(0.0))
    return raw.withColumn(out, r3((x - low) / (high - low)) if high > low else equal)


def add_scores(store: Versions, raw: DataFrame, number: int, key: str, column: str, out: str, equal: Column | None = None) -> str:
    """Adds the raw scores of batch ``number`` to the store's tables raw and scaled; what was done: 'skipped', 'added' or 'rescaled'.

    Rows whose key is there already are left out, and so is a batch whose number the store has seen. The bounds of the new rows are gathered while
    these are written; where they move the store's, all rows are scaled anew, else only the new ones. A null score counts as 0; where all are equal
    they stay as they are, or as ``equal`` says. Both tables, the bounds and the number change in one step, so a batch may run again at any point.

    Rows of one key within a batch are all taken; see ``rostrum.operators.entities.keep_first``."""
    now = store.state()
    facts = now["facts"]
    if number <= facts.get("batch", -1):
        return "skipped"
    if "raw" in now["tables"]:
        raw = raw.join(store.read("raw", version=now["version"]).select(key), key, "left_anti").select(*raw.columns)
    x = F.coalesce(F.col(column), F.lit(0.0))
    part, new = store.stage("raw", raw, low=F.min(x), high=F.max(x))
    if not new["rows"]:
        store.commit(facts={"batch": number}, expect=now["version"])
        return "skipped"
    low, high = min(new["low"], facts.get("low", new["low"])), max(new["high"], facts.get("high", new["high"]))
    moved = (low, high) != (facts.get("low"), facts.get("high"))
    old = now["tables"].get("raw", {"parts": []})["parts"] if moved else []
    flat = F.coalesce(F.col(column), F.lit(0.0)) if equal is None else equal
    scaled, _ = store.stage("scaled", _scaled(store.part(part["schema"], *old, *part["parts"]), column, out, low, high, flat))
    where = {"replace": {"scaled": scaled}, "append": {"raw": part}} if moved else {"append": {"raw": part, "scaled": scaled}}
    store.commit(**where, facts={"batch": number, "low": low, "high": high}, expect=now["version"])
    return "rescaled" if moved else "added"


def scale_new_records(spark: SparkSession, records: str, schema, store: str, checkpoint: str, raw_scores: Callable[[DataFrame], DataFrame], key: str, column: str, out: str, equal: Column | None = None, available_now: bool = True):
    """Streams a folder of Parquet records into a store of scaled scores, equal to the batch result over all records read so far."""
    table = Versions(spark, store)
    return _started(spark, records, schema, checkpoint, lambda df, number: add_scores(table, raw_scores(df), number, key, column, out, equal) and None, available_now)
