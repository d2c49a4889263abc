"""Sources and sinks: record and text folders, requirement files, caches keyed by content, skip log, reports."""
from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators.requirements import flat_requirements, normalise
from rostrum.sources.versions import Versions


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where none is set on a local master, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rostrum-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    name = f"{shared_folder(spark)}/rostrum-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read_records(spark: SparkSession, path: str, schema=None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of the JSON records right in a folder, one a file, or with ``lines`` one a line of any number of files; bad ones have path and text.

    Else the whole file is one record, which suits folders of some thousand files; files named example_output.json are skipped."""
    raw = spark.read.text(path, wholetext=not lines, pathGlobFilter="*.json", recursiveFileLookup=False).withColumn("path", F.col("_metadata.file_path"))
    raw = raw.where(~F.col("path").endswith("/example_output.json"))
    if schema is None:
        ok = raw.withColumn("record", F.try_parse_json("value"))
    else:
        ok = raw.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    well = F.try_parse_json("value").isNotNull()
    return ok.where(well).select("path", "record"), raw.where(~well).select("path", F.col("value").alias("text"))


def read_texts(spark: SparkSession, path: str, only: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """(path, stem, text) of the *.txt files of a folder, in any case of the extension; ``only`` (stem) is an allow-list.

    With ``lines``, of the many texts a file that ``documents.write_texts`` writes; those are told apart by their stem."""
    if lines:
        rows = spark.read.schema("stem string, text string").json(path).select(F.col("_metadata.file_path").alias("path"), "stem", "text")
    else:
        rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.[tT][xX][tT]").withColumnRenamed("value", "text").withColumn("path", F.col("_metadata.file_path"))
        rows = rows.withColumn("stem", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")).select("path", "stem", "text")
    return rows if only is None else rows.join(only.select("stem").distinct(), "stem", "left_semi").select("path", "stem", "text")


def split_pdfs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, skipped) of a binaryFile table: by extension and signature. Skipped rows carry a reason.

    Page texts need a PDF library, which is a hook: see ``rostrum.sources.external.PageReader``."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    head = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    reason = F.when(ext != "pdf", "not a PDF").when(~head, "unreadable PDF")
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def page_text(pages: Column) -> Column:
    """Pages under '--- Page k ---' heads, stripped; null where there is no text."""
    marked = F.transform(pages, lambda p, i: F.concat(F.lit("\n\n--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), F.trim(p)))
    filled = F.exists(pages, lambda p: F.trim(p) != "")
    return F.when(filled, F.regexp_replace(F.array_join(marked, "\n"), r"^\s+|\s+$", ""))


def read_requirements(spark: SparkSession, path: str) -> dict[str, dict]:
    """{'mandatory': specs, 'soft': specs} of a requirement file in the new or the old form, its nested lists laid flat; {} for a missing or bad file.

    A requirement file is a few lines written by a person; it is read on the driver."""
    found = spark.read.text(path, wholetext=True) if _exists(spark, path) else None
    try:
        data = json.loads(found.first()[0]) if found is not None else {}
    except (ValueError, TypeError):
        data = {}
    tiers = {"mandatory": data.get("mandatory_compliances") or (data if "structured" in data else {}), "soft": data.get("soft_compliances") or {}}
    structured = {t: x.get("structured") or {} for t, x in tiers.items()}
    flat = {t: flat_requirements(x) if isinstance(x.get("requirements"), list) else x for t, x in structured.items()}
    return {t: {f: n for f, s in x.items() if (n := normalise(s))} for t, x in flat.items()}


def requirement_table(spark: SparkSession, tiers: dict[str, dict]) -> DataFrame:
    rows = []
    for tier, specs in tiers.items():
        for field, s in specs.items():
            strings = lambda k: [str(x) for x in s.get(k) or []] if isinstance(s.get(k), (list, tuple)) else [str(s[k])] if s.get(k) not in (None, "") else []
            num = lambda k: float(s[k]) if s.get(k) is not None else None
            rows.append((tier, field, s["type"], num("min"), num("max"), s.get("unit"), strings("required"), strings("optional"), strings("allowed"), s.get("minimum")))
    return spark.createDataFrame(rows, "tier string, field string, type string, min double, max double, unit string, required array<string>, optional array<string>, allowed array<string>, minimum string")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A score table; an empty one where there is none yet. It stays as it is while others write."""
    return Versions(spark, path).read("scores", schema)


def write_scores(df: DataFrame, path: str) -> None:
    """Replaces a score table in one step; it may be made from the table itself. Old versions stay until ``Versions.clear``."""
    Versions(df.sparkSession, path).replace(scores=df)


def write_split(kept: DataFrame, filtered: DataFrame, path: str) -> int:
    """Kept and filtered records as two tables of one store, changed together in one step; the input is never touched. The new version."""
    return Versions(kept.sparkSession, path).replace(kept=kept, filtered=filtered)


def write_ranking(df: DataFrame, path: str, description: str = "", skipped: int = 0, note: str = "") -> None:
    """Ranked rows as JSON lines, and one metadata row beside them; no row passes the driver."""
    df.write.mode("overwrite").json(f"{path}/candidates")
    meta = df.agg(F.count(F.lit(1)).alias("total")).withColumns({"description": F.lit(description), "skipped": F.lit(skipped), "note": F.lit(note)})
    meta.write.mode("overwrite").json(f"{path}/metadata")


def write_report(lines: DataFrame, path: str) -> None:
    """The report's lines in rank order, as text files in that order."""
    lines.orderBy("rank").select("line").write.mode("overwrite").text(path)


def append_skip_log(spark: SparkSession, new: DataFrame, path: str, cid: str = "candidate_id") -> None:
    """Appends the rows whose id the log does not have, and all without an id."""
    if _exists(spark, path):
        log = spark.read.parquet(path)
        new = new.join(log.where(F.col(cid).isNotNull()).select(cid).distinct(), cid, "left_anti").select(*new.columns)
    new.write.mode("append").parquet(path)


def cache_misses(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose content key the cache table does not have."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def path_map(records: DataFrame) -> DataFrame:
    """(key, path): a record's path under its id, name, lower-case name and stem; the first path by name for a shared key."""
    keys = F.array("candidate_id", "name", F.lower("name"), F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", ""))
    each = records.select(F.explode(keys).alias("key"), "path").where("key is not null and key <> ''")
    return each.groupBy("key").agg(F.min("path").alias("path"))
