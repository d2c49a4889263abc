"""Fusion, ranking, batches and reports."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import file_name, r3
from rostrum.sources.io import settled

#: Weights of the three scores, and what a single score loses.
WEIGHTS = {"project_aggregate": 0.35, "semantic_score": 0.35, "keyword_score": 0.30}
ONE_SCORE_LOSS = 0.08


def fused(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the scores that are given; a single one less 0.08; null for none."""
    n = sum((F.col(c).isNotNull().cast("int") for c in weights), F.lit(0))
    w = sum((F.when(F.col(c).isNotNull(), F.lit(x)).otherwise(0.0) for c, x in weights.items()), F.lit(0.0))
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) * x for c, x in weights.items()), F.lit(0.0))
    one = F.coalesce(*[F.col(c) for c in weights])
    return F.when(n == 1, r3(F.greatest(one - ONE_SCORE_LOSS, F.lit(0.0)))).when(n > 1, r3(s / w))


def ranked(rows: DataFrame, score: Column, *ties: Column, out: str = "rank", slices: int | None = None) -> DataFrame:
    """1..N by score, descending, nulls last, and the ties given; row order never matters if the ties are unique.

    No global window: rows are dealt to ``slices`` ranges (the session's shuffle partitions by default) by the sort order, numbered within each, and the ranges'
    counts, one row each, give the offsets. The dealt rows are checkpointed, since ranges are drawn from a sample
    and must be the same for the counts and the numbers."""
    order = [score.desc_nulls_last(), *ties]
    slices = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(rows.repartitionByRange(slices, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_from"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_part").withColumn(out, (F.col("_from") + F.col("_at")).cast("int")).drop("_part", "_from", "_at")


def top(rows: DataFrame, k: int, score: Column, *ties: Column, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of the ranking, numbered: every partition hands on k rows at most, and only k are numbered in one task."""
    order = [score.desc_nulls_last(), *ties]
    return rows.orderBy(*order).limit(k).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def batches(rows: DataFrame, rank: str = "rank", size: int = 30) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.col(rank) - 1) / size).cast("int"))


def attach_rerank(rows: DataFrame, results: DataFrame, cid: str = "candidate_id") -> DataFrame:
    """Re-rank scores by id; without a result the final score stands and requirements count as met."""
    out = rows.join(results, cid, "left")
    return out.withColumn("re_rank_score", F.coalesce("re_rank_score", "final_score")).withColumn("meets_requirements", F.coalesce("meets_requirements", F.lit(True)))


def report_lines(rows: DataFrame) -> DataFrame:
    """'{rank}. {name} | Score: {score}' for each ranked row, and where it has columns met and missing (arrays of requirements)
    a line for each of these that is not empty, as '   ✅ Meets (1/2): a'."""
    score = F.format_string("%.3f", F.coalesce("final_score", F.lit(0.0)))
    head = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("name", F.lit("Unknown")), F.lit(" | Score: "), score)
    if not {"met", "missing"} <= set(rows.columns):
        return rows.select("rank", head.alias("line"))
    met, missing = (F.coalesce(c, F.array().cast("array<string>")) for c in ("met", "missing"))
    total = (F.size(met) + F.size(missing)).cast("string")
    line = lambda sign, a: F.when(F.size(a) > 0, F.concat(F.lit(f"\n   {sign} ("), F.size(a).cast("string"), F.lit("/"), total, F.lit("): "), F.array_join(a, ", "))).otherwise("")
    return rows.select("rank", F.concat(head, line("✅ Meets", met), line("❌ Missing", missing)).alias("line"))


def manifest(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Names in the export archive: the résumé's, or a note that it is missing."""
    stem = F.concat(F.format_string("%03d_", "rank"), file_name("name"))
    both = rows.join(paths, "candidate_id", "left")
    return both.select("candidate_id", F.when(F.col("path").isNotNull(), F.concat(stem, F.lit("_resume.pdf"))).otherwise(F.concat(stem, F.lit("_resume_missing.txt"))).alias("entry"))


def selection(rows: DataFrame, chosen: DataFrame, cid: str = "candidate_id", rank: str = "rank") -> DataFrame:
    """The chosen candidates' rows in rank order."""
    return rows.join(chosen.select(cid).distinct(), cid, "left_semi").orderBy(rank)
