"""Checks of candidate records and job descriptions: errors are rows' own data, never exceptions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from rostrum.functions.text import strip
from rostrum.operators.scoring import METRICS

#: Fields that must hold something, those of them that are trimmed first, and weights of a job description.
REQUIRED = ("candidate_id", "name", "profile_keywords_line", "ats_boost_line")
TRIMMED = ("candidate_id", "name")
JOB_WEIGHTS = (
    "required_skills", "preferred_skills", "responsibilities", "domain_relevance", "technical_depth", "soft_skills", "education",
    "certifications", "keywords_exact", "keywords_semantic",
)


def _outside(x: Column) -> Column:
    return x.isNotNull() & (F.isnan(x) | (x < 0) | (x > 1))


def record_errors(records: DataFrame) -> Column:
    """An array of what is wrong with each record, in order of fields; empty for a valid one.

    A required field that the table lacks is an error of every record; other columns are checked where there are any.
    NaN is outside every range; a null number is not given."""
    found = []
    for c in REQUIRED:
        value = F.lit(None).cast("string") if c not in records.columns else strip(c) if c in TRIMMED else F.col(c)
        found.append((F.coalesce(value, F.lit("")) == "", f"{c}: required"))
    if "years_experience" in records.columns:
        years = F.col("years_experience").try_cast("double")
        given = F.col("years_experience").isNotNull()
        found.append((given & (years.isNull() | F.isnan(years) | (years < 0)), "years_experience: not a number of 0 or more"))
    for c in ("inferred_skills", "skill_proficiency"):
        if c in records.columns:
            found.append((F.exists(c, lambda s: s.isNull() | s.skill.isNull()), f"{c}[].skill: required"))
    if "inferred_skills" in records.columns:
        found.append((F.exists("inferred_skills", lambda s: _outside(s.confidence)), "inferred_skills[].confidence: outside 0..1"))
    beyond = lambda m: F.exists("projects", lambda p: _outside(p.metrics[m]))
    found += [(beyond(m), f"projects[].metrics.{m}: outside 0..1") for m in _metrics(records)]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(e)) for bad, e in found]), lambda e: e.isNotNull())


def _metrics(records: DataFrame) -> list[str]:
    if "projects" not in records.columns:
        return []
    kind = records.schema["projects"].dataType
    item = kind.elementType if isinstance(kind, ArrayType) else None
    metrics = item["metrics"].dataType if isinstance(item, StructType) and "metrics" in item.names else None
    return [m for m in METRICS if isinstance(metrics, StructType) and m in metrics.names]


def validated(records: DataFrame) -> DataFrame:
    """``records`` with id and name trimmed, and columns errors and valid; none is dropped."""
    out = records.withColumn("errors", record_errors(records)).withColumn("valid", F.size("errors") == 0)
    return out.withColumns({c: strip(c) for c in TRIMMED if c in records.columns})


def job_errors(job: dict) -> list[str]:
    """What is wrong with one job description, a small record on the driver."""
    title, number = job.get("role_title"), lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    out = [] if isinstance(title, str) and title.strip() else ["role_title: required"]
    for c in ("years_experience_required", "hr_points"):
        v = job.get(c)
        if v is not None and not (number(v) and v >= 0):
            out.append(f"{c}: not a number of 0 or more")
    for w in JOB_WEIGHTS:
        v = (job.get("weighting") or {}).get(w)
        if v is not None and not (number(v) and 0 <= v <= 1):
            out.append(f"weighting.{w}: outside 0..1")
    return out
