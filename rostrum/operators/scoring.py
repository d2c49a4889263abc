"""Project, keyword, semantic and HR scores."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import WORD, norm_lower, phrase_tokens, r3
from rostrum.functions.vec import dot

#: Project metrics, all of weight 0.142857.
METRICS = ("difficulty", "novelty", "skill_relevance", "complexity", "technical_depth", "domain_relevance", "execution_quality")
METRIC_WEIGHT = 0.142857
#: Weights of the parts of the keyword score.
KEYWORD_WEIGHTS = {
    "required_skills": 0.18,
    "preferred_skills": 0.08,
    "weighted_keywords": 0.15,
    "experience_keywords": 0.25,
    "domain_relevance": 0.10,
    "technical_depth": 0.10,
    "project_metrics": 0.09,
    "responsibilities": 0.03,
    "education": 0.02,
}
#: Verbs and their weights.
VERBS = {
    "lead": 4.0, "led": 4.0, "manager": 4.0, "managed": 4.0, "architect": 4.0,
    "architected": 4.0, "designed": 3.6, "design": 3.6, "owned": 3.6,
    "implemented": 3.2, "built": 3.6, "scaled": 3.4, "scale": 3.4,
    "optimized": 3.2, "deployed": 3.2, "productionized": 3.6,
    "mentored": 2.8, "coach": 2.8, "contributed": 2.4, "contributed to": 2.4,
    "improved": 3.0, "reduced": 3.0, "increased": 3.0, "automated": 3.2,
    "orchestrated": 3.4,
}
#: Weights of the sections, and the thresholds and mix of a section's score.
SECTIONS = {"skills": 0.30, "projects": 0.25, "responsibilities": 0.20, "profile": 0.10, "education": 0.05, "overall": 0.10}
COVERED, DENSE, MIX = 0.65, 0.55, (0.5, 0.4, 0.1)
LEAST_CONFIDENCE = 0.6
#: Six sections of at most 200 texts, which are broadcast.
MOST_WANTED = 1200


def _strings() -> Column:
    return F.array().cast("array<string>")


# Projects


def project_score(*metrics: str) -> Column:
    """Weighted mean of the metrics that are given; 0 for none."""
    names = metrics or METRICS
    n = sum((F.when(F.col(m).isNotNull(), F.lit(METRIC_WEIGHT)).otherwise(0.0) for m in names), F.lit(0.0))
    s = sum((F.coalesce(F.col(m), F.lit(0.0)) * METRIC_WEIGHT for m in names), F.lit(0.0))
    return F.when(n > 0, r3(s / n)).otherwise(0.0)


def _aggregate() -> Column:
    return r3(F.avg(project_score())).alias("project_aggregate")


def _metric_mean() -> Column:
    three = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in ("skill_relevance", "domain_relevance", "execution_quality")), F.lit(0.0)) / 3
    return F.avg(three).alias("project_metrics")


def project_aggregate(projects: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Mean of the projects' rounded scores."""
    return projects.groupBy(by).agg(_aggregate())


def project_metric_mean(projects: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Mean over projects of three metrics, a missing one as 0."""
    return projects.groupBy(by).agg(_metric_mean())


def project_facts(projects: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Both means in one pass."""
    return projects.groupBy(by).agg(_aggregate(), _metric_mean())


# Keywords


def tokens(*arrays: str, inferred: str | None = None, phrases: str | None = None) -> Column:
    """A record's token set: lower-cased items of arrays, inferred skills of enough confidence, and phrase words."""
    parts = [F.transform(F.coalesce(F.col(a), _strings()), lambda x: norm_lower(x)) for a in arrays]
    if inferred:
        sure = F.filter(F.col(inferred), lambda s: s.confidence >= LEAST_CONFIDENCE)
        parts.append(F.transform(F.coalesce(F.transform(sure, lambda s: s.skill), _strings()), lambda x: norm_lower(x)))
    if phrases:
        parts.append(F.flatten(F.transform(F.coalesce(F.col(phrases), _strings()), lambda p: phrase_tokens(p))))
    return F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda t: t != ""))


def overlap(wanted: list[str], have: Column) -> Column:
    """Share of the wanted list, repeats counted, that is in the set; 0.5 for an empty list."""
    wanted = [w.strip().lower() for w in wanted]
    if not wanted:
        return F.lit(0.5)
    hit = sum((F.when(F.array_contains(have, w), 1).otherwise(0) for w in wanted), F.lit(0))
    return F.coalesce(hit, F.lit(0)) / F.lit(float(len(wanted)))


def weighted_overlap(wanted: dict[str, float], have: Column) -> Column:
    total = float(sum(wanted.values()))
    if total <= 0:
        return F.lit(0.5)
    return F.coalesce(sum((F.when(F.array_contains(have, k.strip().lower()), float(w)).otherwise(0.0) for k, w in sorted(wanted.items())), F.lit(0.0)) / total, F.lit(0.0))


def lexicon_score(text: Column, lexicon: dict[str, float] | None = None, strict: bool = False) -> Column:
    """Weights of the words that are part of the text, over all weights; with ``strict`` of those that it holds as whole words."""
    lexicon = VERBS if lexicon is None else lexicon
    low = F.lower(F.coalesce(text, F.lit("")))
    if strict:
        found = phrases_found(low, list(lexicon))
        hit = lambda k: F.array_contains(found, k)
    else:
        hit = lambda k: F.contains(low, F.lit(k))
    return sum((F.when(hit(k), float(w)).otherwise(0.0) for k, w in sorted(lexicon.items())), F.lit(0.0)) / float(sum(lexicon.values()))


def phrases_found(text: Column, phrases: list[str]) -> Column:
    """Of a few phrases those that a text holds, their words in a row and as whole words: an array in no order, each once.

    The phrases' words make a trie, a small literal map from state and word to state. A text's words are walked once, with the states that
    phrases begun before have reached; the cost grows with the text and not with the number of phrases."""
    moves, ends, count = {}, {}, 0
    for phrase in sorted(set(phrases)):
        state = 0
        for word in re.findall(r"[\w+#]+", phrase.lower()):
            if (state, word) not in moves:
                count += 1
                moves[state, word] = count
            state = moves[state, word]
        if state:
            ends.setdefault(state, []).append(phrase)
    if not moves:
        return _strings()
    step = F.create_map(*[c for (s, w), n in moves.items() for c in (F.lit(f"{s} {w}"), F.lit(n))])
    said = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    ints = lambda *n: F.array(*map(F.lit, n)).cast("array<int>")

    def walk(a: Column, word: Column) -> Column:
        reached = F.filter(F.transform(F.array_append(a.at, F.lit(0)), lambda s: F.try_element_at(step, F.concat(s.cast("string"), F.lit(" "), word))), lambda s: s.isNotNull())
        ended = F.filter(reached, lambda s: s.isin(*ends))
        return F.struct(reached.alias("at"), F.when(F.size(ended) > 0, F.array_union(a.met, ended)).otherwise(a.met).alias("met"))

    met = F.aggregate(said, F.struct(ints().alias("at"), ints().alias("met")), walk, lambda a: a.met)
    names = F.create_map(*[c for s, p in ends.items() for c in (F.lit(s), F.array(*map(F.lit, p)))])
    return F.array_distinct(F.flatten(F.transform(met, lambda s: F.try_element_at(names, s))))


def keyword_fused(parts: dict[str, str], has_required: bool = True, weights: dict | None = None) -> Column:
    """Weighted sum of part columns, less 0.3 times what the required share falls short of one half; 0 at least."""
    own = KEYWORD_WEIGHTS | {k: v for k, v in (weights or {}).items() if k in KEYWORD_WEIGHTS and v is not None}
    s = sum((F.col(c) * own[k] for k, c in sorted(parts.items())), F.lit(0.0))
    if has_required and "required_skills" in parts:
        req = F.col(parts["required_skills"])
        s = s - F.when(req < 0.5, (F.lit(0.5) - req) * 0.3).otherwise(0.0)
    return r3(F.greatest(s, F.lit(0.0)))


def min_max(df: DataFrame, col: str, out: str, equal: str = "same", previous: str | None = None) -> DataFrame:
    """Scaled to 0..1 over all rows; null counts as 0. Where all are equal: unchanged, or the previous score, else 0.5.

    The bounds are one aggregated row, read as scalar subqueries: no global window, no join."""
    x = F.coalesce(F.col(col), F.lit(0.0))
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    flat = x if equal == "same" else F.coalesce(F.col(previous) if previous else F.lit(None).cast("double"), F.lit(0.5))
    return df.withColumn(out, F.when(hi > lo, r3((x - lo) / (hi - lo))).otherwise(flat))


# Sections and vectors


def _sized(wanted: DataFrame) -> dict[str, int]:
    """Texts of each section of one requirement record; more than ``MOST_WANTED`` in all raise an error."""
    sizes = {r.section: r.n for r in wanted.limit(MOST_WANTED + 1).groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) > MOST_WANTED:
        raise ValueError(f"more than {MOST_WANTED} wanted texts")
    return sizes


def similarities(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(section, jd_id, candidate, rv, cos) of unit vectors, joined by section: a row a pair, where the pairs are the result.

    ``wanted`` (section, jd_id, vec) is one requirement record's, at most 200 texts in each of six sections; more raise an error; it is
    broadcast, and the candidates' side is read where it lies."""
    _sized(wanted)
    pairs = offered.join(F.broadcast(wanted.withColumnRenamed("vec", "jvec")), "section")
    return pairs.select("section", "jd_id", "candidate", "rv", dot(F.col("jvec"), F.col("vec")).alias("cos"))


def _against(wanted: DataFrame, offered: DataFrame, keep: int | None = None) -> tuple[DataFrame, int]:
    """``offered`` with the wanted texts of its section (w, by jd_id, the first ``keep``) and its products with them (cos), and w's greatest length.

    The wanted texts are one broadcast row a section, so a text stays one row. jd_id is one text of the wanted, rv one of a candidate's section."""
    most = max(_sized(wanted).values(), default=0)
    w = F.array_sort(F.collect_list(F.struct("jd_id", F.col("vec").alias("jvec"))))
    w = wanted.groupBy("section").agg((w if keep is None else F.slice(w, 1, keep)).alias("w"))
    rows = offered.join(F.broadcast(w), "section").withColumn("cos", F.transform("w", lambda j: dot(j.jvec, F.col("vec"))))
    return rows, most if keep is None else min(most, keep)


def section_scores(wanted: DataFrame, offered: DataFrame, covered: float = COVERED, dense: float = DENSE) -> DataFrame:
    """Coverage, depth, density and score of each candidate and section.

    One shuffle, after partial aggregation: a maximum for each wanted text's place, and the share of dense texts."""
    rows, most = _against(wanted, offered)
    maxima = F.array(*[F.max(F.get("cos", F.lit(i))) for i in range(most)]).cast("array<double>")
    per = rows.groupBy("candidate", "section").agg(maxima.alias("best"), F.avg((F.array_max("cos") >= dense).cast("double")).alias("density"))
    per = per.withColumn("best", F.filter("best", lambda x: x.isNotNull()))
    mean = lambda f: F.aggregate("best", F.lit(0.0), lambda s, x: s + f(x)) / F.nullif(F.size("best"), F.lit(0))
    cols = per.select("candidate", "section", mean(lambda x: (x >= covered).cast("double")).alias("coverage"), mean(lambda x: x).alias("depth"), "density")
    a, b, c = MIX
    return cols.withColumn("section_score", F.col("coverage") * a + F.col("depth") * b + F.col("density") * c)


def with_empty_sections(scores: DataFrame, candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """All candidates and sections: 0.5 where nothing is wanted, 0 where nothing is offered."""
    names = wanted.select("section").distinct().withColumn("_asked", F.lit(True))
    every = candidates.select("candidate", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section")).join(F.broadcast(names), "section", "left")
    full = every.join(scores, ["candidate", "section"], "left")
    score = F.when(F.col("_asked").isNull(), 0.5).otherwise(F.coalesce("section_score", F.lit(0.0)))
    return full.select("candidate", "section", score.alias("section_score"))


def semantic_raw(scores: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return scores.groupBy("candidate").agg(r3(F.sum(weight[F.col("section")] * F.col("section_score"))).alias("semantic_raw"))


def best_matches(wanted: DataFrame, offered: DataFrame, keep: int = 5) -> DataFrame:
    """For each of a section's first ``keep`` wanted texts by jd_id the candidate's nearest; ties to the smaller text."""
    rows, most = _against(wanted, offered, keep)
    nearest = [F.struct(F.get("w.jd_id", F.lit(i)).alias("jd_id"), F.get("cos", F.lit(i)).alias("cos"), (-F.col("rv")).alias("n")) for i in range(most)]
    best = F.array(*[F.max(x) for x in nearest]).cast("array<struct<jd_id: bigint, cos: double, n: bigint>>")
    per = rows.groupBy("candidate", "section").agg(best.alias("best"))
    out = per.select("candidate", "section", F.posexplode("best").alias("at", "m")).where("m.jd_id is not null")
    return out.selectExpr("candidate", "section", "m.jd_id jd_id", "-m.n rv", "m.cos cos", "at + 1 pos")


# HR notes


def hr_compliance(records: DataFrame, notes: list[dict], by: str = "candidate_id") -> DataFrame:
    """Impact-weighted compliance with notes, a few dicts of impact and low, high or skills.

    A note has an experience part, a skill part or both; both parts count. A record is to be filtered where a note of
    impact 0.7 or more fails in experience or has under 0.3 of its skills. Records need years_experience and skills."""
    y, parts = F.col("years_experience"), []
    part = lambda impact, s, bad: F.struct(F.lit(float(impact)).alias("i"), s.cast("double").alias("s"), F.coalesce(bad, F.lit(False)).alias("bad"))
    for n in notes:
        if n.get("low") is not None or n.get("high") is not None:
            fits = F.lit(True)
            if n.get("low") is not None:
                fits = fits & (y >= float(n["low"]))
            if n.get("high") is not None:
                fits = fits & (y <= float(n["high"]))
            fits = F.coalesce(fits, F.lit(False))
            parts.append(part(n["impact"], fits.cast("int"), ~fits))
        if n.get("skills"):
            asked = sorted({k.strip().lower() for k in n["skills"]})
            share = F.size(F.array_intersect(F.coalesce("skills", _strings()), F.array(*map(F.lit, asked)))) / F.lit(float(len(asked)))
            parts.append(part(n["impact"], share, share < 0.3))
    total = lambda f: F.aggregate("_p", F.lit(0.0), lambda a, p: a + f(p))
    out = records.withColumn("_p", F.array(*parts))
    score = r3(total(lambda p: p.i * p.s) / total(lambda p: p.i))
    return out.select(by, score.alias("hr_score"), F.exists("_p", lambda p: (p.i >= 0.7) & p.bad).alias("hr_should_filter"))
