"""Native records: nested candidates and one job description, as sections, token sets, skills and tags.

A candidate table has columns of ``RECORD``; a missing column counts as null, a null as empty."""
from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.functions.text import boost_line, candidate_id, phrase_tokens, seniority, sentences, strip, total_years
from rostrum.operators import scoring
from rostrum.operators.scoring import LEAST_CONFIDENCE

RECORD = """candidate_id string, name string, profile_keywords_line string, ats_boost_line string, canonical_skills map<string, array<string>>,
inferred_skills array<struct<skill: string, confidence: double>>, skill_proficiency array<struct<skill: string, years_last_used: int>>,
projects array<struct<name: string, approach: string, tech_keywords: array<string>, primary_skills: array<string>, metrics: struct<skill_relevance: double, domain_relevance: double, execution_quality: double>>>,
experience_entries array<struct<primary_tech: array<string>, responsibilities_keywords: array<string>, achievements: array<string>>>,
education array<string>, domain_tags array<string>"""
#: Texts of a section; parts of the boost line that stand in for education.
CAP, STUDY_CAP = 200, 20
#: Keys of a job description whose text is part of its overall section.
DESCRIPTIONS = ("description", "job_description", "summary", "overview", "role_summary", "responsibilities_text", "requirements")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _list(array: Column) -> Column:
    return F.coalesce(array, _strings())


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once; a column that a lambda names is made again for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _each(items: str, part) -> Column:
    """The lists that ``part`` makes of the items of an array column, one after another."""
    return F.coalesce(F.flatten(F.transform(F.col(items), lambda x: _list(part(x)))), _strings())


def _canonical() -> Column:
    """The skills of all categories; a null category is empty and takes no other with it."""
    return F.flatten(F.transform(F.map_values("canonical_skills"), lambda c: _list(c)))


def _sentences_of(texts: Column) -> Column:
    return F.flatten(F.transform(F.filter(_list(texts), lambda t: t.isNotNull()), lambda t: sentences(t)))


def _sure(inferred: str) -> Column:
    some = F.filter(F.col(inferred), lambda s: (s.confidence >= LEAST_CONFIDENCE) & (s.skill != ""))
    return _list(F.transform(some, lambda s: s.skill))


def whole(records: DataFrame) -> DataFrame:
    """``records`` with every column of ``RECORD``, null where it has none."""
    from pyspark.sql.types import _parse_datatype_string

    return records.select(*[F.col(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(RECORD)])


def section_texts(records: DataFrame, cap: int = CAP) -> DataFrame:
    """(candidate_id, section, texts): six sections a record, of at most ``cap`` texts each. Sentences have three words at least."""
    r = whole(records)
    given = lambda a: F.filter(_list(a), lambda t: t.isNotNull() & (t != ""))
    profile, boost = F.col("profile_keywords_line"), F.coalesce("ats_boost_line", F.lit(""))
    skills = F.concat(given(_canonical()), _sure("inferred_skills"))
    projects = _each("projects", lambda p: F.concat(sentences(p["name"]), sentences(p.approach), F.transform(_list(p.tech_keywords), lambda t: strip(t))))
    duties = _each("experience_entries", lambda e: F.concat(_sentences_of(e.responsibilities_keywords), _sentences_of(e.achievements), F.transform(given(e.primary_tech), lambda t: strip(t))))
    study = _sentences_of(F.col("education"))
    parts = F.slice(F.filter(F.transform(F.split(boost, ","), lambda t: strip(t)), lambda t: t != ""), 1, STUDY_CAP)
    overall = F.concat(sentences(profile), _sentences_of(F.transform("projects", lambda p: p.approach)), _each("experience_entries", lambda e: _sentences_of(e.responsibilities_keywords)), sentences(boost))
    every = {
        "profile": sentences(profile), "skills": F.transform(skills, lambda t: strip(t)), "projects": projects, "responsibilities": duties,
        "education": F.when(F.size(study) > 0, study).otherwise(parts), "overall": overall,
    }
    sections = F.array(*[F.struct(F.lit(n).alias("section"), F.slice(_list(a), 1, cap).alias("texts")) for n, a in every.items()])
    return r.select("candidate_id", F.inline(sections))


def record_sections(records: DataFrame, cap: int = CAP) -> DataFrame:
    """(candidate_id, section, pos, text): the texts of ``section_texts``, a row each."""
    return section_texts(records, cap).select("candidate_id", "section", F.posexplode("texts").alias("pos", "text"))


def _split(text: str, least: int = 3) -> list[str]:
    pieces = re.findall(r"[^.!?]*[.!?]|[^.!?]+$", text.replace("\n", " "))
    return [p.strip() for p in pieces if len(p.split()) >= least]


def _leaves(value, depth: int = 0) -> list[str]:
    if depth > 10:
        return []
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in inner for s in _leaves(v, depth + 1)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_leaves(records: pd.Series) -> pd.Series:
    """All texts of a JSON record of any shape, in its order, down to ten levels; none for a null or bad one.

    In Python, since the shape differs from record to record and so has no column expression."""

    def leaves(record):
        try:
            return _leaves(json.loads(record))
        except (TypeError, ValueError, RecursionError):
            return []

    return records.map(leaves)


def job_sections(job: dict, cap: int = CAP) -> dict[str, list[str]]:
    """The six sections of one job description, a small record that is read on the driver; each text once, whatever its case.

    Where all are empty, the sentences of all its texts are the overall section."""
    hints, out = job.get("embedding_hints") or {}, {}
    plain = lambda *keys: [x.strip() for k in keys for x in job.get(k) or [] if isinstance(x, str)]
    lines = lambda texts: [s for t in texts if t for s in _split(t)]
    blocks = [b for b in job.get("sections") or [] if isinstance(b, dict)] if isinstance(job.get("sections"), list) else []
    out["profile"] = lines([job.get("role_title"), *[b.get("title") for b in blocks]])
    out["skills"] = plain("required_skills", "preferred_skills") or plain("keywords_flat")
    out["projects"] = lines([hints.get("projects_embed")])
    out["responsibilities"] = lines(job.get("responsibilities") or [])
    out["education"] = plain("certifications_required", "education_requirements")
    out["overall"] = lines([hints.get("overall_embed"), *[job.get(k) for k in DESCRIPTIONS], *[b.get("content") for b in blocks]])
    for name, texts in out.items():
        first: dict[str, str] = {}
        for t in texts:
            first.setdefault(t.strip().lower(), t)
        out[name] = list(first.values())
    if not any(out.values()):
        out["overall"] = _split(" ".join(s.strip() for s in _leaves(job) if s.strip()))
    return {name: texts[:cap] for name, texts in out.items()}


#: Columns of a table of job descriptions; a missing one counts as null.
JOB = """role_title string, sections array<struct<title: string, content: string>>, required_skills array<string>, preferred_skills array<string>, keywords_flat array<string>,
embedding_hints struct<projects_embed: string, overall_embed: string>, responsibilities array<string>, certifications_required array<string>, education_requirements array<string>, """ + ", ".join(f"{d} string" for d in DESCRIPTIONS)


def job_section_rows(jobs: DataFrame, key: str, cap: int = CAP) -> DataFrame:
    """(key, section, pos, text): the six sections of every job description of a table with columns of ``JOB``, as ``job_sections`` has them.

    Each text once, whatever its case. Where all are empty, the sentences of all texts are the overall section."""
    fields = T._parse_datatype_string(JOB)
    j = jobs.select(key, *[(F.col(f.name).cast(f.dataType) if f.name in jobs.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
    one = lambda c: F.array(c).cast("array<string>")
    clean = lambda *names: F.concat(*[F.transform(F.filter(_list(F.col(n)), lambda t: t.isNotNull()), lambda t: strip(t)) for n in names])
    blocks = F.coalesce("sections", F.array().cast(fields["sections"].dataType))
    wanted = clean("required_skills", "preferred_skills")
    every = {
        "profile": _sentences_of(F.concat(one(F.col("role_title")), F.transform(blocks, lambda b: b.title))),
        "skills": F.when(F.size(wanted) > 0, wanted).otherwise(clean("keywords_flat")), "projects": _sentences_of(one(F.col("embedding_hints.projects_embed"))),
        "responsibilities": _sentences_of(F.col("responsibilities")), "education": clean("certifications_required", "education_requirements"),
        "overall": _sentences_of(F.concat(one(F.col("embedding_hints.overall_embed")), F.array(*DESCRIPTIONS), F.transform(blocks, lambda b: b.content))),
    }

    def once(texts: Column) -> Column:
        """The first ``cap`` that differ in more than case; nothing is computed anew for each text."""
        none = F.struct(_strings().alias("keys"), _strings().alias("texts"))

        def add(a: Column, t: Column) -> Column:
            key = F.lower(strip(t))
            return F.when((F.size(a.keys) >= cap) | F.array_contains(a.keys, key), a).otherwise(F.struct(F.array_append(a.keys, key).alias("keys"), F.array_append(a.texts, t).alias("texts")))

        return F.aggregate(texts, none, add, lambda a: a.texts)

    j = j.withColumns({f"_{n}": once(c) for n, c in every.items()})
    hints = F.array("embedding_hints.projects_embed", "embedding_hints.overall_embed")
    leaves = F.concat(one(F.col("role_title")), F.flatten(F.transform(blocks, lambda b: F.array(b.title, b.content))), *[_list(F.col(n)) for n in ("required_skills", "preferred_skills", "keywords_flat")],
                      F.coalesce(hints, _strings()), *[_list(F.col(n)) for n in ("responsibilities", "certifications_required", "education_requirements")], F.array(*DESCRIPTIONS))
    whole_text = F.array_join(F.filter(F.transform(leaves, lambda t: strip(t)), lambda t: t != ""), " ")
    empty = sum((F.size(f"_{n}") for n in every), F.lit(0)) == 0
    j = j.withColumn("_overall", F.when(empty, sentences(whole_text)).otherwise(F.col("_overall")))
    sections = F.array(*[F.struct(F.lit(n).alias("section"), F.slice(f"_{n}", 1, cap).alias("texts")) for n in every])
    return j.select(key, F.inline(sections)).select(key, "section", F.posexplode("texts").alias("pos", "text"))


def skill_union(records: DataFrame) -> Column:
    """A record's skills of five sources, in lower case, distinct, sorted; inferred ones of any confidence."""
    sources = [_canonical(), F.transform("inferred_skills", lambda s: s.skill), F.transform("skill_proficiency", lambda s: s.skill)]
    sources += [_each("projects", lambda p: p.tech_keywords), _each("projects", lambda p: p.primary_skills)]
    every = F.filter(F.flatten(F.array(*map(_list, sources))), lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(F.transform(every, lambda t: F.lower(strip(t)))))


def boost_tokens(records: DataFrame) -> Column:
    """A record's skills without those of its projects, in lower case, distinct, sorted."""
    sources = [_canonical(), F.transform("inferred_skills", lambda s: s.skill), F.transform("skill_proficiency", lambda s: s.skill)]
    low = F.transform(F.flatten(F.array(*map(_list, sources))), lambda t: F.lower(strip(F.coalesce(t, F.lit("")))))
    return F.array_sort(F.array_distinct(F.filter(low, lambda t: t != "")))


def embedding_hints(records: DataFrame) -> Column:
    """What is embedded of a record that names nothing itself: its profile, its first two projects, its first ten skills in order."""
    text = lambda c: F.coalesce(c, F.lit(""))
    projects = F.transform(F.slice("projects", 1, 2), lambda p: F.concat(text(p["name"]), F.lit(": "), text(p.approach)))
    return F.struct(
        text(F.col("profile_keywords_line")).alias("profile_embed"), F.array_join(_list(projects), " | ").alias("projects_embed"),
        F.array_join(F.slice(boost_tokens(records), 1, 10), ", ").alias("skills_embed"),
    )


def candidate_summary(rows: DataFrame, records: DataFrame, cid: str = "candidate_id") -> DataFrame:
    """(candidate_id, summary): short JSON of each scored row (candidate_id, name and any of the four scores) for a re-ranker.

    Up to five skills a category, ten in all, and three projects; a row without a record has none of these."""
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    field = lambda c, t: F.col(c).cast(t) if c in records.columns else F.lit(None).cast(t)
    scores = {"p": "project_aggregate", "k": "keyword_score", "s": "semantic_score", "f": "final_score"}
    skills = F.slice(F.filter(F.flatten(F.transform(F.map_values("canonical_skills"), lambda c: F.slice(_list(c), 1, 5))), lambda t: t.isNotNull()), 1, 10)
    short = lambda p: F.struct(
        F.substring(F.coalesce(p["name"], F.lit("")), 1, 50).alias("n"), F.array_join(F.slice(_list(p.tech_keywords), 1, 5), ", ").alias("tech"),
        F.coalesce(p.metrics.domain_relevance, F.lit(0.0)).alias("score"),
    )
    extra = records.select(
        cid, field("years_experience", "double").alias("_exp"), F.coalesce(field("location", "string"), F.lit("")).alias("_loc"),
        F.coalesce(field("role_claim", "string"), F.lit("")).alias("_role"), skills.alias("_sk"), F.transform(F.slice("projects", 1, 3), short).alias("_pj"),
    )
    nothing = lambda c: F.coalesce(F.col(c), F.array().cast(extra.schema[c].dataType))
    summary = F.struct(
        F.coalesce(cid, F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("n"), F.struct(*[score(c).alias(k) for k, c in scores.items()]).alias("sc"),
        F.col("_exp").alias("exp"), F.coalesce("_loc", F.lit("")).alias("loc"), F.col("_role").alias("role"), nothing("_sk").alias("sk"), nothing("_pj").alias("pj"),
    )
    return rows.join(extra, cid, "left").select(cid, F.to_json(summary).alias("summary"))


def record_tokens(records: DataFrame) -> Column:
    """A record's token set: skills, technologies, duties, domain tags, and the parts and words of its two lines."""
    parts = [_canonical(), _sure("inferred_skills"), F.transform("skill_proficiency", lambda s: s.skill)]
    parts += [_each("projects", lambda p: F.concat(_list(p.tech_keywords), _list(p.primary_skills)))]
    parts += [_each("experience_entries", lambda e: F.concat(_list(e.primary_tech), _list(e.responsibilities_keywords))), F.col("domain_tags")]
    low = F.transform(F.flatten(F.array(*map(_list, parts))), lambda t: F.lower(strip(F.coalesce(t, F.lit("")))))
    every = F.concat(low, phrase_tokens("profile_keywords_line"), phrase_tokens("ats_boost_line"))
    return F.array_distinct(F.filter(every, lambda t: t != ""))


def job_keywords(job: dict) -> dict:
    """The keyword lists of one job description, in lower case."""
    low = lambda *keys: [x.strip().lower() for k in keys for x in job.get(k) or [] if isinstance(x, str)]
    return {
        "required_skills": low("required_skills"), "preferred_skills": low("preferred_skills"), "domain_relevance": low("domain_tags"), "responsibilities": low("responsibilities"),
        "education": low("education_requirements", "certifications_required"), "weighted_keywords": {k.strip().lower(): v for k, v in (job.get("keywords_weighted") or {}).items()},
    }


def verb_text() -> Column:
    """What the verbs of experience are looked for in."""
    entries = _each("experience_entries", lambda e: F.concat(_list(e.responsibilities_keywords), _list(e.achievements)))
    every = F.concat(entries, F.array("profile_keywords_line", "ats_boost_line"))
    return F.array_join(F.transform(every, lambda t: F.lower(strip(F.coalesce(t, F.lit(""))))), " ")


def keyword_parts(records: DataFrame, job: dict) -> DataFrame:
    """candidate_id, the eight parts of the keyword score of each record, and keyword_raw."""
    asked, r = job_keywords(job), whole(records)
    r = r.withColumns({"_tokens": record_tokens(r), "_text": verb_text()})
    metrics = F.transform("projects", lambda p: sum((F.coalesce(p.metrics[m], F.lit(0.0)) for m in ("skill_relevance", "domain_relevance", "execution_quality")), F.lit(0.0)) / 3)
    mean = F.when(F.size("projects") > 0, F.aggregate(metrics, F.lit(0.0), lambda a, x: a + x) / F.size("projects")).otherwise(0.5)
    lists = ("required_skills", "preferred_skills", "domain_relevance", "responsibilities", "education")
    parts = {n: scoring.overlap(asked[n], F.col("_tokens")) for n in lists}
    parts |= {"weighted_keywords": scoring.weighted_overlap(asked["weighted_keywords"], F.col("_tokens")), "experience_keywords": scoring.lexicon_score(F.col("_text")), "project_metrics": mean}
    out = r.select("candidate_id", *[c.alias(n) for n, c in parts.items()])
    return out.withColumn("keyword_raw", scoring.keyword_fused({n: n for n in parts}, bool(asked["required_skills"]), job.get("weighting")))


def normalised_achievements(value: Column) -> Column:
    """A variant as a list of texts: a text is a list of itself, trimmed; a blank one and anything but a list are empty."""
    kind = F.schema_of_variant(value)
    text = strip(F.try_variant_get(value, "$", "string"))
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<string>")).when((kind == "STRING") & (text != ""), F.array(text)).otherwise(_strings())


def normalised_years(value: Column) -> Column:
    """A variant as a whole number: a fraction is rounded, halves to even; anything but a number is 0."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT", "BIGINT", "INT"), F.bround(number).cast("int")).otherwise(0)


def normalised_line(value: Column) -> Column:
    """A variant as a text: a list's items, joined by spaces."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get(value, "$", "array<string>"), " ")).otherwise(F.try_variant_get(value, "$", "string"))


def enriched_tags(tags: Column, required: Column, preferred: Column, tools: Column, phrases: Column, notes: Column, summary: Column) -> Column:
    """A job description's tags and what later stages look for among them, each once, whatever its case.

    ``notes`` is an array of structs of category, type, impact (as text) and note; ``summary`` a JSON text."""
    given = lambda a: F.filter(F.transform(_list(a), lambda t: strip(t)), lambda t: t != "")
    under = lambda prefix, a, most: F.transform(F.slice(_list(a), 1, most), lambda t: F.when(strip(t) != "", F.concat(F.lit(prefix), strip(t))))

    def note(n: Column) -> Column:
        cut = lambda text: F.when(F.length(text) > 240, F.concat(F.substring(text, 1, 240), F.lit("..."))).otherwise(text)
        short = _let(strip(F.coalesce(n.note, F.lit(""))), cut)
        cat, kind, impact = (F.coalesce(c, F.lit(d)) for c, d in ((n.category, "general"), (n.type, "recommendation"), (n.impact, "0")))
        return F.concat(F.lit("HR_NOTE:cat="), cat, F.lit(";type="), kind, F.lit(";impact="), impact, F.lit(";note="), short)

    every = F.concat(
        _list(tags), F.array(F.concat(F.lit("JD_SUMMARY:"), summary)), under("REQ_SKILL:", required, 100), under("PREF_SKILL:", preferred, 100), under("TOOL:", tools, 100),
        F.transform(given(tags), lambda t: F.concat(F.lit("DOMAIN_TOP:"), t)), F.coalesce(F.transform(F.slice(notes, 1, 200), note), _strings()),
        F.transform(F.slice(_list(phrases), 1, 20), lambda t: _let(strip(t), lambda s: F.when(s != "", F.concat(F.lit("PHRASE:"), F.substring(s, 1, 200))))),
    )
    first = lambda all, keys: F.filter(all, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    keyed = lambda all: _let(F.transform(all, lambda t: F.lower(strip(t))), lambda keys: first(all, keys))
    return _let(F.filter(every, lambda t: t.isNotNull()), keyed)


def domain(industry, department) -> Column:
    """Industry, else department, else Unspecified; empty ones count as not given."""
    given = lambda c: F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.coalesce(given(industry), given(department), F.lit("Unspecified"))


#: What introduces a list of skills in a free text; the words that make it one of skills that are merely preferred.
_INTRO = r"(?i)\b((?:must|nice)[ -]+(?:to[ -]+)?have(?:[ -]skills?)?[ \t]*:?|(?:(?:hard|technical|required|mandatory|preferred|optional|key)[ -]+)?skills?[ \t]*:|(?:required|preferred|optional|mandatory)[ \t]*:)"
_WISH = r"(?i)^(?:nice|preferred|optional)"
#: Where such a list ends: a semicolon, a line's end, a full stop that no letter or digit follows.
_LIST_END = r"[;\n]|\.(?![\p{L}\p{N}])"


def _listed(text: Column) -> Column:
    """(intro, items) of each list of skills in a text: cut where a list begins, read to its end, parted at commas and at 'and'."""
    cut = F.split(F.regexp_replace(text, _INTRO, "\u0001$1\u0002"), "\u0001")
    return F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), lambda p: F.struct(
        F.substring_index(p, "\u0002", 1).alias("intro"),
        F.filter(F.transform(F.split(F.get(F.split(F.get(F.split(p, "\u0002"), F.lit(1)), _LIST_END), F.lit(0)), r",|(?i:\band\b)"), lambda t: strip(t)), lambda t: t != "").alias("items"),
    ))


def parse_requirements(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with low, high (years), location, hard_skills and preferred_skills (sorted, distinct) of free requirement texts.

    The offline default where no model parses them. A list runs from its introduction ("Must have", "Skills:", "Preferred:") to a semicolon,
    the end of the line, a full stop that ends a sentence, or the next introduction; all its items count. A location is what
    follows "location" to the next comma, semicolon or full stop; one with the word any or anywhere asks for nothing. A null text has none of these."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    years = lambda p, g: F.regexp_extract(low, p, g).try_cast("int")
    span, least = r"([0-9]+)[ ]*(?:-|–|—|to)[ ]*([0-9]+)[ ]*(?:years?|yrs?)", r"(?:at least|minimum(?: of)?|min\.?|requires?)[ ]*([0-9]+)[ ]*\+?[ ]*(?:years?|yrs?)"
    place = strip(F.regexp_extract(F.col(text), r"(?i)\blocation[ \t]*:?[ \t]+([^,;.\n]+)", 1))
    lists = _listed(F.coalesce(F.col(text), F.lit("")))
    of = lambda wish: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(lists, lambda x: x.intro.rlike(_WISH) == F.lit(wish)), lambda x: x["items"]))))
    return texts.withColumns({
        "low": F.coalesce(years(span, 1), years(least, 1)), "high": years(span, 2), "location": F.when((place != "") & ~place.rlike(r"(?i)\b(?:any|anywhere)\b"), place),
        "hard_skills": of(False), "preferred_skills": of(True),
    })


def text_fields(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with email, years_experience, name and skills of a free candidate text: the offline default where no model parses it.

    The name is the first line with a word; skills are the parts of the first line that begins with 'Skills:'. Null: none given."""
    t = F.coalesce(F.col(text), F.lit(""))
    first = lambda pattern: F.nullif(strip(F.regexp_extract(t, pattern, 1)), F.lit(""))
    listed = F.transform(F.split(F.regexp_extract(t, r"(?im)^[ \t]*skills[ \t]*:([^\n]*)", 1), "[,;]"), lambda x: strip(x))
    return texts.withColumns({
        "email": first(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), "years_experience": first(r"(?i)([0-9]+(?:\.[0-9]+)?)\+?[ ]*years?").try_cast("double"),
        "name": first(r"([^\n]*[^\s][^\n]*)"), "skills": F.filter(listed, lambda x: x != ""),
    })


def job_fields(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with the fields of ``parse_requirements``, role_title, seniority_level and responsibilities of a free job description.

    The offline default where no model parses it. The title is the first line with a word, responsibilities are its lines that begin with -, * or a bullet."""
    t = F.coalesce(F.col(text), F.lit(""))
    title = F.nullif(strip(F.regexp_extract(t, r"([^\n]*[^\s][^\n]*)", 1)), F.lit(""))
    duties = F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*[-*\u2022]([^\n]*)"), F.lit(1)), lambda x: strip(x))
    return parse_requirements(texts, text).withColumns({
        "role_title": title, "seniority_level": seniority(F.lit(None).cast("string"), F.col(text)), "responsibilities": F.filter(duties, lambda x: x != ""),
    })


#: What heads a part of a candidate's or a job's text, on a line of its own or with a colon behind it, and the part it heads.
HEADS = {
    "summary": "profile", "profile": "profile", "objective": "profile", "about": "profile", "skills": "skills", "technical skills": "skills", "key skills": "skills",
    "experience": "experience", "work experience": "experience", "employment": "experience", "employment history": "experience", "projects": "projects", "project": "projects",
    "education": "education", "certifications": "certifications", "certification": "certifications", "responsibilities": "responsibilities", "requirements": "requirements", "must have": "requirements", "nice to have": "requirements", "required": "requirements", "preferred": "requirements",
    "keywords": "keywords",
}
_HEAD = r"(?im)^[ \t#*]*(" + "|".join(sorted(HEADS, key=len, reverse=True)) + r")[ \t*]*(?::|$)"
_BULLET = r"^[ \t]*[-*\u2022][ \t]*"


def _parts(text: Column) -> Column:
    """(part, body) of each headed part of a text; what stands before the first head is the part named head."""
    cut = F.split(F.concat(F.lit("head\u0002"), F.regexp_replace(F.coalesce(text, F.lit("")), _HEAD, "\u0001$1\u0002")), "\u0001")
    known = F.create_map(*[F.lit(x) for kv in (HEADS | {"head": "head"}).items() for x in kv])
    return F.transform(cut, lambda p: F.struct(F.try_element_at(known, F.lower(F.substring_index(p, "\u0002", 1))).alias("part"), F.get(F.split(p, "\u0002"), F.lit(1)).alias("body")))


def _body(part: str) -> Column:
    return F.array_join(F.transform(F.filter("_parts", lambda p: p.part == part), lambda p: p.body), "\n")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda t: strip(t)), lambda t: t != "")


def _items(text: Column) -> Column:
    """What a list names, once each: parted at commas, semicolons, bars, bullets and line ends."""
    found = F.transform(F.split(text, r"[,;|\n\u2022]"), lambda t: strip(F.regexp_replace(t, _BULLET, "")))
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def _headed(texts: DataFrame, text: str) -> DataFrame:
    """With ``_parts`` as a column made once a row: a one-row generator, which no projection is folded into."""
    return texts.select("*", F.inline(F.array(F.struct(_parts(F.col(text)).alias("_parts")))))


def resume_records(texts: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``texts`` with the columns of ``RECORD``, email, phone, years_experience and certifications of free candidate texts: the offline default where no model parses them.

    The text's heads (``HEADS``) part it. The name is its first line; skills are the items of its skills part, under 'listed'; projects are lines
    'name: approach (tool, tool)'; an experience entry is a line without a bullet, with its years as duration, and the bulleted lines under it.
    Years are those that the text states, else the sum of the entries'. A text without heads has a name, an e-mail, a phone and years at most."""
    t = _headed(text_fields(texts, text).drop("skills"), text)
    phone = F.nullif(strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\+[0-9][\x20().0-9-]{7,}[0-9])", 1)), F.lit(""))
    skills, study = _items(_body("skills")), F.transform(_lines(_body("education")), lambda x: F.regexp_replace(x, _BULLET, ""))

    def project(line: Column) -> Column:
        bare = F.regexp_replace(line, _BULLET, "")
        tools = F.regexp_extract(bare, r"\(([^()]*)\)[ \t.]*$", 1)
        said = strip(F.regexp_replace(bare, r"\([^()]*\)[ \t.]*$", ""))
        return F.struct(strip(F.substring_index(said, ":", 1)).alias("name"), F.when(F.contains(said, F.lit(":")), strip(F.regexp_replace(said, r"^[^:]*:", ""))).alias("approach"), _items(tools).alias("tech_keywords"), _strings().alias("primary_skills"),
                        F.lit(None).cast("struct<skill_relevance: double, domain_relevance: double, execution_quality: double>").alias("metrics"))

    def entry(block: Column) -> Column:
        lines = _lines(block)
        head = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
        duties = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, _BULLET, ""))
        return F.struct(head.alias("title"), F.regexp_extract(F.lower(head), r"([0-9]+\.?[0-9]*[ ]*years?)", 1).alias("duration"), _strings().alias("primary_tech"), duties.alias("responsibilities_keywords"), _strings().alias("achievements"))

    blocks = F.filter(F.split(_body("experience"), r"\n(?=[ \t]*[^\s*\u2022-])"), lambda b: strip(b) != "")
    t = t.withColumns({"phone": phone, "_skills": skills, "education": study, "projects": F.transform(_lines(_body("projects")), project), "experience_entries": F.transform(blocks, entry), "certifications": _items(_body("certifications"))})
    stated, summed = F.col("years_experience"), total_years(F.transform("experience_entries", lambda e: e.duration))
    name = F.when(~F.col("name").rlike(_HEAD), F.col("name"))
    t = t.withColumns({
        "name": name, "candidate_id": candidate_id(F.col("email"), F.col("phone"), F.coalesce(name, F.lit("")), F.col(path) if path else F.lit("")), "years_experience": F.coalesce(stated, F.when(summed > 0, summed)),
        "profile_keywords_line": F.nullif(F.array_join(_lines(_body("profile")), " "), F.lit("")), "ats_boost_line": boost_line("_skills"), "canonical_skills": F.when(F.size("_skills") > 0, F.create_map(F.lit("listed"), F.col("_skills"))),
        "inferred_skills": F.lit(None).cast("array<struct<skill: string, confidence: double>>"), "skill_proficiency": F.lit(None).cast("array<struct<skill: string, years_last_used: int>>"), "domain_tags": _items(_body("keywords")),
    })
    return t.drop("_parts", "_skills")


def job_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with the columns of ``JOB`` that free job descriptions fill, and those of ``job_fields``: the offline default where no model parses them.

    Skills are those of its lists; where none is introduced in a sentence, the items of its skills part. Responsibilities are the lines under that head, else the bulleted ones."""
    t = _headed(job_fields(texts, text), text)
    own = F.transform(_lines(_body("responsibilities")), lambda x: F.regexp_replace(x, _BULLET, ""))
    listed = _items(_body("skills"))
    t = t.withColumns({
        "responsibilities": F.when(F.size(own) > 0, own).otherwise(F.col("responsibilities")), "required_skills": F.when(F.size("hard_skills") > 0, F.col("hard_skills")).otherwise(listed),
        "education_requirements": _lines(_body("education")), "certifications_required": _items(_body("certifications")), "keywords_flat": _items(_body("keywords")), "summary": F.nullif(F.array_join(_lines(_body("profile")), " "), F.lit("")),
    })
    return t.drop("_parts")


def record_defaults(records: DataFrame, text: str, today: Column | None = None) -> DataFrame:
    """``records`` whose meta (raw_text_length, last_updated) and explainability are filled where they are null or missing; what is given stays.

    ``text`` is the column of the text that a record was read from; a null one is of length 0. ``today``: the day of the run."""
    has = lambda c: c in records.columns
    inner = records.schema["meta"].dataType.names if has("meta") else ()
    given = lambda f, kind: F.col("meta")[f].cast(kind) if f in inner else F.lit(None).cast(kind)
    day = F.date_format(F.current_date() if today is None else today, "yyyy-MM-dd")
    length = F.coalesce(given("raw_text_length", "int"), F.length(F.col(text)), F.lit(0))
    nothing = F.struct(_strings().alias("top_matched_sentences"), _strings().alias("top_matched_keywords"))
    others = [F.col("meta")[f].alias(f) for f in inner if f not in ("raw_text_length", "last_updated")]
    filled = F.struct(length.alias("raw_text_length"), F.coalesce(given("last_updated", "string"), day).alias("last_updated"), *others)
    return records.withColumns({"meta": filled, "explainability": F.coalesce(F.col("explainability"), nothing) if has("explainability") else nothing})


def job_defaults(job: dict, text: str, today: str) -> dict:
    """One job description with its meta, hr_points (the number of its notes) and filter_requirements filled where they are missing."""
    meta = {"raw_text_length": len(text), "last_updated": today} | (job.get("meta") or {})
    return {"hr_points": len(job.get("hr_notes") or []), "filter_requirements": None} | job | {"meta": meta}


def call_arguments(response: Column) -> Column:
    """Of a model's answer (JSON) the arguments of its function call, and what is wrong where there are none."""
    call = F.get_json_object(response, "$.choices[0].message.function_call")
    args = F.get_json_object(response, "$.choices[0].message.function_call.arguments")
    error = F.when(call.isNull(), "no function call").when(F.coalesce(args, F.lit("")) == "", "no arguments").when(F.try_parse_json(args).isNull(), "bad arguments")
    return F.struct(F.when(error.isNull(), args).alias("arguments"), error.alias("error"))


def notes_asked(notes: Iterable[dict], job_skills: Iterable[str], years) -> list[dict]:
    """Of parsed notes those of type inferred_requirement, as impact, low, high and the job's skills that their text names, or names a word of.

    ``years`` maps a note's text to (low, high) or None; see ``rostrum.functions.text.experience_range`` for columns."""
    out = []
    for n in notes:
        if (n.get("type") or "").lower() == "inferred_requirement":
            text = (n.get("note") or "").lower()
            low, high = years(text) or (None, None)
            skills = [s for s in job_skills if s.lower() in text or any(w in text for w in s.lower().split())]
            out.append({"impact": float(n.get("impact", 0.5)), "low": low, "high": high, "skills": skills})
    return out


#: Fixed value: letters of a note that a report shows.
NOTE_SHOWN = 100


def short_note(note: Column) -> Column:
    return F.substring(note, 1, NOTE_SHOWN)


def hr_gate(rows: DataFrame, verdicts: DataFrame, cid: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows whose verdict says hr_should_filter are skipped; those without a verdict are kept."""
    both = rows.join(verdicts.select(cid, "hr_should_filter"), cid, "left")
    flagged = F.coalesce("hr_should_filter", F.lit(False))
    return both.where(~flagged).drop("hr_should_filter"), both.where(flagged)


def read_job(spark, path: str) -> dict:
    """The job description at ``path``: one JSON record, named explicitly; {} for a bad one. A small file, read on the driver."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError):
        return {}
