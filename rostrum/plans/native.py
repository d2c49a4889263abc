"""Queries over native records, which an adapter view makes of every document, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import entities, ranking, records, requirements, scoring, validation
from rostrum.plans import fixtures as X
from rostrum.plans.catalogue import CTE, HAVE, R3, SOFT_SQL, _cand, _skilled, query

BASE = "select doc_id, concat('doc_', doc_id) as candidate_id, text, coalesce(lang, 'xx') as lang, coalesce(source, 'none') as source from {documents}"
BOOST = "case when doc_id % 4 < 2 then concat(lang, ', ', source, '; AWS ,') end"
RECORDS = f"""select candidate_id, concat('person ', doc_id) as name, text as profile_keywords_line, {BOOST} as ats_boost_line,
map('a', array(lang, source), 'b', array('SQL ', null)) as canonical_skills,
array(named_struct('skill', concat('inf ', lang), 'confidence', 0.7D), named_struct('skill', concat('guess ', source), 'confidence', 0.5D)) as inferred_skills,
array(named_struct('skill', concat('Prof', doc_id % 5), 'years_last_used', 1)) as skill_proficiency,
case when doc_id % 7 > 0 then array(named_struct('name', concat('Project on ', source), 'approach', text, 'tech_keywords', array(source, 'Spark'), 'primary_skills', array('SQL'),
  'metrics', named_struct('skill_relevance', (doc_id % 3) / 4D, 'domain_relevance', cast(null as double), 'execution_quality', 0.5D))) end as projects,
array(named_struct('primary_tech', array('Tech', lang), 'responsibilities_keywords', array('Led the team of five.', lang), 'achievements', array(concat('Built ', source, ' in one year')))) as experience_entries,
case when doc_id % 2 = 0 then array(concat('Studied at ', source, ' for years'), 'short') end as education, array(source, concat('Dom', doc_id % 3)) as domain_tags
from ({BASE})"""
JOB = {
    "role_title": "Senior data engineer. Ok.", "responsibilities": ["Led the team of five.", "x", "Run the data platform! And more of it"], "required_skills": ["SQL", "Spark", " en", "zzz"],
    "preferred_skills": ["tech", "sql"], "keywords_weighted": {"Web": 0.9, "sql": 0.5, "nope": 0.6}, "domain_tags": ["dom1"], "education_requirements": [], "certifications_required": ["AWS"],
    "weighting": {"required_skills": 0.2, "unknown": 1.0, "education": None}, "embedding_hints": {"overall_embed": "We build data tools. For all of us.", "projects_embed": None},
    "summary": "we build data tools.", "sections": [{"title": "About the whole team", "content": "It is a good team?"}, "x"],
}
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^ \t\n\v\f\r]+')"


def _sent(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(replace(coalesce({x}, ''), chr(10), ' '), '[^.!?]*[.!?]|[^.!?]+$'), lambda t: trim(t)), lambda t: len(regexp_extract_all(t, '[^ \t\r\f\v]+')) >= 3)"


def _phrases(x: str) -> str:
    parts = f"list_transform(string_split(translate(coalesce({x}, ''), '/;', ',,'), ','), lambda t: lower(trim(t, {_WHITE})))"
    return f"list_concat({parts}, list_transform({_WORDS.format(x)}, lambda t: lower(t)))"


_CAT = lambda *lists: "flatten([" + ", ".join(lists) + "])"
NATIVE = f"with n as (select *, {BOOST} as boost from ({BASE}))"
SENT = f"{NATIVE}, s as (select *, {_sent('text')} as st, {_sent('boost')} as sb from n)"
_IF7 = lambda x: f"case when doc_id % 7 > 0 then {x} else [] end"
SECTIONS = {
    "profile": "st",
    "skills": "[lang, source, 'SQL', 'inf ' || lang]",
    "projects": _IF7(_CAT(_sent("'Project on ' || source"), "st", "[source, 'Spark']")),
    "responsibilities": _CAT("['Led the team of five.']", _sent("'Built ' || source || ' in one year'"), "['Tech', lang]"),
    "education": f"case when doc_id % 2 = 0 then {_sent(chr(39) + 'Studied at ' + chr(39) + ' || source || ' + chr(39) + ' for years' + chr(39))} when doc_id % 4 = 1 then [lang, source || '; AWS'] else [] end",
    "overall": _CAT("st", _IF7("st"), "['Led the team of five.']", "sb"),
}
_EACH = " union all ".join(f"select candidate_id, '{n}' as section, ({x})[1:200] as texts from s" for n, x in SECTIONS.items())


def _native(s, d):
    return records.whole(X.view(s, d, RECORDS))


@query("record_sections", f"{SENT}, every as ({_EACH}) select candidate_id, section, len(texts) as n, sha256(array_to_string(texts, '|')) as digest from every where len(texts) > 0")
def record_sections(s, d):
    return records.section_texts(_native(s, d)).where(F.size("texts") > 0).select("candidate_id", "section", F.size("texts").cast("long").alias("n"), F.sha2(F.array_join("texts", "|"), 256).alias("digest"))


_JOBS = f"""select doc_id, concat('Senior ', lang, ' data engineer. Ok.') as role_title, array(named_struct('title', 'About the whole team', 'content', concat('It is ', source, ' team?')), named_struct('title', cast(null as string), 'content', text)) as sections,
case when doc_id % 3 > 0 then array(' SQL', lang, 'sql', cast(null as string)) end as required_skills, array(upper(lang)) as preferred_skills, array('x', source) as keywords_flat,
named_struct('projects_embed', cast(null as string), 'overall_embed', concat('We build ', source, ' tools. For all of us.')) as embedding_hints, array('Led the team of five.', 'x', concat('Run the ', lang, ' platform! And more of it')) as responsibilities,
array('AWS') as certifications_required, case when doc_id % 2 = 0 then array(source, 'aws') end as education_requirements, concat('we build ', source, ' tools.') as summary from ({BASE})"""
_SAID = "list_filter(list_transform({0}, lambda x: trim(x)), lambda x, i: list_position(list_transform({0}, lambda y: lower(trim(y))), lower(trim(x))) = i)[1:200]"
_SECTION = {
    "profile": "['Senior ' || lang || ' data engineer.', 'About the whole team']",
    "skills": "case when doc_id % 3 > 0 then ['SQL', lang, 'sql', upper(lang)] else [upper(lang)] end", "responsibilities": "['Led the team of five.', 'Run the ' || lang || ' platform!', 'And more of it']",
    "education": "case when doc_id % 2 = 0 then ['AWS', source, 'aws'] else ['AWS'] end", "overall": f"flatten([['We build ' || source || ' tools.', 'For all of us.', 'we build ' || source || ' tools.', 'It is ' || source || ' team?'], {_sent('text')}])",
}
_JOB_EACH = " union all ".join(f"select doc_id, '{n}' as section, {_SAID.format('v')} as texts from (select doc_id, {x} as v from n)" for n, x in _SECTION.items())


@query("job_sections", f"{NATIVE} select doc_id, section, len(texts) as n, sha256(array_to_string(texts, '|')) as digest from ({_JOB_EACH})")
def job_sections(s, d):
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "|")
    rows = records.job_section_rows(X.view(s, d, _JOBS), "doc_id")
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sha2(texts, 256).alias("digest"))


TOKENS = f"""{NATIVE}, t as (select *, list_sort(list_distinct(list_filter({_CAT("list_transform([lang, source, 'sql', 'inf ' || lang, 'prof' || (doc_id % 5), 'tech', 'led the team of five.', 'dom' || (doc_id % 3)], lambda x: lower(x))", _IF7("['spark']"), _phrases('text'), _phrases('boost'))}, lambda x: x <> ''))) as tokens from n)"""


@query("token_set", f"{TOKENS} select candidate_id, cast(len(tokens) as int) as n_tokens, sha256(array_to_string(tokens, chr(10))) as digest from t")
def token_set(s, d):
    r = _native(s, d)
    r = r.select("candidate_id", F.array_sort(records.record_tokens(r)).alias("tokens"))
    return r.select("candidate_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", "\n"), 256).alias("digest"))


def _share(items) -> str:
    return "(" + " + ".join(f"cast(list_contains(tokens, '{i}') as int)" for i in items) + f") / {float(len(items))}e0" if items else "0.5e0"


_ASKED = records.job_keywords(JOB)
_LISTS = {k: _share(_ASKED[k]) for k in ("required_skills", "preferred_skills", "domain_relevance", "responsibilities", "education")}
_LISTS["weighted_keywords"] = "(" + " + ".join(f"case when list_contains(tokens, '{k}') then {v}e0 else 0e0 end" for k, v in sorted(_ASKED["weighted_keywords"].items())) + f") / {sum(_ASKED['weighted_keywords'].values())!r}e0"
_VERB_TEXT = f"lower('led the team of five. ' || lang || ' built ' || source || ' in one year ' || trim(coalesce(text, ''), {_WHITE}) || ' ' || trim(coalesce(boost, ''), {_WHITE}))"
_LISTS["experience_keywords"] = "(" + " + ".join(f"case when contains(vt, '{k}') then {v}e0 else 0e0 end" for k, v in sorted(scoring.VERBS.items())) + f") / {sum(scoring.VERBS.values())!r}e0"
_LISTS["project_metrics"] = "case when doc_id % 7 > 0 then ((doc_id % 3) / 4e0 + 0.5e0) / 3 else 0.5e0 end"
_PART_W = scoring.KEYWORD_WEIGHTS | {"required_skills": 0.2}
_KW = " + ".join(f"{k} * {_PART_W[k]}e0" for k in sorted(_LISTS))


@query("keyword_all_parts", f"""{TOKENS}, v as (select *, {_VERB_TEXT} as vt from t), p as (select candidate_id, {', '.join(f'{x} as {k}' for k, x in _LISTS.items())} from v)
select candidate_id, {', '.join(R3.format(k) + ' as ' + k for k in _LISTS)}, {R3.format(f'greatest({_KW} - case when required_skills < 0.5 then (0.5e0 - required_skills) * 0.3e0 else 0e0 end, 0e0)')} as keyword_raw from p""")
def keyword_all_parts(s, d):
    out = records.keyword_parts(_native(s, d), JOB)
    return out.select("candidate_id", *[T.r3(k).alias(k) for k in _LISTS], "keyword_raw")


@query("record_skills", f"""{NATIVE} select candidate_id, array_to_string(list_sort(list_distinct(list_transform({_CAT("[lang, source, 'sql', 'inf ' || lang, 'guess ' || source, 'prof' || (doc_id % 5)]", _IF7("[source, 'spark']"))}, lambda x: lower(x)))), ', ') as skills from n""")
def record_skills(s, d):
    r = _native(s, d)
    return r.select("candidate_id", F.array_join(records.skill_union(r), ", ").alias("skills"))


_RAW = """select doc_id, concat('{{"a": ', case doc_id % 4 when 0 then concat('" ', lang, ' "') when 1 then concat('["', lang, '", "x"]') when 2 then '7' else '" "' end,
', "y": ', case doc_id % 4 when 0 then '2.5' when 1 then '3' when 2 then '"5"' else '3.5' end, ', "l": ', case doc_id % 2 when 0 then '["p", "q"]' else '"r s"' end, '}}') as json from (BASE)""".replace("BASE", BASE)


@query("record_normalise", f"""{NATIVE} select doc_id, case doc_id % 4 when 0 then lang when 1 then lang || '|x' else '' end as achievements,
cast(case doc_id % 4 when 0 then 2 when 1 then 3 when 2 then 0 else 4 end as int) as years, case doc_id % 2 when 0 then 'p q' else 'r s' end as line from n""")
def record_normalise(s, d):
    v = X.view(s, d, _RAW).withColumn("v", F.try_parse_json("json"))
    part = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    return v.select("doc_id", F.array_join(records.normalised_achievements(part("a")), "|").alias("achievements"), records.normalised_years(part("y")).alias("years"), records.normalised_line(part("l")).alias("line"))


_TAGS = f"""flatten([[source, upper(source), 'REQ_SKILL:sql'], ['JD_SUMMARY:{{}}'], ['REQ_SKILL:SQL', 'REQ_SKILL:' || lang], ['PREF_SKILL:sql'], ['TOOL:Spark'],
['DOMAIN_TOP:' || source, 'DOMAIN_TOP:' || upper(source), 'DOMAIN_TOP:REQ_SKILL:sql'],
['HR_NOTE:cat=general;type=x;impact=0.5;note=' || case when length(st) > 240 then substr(st, 1, 240) || '...' else st end], case when st <> '' then ['PHRASE:' || substr(st, 1, 200)] else [] end])"""


@query("job_tags", f"""{NATIVE}, q as (select *, trim(coalesce(text, ''), {_WHITE}) as st from n), a as (select doc_id, {_TAGS} as tags from q),
k as (select doc_id, tags, list_transform(tags, lambda x: lower(trim(x, {_WHITE}))) as low from a),
u as (select doc_id, list_filter(tags, lambda x, i: list_position(low, lower(trim(x, {_WHITE}))) = i) as tags from k)
select doc_id, cast(len(tags) as int) as n, sha256(array_to_string(tags, '|')) as digest from u""")
def job_tags(s, d):
    b = X.view(s, d, BASE)
    lits = lambda *x: F.array(*[F.lit(v).cast("string") for v in x])
    note = F.struct(F.lit(None).cast("string").alias("category"), F.lit("x").alias("type"), F.lit("0.5").alias("impact"), F.col("text").alias("note"))
    tags = records.enriched_tags(F.array("source", F.upper("source"), F.lit("REQ_SKILL:sql")), F.array(F.lit("SQL "), F.col("lang"), F.lit("")), lits("sql"), lits("Spark", None), F.array("text"), F.array(note), F.lit("{}"))
    return b.select("doc_id", tags.alias("t")).select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", "|"), 256).alias("digest"))


# Lists that end at a full stop, a semicolon, a line's end or the next list; names with a full stop inside; company is not anywhere.
_WISHES = """select c_custkey, case c_custkey % 5 when 0 then concat('Must have: ', c_name, ', sql and Node.js. Location: ', c_mktsegment, ' at our company, soon')
when 1 then concat(c_custkey % 9, '-', c_custkey % 9 + 3, ' years. Skills: ', c_mktsegment, '; location any place. Preferred: go and rust')
when 2 then concat('at least ', c_custkey % 7, ' years', chr(10), 'hard skills: C++, SQL', chr(10), c_mktsegment, ' nice-to-have ', c_name, ', sandbox. Required: sql, C++')
when 3 then concat('We hire. Must have ', c_name, ' Preferred skills: ', c_mktsegment, '. requires 5+ years') else case when c_custkey % 2 = 0 then '' end end as text from {customer}"""


@query("requirement_parse", """select c_custkey, case c_custkey % 5 when 1 then c_custkey % 9 when 2 then c_custkey % 7 when 3 then 5 end::double as low, case c_custkey % 5 when 1 then c_custkey % 9 + 3 end::double as high,
case c_custkey % 5 when 0 then c_mktsegment || ' at our company' end as location,
case c_custkey % 5 when 0 then c_name || '|Node.js|sql' when 1 then c_mktsegment when 2 then 'C++|SQL|sql' when 3 then c_name else '' end as hard,
case c_custkey % 5 when 1 then 'go|rust' when 2 then c_name || '|sandbox' when 3 then c_mktsegment else '' end as preferred from customer""")
def requirement_parse(s, d):
    out = records.parse_requirements(X.view(s, d, _WISHES))
    return out.select("c_custkey", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "location", F.array_join("hard_skills", "|").alias("hard"), F.array_join("preferred_skills", "|").alias("preferred"))


NOTE_TAGS = [
    "HR_NOTE:cat=exp;type=inferred_requirement;impact=0.8;note=at least 2 years of promo work", "HR_NOTE:cat=exp;type=recommendation;impact=0.9;note=brand#99 and 9+ years",
    "HR_NOTE:type=Inferred_Requirement;impact=bad;note=brand#12 and brand#25 needed",
]


@query("hr_gate", f"""{CTE}, {HAVE}, g as (select candidate_id, coalesce(years_experience >= 2, false) as e, list_contains(skills, 'promo') as p, len(list_intersect(skills, ['brand#1', 'brand#12', 'brand#25'])) / 3e0 as b from cand join have using (candidate_id))
select candidate_id, {R3.format('(0.8e0 * cast(e as int) + 0.8e0 * cast(coalesce(p, false) as int) + 0.5e0 * b) / 2.1e0')} as hr_score from g where e and coalesce(p, false)""")
def hr_gate(s, d):
    """Note tags are read, those that require something are asked of every candidate, and who fails a weighty one is skipped."""
    tags = s.createDataFrame([(t,) for t in NOTE_TAGS], "tag string").withColumn("n", T.hr_note("tag"))
    notes = tags.select("n.type", "n.note", "n.impact", T.experience_range("n.note").alias("r")).collect()  # one job's notes
    ranges = {(n.note or "").lower(): n.r and (n.r.low, n.r.high) for n in notes}
    asked = records.notes_asked([n.asDict() for n in notes], X.JD_REQUIRED, ranges.get)
    scored = scoring.hr_compliance(_skilled(s, d), asked)
    return records.hr_gate(scored.select("candidate_id", "hr_score"), scored)[0]


@query("report_requirements", f"""{CTE}, {SOFT_SQL}, r as (select candidate_id, l, g, cast(row_number() over (order by candidate_id) as int) as rank from soft)
select rank, concat(cast(rank as varchar), '. ', candidate_id, ' | Score: 0.500',
  case when l or g then concat(chr(10), '   ✅ Meets (', cast(cast(l as int) + cast(g as int) as varchar), '/2): ', concat_ws(', ', case when l then 'location' end, case when g then 'segment' end)) else '' end,
  case when l and g then '' else concat(chr(10), '   ❌ Missing (', cast(2 - cast(l as int) - cast(g as int) as varchar), '/2): ', concat_ws(', ', case when not l then 'location' end, case when not g then 'segment' end)) end) as line from r""")
def report_requirements(s, d):
    rows = requirements.compliance(_cand(s, d), X.SOFT).select("candidate_id", F.col("candidate_id").alias("name"), "met", "missing", F.lit(0.5).alias("final_score"))
    return ranking.report_lines(ranking.ranked(rows, F.col("final_score"), F.col("candidate_id").asc()))


@query("domain_fallback", f"{CTE} select candidate_id, case when candidate_id like '%1' then coalesce(nullif(case when candidate_id like '%11' then '' else segment end, ''), 'Unspecified') else location end as domain from cand")
def domain_fallback(s, d):
    industry = F.when(~F.col("candidate_id").like("%1"), F.col("location")).otherwise("")
    department = F.when(~F.col("candidate_id").like("%11"), F.col("segment")).otherwise("")
    return _cand(s, d).select("candidate_id", records.domain(industry, department).alias("domain"))


_ODD = """select doc_id, case when doc_id % 11 = 0 then '  ' when doc_id % 13 > 0 then concat(' doc_', doc_id) end as candidate_id, coalesce(source, '') as name, text as profile_keywords_line,
lang as ats_boost_line, cast(doc_id % 5 - 1 as double) as years_experience, array(named_struct('skill', lang, 'confidence', (doc_id % 4) / 2D)) as inferred_skills,
array(named_struct('name', source, 'metrics', named_struct('novelty', (doc_id % 3) / 1.5D, 'complexity', case when doc_id % 7 = 0 then -0.5D end))) as projects from {documents}"""


@query("record_validate", """select doc_id, case when doc_id % 11 = 0 then '' when doc_id % 13 > 0 then concat('doc_', doc_id) end as candidate_id, concat_ws('; ',
case when doc_id % 11 = 0 or doc_id % 13 = 0 then 'candidate_id: required' end, case when trim(coalesce(source, '')) = '' then 'name: required' end,
case when coalesce(text, '') = '' then 'profile_keywords_line: required' end, case when coalesce(lang, '') = '' then 'ats_boost_line: required' end,
case when doc_id % 5 = 0 then 'years_experience: not a number of 0 or more' end, case when lang is null then 'inferred_skills[].skill: required' end,
case when doc_id % 4 = 3 then 'inferred_skills[].confidence: outside 0..1' end, case when doc_id % 3 = 2 then 'projects[].metrics.novelty: outside 0..1' end,
case when doc_id % 7 = 0 then 'projects[].metrics.complexity: outside 0..1' end) as errors from {documents}""")
def record_validate(s, d):
    return validation.validated(X.view(s, d, _ODD)).select("doc_id", "candidate_id", F.array_join("errors", "; ").alias("errors"))


_BOOSTED = "list_sort(list_distinct([lower(lang), lower(source), 'sql', 'inf ' || lower(lang), 'guess ' || lower(source), 'prof' || (doc_id % 5)]))"


@query("embedding_hints", f"""{NATIVE} select candidate_id, coalesce(text, '') as profile_embed, case when doc_id % 7 > 0 then 'Project on ' || source || ': ' || coalesce(text, '') else '' end as projects_embed,
array_to_string(({_BOOSTED})[1:10], ', ') as skills_embed from n""")
def embedding_hints(s, d):
    r = _native(s, d)
    return r.select("candidate_id", records.embedding_hints(r).alias("h")).select("candidate_id", "h.*")


@query("candidate_summary", f"""{NATIVE}, j as (select *, chr(34) as q, case when doc_id % 3 = 0 then 0.25e0 else 0.5e0 end as f from n)
select candidate_id, concat('{{"id":"', candidate_id, '","n":"person","sc":{{"p":0.0,"k":0.0,"s":0.0,"f":', case when doc_id % 3 = 0 then '0.25' else '0.5' end, '}},"loc":"",',
  case when doc_id % 2 = 0 then concat('"role":"","sk":["', lang, '","', source, '","SQL "],"pj":[', case when doc_id % 7 > 0 then concat('{{"n":"', substr('Project on ' || source, 1, 50), '","tech":"', source, ', Spark","score":0.0}}') else '' end, ']}}')
  else '"sk":[],"pj":[]}}' end) as summary from j""".replace("{{", "{").replace("}}", "}"))
def candidate_summary(s, d):
    r = X.view(s, d, RECORDS)
    number = F.substring("candidate_id", 5, 18).cast("long")
    rows = r.select("candidate_id", F.lit("person").alias("name"), F.when(number % 3 == 0, 0.25).otherwise(0.5).alias("final_score"))
    return records.candidate_summary(rows, r.where(number % 2 == 0))


_MISS = "list_filter([" + ", ".join(f"'{x}'" for x in X.JD_REQUIRED) + "], lambda x: not list_contains(skills, x))"


@query("skills_report", f"""{CTE}, {HAVE}, m as (select candidate_id, {_MISS} as missing from have)
select candidate_id, len(missing) = 0 as meets, case len(missing) when 0 then 'exact' when {len(X.JD_REQUIRED)} then 'missing' else 'partial' end as match_quality,
case len(missing) when 0 then 'Has all required skills: {", ".join(X.JD_REQUIRED)}' when {len(X.JD_REQUIRED)} then 'Missing all required skills: {", ".join(X.JD_REQUIRED[:3])}'
  else concat('Has ', {len(X.JD_REQUIRED)} - len(missing), '/{len(X.JD_REQUIRED)} required skills. Missing: ', array_to_string(missing[1:3], ', ')) end as details from m""")
def skills_report(s, d):
    r = _skilled(s, d).select("candidate_id", requirements.skills_report(F.col("skills"), X.JD_REQUIRED).alias("r"))
    return r.select("candidate_id", "r.meets", "r.match_quality", "r.details")


# Each person's key is the id, the slug, another spelling or none; every fifth mapped file is gone; some files are not mapped.
_N = "cast(substr(candidate_id, 6) as bigint)"
_SEEN = f"select candidate_id, concat('Ann ', segment, '-', {_N}) as name from cand"
_MAPPED = f"""select case {_N} % 6 when 0 then candidate_id when 1 then concat('ann_', lower(segment), '_', {_N}) when 2 then concat('ANN-', segment, ' ', {_N}, '.') else concat('z', {_N}) end as key,
concat('m/', candidate_id, '.pdf') as path from cand"""
_THERE = f"""select concat('m/', candidate_id, '.pdf') as path from cand where {_N} % 5 > 0 union all
select concat('u/Ann_', segment, '-', {_N}, '.pdf') as path from cand where {_N} % 4 = 0"""
_SLUG = "trim(replace(replace(replace(lower({}), ' ', '_'), '-', '_'), '.', ''), '_')"


@query("path_lookup", f"""{CTE}, p as (select *, {_SLUG.format('name')} as slug from ({_SEEN})), m as (select * from ({_MAPPED}) where path in (select path from ({_THERE}))),
t as (select path, {_SLUG.format("regexp_extract(path, '([^/]+)[.]pdf$', 1)")} as slug from ({_THERE})),
w as (select p.candidate_id, name, path, 1 as kind from p join m on key = p.candidate_id union all select p.candidate_id, name, path, 2 from p join m on key = slug
union all select p.candidate_id, name, path, 3 from p join m on {_SLUG.format('key')} = slug union all select p.candidate_id, name, path, 4 from p join t using (slug))
select p.candidate_id, p.name, b.path, coalesce(b.kind, 0) as kind from p left join (select * from w qualify row_number() over (partition by candidate_id order by kind, path) = 1) b using (candidate_id)""")
def path_lookup(s, d):
    c = _cand(s, d)
    made = lambda sql: s.sql(sql.replace(" from cand", " from {cand}"), cand=c)
    found = entities.find_paths(made(_SEEN), made(_MAPPED), made(_THERE))
    return found.withColumn("kind", F.coalesce("kind", F.lit(0)))


@query("text_fields", r"""select doc_id, nullif(regexp_extract(coalesce(text, ''), '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1), '') as email,
try_cast(nullif(regexp_extract(lower(coalesce(text, '')), '([0-9]+(?:\.[0-9]+)?)\+?[ ]*years?', 1), '') as double) as years_experience,
nullif(trim(regexp_extract(coalesce(text, ''), '([^\n]*[^ \t\n\v\f\r][^\n]*)', 1), WHITE), '') as name from {documents}""".replace("WHITE", _WHITE))
def text_fields(s, d):
    return records.text_fields(X.table(s, d, "documents").select("doc_id", "text")).select("doc_id", "email", "years_experience", "name")


# The text at the tenth level counts, the one at the eleventh does not.
_NEST = lambda n, x: "array(" * n + x + ")" * n
_NESTED = f"""select doc_id, case when doc_id % 9 = 0 then 'no json' when doc_id % 10 = 0 then null else
to_json(named_struct('a', text, 'n', doc_id, 'b', array(named_struct('c', lang), named_struct('c', source)), 'ten', {_NEST(9, "'in'")}, 'eleven', {_NEST(10, "'out'")})) end as record from {{documents}}"""


@query("text_leaves", """select doc_id, len(l) as n, sha256(array_to_string(l, '|')) as digest from (select doc_id,
case when doc_id % 9 = 0 or doc_id % 10 = 0 then [] else list_filter([text, lang, source, 'in'], lambda x: x is not null) end as l from {documents})""")
def text_leaves(s, d):
    rows = X.view(s, d, _NESTED).select("doc_id", records.text_leaves("record").alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("digest"))


_POST = "select doc_id, concat(' \n ', coalesce(lang, 'Any'), ' engineer \n', text, '\n - ', source, '\n* \n', case when doc_id % 3 = 0 then '  * Mid-level, at least 4 years' else '' end) as text from {documents}"


@query("job_fields", r"""with t as (select doc_id, lang, source, text from {documents})
select doc_id, case when source is null or text is null then null else coalesce(lang, 'Any') || ' engineer' end as role_title,
case when source is null or text is null then 'Unspecified' when contains(lower(text), 'principal') or contains(lower(source), 'principal') then 'Principal'
  when (contains(lower(text), 'lead') or contains(lower(source), 'lead')) and not contains(lower(text), 'tech lead') then 'Lead' when contains(lower(text), 'senior') or contains(lower(source), 'senior') then 'Senior'
  when contains(lower(text), 'mid-level') or contains(lower(text), 'mid level') or contains(lower(text), 'midlevel') or doc_id % 3 = 0 then 'Mid'
  when contains(lower(text), 'junior') or contains(lower(text), 'entry level') or contains(lower(text), 'fresher') then 'Junior' else 'Unspecified' end as seniority_level,
case when source is null or text is null then 0 else len(list_filter(list_transform(regexp_extract_all(text, '(?m)^[ \t]*[-*•]([^\n]*)', 1), lambda x: trim(x)), lambda x: x <> '')) + case when source = '' then 0 else 1 end + case when doc_id % 3 = 0 then 1 else 0 end end as duties
from t""")
def job_fields(s, d):
    out = records.job_fields(X.view(s, d, _POST))
    return out.select("doc_id", "role_title", "seniority_level", F.size("responsibilities").cast("long").alias("duties"))


@query("record_defaults", """select doc_id, cast(case when doc_id % 2 = 0 then 7 else coalesce(length(text), 0) end as int) as raw_text_length,
case when doc_id % 3 = 0 and doc_id % 2 = 0 then '2020-01-01' else '2024-05-06' end as last_updated, case when doc_id % 5 = 0 then 1 else 0 end as explained from {documents}""")
def record_defaults(s, d):
    given = """select doc_id, text, case when doc_id % 2 = 0 then named_struct('raw_text_length', 7, 'last_updated', case when doc_id % 3 = 0 then '2020-01-01' end) end as meta,
case when doc_id % 5 = 0 then named_struct('top_matched_sentences', array('x'), 'top_matched_keywords', cast(array() as array<string>)) end as explainability from {documents}"""
    out = records.record_defaults(X.view(s, d, given), "text", F.lit("2024-05-06").cast("date"))
    return out.select("doc_id", "meta.raw_text_length", "meta.last_updated", F.size("explainability.top_matched_sentences").alias("explained"))


_ARGS = "to_json(named_struct('t', text, 'n', turn))"
_CALL = "to_json(named_struct('choices', array(named_struct('message', named_struct('function_call', named_struct('name', 'f', 'arguments', {}))))))"
_ANSWERED = f"""select conv_id, turn, case (conv_id + turn) % 6 when 0 then {_CALL.format(_ARGS)} when 1 then to_json(named_struct('choices', array(named_struct('message', named_struct('content', text)))))
when 2 then {_CALL.format("cast(null as string)")} when 3 then {_CALL.format("concat('{{', text)")} when 4 then concat('so: ', text) else {_CALL.format(_ARGS)} end as response from {{conversations}}"""


@query("call_arguments", """select conv_id, turn, case when (conv_id + turn) % 6 in (0, 5) then text end as t, case when (conv_id + turn) % 6 in (0, 5) then turn::double end as n,
case (conv_id + turn) % 6 when 1 then 'no function call' when 2 then 'no arguments' when 3 then case when text is null then 'no arguments' else 'bad arguments' end when 4 then 'no function call' end as error from conversations""")
def call_arguments(s, d):
    rows = X.view(s, d, _ANSWERED).select("conv_id", "turn", records.call_arguments(F.col("response")).alias("r"))
    return rows.select("conv_id", "turn", F.get_json_object("r.arguments", "$.t").alias("t"), F.get_json_object("r.arguments", "$.n").cast("double").alias("n"), "r.error")
