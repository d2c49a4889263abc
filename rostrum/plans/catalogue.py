"""Every registered query of the matching engine, with its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import entities, ranking, requirements, scoring
from rostrum.plans import fixtures as X
from rostrum.sources.io import cache_misses, settled

R3 = "cast(round(cast({} as decimal(18,9)), 3) as double)"
#: Frequent pieces of the documents' words, in place of the verbs, which do not occur there.
PIECES = {"the": 4.0, "tion": 3.6, "and": 3.2, "ung": 2.8, "que": 2.4}
NOTES = [
    {"impact": 0.8, "low": 2.0, "high": None, "skills": ["promo", "brand#1", "brand#2"]},
    {"impact": 0.4, "low": None, "high": 5.0, "skills": []},
    {"impact": 0.9, "low": None, "high": None, "skills": ["brand#12", "brand#13", "economy", "brand#99"]},
]

_cand = lambda s, d: X.view(s, d, X.CAND)
_proj = lambda s, d: X.view(s, d, X.PROJ)
_cskill = lambda s, d: X.view(s, d, X.CSKILL)


def _skilled(s, d) -> DataFrame:
    """Candidates with their skill sets; none is an empty set."""
    sets = X.view(s, d, X.SKILLS).groupBy("candidate_id").agg(F.collect_set("skill").alias("skills"))
    return _cand(s, d).join(sets, "candidate_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def _quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = X.sql_text(sql)
        return f

    return add


CTE = f"with cand as ({X.CAND}), proj as ({X.PROJ}), cskill as ({X.CSKILL})"
_M = scoring.METRICS
_NUM = " + ".join(f"coalesce({m}, 0) * 0.142857e0" for m in _M)
_DEN = " + ".join(f"(case when {m} is null then 0e0 else 0.142857e0 end)" for m in _M)
P_SCORE = f"case when {_DEN} > 0 then {R3.format(f'({_NUM}) / ({_DEN})')} else 0e0 end"
P_AGG = f"pscore as (select candidate_id, {P_SCORE} as s from proj), pagg as (select candidate_id, {R3.format('avg(s)')} as project_aggregate from pscore group by candidate_id)"


@query("project_aggregate", f"{CTE}, {P_AGG} select * from pagg")
def project_aggregate(s, d):
    return scoring.project_aggregate(_proj(s, d))


RANKED_SQL = f"""p as (select c.candidate_id, c.name, coalesce(years_experience, 0) as years, coalesce(project_aggregate, 0) as project_aggregate
  from cand c left join pagg using (candidate_id)),
b as (select min(project_aggregate) lo, max(project_aggregate) hi from p),
n as (select candidate_id, name, years, project_aggregate, case when hi > lo then {R3.format('(project_aggregate - lo) / (hi - lo)')} else project_aggregate end as project_score from p, b)"""


def _project_rank(s, d):
    base = _cand(s, d).join(scoring.project_aggregate(_proj(s, d)), "candidate_id", "left")
    base = base.select("candidate_id", "name", F.coalesce("years_experience", F.lit(0.0)).alias("years"), F.coalesce("project_aggregate", F.lit(0.0)).alias("project_aggregate"))
    scored = scoring.min_max(base, "project_aggregate", "project_score")
    return ranking.ranked(scored, F.col("project_score"), F.col("years").desc(), F.col("candidate_id").asc())


@query("project_rank", f"{CTE}, {P_AGG}, {RANKED_SQL} select *, cast(row_number() over (order by project_score desc, years desc, candidate_id) as int) as rank from n")
def project_rank(s, d):
    return _project_rank(s, d)


HAVE = "have as (select c.candidate_id, coalesce(list(skill), []) as skills from cand c left join cskill k using (candidate_id) group by c.candidate_id)"
# list() keeps a null of the outer join; no predicate below is met by it.


def _ratio(items) -> str:
    return "(" + " + ".join(f"cast(list_contains(skills, '{i}') as int)" for i in items) + f") / {float(len(items))}e0"


_WSUM = sum(X.JD_WEIGHTED.values())
REQ, PREF = _ratio(X.JD_REQUIRED), _ratio(X.JD_PREFERRED)
WKW = "(" + " + ".join(f"case when list_contains(skills, '{k}') then {w}e0 else 0e0 end" for k, w in sorted(X.JD_WEIGHTED.items())) + f") / {_WSUM!r}e0"


@query("keyword_overlap", f"{CTE}, {HAVE} select candidate_id, {R3.format(REQ)} as required, {R3.format(PREF)} as preferred from have")
def keyword_overlap(s, d):
    k = _skilled(s, d)
    return k.select("candidate_id", T.r3(scoring.overlap(X.JD_REQUIRED, F.col("skills"))).alias("required"), T.r3(scoring.overlap(X.JD_PREFERRED, F.col("skills"))).alias("preferred"))


@query("keyword_weighted", f"{CTE}, {HAVE} select candidate_id, {R3.format(WKW)} as weighted from have")
def keyword_weighted(s, d):
    return _skilled(s, d).select("candidate_id", T.r3(scoring.weighted_overlap(X.JD_WEIGHTED, F.col("skills"))).alias("weighted"))


PMET = "pmet as (select candidate_id, avg((coalesce(skill_relevance, 0) + coalesce(domain_relevance, 0) + coalesce(execution_quality, 0)) / 3) as m from proj group by candidate_id)"


@query("keyword_project_metrics", f"{CTE}, {PMET} select candidate_id, {R3.format('coalesce(m, 0.5e0)')} as project_metrics from cand left join pmet using (candidate_id)")
def keyword_project_metrics(s, d):
    m = scoring.project_metric_mean(_proj(s, d))
    return _cand(s, d).select("candidate_id").join(m, "candidate_id", "left").select("candidate_id", T.r3(F.coalesce("project_metrics", F.lit(0.5))).alias("project_metrics"))


_LEX = "(" + " + ".join(f"case when contains(lower(coalesce(text, '')), '{k}') then {w}e0 else 0e0 end" for k, w in sorted(PIECES.items())) + f") / {sum(PIECES.values())!r}e0"


@query("keyword_lexicon", f"select doc_id, {R3.format(_LEX)} as lexicon from {{documents}}")
def keyword_lexicon(s, d):
    return X.table(s, d, "documents").select("doc_id", T.r3(scoring.lexicon_score(F.col("text"), PIECES)).alias("lexicon"))


_W = scoring.KEYWORD_WEIGHTS
FUSED = f"""kw as (select candidate_id, {REQ} as req, {PREF} as pref, {WKW} as wkw, coalesce(m, 0.5e0) as pm from have left join pmet using (candidate_id)),
fused as (select candidate_id, {R3.format(f"greatest(pref * {_W['preferred_skills']}e0 + pm * {_W['project_metrics']}e0 + req * {_W['required_skills']}e0 + wkw * {_W['weighted_keywords']}e0 - case when req < 0.5 then (0.5e0 - req) * 0.3e0 else 0e0 end, 0e0)")} as keyword_raw from kw)"""


def _keyword_raw(rows):
    """``rows`` (skills, project_metrics) with keyword_raw."""
    k = rows.withColumn("project_metrics", F.coalesce("project_metrics", F.lit(0.5)))
    k = k.withColumns({"required_skills": scoring.overlap(X.JD_REQUIRED, F.col("skills")), "preferred_skills": scoring.overlap(X.JD_PREFERRED, F.col("skills")), "weighted_keywords": scoring.weighted_overlap(X.JD_WEIGHTED, F.col("skills"))})
    parts = {p: p for p in ("required_skills", "preferred_skills", "weighted_keywords", "project_metrics")}
    return k.withColumn("keyword_raw", scoring.keyword_fused(parts))


def _keyword_fused(s, d):
    rows = _skilled(s, d).join(scoring.project_metric_mean(_proj(s, d)), "candidate_id", "left")
    return _keyword_raw(rows).select("candidate_id", "keyword_raw")


query("keyword_fused", f"{CTE}, {HAVE}, {PMET}, {FUSED} select * from fused")(_keyword_fused)
KNORM = f"kb as (select min(keyword_raw) lo, max(keyword_raw) hi from fused), knorm as (select candidate_id, keyword_raw, case when hi > lo then {R3.format('(keyword_raw - lo) / (hi - lo)')} else keyword_raw end as keyword_score from fused, kb)"


def _keyword_score(s, d):
    return scoring.min_max(settled(_keyword_fused(s, d)), "keyword_raw", "keyword_score")


query("keyword_normalised", f"{CTE}, {HAVE}, {PMET}, {FUSED}, {KNORM} select * from knorm")(_keyword_score)


@query("sentence_sections", r"""with x as (select doc_id, list_filter(list_transform(regexp_extract_all(replace(text, chr(10), ' '), '[^.!?]*[.!?]|[^.!?]+$'), lambda t: trim(t)), lambda t: len(regexp_extract_all(t, '[^ \t\r\f\v]+')) >= 3) as s from {documents})
select doc_id, cast(len(s) as int) as n_sentences, s[1] as first_sentence from x""")
def sentence_sections(s, d):
    return X.table(s, d, "documents").select("doc_id", T.sentences("text").alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


# Vectors: the requirement's texts are the first 24, the candidates' the others.
VEC = """jd as (select vec_id as jd_id, vec_id % 6 as sec, embedding as jvec from {embeddings} where vec_id < 24),
rv as (select vec_id as rv, vec_id % 6 as sec, vec_id % 50 as candidate, embedding as vec from {embeddings} where vec_id >= 24),
sims as (select sec, jd_id, candidate, rv, list_dot_product(cast(jvec as double[]), cast(vec as double[])) as cos from jd join rv using (sec))"""


def _vectors(s, d):
    v = X.table(s, d, "embeddings").withColumn("section", F.element_at(F.array(*map(F.lit, X.SECTION_NAMES)), (F.col("vec_id") % 6 + 1).cast("int")))
    jd = v.where("vec_id < 24").select("section", F.col("vec_id").alias("jd_id"), F.col("embedding").alias("vec"))
    rv = v.where("vec_id >= 24").select("section", (F.col("vec_id") % 50).alias("candidate"), F.col("vec_id").alias("rv"), F.col("embedding").alias("vec"))
    return jd, rv


SEC = f"list_extract([{_quoted(X.SECTION_NAMES)}], cast(sec + 1 as int))"


@query("semantic_similarity", f"with {VEC} select {SEC} as section, jd_id, candidate, rv, {R3.format('cos')} as cos from sims")
def semantic_similarity(s, d):
    return scoring.similarities(*_vectors(s, d)).withColumn("cos", T.r3("cos"))


TAU = (0.2, 0.1)  # lower than the defaults, which these vectors never reach
SECTION = f"""best as (select sec, candidate, jd_id, max(cos) b from sims group by all),
rowside as (select sec, candidate, avg(case when b >= {TAU[0]} then 1e0 else 0e0 end) coverage, avg(b) depth from best group by all),
bestr as (select sec, candidate, rv, max(cos) b from sims group by all),
colside as (select sec, candidate, avg(case when b >= {TAU[1]} then 1e0 else 0e0 end) density from bestr group by all),
secs as (select {SEC} as section, candidate, coverage, depth, density, coverage * 0.5e0 + depth * 0.4e0 + density * 0.1e0 as section_score from rowside join colside using (sec, candidate))"""


@query("semantic_section", f"with {VEC}, {SECTION} select section, candidate, {', '.join(R3.format(c) + ' as ' + c for c in ('coverage', 'depth', 'density', 'section_score'))} from secs")
def semantic_section(s, d):
    x = scoring.section_scores(*_vectors(s, d), *TAU)
    return x.select("section", "candidate", *[T.r3(c).alias(c) for c in ("coverage", "depth", "density", "section_score")])


def _semantic_raw(s, d):
    wanted, offered = _vectors(s, d)
    scores = scoring.section_scores(wanted, offered, *TAU)
    return scoring.semantic_raw(scoring.with_empty_sections(scores, offered.select("candidate").distinct(), wanted))


_SW = "case section " + " ".join(f"when '{k}' then {v}e0" for k, v in scoring.SECTIONS.items()) + " end"
RAW = f"""names as (select unnest([{_quoted(X.SECTION_NAMES)}]) as section), people as (select distinct candidate from sims),
raw as (select p.candidate, {R3.format(f'sum({_SW} * coalesce(section_score, 0e0))')} as semantic_raw from people p cross join names n left join secs using (candidate, section) group by p.candidate)"""


@query("semantic_score", f"with {VEC}, {SECTION}, {RAW}, b as (select min(semantic_raw) lo, max(semantic_raw) hi from raw) select candidate, semantic_raw, case when hi > lo then {R3.format('(semantic_raw - lo) / (hi - lo)')} else 0.5e0 end as semantic_score from raw, b")
def semantic_score(s, d):
    return scoring.min_max(_semantic_raw(s, d), "semantic_raw", "semantic_score", equal="previous")


@query("semantic_best_match", f"""with {VEC}, best as (select sec, candidate, jd_id, rv, cos from sims qualify row_number() over (partition by sec, candidate, jd_id order by cos desc, rv) = 1)
select {SEC} as section, candidate, jd_id, rv, {R3.format('cos')} as cos, cast(pos as int) as pos from (select *, row_number() over (partition by sec, candidate order by jd_id) as pos from best) where pos <= 5""")
def semantic_best_match(s, d):
    return scoring.best_matches(*_vectors(s, d)).withColumn("cos", T.r3("cos"))


# Requirements


@query("req_numeric", f"{CTE} select candidate_id, coalesce(years_experience >= 1 and years_experience <= 5, false) as met from cand")
def req_numeric(s, d):
    return _cand(s, d).select("candidate_id", requirements.numeric(F.col("years_experience"), 1, 5).alias("met"))


@query("req_list_exact", f"{CTE}, {HAVE} select candidate_id, list_contains(skills, 'promo') and list_contains(skills, 'brand#1') as met from have")
def req_list_exact(s, d):
    return _skilled(s, d).select("candidate_id", F.forall(F.array(F.lit("promo"), F.lit("brand#1")), lambda r: F.array_contains("skills", r)).alias("met"))


def _fuzzy(items) -> str:
    return " and ".join(f"len(list_filter(skills, lambda x: contains(x, '{i}') or contains('{i}', x))) > 0" for i in items)


@query("req_list_fuzzy", f"{CTE}, {HAVE} select candidate_id, {_fuzzy(['promo', 'brand#1'])} as met from have")
def req_list_fuzzy(s, d):
    return _skilled(s, d).select("candidate_id", requirements.skill_list(F.col("skills"), ["promo", "brand#1"]).alias("met"))


@query("req_text", f"{CTE} select candidate_id, contains(lower(segment), 'building') as met from cand")
def req_text(s, d):
    return _cand(s, d).select("candidate_id", requirements.text(F.col("segment"), "BUILDING").alias("met"))


LOC = "len(list_filter(['nation_1', 'nation_2'], lambda a: contains(lower(location), a) or contains(a, lower(location)))) > 0"


@query("req_location", f"{CTE} select candidate_id, {LOC} as met from cand")
def req_location(s, d):
    return _cand(s, d).select("candidate_id", requirements.location(F.col("location"), "x", ["NATION_1", "NATION_2"]).alias("met"))


@query("req_education", f"{CTE} select candidate_id, segment in ('BUILDING', 'MACHINERY') as met from cand")
def req_education(s, d):
    degree = F.create_map(*[F.lit(x) for kv in X.DEGREES.items() for x in kv])[F.col("segment")]
    return _cand(s, d).select("candidate_id", requirements.education(degree, "Master's").alias("met"))


@query("req_boolean", f"{CTE} select candidate_id, coalesce(years_experience <> 0, false) as met from cand")
def req_boolean(s, d):
    return _cand(s, d).select("candidate_id", requirements.boolean(F.col("years_experience"), "double").alias("met"))


_HAS = "list_filter(['promo', 'brand#1'], lambda i: len(list_filter(skills, lambda x: contains(x, i) or contains(i, x))) > 0)"
_WHY = """case when e then null when years is null then 'experience: experience not found in resume' else concat('experience: experience: ', cast(years as varchar), ' (required: 1-5)') end as why_e,
  case when h then null else concat('hard_skills: Skills: Found ', case len(has) when 0 then 'none' else array_to_string(has, ', ') end, '. Missing: ', array_to_string(list_filter(['promo', 'brand#1'], lambda i: not list_contains(has, i)), ', ')) end as why_h"""
CHECK = f"""chk as (select candidate_id, c.name, years_experience as years, coalesce(years_experience >= 1 and years_experience <= 5, false) as e, {_fuzzy(['promo', 'brand#1'])} as h, {_HAS} as has from cand c join have using (candidate_id)),
checked as (select candidate_id, name, e and h as ok, (cast(e as int) + cast(h as int)) / 2e0 as score, concat_ws('; ', why_e, why_h) as filter_reason from (select *, {_WHY} from chk))"""


@query("mandatory_filter", f"{CTE}, {HAVE}, {CHECK} select candidate_id, score from checked where ok")
def mandatory_filter(s, d):
    return requirements.mandatory(_skilled(s, d), X.MANDATORY)[0].select("candidate_id", "score")


@query("filter_skipped", f"{CTE}, {HAVE}, {CHECK} select candidate_id, name, score, filter_reason from checked where not ok")
def filter_skipped(s, d):
    return requirements.mandatory(_skilled(s, d), X.MANDATORY)[1].select("candidate_id", "name", "score", "filter_reason")


SOFT_SQL = f"soft as (select candidate_id, location, segment, {LOC} as l, contains(lower(segment), 'building') as g from cand)"


@query("soft_compliance", f"""{CTE}, {SOFT_SQL} select candidate_id, concat_ws(', ', case when l then 'location' end, case when g then 'segment' end) as met,
concat_ws(', ', case when not l then 'location' end, case when not g then 'segment' end) as missing, (cast(l as int) + cast(g as int)) / 2e0 as score,
concat('Location: ', location, ' (allowed: NATION_1, NATION_2)|segment: ', chr(39), segment, chr(39), ' (required: ', chr(39), 'BUILDING', chr(39), ')') as details from soft""")
def soft_compliance(s, d):
    c = requirements.compliance(_cand(s, d), X.SOFT)
    details = F.array_join(F.transform("details", lambda x: x.details), "|").alias("details")
    return c.select("candidate_id", F.array_join("met", ", ").alias("met"), F.array_join("missing", ", ").alias("missing"), "score", details)


@query("compliance_label", f"""{CTE}, {SOFT_SQL} select candidate_id, case cast(l as int) + cast(g as int) when 2 then '✅ 2/2' when 1 then '⚠️ 1/2' else '❌ 0/2' end as label from soft""")
def compliance_label(s, d):
    c = requirements.compliance(_cand(s, d), X.SOFT).select("candidate_id", F.size("met").alias("m"), F.lit(2).alias("n"))
    return c.select("candidate_id", requirements.label("m", "n").alias("label"))


# Entities


REPEATED = f"""{CTE}, dup as (select candidate_id, name, 1 as src, candidate_id || 'a' as ord from cand union all
select case when candidate_id like '%3' then null else candidate_id end, name, 2, candidate_id || 'b' from cand where candidate_id like '%1' or candidate_id like '%3')"""


def _repeated(s, d):
    c = _cand(s, d).select("candidate_id", "name")
    again = c.where("candidate_id like '%1' or candidate_id like '%3'")
    two = again.select(F.when(~F.col("candidate_id").like("%3"), F.col("candidate_id")).alias("candidate_id"), "name", F.lit(2).alias("src"), F.concat("candidate_id", F.lit("b")).alias("ord"))
    return c.select("candidate_id", "name", F.lit(1).alias("src"), F.concat("candidate_id", F.lit("a")).alias("ord")).unionAll(two)


@query("dedup_keep_first", f"""{REPEATED} select candidate_id, name, src from dup
qualify case when candidate_id is not null then row_number() over (partition by candidate_id order by ord) = 1
             else row_number() over (partition by name order by ord) = 1 end""")
def dedup_keep_first(s, d):
    return entities.keep_first(_repeated(s, d), "ord").select("candidate_id", "name", "src")


@query("duplicate_counters", f"{REPEATED} select cast(count(*) as bigint) as n_rows, count(distinct candidate_id) as n_ids, count(candidate_id) - count(distinct candidate_id) as n_surplus, count(*) - count(candidate_id) as n_without_id from dup")
def duplicate_counters(s, d):
    return entities.duplicate_counts(_repeated(s, d))


MERGE = f"""{CTE}, {P_AGG}, {HAVE}, {PMET}, {FUSED},
a as (select candidate_id, name, project_aggregate from cand join pagg using (candidate_id) where candidate_id not like '%7'),
k as (select case when candidate_id like '%5' then null else candidate_id end as candidate_id, name, keyword_raw from cand join fused using (candidate_id) where candidate_id not like '%2')"""


@query("score_merge_outer", f"""{MERGE}, byid as (select a.candidate_id, a.name, project_aggregate, keyword_raw from a join k using (candidate_id)),
al as (select * from a where not exists (select 1 from k where k.candidate_id = a.candidate_id)),
ar as (select * from k where not exists (select 1 from a where k.candidate_id = a.candidate_id))
select * from byid union all
select coalesce(al.candidate_id, ar.candidate_id), coalesce(al.name, ar.name), project_aggregate, keyword_raw
from al full outer join ar on al.name = ar.name and (al.candidate_id is null or ar.candidate_id is null)""")
def score_merge_outer(s, d):
    c = _cand(s, d).select("candidate_id", "name")
    a = c.join(scoring.project_aggregate(_proj(s, d)), "candidate_id").where("candidate_id not like '%7'").select("candidate_id", "name", "project_aggregate")
    k = c.join(_keyword_fused(s, d), "candidate_id").where("candidate_id not like '%2'")
    k = k.select(F.when(~F.col("candidate_id").like("%5"), F.col("candidate_id")).alias("candidate_id"), "name", "keyword_raw")
    return entities.merge_scores(a, k)


@query("batch_semi", f"{CTE}, {P_AGG}, batch as (select case when candidate_id like '%0' then candidate_id end as candidate_id, case when candidate_id like '%1' then name else '' end as name from cand where candidate_id like '%0' or candidate_id like '%1') select c.candidate_id, c.name from cand c where exists (select 1 from batch b where b.candidate_id = c.candidate_id or (b.name <> '' and b.name = c.name))")
def batch_semi(s, d):
    c = _cand(s, d).select("candidate_id", "name")
    batch = c.where("candidate_id like '%0' or candidate_id like '%1'").select(F.when(F.col("candidate_id").like("%0"), F.col("candidate_id")).alias("candidate_id"), F.when(F.col("candidate_id").like("%1"), F.col("name")).otherwise("").alias("name"))
    return entities.in_batch(c, batch)


@query("skip_anti", f"{CTE}, log as (select candidate_id, name, 'old' as reason from cand where candidate_id like '%4'), new as (select case when candidate_id like '%9' then null else candidate_id end as candidate_id, name, 'new' as reason from cand where candidate_id like '%4' or candidate_id like '%6' or candidate_id like '%9') select * from log union all select * from new where candidate_id is null or not exists (select 1 from log where log.candidate_id = new.candidate_id)")
def skip_anti(s, d):
    c = _cand(s, d).select("candidate_id", "name")
    log = c.where("candidate_id like '%4'").withColumn("reason", F.lit("old"))
    new = c.where("candidate_id like '%4' or candidate_id like '%6' or candidate_id like '%9'")
    new = new.select(F.when(~F.col("candidate_id").like("%9"), F.col("candidate_id")).alias("candidate_id"), "name", F.lit("new").alias("reason"))
    return entities.append_skips(log, new)


@query("record_lookup", f"{CTE}, {P_AGG} select c.candidate_id, name, years_experience, project_aggregate from pagg p left join cand c using (candidate_id)")
def record_lookup(s, d):
    rows = entities.lookup(scoring.project_aggregate(_proj(s, d)), _cand(s, d))
    return rows.select("candidate_id", "name", "years_experience", "project_aggregate")


# Fusion and ranks. The semantic score of a candidate is that of the vector group of its number modulo 50.
ALL = f"""{CTE}, {P_AGG}, {HAVE}, {PMET}, {FUSED}, {KNORM}, {VEC}, {SECTION}, {RAW},
sb as (select min(semantic_raw) lo, max(semantic_raw) hi from raw), sem as (select candidate, case when hi > lo then {R3.format('(semantic_raw - lo) / (hi - lo)')} else 0.5e0 end as semantic_score from raw, sb),
three as (select c.candidate_id, c.name, coalesce(years_experience, 0) as years, case when c.candidate_id like '%8' then null else project_aggregate end as project_aggregate,
  case when c.candidate_id like '%8' or c.candidate_id like '%6' then null else semantic_score end as semantic_score, case when c.candidate_id like '%88' then null else keyword_score end as keyword_score
  from cand c left join pagg using (candidate_id) left join knorm using (candidate_id) left join sem on sem.candidate = cast(substr(c.candidate_id, 6) as bigint) % 50),
fin as (select *, case (case when project_aggregate is null then 0 else 1 end) + (case when semantic_score is null then 0 else 1 end) + (case when keyword_score is null then 0 else 1 end)
  when 0 then null when 1 then {R3.format('greatest(coalesce(project_aggregate, semantic_score, keyword_score) - 0.08e0, 0e0)')}
  else {R3.format("(coalesce(project_aggregate, 0) * 0.35e0 + coalesce(semantic_score, 0) * 0.35e0 + coalesce(keyword_score, 0) * 0.3e0) / ((case when project_aggregate is null then 0e0 else 0.35e0 end) + (case when semantic_score is null then 0e0 else 0.35e0 end) + (case when keyword_score is null then 0e0 else 0.3e0 end))")} end as final_score from three)"""


def _three(s, d, people=None):
    """Three scores of ``people`` (candidates with skills; all by default). What their bounds and rows both read is written once, slim."""
    sem = scoring.min_max(settled(_semantic_raw(s, d)), "semantic_raw", "semantic_score", equal="previous").select("candidate", "semantic_score")
    projects = _proj(s, d)
    if people is None:
        people = _skilled(s, d)
    else:
        projects = projects.join(people.select("candidate_id"), "candidate_id", "left_semi")
    rows = _keyword_raw(people.join(scoring.project_facts(projects), "candidate_id", "left"))
    rows = settled(rows.select("candidate_id", "name", "years_experience", "project_aggregate", "keyword_raw"))
    c = scoring.min_max(rows, "keyword_raw", "keyword_score").withColumn("candidate", F.substring("candidate_id", 6, 9).cast("long") % 50).join(sem, "candidate", "left")
    ends = lambda *e: F.expr(" or ".join(f"candidate_id like '%{x}'" for x in e))
    return c.select(
        "candidate_id", "name", F.coalesce("years_experience", F.lit(0.0)).alias("years"), F.when(~ends("8"), F.col("project_aggregate")).alias("project_aggregate"),
        F.when(~ends("8", "6"), F.col("semantic_score")).alias("semantic_score"), F.when(~ends("88"), F.col("keyword_score")).alias("keyword_score"),
    ).withColumn("final_score", ranking.fused())


def _final(s, d):
    rows = _three(s, d).where("final_score is not null")
    return ranking.ranked(rows, F.col("final_score"), F.col("years").desc(), F.col("candidate_id").asc())


FRANK = "frank as (select *, cast(row_number() over (order by final_score desc, years desc, candidate_id) as int) as rank from fin where final_score is not null)"


@query("final_fusion", f"{ALL} select candidate_id, final_score from fin")
def final_fusion(s, d):
    return _three(s, d).select("candidate_id", "final_score")


@query("final_rank", f"{ALL}, {FRANK} select candidate_id, final_score, years, rank from frank")
def final_rank(s, d):
    return _final(s, d).select("candidate_id", "final_score", "years", "rank")


@query("rerank_batches", f"{ALL}, {FRANK}, rr as (select candidate_id, 1 - final_score as re_rank_score, final_score > 0.3 as meets_requirements from frank where rank % 3 = 0), j as (select candidate_id, cast((rank - 1) // 30 as int) as batch, {R3.format('coalesce(re_rank_score, final_score)')} as re_rank_score, coalesce(meets_requirements, true) as meets_requirements, years from frank left join rr using (candidate_id)) select candidate_id, batch, re_rank_score, meets_requirements, cast(row_number() over (order by re_rank_score desc, years desc, candidate_id) as int) as rank from j")
def rerank_batches(s, d):
    rows = ranking.batches(_final(s, d))
    results = rows.where("rank % 3 = 0").select("candidate_id", (1 - F.col("final_score")).alias("re_rank_score"), (F.col("final_score") > 0.3).alias("meets_requirements"))
    both = ranking.attach_rerank(rows, results).withColumn("re_rank_score", T.r3("re_rank_score")).drop("rank")
    out = ranking.ranked(both, F.col("re_rank_score"), F.col("years").desc(), F.col("candidate_id").asc())
    return out.select("candidate_id", "batch", "re_rank_score", "meets_requirements", "rank")


@query("top_k", f"{ALL}, {FRANK} select candidate_id, rank from frank where rank <= 10")
def top_k(s, d):
    rows = _three(s, d).where("final_score is not null")
    return ranking.top(rows, 10, F.col("final_score"), F.col("years").desc(), F.col("candidate_id").asc()).select("candidate_id", "rank")


@query("report_lines", f"{ALL}, {FRANK} select rank, concat(cast(rank as varchar), '. ', name, ' | Score: ', printf('%.3f', final_score)) as line from frank")
def report_lines(s, d):
    return ranking.report_lines(_final(s, d))


@query("zip_manifest", f"{ALL}, {FRANK} select candidate_id, concat(printf('%03d', rank), '_', regexp_replace(name, '[^A-Za-z0-9_]', '', 'g'), case when candidate_id like '%3' then '_resume_missing.txt' else '_resume.pdf' end) as entry from frank where not regexp_matches(name, '[ -]') union all select candidate_id, concat(printf('%03d', rank), '_', regexp_replace(replace(replace(name, ' ', '_'), '-', '_'), '[^A-Za-z0-9_]', '', 'g'), case when candidate_id like '%3' then '_resume_missing.txt' else '_resume.pdf' end) from frank where regexp_matches(name, '[ -]')")
def zip_manifest(s, d):
    rows = _final(s, d)
    paths = rows.where("candidate_id not like '%3'").select("candidate_id", F.concat(F.lit("/x/"), "candidate_id").alias("path"))
    return ranking.manifest(rows, paths)


HR = f"""hr as (select candidate_id, coalesce(years_experience >= 2, false) as e1, coalesce(years_experience <= 5, false) as e2,
  len(list_intersect(skills, ['promo', 'brand#1', 'brand#2'])) / 3e0 as s1, len(list_intersect(skills, ['brand#12', 'brand#13', 'economy', 'brand#99'])) / 4e0 as s3 from cand join have using (candidate_id))"""


@query("hr_compliance", f"{CTE}, {HAVE}, {HR} select candidate_id, {R3.format('(0.8e0 * cast(e1 as int) + 0.8e0 * s1 + 0.4e0 * cast(e2 as int) + 0.9e0 * s3) / (0.8e0 + 0.8e0 + 0.4e0 + 0.9e0)')} as hr_score, not e1 or s1 < 0.3 or s3 < 0.3 as hr_should_filter from hr")
def hr_compliance(s, d):
    return scoring.hr_compliance(_skilled(s, d), NOTES)


@query("hr_note_parse", f"{CTE} select candidate_id, segment as category, 'note ' || location as note, case when candidate_id like '%5' then 0.5e0 else 0.25e0 end as impact from cand")
def hr_note_parse(s, d):
    impact = F.when(F.col("candidate_id").like("%5"), "bad").otherwise("0.25")
    tag = F.concat(F.lit("HR_NOTE:category="), "segment", F.lit(";note=note "), "location", F.lit(";impact="), impact)
    n = _cand(s, d).withColumn("tag", tag).select("candidate_id", T.hr_note("tag").alias("n"))
    return n.select("candidate_id", "n.category", "n.note", "n.impact")


_NOTED = """select c_custkey, case c_custkey % 7 when 0 then concat(c_custkey % 4, '-', c_custkey % 4 + 3, ' years') when 1 then concat(c_custkey % 5, ' to ', c_custkey % 5 + 2, ' Years of ', c_mktsegment)
when 2 then concat('at least ', c_custkey % 9, ' years') when 3 then concat(c_name, ' has ', c_custkey % 9, ' years experience') when 4 then concat(c_custkey % 9, '+ years') when 5 then concat('over ', c_custkey % 9, ' year') else c_mktsegment end as note from {customer}"""


@query("experience_parse", """select c_custkey, case c_custkey % 7 when 0 then c_custkey % 4 when 1 then c_custkey % 5 when 6 then null else c_custkey % 9 end::double as low,
case c_custkey % 7 when 0 then c_custkey % 4 + 3 when 1 then c_custkey % 5 + 2 when 3 then c_custkey % 9 + 2 end::double as high from customer""")
def experience_parse(s, d):
    return X.view(s, d, _NOTED).select("c_custkey", T.experience_range("note").alias("r")).select("c_custkey", "r.low", "r.high")


@query("skills_missing", f"{CTE}, {HAVE} select candidate_id, " + " || ".join(f"case when {_fuzzy([i])} then '' else '{i};' end" for i in X.JD_REQUIRED) + " as missing from have")
def skills_missing(s, d):
    m = requirements.missing_skills(F.col("skills"), X.JD_REQUIRED)
    return _skilled(s, d).select("candidate_id", F.array_join(F.transform(m, lambda x: F.concat(x, F.lit(";"))), "").alias("missing"))


@query("skills_union", "select concat('cand_', lpad(cast(o_custkey as string), 9, '0')) as candidate_id, count(distinct lower(x.skill)) as n_skills from {orders} join {lineitem} on l_orderkey = o_orderkey join (select p_partkey, p_brand as skill from {part} union all select p_partkey, p_type from {part}) x on p_partkey = l_partkey group by o_custkey")
def skills_union(s, d):
    return _cskill(s, d).groupBy("candidate_id").agg(F.count_distinct("skill").alias("n_skills"))


@query("boost_line", f"{CTE} select candidate_id, string_agg(skill, ', ' order by skill) as boost from cskill group by candidate_id")
def boost_line(s, d):
    return _skilled(s, d).where(F.size("skills") > 0).select("candidate_id", T.boost_line("skills").alias("boost"))


@query("candidate_hash", f"{CTE} select candidate_id, case when candidate_id like '%1' then substr(lower(name), 1, 8) || '_' || substr(sha256('email:' || lower(name) || '@x.org'), 1, 12) else substr(replace(lower(name), ' ', ''), 1, 8) || '_' || substr(sha256('name:' || name), 1, 12) end as hash from cand")
def candidate_hash(s, d):
    mail = F.when(F.col("candidate_id").like("%1"), F.concat("name", F.lit("@x.org")))
    return _cand(s, d).select("candidate_id", T.candidate_id(mail, F.lit(None).cast("string"), F.col("name"), F.lit("f.txt")).alias("hash"))


@query("name_normalise", r"""select doc_id, array_to_string(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+|[^\p{L}]+'), lambda t: case when t[1] = 'ß' then 'Ss' else upper(t[1]) end || lower(t[2:])), ''), '[^ \t\n\v\f\r]+'), ' ') as name from {documents}""")
def name_normalise(s, d):
    return X.table(s, d, "documents").select("doc_id", T.title_name("text").alias("name"))


@query("seniority", "select doc_id, case when contains(lower(text), 'principal') then 'Principal' when contains(lower(text), 'lead') and not contains(lower(text), 'tech lead') then 'Lead' when contains(lower(text), 'senior') then 'Senior' when contains(lower(text), 'mid-level') or contains(lower(text), 'mid level') or contains(lower(text), 'midlevel') then 'Mid' when contains(lower(text), 'junior') or contains(lower(text), 'entry level') or contains(lower(text), 'fresher') then 'Junior' else 'Unspecified' end as level from {documents}")
def seniority(s, d):
    return X.table(s, d, "documents").select("doc_id", T.seniority(F.lit(None).cast("string"), F.col("text")).alias("level"))


#: Departments and what is asked of them, with cases of every branch.
FIELDS = [["Computer Science"], ["Mechanical Engineering"], ["Botany"], ["Botany", "B.Tech Civil"], ["", " "], None, ["Law "], ["Fine Arts"], ["ENTC"], ["History of Law"]]
ASKS = [("IT", [], []), ("Non-IT", [], ["civil"]), ("", ["law", "art"], []), ("", [], ["Law"]), ("", [], []), ("it", ["law"], ["computer science"])]
_ASK_ROWS = ", ".join(f"({i}, '{c.lower()}', [{_quoted(x.lower() for x in a)}]::varchar[], [{_quoted(x.lower() for x in e)}]::varchar[])" for i, (c, a, e) in enumerate(ASKS))
_VOCAB = " ".join(f"when '{k}' then [{_quoted(v)}]" for k, v in requirements.DEPARTMENTS.items())
# A customer's departments: those of its number, and its segment where it is even.
_OWN = lambda array: "case c_custkey % 10 " + " ".join(f"when {i} then {'null' if f is None else array(f)}" for i, f in enumerate(FIELDS)) + " end"


@query("department_match", f"""with f as (select c_custkey, list_filter(list_transform(list_concat(coalesce({_OWN(lambda f: f'[{_quoted(f)}]')}, []), case when c_custkey % 20 < 10 then [c_mktsegment] else [] end), lambda x: lower(trim(x))), lambda x: x <> '') as have from customer),
a as (select *, case category {_VOCAB} else []::varchar[] end as vocab from (values {_ASK_ROWS}) t(ask, category, allowed, excluded))
select c_custkey, ask, len(have) > 0 and case when category in ('it', 'non-it') then len(list_filter(have, lambda h: len(list_filter(vocab, lambda v: contains(h, v))) > 0)) > 0
  when len(allowed) > 0 then len(list_filter(have, lambda h: len(list_filter(allowed, lambda v: contains(h, v) or contains(v, h))) > 0)) > 0
  else len(list_filter(have, lambda h: len(list_filter(excluded, lambda v: contains(h, v) or contains(v, h))) > 0)) = 0 end as met
from f cross join a""")
def department_match(s, d):
    own = F.expr(_OWN(lambda f: f"array({_quoted(f)})"))
    rows = X.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 20 < 10, F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array("c_mktsegment"))).otherwise(own).alias("fields"))
    checks = [F.struct(F.lit(i).alias("ask"), requirements.department(F.col("fields"), *ask).alias("met")) for i, ask in enumerate(ASKS)]
    return rows.select("c_custkey", F.inline(F.array(*checks)))


MODES = ["Remote", "onsite", "on-site or hybrid", "hybrid", "NATION_1", "nation_1, europe", "flexible", "remote/onsite", "", "remote or onsite"]
_MODE_ROWS = ", ".join(f"('{m.lower().strip()}')" for m in MODES)


@query("location_workmode", f"""{CTE}, place as (select candidate_id, case when candidate_id like '%1' then null when candidate_id like '%2' then '' when candidate_id like '%3' then location || ' (Remote)'
  when candidate_id like '%4' then 'Hybrid, ' || location when candidate_id like '%5' then 'On-Site and remote' else location end as p from cand)
select candidate_id, mode, coalesce(case when mode in ('any', 'anywhere', 'remote/onsite', 'flexible', '') then true
  when coalesce(p, '') = '' then false
  when contains(mode, 'remote') and contains(lower(p), 'remote') then true
  when (contains(mode, 'onsite') or contains(mode, 'on-site')) and (contains(lower(p), 'onsite') or contains(lower(p), 'on-site') or not contains(lower(p), 'remote')) then true
  when contains(mode, 'hybrid') and contains(lower(p), 'hybrid') then true
  when contains(mode, 'remote') and not contains(lower(p), 'remote') then false
  else contains(lower(p), mode) or contains(mode, lower(p)) end, false) as met
from place cross join (values {_MODE_ROWS}) m(mode)""")
def location_workmode(s, d):
    loc = "case when candidate_id like '%1' then null when candidate_id like '%2' then '' when candidate_id like '%3' then location || ' (Remote)' when candidate_id like '%4' then 'Hybrid, ' || location when candidate_id like '%5' then 'On-Site and remote' else location end"
    modes = [F.struct(F.lit(m.lower().strip()).alias("mode"), requirements.work_mode(F.col("p"), m).alias("met")) for m in MODES]
    return _cand(s, d).select("candidate_id", F.expr(loc).alias("p")).select("candidate_id", F.inline(F.array(*modes)))


@query("other_criteria", "select doc_id, (cast(contains(lower(text), 'that') as int) + cast(contains(lower(text), 'quevi') as int) + cast(contains(lower(text), 'keit') as int) + cast(contains(lower(text), 'zzzz') as int)) * 2 >= 4 or contains(lower(text), 'that') or contains(lower(text), 'quevi') as one, contains(lower(text), 'that') and contains(lower(text), 'tion') as two, false as none from {documents}")
def other_criteria(s, d):
    met = lambda *c: requirements.other_criteria(F.col("text"), c)
    return X.table(s, d, "documents").select("doc_id", met("that quevi keit of zzzz").alias("one"), met("That", "tion").alias("two"), met("a of it", "that").alias("none"))


# Names share a first word with many files; stems are the name's words run together, one word, the record's stem, or hold it.
_PEOPLE = "select candidate_id, 'Jo ' || segment || ' nn' || cast(cast(substr(candidate_id, 6) as bigint) as string) as name, 'Rec-' || candidate_id as stem from cand"
_FILES = """select 'f/' || candidate_id || '.pdf' as path, case cast(substr(candidate_id, 6) as bigint) % 6 when 0 then lower(segment) || 'nn' || cast(cast(substr(candidate_id, 6) as bigint) as string) || 'cv'
  when 1 then segment when 2 then 'Rec-' || candidate_id when 3 then 'the rec-' || candidate_id || ' final' when 4 then 'c-' || substr(candidate_id, 1, 14) else candidate_id end as stem from cand where candidate_id not like '%5'"""
_KEY = "lower(regexp_replace({}, '[^A-Za-z0-9 _-]', '', 'g'))"


@query("file_match", f"""{CTE}, p as (select *, {_KEY.format('stem')} as rs, list_filter(string_split({_KEY.format('name')}, ' '), lambda x: length(x) > 2) as w from ({_PEOPLE})),
f as (select *, {_KEY.format('stem')} as fs from ({_FILES})),
m as (select p.candidate_id, f.path, case when contains(fs, w[1]) and contains(fs, w[2]) then 1 when f.stem = p.stem then 2 when contains(fs, rs) or contains(rs, fs) then 3 end as kind from p cross join f)
select candidate_id, path, kind from m where kind is not null qualify row_number() over (partition by candidate_id order by kind, path) = 1""")
def file_match(s, d):
    c = _cand(s, d)
    return entities.match_files(s.sql(_PEOPLE.replace(" from cand", " from {cand}"), cand=c), s.sql(_FILES.replace(" from cand", " from {cand}"), cand=c))


@query("hash_cache_misses", "select doc_id, md5(text) as content_md5, sha256('model||' || text) as embed_key from {documents} x where not exists (select 1 from {documents} y where y.doc_id % 2 = 0 and y.text = x.text)")
def hash_cache_misses(s, d):
    docs = X.table(s, d, "documents").withColumns({"content_md5": F.md5("text"), "embed_key": F.sha2(F.concat(F.lit("model||"), "text"), 256)})
    cache = docs.where("doc_id % 2 = 0").select("content_md5")
    return cache_misses(docs, cache, "content_md5").select("doc_id", "content_md5", "embed_key")


KEPT = ALL.replace(f"{KNORM}", f"{CHECK}, kfused as (select fused.* from fused semi join (select candidate_id from checked where ok) w using (candidate_id)), " + KNORM.replace("fused", "kfused"))


@query("pipeline_full", f"{KEPT}, kfin as (select fin.* from fin semi join (select candidate_id from checked where ok) w using (candidate_id)) select candidate_id, name, final_score, years, cast(row_number() over (order by final_score desc, years desc, candidate_id) as int) as rank from kfin where final_score is not null")
def pipeline_full(s, d):
    """Mandatory filter, three scores over what it keeps, fusion and rank."""
    kept = requirements.mandatory(_skilled(s, d), X.MANDATORY)[0]
    rows = _three(s, d, settled(kept.select("candidate_id", "name", "years_experience", "skills"))).where("final_score is not null")
    out = ranking.ranked(rows, F.col("final_score"), F.col("years").desc(), F.col("candidate_id").asc())
    return out.select("candidate_id", "name", "final_score", "years", "rank")


def queries() -> dict:
    from rostrum.plans import asked, files, native, resolution, stores, texts  # register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from rostrum.plans import asked, files, native, resolution, stores, texts

    return dict(SQL)
