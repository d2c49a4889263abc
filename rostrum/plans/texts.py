"""Queries of text functions and of models' answers, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.functions.letters import plain_letters
from rostrum.functions.vec import l2_normalised
from rostrum.operators import answers, records, requirements, scoring
from rostrum.plans import fixtures as X
from rostrum.plans.catalogue import R3, query

_SPACED = "' ' || array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_+#]+'), ' ') || ' '"


@query("plain_letters", "select doc_id, sha256(strip_accents(coalesce(text, ''))) as digest, trim(replace(replace(replace(lower(strip_accents(coalesce(source, '') || ' Á-' || coalesce(lang, ''))), ' ', '_'), '-', '_'), '.', ''), '_') as slug from {documents}")
def plain_letters_query(s, d):
    named = F.concat(F.coalesce("source", F.lit("")), F.lit(" Á-"), F.coalesce("lang", F.lit("")))
    return X.table(s, d, "documents").select("doc_id", F.sha2(plain_letters(F.coalesce("text", F.lit(""))), 256).alias("digest"), T.slug_name(named).alias("slug"))


#: Words and phrases of the documents' four languages, some inside others, with weights.
WORDS = {"the": 4.0, "and the": 3.6, "and": 3.2, "of": 2.8, "que": 2.4, "he": 2.0, "with": 1.0, "zzz": 0.5}


@query("lexicon_whole_words", f"with w as (select doc_id, {_SPACED.format('text')} as t from {{documents}}) select doc_id, "
       + R3.format("(" + " + ".join(f"case when contains(t, ' {k} ') then {w}e0 else 0e0 end" for k, w in sorted(WORDS.items())) + f") / {sum(WORDS.values())!r}e0") + " as strict from w")
def lexicon_whole_words(s, d):
    return X.table(s, d, "documents").select("doc_id", T.r3(scoring.lexicon_score(F.col("text"), WORDS, strict=True)).alias("strict"))


@query("word_any", f"with w as (select doc_id, lower(text) as t, {_SPACED.format('text')} as p from {{documents}}) select doc_id, coalesce(contains(t, 'he and') or contains(t, 'he') or contains(t, 'and'), false) as loose, contains(p, ' he ') or contains(p, ' and ') as strict from w")
def word_any(s, d):
    said = lambda strict: F.coalesce(T.word_any(F.lit("He and"), F.col("text"), strict), F.lit(False))
    return X.table(s, d, "documents").select("doc_id", said(False).alias("loose"), said(True).alias("strict"))


@query("skills_whole_words", "select c_custkey, true as loose, c_mktsegment <> 'BUILDING' as strict from {customer}")
def skills_whole_words(s, d):
    """r is part of every segment's letters, but a word of one text only."""
    items = F.array(F.lower(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("docker")).otherwise(F.concat("c_mktsegment", F.lit(" r")))))
    met = lambda strict: requirements.skill_list(items, ["R"], strict)
    return X.table(s, d, "customer").select("c_custkey", met(False).alias("loose"), met(True).alias("strict"))


@query("skill_lists", """select doc_id, concat_ws('|', coalesce(nullif(trim(lang), ''), null), case when lower(trim(source)) is distinct from lower(trim(lang)) then nullif(trim(source), '') end, 'SQL') as skills,
concat_ws('|', 'first', coalesce(lang, '')) as tags from {documents}""")
def skill_lists(s, d):
    docs = X.table(s, d, "documents")
    skills = T.distinct_ci(F.array("lang", F.upper("lang"), F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit(" "), "source"), "source", F.lit("SQL"), F.lit("sql ")))
    tags = T.tagged(F.array(F.lit("REQ_SKILL: first "), F.lit("TOOL:x"), F.concat(F.lit("REQ_SKILL:"), F.coalesce("lang", F.lit("")))), "REQ_SKILL:")
    return docs.select("doc_id", F.array_join(skills, "|").alias("skills"), F.array_join(tags, "|").alias("tags"))


_CRITERIA = "case c_custkey % 6 when 0 then concat(c_custkey % 4, ' - ', c_custkey % 4 + 2, ' years') when 1 then concat('At least ', c_custkey % 9) when 2 then concat('up to ', c_custkey % 9, ' years') when 3 then concat(c_custkey % 9, ' years of ', c_mktsegment) when 4 then c_mktsegment end"


@query("criteria_ranges", """select c_custkey, case c_custkey % 6 when 0 then c_custkey % 4 when 1 then c_custkey % 9 when 2 then 0 when 3 then c_custkey % 9 - 1 end::double as low,
case c_custkey % 6 when 0 then c_custkey % 4 + 2 when 2 then c_custkey % 9 when 3 then c_custkey % 9 + 1 end::double as high, (c_custkey % 9 + case when c_custkey % 2 = 0 then 1.5 else 0 end)::double as total from {customer}""")
def criteria_ranges(s, d):
    total = T.total_years(F.array(F.concat((F.col("c_custkey") % 9).cast("string"), F.lit(" years")), F.when(F.col("c_custkey") % 2 == 0, "1.5 years here").otherwise("some months")))
    r = X.table(s, d, "customer").select("c_custkey", T.criteria_range(F.expr(_CRITERIA)).alias("r"), total.alias("total"))
    return r.select("c_custkey", "r.low", "r.high", "total")


@query("strict_skills", """select doc_id, (coalesce(lang, '') = 'en' or contains(lower(coalesce(text, '')), 'that') or contains(lower(coalesce(text, '')), 'tion')) and coalesce(lang, '') in ('en', 'de') as met from {documents}""")
def strict_skills(s, d):
    """One skill by name or by a word of the text, one by name alone, as it is too short for the text."""
    items = F.array(F.when(F.col("lang") == "en", "that tion").otherwise("x"), F.when(F.col("lang").isin("en", "de"), "go").otherwise("y"))
    return X.table(s, d, "documents").select("doc_id", requirements.strict_skills(items, F.coalesce("text", F.lit("")), ["That Tion", "GO"]).alias("met"))


@query("unit_vectors", f"select vec_id, {R3.format('list_dot_product(cast(embedding as double[]), cast(embedding as double[])) / greatest(list_dot_product(cast(embedding as double[]), cast(embedding as double[])), 1e-18)')} as length, {R3.format('embedding[1] / greatest(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 1e-9)')} as first from {{embeddings}}")
def unit_vectors(s, d):
    v = X.table(s, d, "embeddings").select("vec_id", l2_normalised(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return v.select("vec_id", T.r3(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("length"), T.r3(F.get("v", F.lit(0))).alias("first"))


# Answers: whole, fenced, cut within a text, with words about them, cut behind an item of a list, and none at all.
_FULL = """to_json(named_struct('ranked_candidates', array(named_struct('candidate_id', concat('c', conv_id), 're_rank_score', turn / 8D, 'meets_requirements', turn % 2 = 0, 'requirements_met', array('skills', 'other'),
'requirements_missing', array('visa', 'x'), 'note', coalesce(text, '')), named_struct('candidate_id', 'last', 're_rank_score', 0.5D, 'meets_requirements', true, 'requirements_met', array('visa'), 'requirements_missing', array('skills'), 'note', 'n'))))"""
_DAMAGED = f"""select conv_id, turn, case (conv_id + turn) % 6 when 0 then f when 1 then concat('```json', chr(10), f, chr(10), '```', chr(10), 'done') when 2 then substr(f, 1, locate('"note"', f) + 8) when 3 then concat('Here: ', f, ' That is all {{{{}}}}.')
when 4 then substr(f, 1, locate('"visa"', f) + 5) else 'no answer' end as answer from (select conv_id, turn, {_FULL} as f from {{conversations}})"""


@query("rerank_answers", """with b as (select conv_id, turn, (conv_id + turn) % 6 as k from {conversations}),
one as (select conv_id, turn, 'c' || conv_id as candidate_id, turn / 8e0 as score, turn % 2 = 0 as meets, 'skills' as met, 'visa' as missing from b where k < 5),
two as (select conv_id, turn, 'last' as candidate_id, 0.5e0 as score, true as meets, 'visa' as met, 'skills' as missing from b where k in (0, 1, 3)) select * from one union all select * from two""")
def rerank_answers(s, d):
    rows = answers.rerank_answers(X.view(s, d, _DAMAGED), "answer", ["skills", "visa"])
    return rows.select("conv_id", "turn", "candidate_id", F.col("re_rank_score").alias("score"), F.col("meets_requirements").alias("meets"), F.array_join("requirements_met", ",").alias("met"), F.array_join("requirements_missing", ",").alias("missing"))


_REQ = """select conv_id, turn, concat('```json', chr(10), '{{"experience": {{"type": "numeric", "min": ', turn, case when turn % 2 = 0 then '}}, "role": "' || role || '"}}' || chr(10) || '```' else ', "max": 9}}, "role": "' || role end) as answer from {conversations}"""


@query("requirement_answers", "select conv_id, turn, turn::bigint as low, case when turn % 2 = 1 then 9 else 0 end::bigint as high, role as said from {conversations}")
def requirement_answers(s, d):
    v = X.view(s, d, _REQ).select("conv_id", "turn", answers.requirement_answer(F.col("answer")).alias("v"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    return v.select("conv_id", "turn", at("$.experience.min", "bigint").alias("low"), F.coalesce(at("$.experience.max", "bigint"), F.lit(0)).alias("high"), at("$.role", "string").alias("said"))


@query("rerank_packs", """with r as (select doc_id, doc_id + 1 as rank, coalesce(length(text), 0) as size from {documents}), b as (select *, cast((rank - 1) // 30 as int) as block from r)
select doc_id, block, cast(floor(coalesce(sum(size) over (partition by block order by rank rows between unbounded preceding and 1 preceding), 0) / 5000) as int) as part from b""")
def rerank_packs(s, d):
    rows = X.table(s, d, "documents").select("doc_id", (F.col("doc_id") + 1).alias("rank"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return answers.packed(rows, F.col("size"), 5000).select("doc_id", "batch.block", "batch.part")


@query("note_texts", "select c_custkey, substr(c_name || ' ' || c_mktsegment || ' needs ten years of work in the field and a good deal of patience with the people of the house and more', 1, 100) as note from {customer}")
def note_texts(s, d):
    note = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" needs ten years of work in the field and a good deal of patience with the people of the house and more"))
    return X.table(s, d, "customer").select("c_custkey", records.short_note(note).alias("note"))


# A candidate's text: heads with and without colons, lists, projects with and without tools, entries with and without bullets.
_RESUME = """select c_custkey, concat(c_name, chr(10), 'mail: c', c_custkey, '@x.org, +49 30 ', 1000000 + c_custkey, chr(10), 'Summary', chr(10), 'Works in ', c_mktsegment, '.', chr(10), 'SKILLS: SQL, Spark; ', lower(c_mktsegment), ', SQL', chr(10),
case when c_custkey % 3 > 0 then concat('## Experience', chr(10), 'Engineer at A, 2 years', chr(10), '- built ', c_mktsegment, chr(10), '* led', chr(10), 'Clerk, 1.5 years', chr(10)) else '' end,
'Projects:', chr(10), '- Lake: stores ', c_mktsegment, ' (Spark, Delta)', chr(10), 'Plain', chr(10), 'Education', chr(10), 'BSc ', c_mktsegment) as text from {customer}"""


@query("resume_records", """select c_custkey, c_name as name, 'c' || c_custkey || '@x.org' as email, '+49 30 ' || (1000000 + c_custkey) as phone, case when c_custkey % 3 > 0 then 2e0 end as years, 'Works in ' || c_mktsegment || '.' as profile,
array_to_string(list_sort([lower(c_mktsegment), 'spark', 'sql']), ', ') as boost, 'SQL|Spark|' || lower(c_mktsegment) as skills, 'Lake>stores ' || c_mktsegment || '>Spark,Delta|Plain>>' as projects,
case when c_custkey % 3 > 0 then 'Engineer at A, 2 years>2 years>built ' || c_mktsegment || ',led|Clerk, 1.5 years>1.5 years>' else '' end as entries, 'BSc ' || c_mktsegment as education,
left('c' || c_custkey, 8) || '_' || substr(sha256('email:c' || c_custkey || '@x.org'), 1, 12) as candidate_id from {customer}""")
def resume_records(s, d):
    r = records.resume_records(X.view(s, d, _RESUME))
    text = lambda c: F.coalesce(c, F.lit(""))
    projects = F.transform("projects", lambda p: F.concat(p["name"], F.lit(">"), text(p.approach), F.lit(">"), F.array_join(p.tech_keywords, ",")))
    entries = F.transform("experience_entries", lambda e: F.concat(e.title, F.lit(">"), e.duration, F.lit(">"), F.array_join(e.responsibilities_keywords, ",")))
    return r.select("c_custkey", "name", "email", "phone", F.col("years_experience").alias("years"), F.col("profile_keywords_line").alias("profile"), F.col("ats_boost_line").alias("boost"), F.array_join(F.col("canonical_skills")["listed"], "|").alias("skills"),
                    F.array_join(projects, "|").alias("projects"), F.array_join(entries, "|").alias("entries"), F.array_join("education", "|").alias("education"), "candidate_id")


_JOB_TEXT = """select c_custkey, concat('Senior ', c_mktsegment, ' analyst', chr(10), 'About: we sell ', c_mktsegment, chr(10), case when c_custkey % 2 = 0 then concat('Must have: SQL, ', c_mktsegment, ' and Spark.', chr(10)) else concat('Skills', chr(10), '- SQL', chr(10), '- ', c_mktsegment, chr(10)) end,
case when c_custkey % 3 = 0 then concat('Responsibilities:', chr(10), '- run reports', chr(10), 'Meet clients', chr(10)) else '' end, 'Certifications: AWS, GCP', chr(10), 'Education', chr(10), 'BSc') as text from {customer}"""


@query("job_records", """select c_custkey, 'Senior ' || c_mktsegment || ' analyst' as title, 'Senior' as level, case when c_custkey % 2 = 0 then array_to_string(list_sort(['SQL', 'Spark', c_mktsegment]), '|') else 'SQL|' || c_mktsegment end as skills,
case when c_custkey % 3 = 0 then 'run reports|Meet clients' when c_custkey % 2 = 1 then 'SQL|' || c_mktsegment else '' end as duties, 'AWS|GCP' as certificates, 'BSc' as education, 'we sell ' || c_mktsegment as summary from {customer}""")
def job_records(s, d):
    r, joined = records.job_records(X.view(s, d, _JOB_TEXT)), lambda c: F.array_join(c, "|")
    return r.select("c_custkey", F.col("role_title").alias("title"), F.col("seniority_level").alias("level"), joined("required_skills").alias("skills"), joined("responsibilities").alias("duties"), joined("certifications_required").alias("certificates"), joined("education_requirements").alias("education"), "summary")
