import json

from pyspark.sql import functions as F

from rostrum.operators import entities, ranking, records, requirements, validation
from rostrum.sources import external


def test_missing_columns_and_nulls_are_empty(spark):
    r = records.whole(spark.createDataFrame([("a", None), (None, "One two three. x")], "candidate_id string, profile_keywords_line string"))
    out = {tuple(x) for x in records.record_sections(r).collect()}
    assert out == {(None, "profile", 0, "One two three."), (None, "overall", 0, "One two three.")}
    assert [x.t for x in r.select(records.record_tokens(r).alias("t")).collect()] == [[], ["one two three. x", "one", "two", "three.", "x"]]
    assert [x.s for x in r.select(records.skill_union(r).alias("s")).collect()] == [[], []]
    parts = records.keyword_parts(r, {}).first()
    assert (parts.required_skills, parts.weighted_keywords, parts.project_metrics, parts.experience_keywords) == (0.5, 0.5, 0.5, 0.0)
    assert records.record_sections(r.limit(0)).count() == 0


def test_an_empty_job_falls_back_to_all_its_texts():
    assert records.job_sections({"odd": {"deep": ["We look for you.", 3, "And you"]}})["overall"] == ["We look for you."]
    assert not any(records.job_sections({}).values())
    assert records.job_keywords({"required_skills": [" SQL ", None]})["required_skills"] == ["sql"]


def test_gate_keeps_rows_without_a_verdict(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "candidate_id string")
    verdicts = spark.createDataFrame([("a", True), ("b", False)], "candidate_id string, hr_should_filter boolean")
    kept, skipped = records.hr_gate(rows, verdicts)
    assert {r[0] for r in kept.collect()} == {"b", None} and [r[0] for r in skipped.collect()] == ["a"]
    asked = records.notes_asked([{"type": "x", "note": "sql"}, {"type": "inferred_requirement", "note": "SQL server", "impact": 0.7}], ["sql", "mobile server", "go"], lambda t: None)
    assert asked == [{"impact": 0.7, "low": None, "high": None, "skills": ["sql", "mobile server"]}]


def test_files_of_other_people_do_not_match(spark):
    people = spark.createDataFrame([("1", "John Doe", "r1"), ("2", "Ann Lee", "r2"), ("3", "Li", "resume_3"), ("4", "Bo", "q")], "candidate_id string, name string, stem string")
    files = spark.createDataFrame([("f/john_smith.pdf", "john_smith"), ("f/annlee_cv.pdf", "annlee_cv"), ("f/resume_3 final.pdf", "resume_3 final"), ("f/.pdf", "")], "path string, stem string")
    assert {tuple(r) for r in entities.match_files(people, files).collect()} == {("2", "f/annlee_cv.pdf", 1), ("3", "f/resume_3 final.pdf", 3)}
    assert entities.match_files(people.limit(0), files).count() == 0


def test_skill_fields_resolve_to_one_column(spark):
    df = spark.createDataFrame([(1.0, ["a"], "x")], "years_experience double, skills array<string>, Domains string")
    found = [requirements.resolve(df, f) for f in ("Hard_Skills", "programming_skills", "exp", "domain_experience", "domains", "salary_range")]
    assert found == ["skills", "skills", "years_experience", None, "Domains", None]


def test_normalising_variants(spark):
    v = spark.createDataFrame([("2.5",), ("3",), ("null",), ('"x "',), ('[" a"]',), ("{}",)], "j string").withColumn("v", F.try_parse_json("j"))
    got = [tuple(r) for r in v.select(records.normalised_achievements(F.col("v")), records.normalised_years(F.col("v"))).collect()]
    assert got == [([], 2), ([], 3), ([], 0), (["x"], 0), ([" a"], 0), ([], 0)]


def test_validation_names_what_is_wrong(spark):
    schema = """candidate_id string, name string, profile_keywords_line string, ats_boost_line string, years_experience double,
    inferred_skills array<struct<skill: string, confidence: double>>, projects array<struct<name: string, metrics: struct<novelty: double>>>"""
    ok = (" a ", " N ", "p", " ", 0.0, [("s", 1.0), ("t", None)], [("x", (0.0,)), ("y", None)])
    bad = ("\t", None, "", None, float("nan"), [(None, 1.5), None], [("x", (float("nan"),))])
    rows = validation.validated(spark.createDataFrame([ok, bad, ("b", "n", "p", "q", None, None, None)], schema)).collect()
    assert [(r.candidate_id, r["name"], r.valid) for r in rows] == [("a", "N", True), ("", None, False), ("b", "n", True)]
    assert rows[1].errors == [
        "candidate_id: required", "name: required", "profile_keywords_line: required", "ats_boost_line: required", "years_experience: not a number of 0 or more",
        "inferred_skills[].skill: required", "inferred_skills[].confidence: outside 0..1", "projects[].metrics.novelty: outside 0..1",
    ]
    few = spark.createDataFrame([("a",)], "candidate_id string")
    assert validation.validated(few).first().errors == ["name: required", "profile_keywords_line: required", "ats_boost_line: required"]
    assert validation.job_errors({"role_title": " ", "hr_points": -1, "weighting": {"education": 1.1}}) == ["role_title: required", "hr_points: not a number of 0 or more", "weighting.education: outside 0..1"]
    assert validation.job_errors({"role_title": "x", "weighting": None, "years_experience_required": 0}) == []


def test_hints_and_summary_cut_lists(spark):
    skills = {"a": [f"S{i}" for i in range(7)], "b": [f"T{i}" for i in range(7)], "c": None}
    project = {"name": "n" * 60, "approach": None, "tech_keywords": list("uvwxyz"), "primary_skills": None, "metrics": None}
    base = records.whole(spark.createDataFrame([("1", skills, [project] * 4)], "candidate_id string, canonical_skills map<string, array<string>>, " + [x for x in records.RECORD.split("\n") if x.startswith("projects")][0].rstrip(",")))
    hints = base.select(records.embedding_hints(base).alias("h")).first().h
    assert hints.profile_embed == "" and hints.projects_embed == " | ".join(["n" * 60 + ": "] * 2) and len(hints.skills_embed.split(", ")) == 10
    assert len(base.select(records.skill_union(base).alias("s")).first().s) == 20  # a null category hides no other
    rows = spark.createDataFrame([("1", "A", 0.5), ("2", None, None)], "candidate_id string, name string, final_score double")
    got = {r.candidate_id: json.loads(r.summary) for r in records.candidate_summary(rows, base).collect()}
    assert got["1"]["sk"] == [f"S{i}" for i in range(5)] + [f"T{i}" for i in range(5)] and len(got["1"]["pj"]) == 3
    assert got["1"]["pj"][0] == {"n": "n" * 50, "tech": "u, v, w, x, y", "score": 0.0}
    assert got["2"] == {"id": "2", "n": "", "sc": {"p": 0.0, "k": 0.0, "s": 0.0, "f": 0.0}, "loc": "", "sk": [], "pj": []}


def test_paths_by_id_then_slug_then_stem(spark):
    people = spark.createDataFrame([("1", "José Ñ"), ("1", "José Ñ"), ("2", "Ann-Lee."), (None, "Bo"), ("4", None), ("5", "Cy")], "candidate_id string, name string")
    mapping = spark.createDataFrame([("1", "gone"), ("JOSE n", "j"), ("ann_lee", "a"), ("Ann Lee", "b"), ("", "a"), (None, "a")], "key string, path string")
    files = spark.createDataFrame([("j",), ("a",), ("b",), ("d/B.o.pdf",), ("d/bo.pdf",), (None,)], "path string")
    got = {(r.candidate_id, r["name"]): (r.path, r.kind) for r in entities.find_paths(people, mapping, files).collect()}
    assert got == {("1", "José Ñ"): ("j", 3), ("2", "Ann-Lee."): ("a", 2), (None, "Bo"): ("d/B.o.pdf", 4), ("4", None): (None, None), ("5", "Cy"): (None, None)}
    assert entities.find_paths(people.limit(0), mapping, files).count() == 0


def test_skills_report_words(spark):
    df = spark.createDataFrame([(["sql", "go"],), (["sql"],), (None,)], "s array<string>")
    got = [r.r for r in df.select(requirements.skills_report(F.col("s"), ["SQL", " Go"]).alias("r")).collect()]
    assert [(r.meets, r.match_quality, r.missing_skills) for r in got] == [(True, "exact", []), (False, "partial", ["go"]), (False, "missing", ["sql", "go"])]
    assert got[1].details == "Has 1/2 required skills. Missing: go"
    assert df.select(requirements.skills_report(F.col("s"), []).alias("r")).first().r is None


def test_top_is_the_head_of_the_ranking(spark):
    rows = spark.range(50).selectExpr("id", "case when id % 9 > 0 then double(id % 7) end as score")
    every = {r.id: r["rank"] for r in ranking.ranked(rows, F.col("score"), F.col("id").asc()).collect() if r["rank"] <= 5}
    assert {r.id: r["rank"] for r in ranking.top(rows, 5, F.col("score"), F.col("id").asc()).collect()} == every


def test_parsers_and_readers_run_by_task(spark):
    class Upper:
        def parse(self, text):
            return text.upper()

    class Pages:
        def pages(self, content):
            if content == b"x":
                raise ValueError
            return content.decode().split("|")

    texts = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    assert {r.id: r.json for r in external.parsed(texts, Upper()).collect()} == {1: "A", 2: None}
    files = spark.createDataFrame([("p", bytearray(b"a|b")), ("q", bytearray(b"x")), ("r", None)], "path string, content binary")
    assert {r.path: r.pages for r in external.paged(files, Pages()).collect()} == {"p": ["a", "b"], "q": None, "r": None}
    free = spark.createDataFrame([("\n Ann Lee \nSkills: SQL; Go,\n3.5+ years at x, a.b@c.org",), (None,)], "text string")
    one, none = records.text_fields(free).collect()
    assert (one.email, one.years_experience, one["name"], one.skills) == ("a.b@c.org", 3.5, "Ann Lee", ["SQL", "Go"])
    assert (none.email, none.years_experience, none["name"], none.skills) == (None, None, None, [])


def test_leaves_jobs_and_defaults(spark):
    shapes = spark.createDataFrame([('{"a": ["x", {"b": "y", "n": 1, "z": null}]}',), ("bad",), (None,), ('"alone"',)], "r string")
    assert [r[0] for r in shapes.select(records.text_leaves("r")).collect()] == [["x", "y"], [], [], ["alone"]]
    post = "\n Lead engineer\nMinimum 4 years. Location: Pune\n- Run it\n \u2022 Build\n*  \nRequired: SQL"
    one, none = records.job_fields(spark.createDataFrame([(post,), (None,)], "text string")).collect()
    assert (one.role_title, one.seniority_level, one.low, one.responsibilities) == ("Lead engineer", "Lead", 4, ["Run it", "Build"])
    assert (none.role_title, none.low, none.responsibilities) == (None, None, [])
    plain = records.record_defaults(spark.createDataFrame([("abc",), (None,)], "text string"), "text").collect()
    assert [r.meta.raw_text_length for r in plain] == [3, 0] and plain[0].explainability.top_matched_keywords == []
    partly = spark.createDataFrame([("abc", (5, "v1"))], "text string, meta struct<raw_text_length: int, model: string>")
    row = records.record_defaults(partly, "text").first()
    assert row.meta.raw_text_length == 5 and row.meta.model == "v1" and row.meta.last_updated
    assert records.job_defaults({"hr_notes": [1, 2], "meta": {"last_updated": "x"}}, "abc", "y") == {
        "hr_notes": [1, 2], "hr_points": 2, "filter_requirements": None, "meta": {"raw_text_length": 3, "last_updated": "x"}}
    assert records.job_defaults({"hr_points": 9, "filter_requirements": {}}, "", "y")["hr_points"] == 9


def test_tags_are_made_once_and_sections_without_a_shuffle(spark):
    from rostrum.plans import native

    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(native.job_tags(spark, d)).count("HR_NOTE:cat=") == 1  # named again, it would be made again for each tag
    assert "Exchange" not in native.record_sections(spark, d)._jdf.queryExecution().executedPlan().toString()
    r = spark.createDataFrame([("a", "One two three. four five six"), ("a", "One two three."), (None, None)], "candidate_id string, profile_keywords_line string")
    got = sorted((x.candidate_id or "", x.section, x.texts) for x in records.section_texts(r).where("size(texts) > 0").collect())
    assert got == [("a", s, t) for s in ("overall", "profile") for t in (["One two three."], ["One two three.", "four five six"])]
