import json
import random

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.functions.vec import dot, l2_normalised
from rostrum.operators import entities, ranking, requirements as R, scoring
from rostrum.sources import external, io
from rostrum.streaming.incremental import score_new_records


def one(spark, expr, **cols):
    row = spark.range(1).withColumns({k: (v if not isinstance(v, (str, float, int, list, type(None))) else F.lit(v)) for k, v in cols.items()})
    return row.select(expr.alias("x")).first()["x"]


def test_names(spark):
    f = lambda n: one(spark, T.title_name("n"), n=F.lit(n).cast("string"))
    assert [f(x) for x in ("o'neil mc-donald", "JEAN-LUC  picard", "abc1def", None)] == ["O'Neil Mc-Donald", "Jean-Luc Picard", "Abc1Def", ""]
    assert one(spark, T.slug_name("n"), n="José María-López Jr.") == "jose_maria_lopez_jr"
    assert one(spark, T.plain_name("n"), n=" A. B-c! ") == "a bc"
    assert one(spark, T.file_name("n"), n="A b-c.d") == "A_b_cd"
    assert one(spark, T.matching_key("n"), n="A_b-C d!") == "a_b-c d"


def test_sentences_tokens_tags(spark):
    t = "Hello world one two! ok. This is three words\nand more? tail bit here"
    assert one(spark, T.sentences("t"), t=t) == ["Hello world one two!", "This is three words and more?", "tail bit here"]
    assert one(spark, T.phrase_tokens("t"), t="A b/c;D") == ["a b", "c", "d", "a", "b/c;d"]
    df = spark.createDataFrame([(["Python", "python", " Python", "", None],)], "a array<string>")
    assert df.select(T.distinct_ci("a")).first()[0] == ["Python"]
    tags = spark.createDataFrame([(["REQ_SKILL: a", "PREF_SKILL:b", "REQ_SKILL:c"],)], "a array<string>")
    assert tags.select(T.tagged("a", "REQ_SKILL:")).first()[0] == ["a", "c"]
    note = spark.createDataFrame([("HR_NOTE:cat=x;note=a=b;impact=zz",)], "t string").select(T.hr_note("t").alias("n")).first()["n"]
    assert (note.category, note.note, note.impact) == ("x", "a=b", 0.5)
    assert df.select(T.boost_line("a", F.array(F.lit("Zig"), F.lit("ada")))).first()[0] == "ada, python, zig"


def test_experience(spark):
    f = lambda s: one(spark, T.experience_range("s"), s=s)
    got = [f(s) for s in ("2-3 years", "at least 4 years", "3 years experience", "5+ years", "none")]
    assert [g and (g.low, g.high) for g in got] == [(2, 3), (4, None), (3, 5), (5, None), None]
    g = one(spark, T.criteria_range("s"), s="up to 4 years")
    assert (g.low, g.high) == (0, 4)
    assert spark.createDataFrame([(["2 years", "1.5 years", "x"],)], "d array<string>").select(T.total_years("d")).first()[0] == 3.5


def test_candidate_id(spark):
    df = spark.createDataFrame([("Ann@x.org", "1", "A B", "f.txt"), (None, "+1 (2)-3", "A B", "f.txt"), (None, None, None, "d/some.txt")], "e string, p string, n string, f string")
    ids = [r[0] for r in df.select(T.candidate_id("e", "p", "n", "f")).collect()]
    assert [i.split("_")[0] for i in ids] == ["ann", "ab", "some"] and len(set(ids)) == 3


def test_predicates(spark):
    num = lambda v, lo=None, hi=None: one(spark, R.numeric(F.col("v"), lo, hi), v=F.lit(v).cast("string"))
    assert [num(None, 0), num("x", 0), num("0.0", 0), num("1.0", 1, 4), num("4.5", 1, 4), num("3")] == [False, False, True, True, False, None]
    items = spark.createDataFrame([(["mlops"],)], "i array<string>")
    assert items.select(R.skill_list(F.col("i"), ["ml"])).first()[0] is True
    assert items.select(R.skill_list(F.col("i"), [])).first()[0] is None
    loc = lambda v, **k: one(spark, R.location(F.col("v"), **k), v=F.lit(v).cast("string"))
    assert [loc("Pune", allowed=["NYC"]), loc("Pune", required="x", allowed=["NYC"]), loc("Pune", required="x"), loc(None, required="x")] == [True, False, True, False]
    assert loc("Pune", allowed=["NYC"], strict=True) is False
    edu = lambda v, m: one(spark, R.education(F.col("v"), m), v=v)
    assert [edu("B.Tech", "Bachelor's"), edu("Bachelor's and Master's", "Master's"), edu("PhD", "Master's")] == [False, False, True]
    assert one(spark, R.work_mode(F.col("v"), "onsite"), v="Remote") is False
    assert one(spark, R.other_criteria(F.col("v"), ["strong python skills"]), v="python here") is True
    assert items.select(R.strict_skills(F.col("i"), F.lit("deep machine learning"), ["machine work"])).first()[0] is True
    q = spark.createDataFrame([(None,), ("x",), ("1",), ("9",), ("3",)], "v string").select(R.match_quality(F.col("v"), 2, 5))
    assert [r[0] for r in q.collect()] == ["missing", "invalid", "below", "exceeds", "exact"]


def test_mandatory_and_report(spark):
    df = spark.createDataFrame([("a", 3.0, ["python"], "Pune"), ("b", None, None, "Rome"), ("c", 9.0, ["py"], None)], "candidate_id string, years_experience double, skills array<string>, location string")
    specs = {"experience": {"min": 1, "max": 5}, "skills": ["python"], "location": {"type": "location", "required": "x", "allowed": ["pune"]}, "empty": {}, "budget": {"type": "text", "required": "z"}}
    kept, out = R.mandatory(df, {k: v for k, v in specs.items() if k != "budget"})
    assert [r.candidate_id for r in kept.collect()] == ["a"]
    assert {r.candidate_id: r.filter_reason for r in out.collect()} == {
        "b": "experience: experience not found in resume; location: Location: Rome (allowed: pune); skills: Skills: Found none. Missing: python",
        "c": "experience: experience: 9.0 (required: 1-5); location: Location not found in resume",
    }
    assert {r.candidate_id: r.score for r in R.compliance(df, specs).collect()}["a"] == 0.75
    assert R.compliance(df, {}).first().score == 1.0


def test_scores(spark):
    p = spark.createDataFrame([("a", 0.8, 0.4), ("b", None, None)], "candidate_id string, difficulty double, novelty double")
    for m in scoring.METRICS[2:]:
        p = p.withColumn(m, F.lit(None).cast("double"))
    assert {r.candidate_id: r.project_aggregate for r in scoring.project_aggregate(p).collect()} == {"a": 0.6, "b": 0.0}
    one_p = p.where("candidate_id = 'a'").withColumn("skill_relevance", F.lit(0.9))
    assert scoring.project_metric_mean(one_p).first().project_metrics == pytest.approx(0.3)
    have = spark.createDataFrame([(["a"],)], "h array<string>")
    v = lambda e: have.select(e).first()[0]
    assert v(scoring.overlap([], F.col("h"))) == 0.5 and v(scoring.overlap(["a", "b", "a"], F.col("h"))) == pytest.approx(2 / 3)
    assert v(scoring.weighted_overlap({}, F.col("h"))) == 0.5 and v(scoring.weighted_overlap({"a": 0.5, "b": 0.5}, F.col("h"))) == 0.5
    r = spark.createDataFrame([(0.2,)], "req double").select(scoring.keyword_fused({"required_skills": "req"}, weights={"required_skills": 1.0})).first()[0]
    assert r == pytest.approx(0.11)
    same = spark.createDataFrame([(0.4,), (0.4,)], "x double")
    assert {x.y for x in scoring.min_max(same, "x", "y").collect()} == {0.4}
    assert {x.y for x in scoring.min_max(same, "x", "y", equal="previous").collect()} == {0.5}
    assert scoring.VERBS["lead"] == 4.0 and len(scoring.VERBS) == 25
    tok = spark.createDataFrame([(["A b"], [("X", 0.9), ("Y", 0.1)])], "p array<string>, i array<struct<skill: string, confidence: double>>")
    assert tok.select(scoring.tokens(inferred="i", phrases="p")).first()[0] == ["x", "a b", "a", "b"]


def test_sections(spark):
    jd = spark.createDataFrame([("skills", 1, [1.0, 0.0]), ("skills", 2, [0.0, 1.0])], "section string, jd_id long, vec array<double>")
    rv = spark.createDataFrame([("skills", 7, 10, [1.0, 0.0]), ("skills", 7, 11, [0.6, 0.8])], "section string, candidate long, rv long, vec array<double>")
    x = scoring.section_scores(jd, rv).first()
    assert (x.coverage, x.depth, x.density) == (1.0, 0.9, 1.0) and x.section_score == pytest.approx(0.96)
    full = scoring.with_empty_sections(scoring.section_scores(jd, rv), spark.createDataFrame([(7,), (8,)], "candidate long"), jd)
    near = scoring.best_matches(jd, rv.unionAll(rv.selectExpr("section", "candidate", "rv + 5", "vec")), keep=1).collect()
    assert [tuple(r) for r in near] == [(7, "skills", 1, 10, 1.0, 1)]
    pairs = scoring.similarities(jd, rv).groupBy("candidate", "jd_id").agg(F.max("cos").alias("c")).collect()
    assert {(r.candidate, r.jd_id): r.c for r in pairs} == {(7, 1): 1.0, (7, 2): 0.8}
    assert scoring.section_scores(jd.limit(0), rv).count() == 0 and scoring.best_matches(jd, rv.limit(0)).count() == 0
    got = {(r.candidate, r.section): r.section_score for r in full.collect()}
    assert len(got) == 12 and got[8, "skills"] == 0.0 and got[8, "profile"] == 0.5
    assert one(spark, dot(F.col("a"), F.col("a")), a=F.array(F.lit(3.0), F.lit(4.0))) == 25.0
    assert one(spark, l2_normalised(F.col("a")), a=F.array(F.lit(3.0), F.lit(4.0))) == [0.6, 0.8]


def test_fusion_and_rank(spark):
    rows = [(0.8, None, None), (0.05, None, None), (0.8, 0.6, None), (None, None, None), (0.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "project_aggregate double, semantic_score double, keyword_score double")
    assert [r[0] for r in df.select(ranking.fused()).collect()] == [0.72, 0.0, 0.7, None, 0.325]
    rnd = random.Random(4)
    data = [(i, rnd.randint(0, 9) / 10, float(rnd.randint(0, 3))) for i in range(500)]
    many = spark.createDataFrame(data, "id long, s double, y double").repartition(5)
    got = {r.id: r["rank"] for r in ranking.ranked(many, F.col("s"), F.col("y").desc(), F.col("id").asc()).collect()}
    want = {r[0]: k + 1 for k, r in enumerate(sorted(data, key=lambda r: (-r[1], -r[2], r[0])))}
    assert got == want


def test_entities(spark):
    rows = [(1, "1", "A"), (2, "1", "A"), (3, "2", "A"), (4, None, "A"), (5, None, "B"), (6, None, "B")]
    df = spark.createDataFrame(rows, "o int, candidate_id string, name string")
    assert sorted(r.o for r in entities.keep_first(df, "o").collect()) == [1, 3, 5]
    log = spark.createDataFrame([("1", "x")], "candidate_id string, reason string")
    new = spark.createDataFrame([("1", "y"), ("2", "y"), (None, "y")], "candidate_id string, reason string")
    assert sorted(str(r.candidate_id) for r in entities.append_skips(log, new).collect()) == ["1", "2", "None"]
    a = spark.createDataFrame([("1", "ann b", 0.1), ("2", "carl", 0.2)], "candidate_id string, name string, p double")
    b = spark.createDataFrame([("1", "ann b", 0.5), (None, "CARL", 0.6), ("9", "ann b", 0.7)], "candidate_id string, name string, k double")
    got = {(r.candidate_id, r.p, r.k) for r in entities.merge_scores(a, b).collect()}
    assert got == {("1", 0.1, 0.5), ("2", 0.2, 0.6), ("9", None, 0.7)}


def test_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "records"
    d.mkdir()
    (d / "a.json").write_text('{"name": "A"}')
    (d / "b.json").write_text("{bad")
    (d / "example_output.json").write_text('{"name": "skip"}')
    good, bad = io.read_records(spark, str(d), "name string")
    assert [r.record.name for r in good.collect()] == ["A"] and bad.count() == 1
    t = tmp_path / "texts"
    t.mkdir()
    (t / "x.TXT").write_text("hello\nthere")
    (t / "y.txt").write_text("no")
    only = spark.createDataFrame([("x",)], "stem string")
    assert [r.text for r in io.read_texts(spark, str(t), only).collect()] == ["hello\nthere"]
    req = tmp_path / "r.json"
    req.write_text(json.dumps({"mandatory_compliances": {"structured": {"experience": {"min": 1}, "x": {}}}, "soft_compliances": {"structured": {"skills": ["a"]}}}))
    tiers = io.read_requirements(spark, str(req))
    assert tiers == {"mandatory": {"experience": {"min": 1, "type": "numeric"}}, "soft": {"skills": {"type": "list", "required": ["a"]}}}
    assert io.read_requirements(spark, str(tmp_path / "none.json")) == {"mandatory": {}, "soft": {}}
    assert io.requirement_table(spark, tiers).count() == 2
    skip = str(tmp_path / "skips")
    new = spark.createDataFrame([("1", "x"), (None, "x")], "candidate_id string, reason string")
    io.append_skip_log(spark, new, skip)
    io.append_skip_log(spark, new, skip)
    assert spark.read.parquet(skip).count() == 3
    pages = spark.createDataFrame([([" a ", "b"],), ([" "],)], "p array<string>").select(io.page_text(F.col("p")))
    assert [r[0] for r in pages.collect()] == ["--- Page 1 ---\na\n\n\n--- Page 2 ---\nb", None]
    files = spark.createDataFrame([("a.PDF", bytearray(b"%PDF-1.4")), ("b.pdf", bytearray(b"zz")), ("c.doc", bytearray(b""))], "path string, content binary")
    taken, skipped = io.split_pdfs(files)
    assert [r.path for r in taken.collect()] == ["a.PDF"] and {r.reason for r in skipped.collect()} == {"not a PDF", "unreadable PDF"}
    io.write_report(ranking.report_lines(spark.createDataFrame([(1, "A", 0.5)], "rank int, name string, final_score double")), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["1. A | Score: 0.500"]


def test_external(spark):
    rows = spark.createDataFrame([("a b",), (None,), ("a b",)], "text string")
    v = [r.vec for r in external.embedded(rows, external.HashEmbedder(8)).collect()]
    assert v[0] == v[2] and sum(x * x for x in v[0]) == pytest.approx(1)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 5

    assert external.retried(flaky, sleep=lambda s: None) == 5
    now = [0.0]
    b = external.CircuitBreaker(failures=2, rest=10, clock=lambda: now[0])

    def fail():
        raise ValueError

    for _ in range(2):
        with pytest.raises(ValueError):
            b.call(fail)
    with pytest.raises(RuntimeError):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1
    df = spark.createDataFrame([(0, "a", 0.5)], "batch int, candidate_id string, final_score double")
    assert external.reranked(df, external.KeepOrder()).first().re_rank_score == 0.5


def test_incremental(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda i: spark.createDataFrame([(i, float(i))], "id long, raw double").write.mode("append").parquet(src)
    seen = []
    make(1)
    for i in (2, 3):
        score_new_records(spark, src, "id long, raw double", dst, str(tmp_path / "cp"), lambda df: df, lambda t: seen.append(t.count())).awaitTermination()
        make(i)
    assert seen == [1, 2]
