import io as bytes_io
import json
import random
import unicodedata
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.functions.letters import plain_letters
from rostrum.operators import answers, entities, records, scoring
from rostrum.operators import requirements as R
from rostrum.operators.counters import Counters
from rostrum.sources import documents, external


def test_rows_without_id_and_name_are_all_kept(spark):
    rows = [(1, None, None), (2, None, ""), (3, "", " "), (4, "7", ""), (5, None, "Bo"), (6, "7", "Bo"), (7, "8", "Cy"), (8, None, "cy"), (9, None, "bo"), (10, None, "Di"), (11, "9", "di")]
    df = spark.createDataFrame(rows, "o int, candidate_id string, name string")
    assert sorted(r.o for r in entities.keep_first(df, "o").collect()) == [1, 2, 3, 4, 5, 7, 10, 11]
    odd = df.select("o", "candidate_id", "name", F.lit("x").alias("_id"), F.lit("y").alias("_Name"))
    assert entities.keep_first(odd, "o").columns == odd.columns and entities.keep_first(odd, "o").count() == 8
    assert entities.keep_first(df.limit(0), "o").collect() == []


def test_merge_loses_and_doubles_none(spark):
    a = spark.createDataFrame([(None, None, i) for i in range(4)] + [("1", "x", 10), ("2", "x", 11), (None, "X", 12), (None, "y", 13), ("5", "z", 14), ("5", "z", 15)], "candidate_id string, name string, p int")
    b = spark.createDataFrame([(None, "", i) for i in range(4)] + [(None, "x", 20), ("9", "x", 21), ("8", "x", 22), (None, "y", 23), ("5", "z", 24), ("5", "z", 25), ("5", "z", 26)], "candidate_id string, name string, k int")
    out = [tuple(r) for r in entities.merge_scores(a, b).collect()]
    assert sorted(r[2] for r in out if r[2] is not None) == [0, 1, 2, 3, 10, 11, 12, 13, 14, 15]
    assert sorted(r[3] for r in out if r[3] is not None) == [0, 1, 2, 3, 20, 21, 22, 23, 24, 25, 26]
    assert {("1", "x", 10, 20), ("2", "x", 11, None), ("8", "X", 12, 22), ("9", "x", None, 21), (None, "y", 13, 23)} <= set(out) and len(out) == 16
    one = spark.createDataFrame([(None, "n", 1)], "candidate_id string, name string, p int")
    two = spark.createDataFrame([("1", "n", 1), ("2", "n", 2)], "candidate_id string, name string, k int")
    assert sorted(tuple(r) for r in entities.merge_scores(one, two).collect()) == [("1", "n", 1, 1), ("2", "n", None, 2)]
    assert entities.merge_scores(one.limit(0), two).count() == 2 and entities.merge_scores(one, two.limit(0)).count() == 1


def test_merge_of_many_like_named_rows(spark):
    """All of one name: every row meets one other at most, and as many meet as can."""
    rnd = random.Random(7)
    for _ in range(3):
        side = lambda n: [(None if rnd.random() < 0.5 else f"{rnd.random()}", "same", i) for i in range(n)]
        left, right = side(rnd.randint(1, 40)), side(rnd.randint(1, 40))
        out = entities.merge_scores(spark.createDataFrame(left, "candidate_id string, name string, p int"), spark.createDataFrame(right, "candidate_id string, name string, k int")).collect()
        assert sorted(r.p for r in out if r.p is not None) == list(range(len(left))) and sorted(r.k for r in out if r.k is not None) == list(range(len(right)))
        met = [(left[r.p], right[r.k]) for r in out if r.p is not None and r.k is not None]
        assert all(x[0] is None or y[0] is None for x, y in met)
        a, b = sum(x[0] is not None for x in left), sum(y[0] is None for y in right)
        with_id = min(a, b)  # of the left with an id
        assert len(met) == with_id + min(len(left) - a, len(right) - with_id)


def test_positions_are_spread_and_right(spark):
    data = [(i % 3 == 0, (i * 7919) % 500, i) for i in range(500)] + [(True, 5, 1)] * 50
    df = spark.createDataFrame(data, "k boolean, o int, _own int")
    got = sorted((r.k, r.at, r.o) for r in entities.positions(df, ["k"], [F.col("o")], "at").collect())
    want = sorted((k, i, o) for k in (False, True) for i, (_, o) in enumerate(sorted((x[0], x[1]) for x in data if x[0] == k)))
    assert got == want


def test_file_match_with_one_prefix_for_all(spark):
    rnd = random.Random(1)
    people = [(str(i), f"Jo{'nas' * (i % 2)} Common Nr{i}", f"Rec-candidate_{i:05d}") for i in range(120)]
    files = [(f"f/{i}.pdf", rnd.choice([f"Rec-candidate_{i:05d}", f"rec-candidate_{i:05d} final", f"Rec-cand", f"common nr{i} cv", f"rec-candidate_{i:04d}"])) for i in range(100)] + [("z", ""), ("y", "x")]
    p, f = spark.createDataFrame(people, "candidate_id string, name string, stem string"), spark.createDataFrame(files, "path string, stem string")
    key = lambda s: "".join(c for c in s if c.isalnum() or c in " _-").lower()
    want = {}
    for cid, name, stem in people:
        words = list(dict.fromkeys(w for w in key(name).split() if len(w) > 2))
        found = []
        for path, fs in files:
            k, r = key(fs), key(stem)
            if words and sum(w in k for w in words) >= min(2, len(words)):
                found.append((1, path))
            elif fs == stem:
                found.append((2, path))
            elif k and (r in k or k in r):
                found.append((3, path))
        if found:
            want[cid] = min(found)
    assert {r.candidate_id: (r.kind, r.path) for r in entities.match_files(p, f).collect()} == want
    texts, parts = [f"resume_of_{i:06d}_x" for i in range(800)], [f"resume_of_{i:06d}" for i in range(800)]
    t, q = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((texts, "text"), (parts, "part")))
    grams = t.select("text", F.explode(entities._grams(F.col("text"))).alias("g"))
    compared = entities._rarest(q, grams).join(grams, "g").count()
    assert entities.containing(q, t).count() == 800 and compared <= 60 * 800  # against 640,000 pairs of one prefix


def test_modes_and_nested_requirements():
    empty = {"type": "list", "specified": True, "required": [], "optional": []}
    wish, typed = empty | {"optional": ["a"]}, {"type": "text"}
    assert [R.has_value(empty, m) for m in R.MODES] == [False, True, True, True, False]
    assert [R.has_value(wish, m) for m in R.MODES] == [True, True, True, True, False]
    assert all(R.has_value(typed, m) and not R.has_value({}, m) and not R.has_value({"specified": False}, m) and R.has_value(0.5, m) and not R.has_value("", m) for m in R.MODES)
    with pytest.raises(ValueError):
        R.has_value(empty, "x")
    flat = R.flat_requirements({"requirements": [{"type": "Skill", "value": ["b", " "]}, {"type": "years", "value": "3"}, {"type": "years", "value": "many"}, {"type": "skills", "data": {}}, 5, {"type": "loc", "value": "Pune"}], "edu": "PhD", "Loc": "Rome", "exp": 4})
    assert flat["hard_skills"]["required"] == ["b"] and flat["location"]["required"] == "Rome" and flat["experience"]["min"] == 4.0 and flat["education"]["required"] == "PhD"
    assert R.flat_requirements(None) == R.flat_requirements({"requirements": 5, "x": None}) == {} or R.flat_requirements({"x": None}) == {}


def test_experience_and_skills_of_native_records(spark):
    rows = spark.createDataFrame([(1, 0.0, [("2 years",), ("1.5 Years",)]), (2, None, [("x",)]), (3, 7.0, None)], "id int, years_experience double, experience_entries array<struct<duration: string>>")
    met = lambda **f: {r.id: r.m for r in rows.select("id", R.check(rows, "exp", {"type": "numeric", "min": 0, "max": 4}, **f)[0].alias("m")).collect()}
    assert met() == {1: True, 2: False, 3: False} and met(zero_is_missing=True) == {1: True, 2: False, 3: False} and met(enforce_max=False) == {1: True, 2: False, 3: True}
    native = records.whole(spark.createDataFrame([("a", [("Docker", 0.1)])], "candidate_id string, inferred_skills array<struct<skill: string, confidence: double>>"))
    check = lambda words: native.select(R.check(native, "skills", ["r"], whole_words=words)[0]).first()[0]
    assert check(False) is True and check(True) is False


def test_requirement_lists_are_read_whole(spark):
    texts = ["Must have: python, sql and go. Location: Pune at our company", "Skills: Node.js, C++ and\tandroid; location anywhere", "location: Any", None, "nice to have: a, b and c. Must have d", "2 to 4 yrs"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: (r.low, r.high, r.location, r.hard_skills, r.preferred_skills) for r in records.parse_requirements(df).collect()}
    assert got == {0: (None, None, "Pune at our company", ["go", "python", "sql"], []), 1: (None, None, None, ["C++", "Node.js", "android"], []), 2: (None, None, None, [], []), 3: (None, None, None, [], []), 4: (None, None, None, ["d"], ["a", "b", "c"]), 5: (2, 4, None, [], [])}


def test_repeated_note_keys(spark):
    t = spark.createDataFrame([("HR_NOTE:category=a;note=x; note = y=z ;impact=0.25;junk",), ("HR_NOTE:",), (None,)], "tag string")
    got = [(r.n.category, r.n.note, r.n.impact) for r in t.select(T.hr_note("tag").alias("n")).collect()]
    assert got == [("a", "y=z", 0.25), (None, None, 0.5), (None, None, 0.5)]


def test_letters_equal_nfkd_on_all_code_points(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[i : i + 64])) for i in range(0, len(codes), 64)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert all(r.p == plain(r.t) for r in df.select("t", plain_letters(F.col("t")).alias("p")).collect())
    assert df.limit(1).select(T.slug_name(F.lit("-Ǆ Łukasz ﬁ.½ 가-")).alias("s")).first().s == "dž_łukasz_fi1⁄2_가".replace("ž", "z").replace("가", unicodedata.normalize("NFKD", "가"))


def test_whole_words(spark):
    df = spark.createDataFrame([("I scheduled and contributed to c++",), ("led",), ("We contributed, to it. LEAD",), (None,), ("contributed contributed to",)], "t string")
    found = [sorted(r.f) for r in df.select(scoring.phrases_found(F.col("t"), ["led", "contributed", "contributed to", "lead", "c++", "!"]).alias("f")).collect()]
    assert found == [["c++", "contributed", "contributed to"], ["led"], ["contributed", "contributed to", "lead"], [], ["contributed", "contributed to"]]
    score = df.select(scoring.lexicon_score(F.col("t")).alias("a"), scoring.lexicon_score(F.col("t"), strict=True).alias("b")).collect()
    assert score[0].a > score[0].b and score[1].a == score[1].b and score[3].b == 0.0
    assert df.select(scoring.phrases_found(F.col("t"), []).alias("f")).first().f == []


def test_answers_cut_anywhere_are_read(spark):
    doc = {"a": [1, 2.5e-3, {"b": 'x"y\\ zé\n', "c": None, "d": []}, True, False], "k,:{": "[{", "n": -12, "e": {}}
    whole = json.dumps(doc)
    rows = [(i, whole[:i]) for i in range(1, len(whole) + 1)] + [(-1, f"```json\n{whole}\n```"), (-2, f"Sure: {whole} Done {{x"), (-4, ""), (-5, None), (-6, "no json"), (-7, "{]"), (-10, '{"a":tr'), (-11, '["\\u00')]
    got = {r.i: r.r for r in spark.createDataFrame(rows, "i int, t string").select("i", answers.repaired(F.col("t")).alias("r")).collect()}
    assert all(json.loads(got[i]) is not None for i in range(1, len(whole) + 1))
    assert json.loads(got[len(whole)]) == json.loads(got[-1]) == json.loads(got[-2]) == doc
    assert got[-4] is got[-5] is got[-6] is got[-7] is None and got[-10] == '{"a":true}' and got[-11] == '[""]'
    some = spark.createDataFrame([(1, '{"ranked_candidates": [{"candidate_id": "a", "requirements_met": ["x", "y"]}, {"re_rank_score": 1}, {"candidate_id": "b", "re_rank'), (2, "{}"), (3, None)], "batch int, answer string")
    out = [(r.batch, r.candidate_id, r.re_rank_score, r.requirements_met, r.requirements_missing) for r in answers.rerank_answers(some, "answer", ["y"]).collect()]
    assert out == [(1, "a", None, ["y"], []), (1, "b", None, [], [])]
    assert [r.requirements_met for r in answers.rerank_answers(some, "answer").collect()] == [["x", "y"], []]


def test_counters_need_no_job_of_their_own(spark):
    counts = Counters()
    df = counts.watch(spark.range(10), read=F.count(F.lit(1)))
    counts.watch(df.where("id > 6"), kept=F.count(F.lit(1))).collect()
    assert counts.values() == {"read": 10, "kept": 3}


def pdf(streams, packed=False, flate=False):
    data = [zlib.compress(s) if flate else s for s in streams]
    kind = b"/Filter /FlateDecode" if flate else b""
    pages = {3 + i: b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (10 + i) for i in range(len(streams))}
    heads = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [%s]>>" % b" ".join(b"%d 0 R" % n for n in pages)} | pages
    body = b"".join(b"%d 0 obj <<%s>> stream\n%s\nendstream endobj\n" % (10 + i, kind, s) for i, s in enumerate(data))
    if packed:
        at, head, inner = 0, b"", b""
        for n, h in heads.items():
            head += b"%d %d " % (n, at)
            inner, at = inner + h + b" ", at + len(h) + 1
        return b"%PDF-1.5\n" + body + b"90 0 obj <</Type /ObjStm /N %d /First %d /Filter /FlateDecode>> stream\n%s\nendstream endobj\n" % (len(heads), len(head), zlib.compress(head + inner))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % x for x in heads.items()) + body


def test_pdf_pages():
    streams = [b"BT (One \\(a\\) \\351) Tj 0 -12 Td <54776F> Tj ET", b"BT [(Th) 20 (ree) -400 (four)] TJ T* (x) ' ET"]
    for packed in (False, True):
        for flate in (False, True):
            assert documents.PdfReader().pages(pdf(streams, packed, flate)) == ["One (a) é\nTwo", "Three four\nx"]
    for bad in (b"", b"%PDF-1.4 nothing", b"%PDF-1.4 /Encrypt"):
        try:
            assert documents.PdfReader().pages(bad) == []
        except ValueError:
            pass


def test_archives_and_files(spark):
    rows = spark.createDataFrame([(i, f"{i:03d}.txt", None if i == 2 else bytearray(b"x" * i)) for i in range(1, 8)], "rank int, entry string, content binary")
    parts = documents.archives(rows, 3)
    got = parts.orderBy("archive").collect()
    assert [r.name for r in got] == ["export_0001.zip", "export_0002.zip", "export_0003.zip"]
    assert zipfile.ZipFile(bytes_io.BytesIO(bytes(got[0].content))).namelist() == ["001.txt", "002.txt", "003.txt"]
    assert [bytes(r.content) for r in parts.orderBy("archive").collect()] == [bytes(r.content) for r in got]
    back = {r.entry: bytes(r.content) for r in documents.archive_entries(parts).collect()}
    assert len(back) == 7 and back["002.txt"].startswith(b"The file") and back["007.txt"] == b"x" * 7
    files = spark.createDataFrame([("b/x.docx", bytearray(b"no zip")), ("a/y.pdf", bytearray(b""))], "path string, content binary")
    assert [tuple(r) for r in documents.docx_texts(files).collect()] == [("b/x.docx", "x", None)]
    assert [(r.path, r.ordinal) for r in documents.in_order(files).orderBy("ordinal").collect()] == [("a/y.pdf", 1), ("b/x.docx", 2)]
    p = files.select(T.extension(F.lit("A.PDF")).alias("e"), T.mime_type(F.lit("noext")).alias("m"), T.clean_lines(F.lit(" a \r\n\n b")).alias("c"), T.temporary_id("path").alias("t")).first()
    assert (p.e, p.m, p.c) == ("pdf", "", "a\nb") and p.t.startswith(("x_", "y_")) and len(p.t) == 10


def test_breakers_of_a_process():
    a = external.CircuitBreaker.of_process("one")
    assert a is external.CircuitBreaker.of_process("one") is not external.CircuitBreaker.of_process("two")
    waits = []
    with pytest.raises(OSError):
        external.retried(lambda: (_ for _ in ()).throw(OSError()), external.EMBED_TRIES, sleep=waits.append, growth=external.EMBED_GROWTH, jitter=0.0)
    assert [round(w, 3) for w in waits] == [1.0, 1.4, 1.96, 2.744]


def test_job_and_requirement_files(spark, tmp_path):
    from rostrum.sources import io

    (tmp_path / "job.json").write_text(json.dumps({"role_title": "Analyst"}))
    (tmp_path / "bad.json").write_text("{no")
    assert records.read_job(spark, str(tmp_path / "job.json")) == {"role_title": "Analyst"} and records.read_job(spark, str(tmp_path / "bad.json")) == {}
    nested = {"structured": {"requirements": [{"type": "skills", "data": {"skills": ["sql"]}}, {"type": "years", "value": 2}]}}
    (tmp_path / "r.json").write_text(json.dumps({"mandatory_compliances": nested, "soft_compliances": {"structured": {"remote": True, "x": []}}}))
    got = io.read_requirements(spark, str(tmp_path / "r.json"))
    assert got["mandatory"]["hard_skills"]["required"] == ["sql"] and got["mandatory"]["experience"]["min"] == 2.0 and got["soft"] == {"remote": {"type": "boolean", "required": True}}
    assert io.requirement_table(spark, got).count() == 3


def test_texts_without_parts_are_records(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Only a name"), (4, "Skills:\n- a\n- b\nEducation: PhD"), (5, "Ann\nExperience\nLead, 3 years\n- x\n\nProjects\n(x)")], "i int, text string")
    r = {x.i: x for x in records.resume_records(df).collect()}
    assert r[1].name is None and r[1].canonical_skills is None and r[1].projects == [] and r[1].experience_entries == [] and r[2].education == []
    assert r[3].name == "Only a name" and r[4].name is None and r[4].canonical_skills == {"listed": ["a", "b"]} and r[4].education == ["PhD"]
    assert r[5].years_experience == 3.0 and [(e.title, e.responsibilities_keywords) for e in r[5].experience_entries] == [("Lead, 3 years", ["x"])] and r[5].projects[0].tech_keywords == ["x"]
    assert set(records.whole(records.resume_records(df)).columns) <= set(records.resume_records(df).columns)
    assert records.resume_records(df.limit(0)).collect() == [] and records.job_records(df).count() == 5
    sections = records.job_section_rows(records.job_records(df), "i")
    assert {x.section for x in sections.where("i = 4").collect()} >= {"skills", "education"}


def test_file_match_sends_no_exploded_texts_through_the_driver(spark, tmp_path):
    """Its joins sort, though the tables seem small."""
    ids = [f"{i:09d}" for i in range(300)]
    p = spark.createDataFrame([(i, f"Person nn{i}", f"Rec-cand_{i}") for i in ids], "candidate_id string, name string, stem string")
    f = spark.createDataFrame([(f"f/{i}.pdf", f"the rec-cand_{i} final") for i in ids], "path string, stem string")
    p.write.parquet(f"{tmp_path}/p")
    f.write.parquet(f"{tmp_path}/f")
    p, f = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/f")
    out = entities.match_files(p, f)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.candidate_id, r.path, r.kind) for r in out.collect()} == {(i, f"f/{i}.pdf", 3) for i in ids}
    parts, texts = p.select(F.lower("stem").alias("part")), f.select(F.col("stem").alias("text"))
    assert "BroadcastHashJoin" not in entities.containing(parts, texts)._jdf.queryExecution().executedPlan().toString()


def test_folders_have_many_texts_and_records_a_file(spark, tmp_path):
    from rostrum.sources import documents, io

    rows = [(f"s{i}", f" line {i}\nnext\n") for i in range(60)] + [("s0", "again"), ("a/b", 'x"'), ("none", None)]
    index = documents.write_texts(spark.createDataFrame(rows, "stem string, text string"), f"{tmp_path}/t")
    assert len(list((tmp_path / "t").rglob("part-*"))) <= 4 and {r.stem for r in index.collect()} == {s for s, _ in rows}
    back = io.read_texts(spark, f"{tmp_path}/t", spark.createDataFrame([(s,) for s, _ in rows if s != "s1"], "stem string"), lines=True)
    assert sorted((r.stem, r.text or "") for r in back.collect()) == sorted((s, (t or "").strip()) for s, t in rows if s != "s1")
    assert {r.stem for r in documents.write_texts(spark.createDataFrame(rows[:3], "stem string, text string"), f"{tmp_path}/e", each=True).collect()} == {"s0", "s1", "s2"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "part.json").write_text('{"name": "a"}\n{"name": \n{"name": "b"}\n')
    good, bad = io.read_records(spark, f"{tmp_path}/r", "name string", lines=True)
    assert sorted(r.record.name for r in good.collect()) == ["a", "b"] and [r.text for r in bad.collect()] == ['{"name": ']


def test_folder_queries_write_few_files(spark, monkeypatch, tmp_path):
    from rostrum.plans import files
    from rostrum.sources import io

    monkeypatch.setattr(io, "scratch_folder", lambda s: str(tmp_path))
    suppliers = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    for query, at in ((files.text_folder, "t"), (files.record_folder, "r")):
        assert query(spark, "/root/testdata/sf0.01").count() == suppliers
        assert len(list((tmp_path / at).rglob("part-*"))) < suppliers / 10


def test_merge_makes_each_side_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    rows = [(f"c{i}" if i % 3 else None, f"n{i % 7}", i) for i in range(100)]
    side = spark.createDataFrame(rows, "candidate_id string, name string, p int").withColumn("p", F.udf(counted, "int")("p"))
    out = entities.merge_scores(side, side.withColumnRenamed("p", "k")).collect()
    assert sorted(r.p for r in out if r.p is not None) == sorted(r.k for r in out if r.k is not None) == list(range(100))
    assert made.value == 200
