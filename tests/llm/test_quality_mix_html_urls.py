import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from rostrum.llm import html, mixing, quality, urls
from rostrum.llm._spark import Scratch


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_quality(rows, min_docs, share, texts=None):
    """Verdicts on (id, host, text); ``texts`` gets the texts without boilerplate lines."""
    norm = lambda line: re.sub("[0-9]", "0", " ".join(words(line)).translate(str.maketrans(urls.UPPER, urls.LOWER)))
    lines = [[norm(x) for x in (t or "").split("\n") if words(x)] for _, _, t in rows]
    hosts, seen = defaultdict(set), defaultdict(set)
    for (_, h, t), own in zip(rows, lines):
        hosts[h].add(t or "")
        for x in own:
            seen[h, x].add(t or "")
    out = []
    for (i, h, t), own in zip(rows, lines):
        w = words(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + d for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for d in range(5)}
        raw = [x for x in (t or "").split("\n") if words(x)]
        common = {x for x in own if len(seen[h, x]) >= min_docs and len(seen[h, x]) > share * len(hosts[h])}
        cut = sum(len(x.split(" ")) for x in own if x in common)
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        left = len(w) - cut
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(raw) - len(set(raw)), len(rep), failed, not failed and left >= 10 and left >= 0.3 * len(w), cut))
        if texts is not None:
            texts.append(None if t is None else "\n".join(x for x in t.split("\n") if not words(x) or norm(x) not in common))
    return out


def test_quality_equals_brute_force(spark):
    bar = "Home About Contact us now 24"
    body = lambda k: "\n".join(" ".join(f"w{k}x{j}é{i}" for j in range(12)) for i in range(3))
    rows = [(k, "a" if k % 3 else None, f"{bar}\n{body(k)}\nHOME about  contact us now 77") for k in range(60)]
    rows += [(100 + k, "a", f"{bar}\none two {k} {bar} {bar}") for k in range(12)]
    rows += [(200 + k, "a", body(5)) for k in range(40)]  # copies: their lines stay
    rows += [(300 + k, "a", "\n".join([bar] * 9 + [f"only{k} this"])) for k in range(20)]
    rows += [(5, "a", rows[5][2]), (None, None, None), (None, "a", ""), (7, "b", " \n\t\n"), (8, "b", "x " * 5000), (9, "b", "a b c d e a b c d e\n|#|\n|#|")]
    # Different documents whose longest line is the same notice.
    notice = "notice " + " ".join(f"n{i}" for i in range(40))
    rows += [(400 + k, "c", f"{notice}\n" + " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}own{j}" for j in range(30 if k % 2 else 2))) for k in range(60)]
    docs = spark.createDataFrame([(*r, 1, r[0]) for r in rows], "doc_id long, source string, text string, kept int, row_key long")
    texts = []
    want = brute_quality(rows, 5, 0.1, texts)
    got = quality.quality_rules(docs, min_docs=5, host_share=0.1).drop("row_key", "cut_lines").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.doc_id for r in got if r.n_cut_words == 41} == {400 + k for k in range(60)}
    kept = quality.keep_good(docs, min_docs=5, host_share=0.1)
    assert kept.schema == docs.schema
    good = [(i, h, t, 1, i) for (i, h, _), t, v in zip(rows, texts, want) if v[7]]
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(good, key=key)
    assert {401, 403} <= {r[0] for r in good} and not {400, 402} & {r[0] for r in good} and not any("notice" in r[2] for r in good)
    assert {200 + k for k in range(40)} <= {r[0] for r in good}
    assert quality.quality_rules(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_flow_is_the_cheapest():
    patterns, quotas = {("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 18, "b": 12}
    got = mixing.route(patterns, quotas, 2)
    assert sum(got.values()) == 30
    second = sum(max(0, v - patterns[p]) for p, v in got.items())
    best = None
    for x, y, z in itertools.product(range(21), range(21), range(9)):
        for to_a in range(y + 1):
            if x + to_a <= 18 and y - to_a + z <= 12 and x + y + z == 30:
                cost = max(0, x - 10) + max(0, y - 10) + max(0, z - 4)
                best = cost if best is None else min(best, cost)
    assert second == best == 6


def test_flows_of_overlapping_sources_equal_enumeration():
    rnd = random.Random(6)
    for _ in range(60):
        names = ["a", "b", None][: rnd.randint(1, 3)]
        keys = {tuple(sorted(rnd.sample(names, rnd.randint(1, len(names))), key=mixing.by_code_point)) for _ in range(3)}
        patterns = {k: rnd.randint(0, 4) for k in keys}
        quotas = {s: rnd.randint(0, 9) for s in names}
        got = mixing.route(patterns, quotas, 2)
        assert got == mixing.route(dict(reversed(patterns.items())), dict(reversed(quotas.items())), 2)

        def fits(give):
            """Hall's condition: no set of patterns gives more than all of its sources take."""
            for n in range(1, len(give) + 1):
                for some in itertools.combinations(give, n):
                    if sum(give[p] for p in some) > sum(quotas[s] for s in {s for p in some for s in p}):
                        return False
            return True

        cost = lambda give: (-sum(give.values()), sum(max(0, v - patterns[p]) for p, v in give.items()))
        every = (dict(zip(patterns, v)) for v in itertools.product(*[range(2 * n + 1) for n in patterns.values()]))
        assert fits(got) and cost(got) == min(cost(g) for g in every if fits(g))


def test_flow_of_many_patterns_is_quick():
    rnd = random.Random(8)
    patterns = {tuple(sorted(rnd.sample([f"s{i:02}" for i in range(60)], 3))): rnd.randint(1, 10**6) for _ in range(8000)}
    got = mixing.route(patterns, {f"s{i:02}": 2 * 10**8 for i in range(60)}, 2)
    assert all(0 <= v <= 2 * patterns[p] for p, v in got.items())


def test_targets():
    sizes = {"a": 10, "b": 100, "c": 50}
    got = mixing.targets(sizes, {"a": 3, "b": 1, "c": 2}, 240, 2)
    assert got == {"a": 20.0, "b": 120.0, "c": 100.0}


def test_mix(spark):
    rows = [(k, None if k % 4 == 0 else f"s{k % 4}", "w " * (k % 17)) for k in range(400)]
    rows += [(1, "s1", "w "), (1, "s1", "w "), (None, "s2", None), (None, None, "a b"), (900, "s3", "w " * 30_000)]
    docs = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], "doc_id long, source string, text string, size int, key string, taken string")
    out = mixing.mix(docs, bucket_docs=20).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "source", "text", "key", "size", "source_size", "target", "taken"}
    by = defaultdict(lambda: [0, 0, 0])
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r["size"] == len(words(r.text)) and r.key == "x"
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    goal = mixing.targets({s: by[s][0] for s in ("s1", "s2", "s3", None)}, {"s1": 3, "s2": 1, "s3": 2, None: 3}, 1.5 * sum(v[0] for v in by.values()), 2)
    for s, (n, taken, target) in by.items():
        assert target == pytest.approx(goal[s]) and target - (20 if s != "s3" else 30_000) <= taken <= target + 1
    again = mixing.mix(docs.repartition(7), bucket_docs=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    twice = mixing.repeated(docs, bucket_docs=20)
    assert twice.schema == docs.schema and twice.count() == sum(r.taken // r["size"] for r in out if r["size"])
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeated(docs.limit(0)).count() == 0
    overlap = mixing.mix(docs.selectExpr("doc_id", "text", "if(doc_id % 3 = 0, array(source, 'all'), array(source)) own"), members="own", bucket_docs=20).collect()
    assert len(overlap) == len(rows) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in overlap)
    with pytest.raises(ValueError):
        mixing.mix(docs, max_patterns=2)


def test_mix_takes_the_seeded_choice(spark):
    """Every document before the one where a source's words run out is taken, none after it, unless a whole one still fits in its bucket."""
    rows = [(k, "abc"[k % 3], " ".join(["w"] * (1 + k % 5))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    place = docs.selectExpr("doc_id", f"xxhash64(11, doc_id is null, doc_id, text) & {(1 << 53) - 1} p")
    out = mixing.mix(docs, bucket_docs=1_000).join(place, "doc_id").collect()
    for s in "abc":
        own = sorted((r for r in out if r.source == s), key=lambda r: (r.p, r["size"]))
        n, target = sum(r["size"] for r in own), int(own[0].target)
        room, full = target % n, target // n
        for r in own:
            fits = r["size"] <= room
            room -= r["size"] if fits else 0
            assert r.taken == r["size"] * (full + fits)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header>
<div id="cookie-notice">We use cookies and many other things on this site</div><nav><ul><li><a>one</a><li><a>two</a></ul></nav>
<div class="wrap"><div class="post-content"><h2>Head &amp; line</h2><p>First  para with   <b>bold</b> words and so on, long enough.
<p>Second&nbsp;para &lt;here&gt;, also with many words in it.<div class="ad">Buy now this very good thing today please</div>
<script>var x = "<p>not text</p>";</script><p>Short.</p></div>
<form><p>Your name and your address and more words</p></form><div class="comments"><p>I liked it, a long reader comment with words</p></div></div>
<aside>Side words that are many and more of them here</aside><footer>&copy; 2020</footer></body>"""


TEXT = "Head & line\nFirst para with bold words and so on, long enough.\nSecond para <here>, also with many words in it.\nShort."


def test_html():
    assert html.extract(PAGE) == TEXT
    for cut in range(0, len(PAGE), 7):
        html.extract(PAGE[:cut])
    assert html.extract("") == "" and html.extract("<nav>a b c</nav>") == "" and html.extract("plain text only") == "plain text only"
    assert html.extract("<p>" + "word " * 200_000).count("word") == 200_000
    assert html.extract("<p>one two three<!-- no --> four &am") == "one two three four &am"


def test_region_is_the_best_of_all():
    rnd = random.Random(4)
    pieces = ["<p>", "</p>", "<div>", "</div>", "<ul><li><a href=x>go on</a></ul>", "one two ", "three ", "<article>", "</article>", "<nav>", "</nav>", "<h2>", "<a>", "</a>", "<br>", "four five six seven "]
    weights = html.DEFAULT | {"tag": -1.0, "<article>": -6.0, "<p>": -0.4}
    several = 0
    for _ in range(500):
        page = html.Page("".join(rnd.choices(pieces, k=rnd.randint(1, 40))))
        blocks = page.blocks

        def total(i, j):
            tags = [t for b in blocks[i + 1 : j] for t in b[4]]
            return sum(html.block_score(b, weights) for b in blocks[i:j]) + sum(html.tag_score(t, weights) for t in tags)

        best = max([total(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)], default=0.0)
        first, last = html.region(page, weights)
        assert (first, last) == (0, 0) if best <= 1e-9 else abs(total(first, last) - best) < 1e-9
        several += last - first > 1 and (first > 0 or last < len(blocks))
    assert several > 30


def test_html_words_of_the_article_stay():
    body = "<p>Some words of the article that are quite a few.</p>"
    page = f'''<div class="site-header"><p>Site and its long motto of many words</p></div><div class="search-results-study">{body}<div class="share-price"><p>The price.</p></div>
<p>A line<br>broken   in<br/>three.</p><div class="related-posts"><p>More to read here and there and on and on</p></div><ul><li>item one of it</li><li>two</li></ul><p><a href=x>Read the whole study</a></p></div><div id="userComments"><p>I say so, and so do many others here</p></div>'''
    want = "Some words of the article that are quite a few.\nThe price.\nA line broken in three.\nitem one of it\ntwo\nRead the whole study"
    assert html.extract(page) == want
    assert html.extract(f"<div><p>Some tagline of a few words</p></div><main>{page}</main><div><p>Small print, all of it</p></div>") == want


def test_html_deep_nesting_is_linear():
    deep = "<div>a " * 60_000 + "</section>" * 60_000
    assert html.extract(deep).count("a") == 60_000
    assert html.extract("<a href=\"" * 30_000) == ""


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = html.extract_pages(pages, html.fit_weights(pages)).collect()
    assert sorted(r.n_chars for r in out) == [0, len(TEXT), len(TEXT)] and html.extract_pages(pages.limit(0), html.DEFAULT).count() == 0
    marked = spark.createDataFrame([(f"<nav><a>m{k}</a></nav><article><p>one two three four {k}</p></article>",) for k in range(5)], "html string").selectExpr("1L page_id", "html")
    w = html.fit_weights(marked)
    assert w["word"] > 0 > w["tag"] and w["link"] < 0


def test_cascade_is_exact_with_false_positives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) key", "id % 7 = 0 listed")
    c = urls.Cascade(Scratch(spark), Scratch(spark).save(keys), bits_per_key=2, hashes=2)
    assert len(c.levels) > 2
    import pyspark.sql.functions as F

    assert keys.withColumn("has", c.has(F.col("key"))).where("has <> listed").count() == 0
    listed = keys.where("listed").select("key").unionAll(spark.sql("select cast(null as string)"))
    for bits in (1 << 26, 2000, 300):
        out = urls.listed_flag(keys.select("key", F.lit(1).alias("host")), "key", listed, max_bits=bits).join(keys.withColumnRenamed("listed", "want"), "key")
        assert out.count() == 3000 and out.where("listed <> want").count() == 0


def test_url_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de", "example.net", "/de", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("ftp://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("x://example.com/de/?://org/fr/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://bad.org/en", "bad.org", "/en", None, "block"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(c[0], 1) for c in cases * 2], "url string, page_id int")
    out = urls.filter_urls(pages, spark.createDataFrame([("bad.org",), (None,)], "h string")).collect()
    assert Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in out) == Counter(cases * 2)
    assert urls.filter_urls(pages.limit(0), spark.createDataFrame([], "h string")).count() == 0


def test_very_long_texts_and_urls(spark):
    text = " ".join(f"w{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, "a", text), (2, "a", "one two"), (3, "b", text + " x")], "doc_id long, source string, text string")
    got = {r.doc_id: (r["size"], r.source_size, r.taken) for r in mixing.mix(docs).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (100_000, 100_002), 2: (2, 100_002), 3: (100_001, 100_001)}
    assert all(taken in (0, size, 2 * size) for size, _, taken in got.values())
    path = "/en/" + "x" * 200_000
    pages = spark.createDataFrame([(1, "https://EXAMPLE.net" + path), (2, "https://a." + "b" * 100_000 + ".net" + path)], "page_id long, url string")
    listed = spark.createDataFrame([("none.example",)], "key string")
    rows = {r.page_id: r for r in urls.filter_urls(pages, listed).collect()}
    assert (rows[1].host, rows[1].path == path, rows[1].verdict) == ("example.net", True, "allow") and rows[2].verdict == "block"


def test_url_columns_of_the_callers_stay(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x", "mine", "p", 7), (2, None, None, None, 8)], "page_id long, url string, host string, Verdict string, _shard int")
    for bits in (1 << 26, 1):
        out = urls.filter_urls(pages, spark.createDataFrame([("bad.org",), ("",)], "h string"), max_bits=bits)
        assert out.columns == ["page_id", "url", "host", "Verdict", "_shard", "_host", "path", "listed", "rule", "_verdict"]
        assert sorted(tuple(r)[2:] for r in out.where("page_id = 1").collect()) == [("mine", "p", 7, "bad.org", "/x", True, None, "block")]


def test_one_scan_for_any_number_of_shards(spark, tmp_path):
    spark.range(400).selectExpr("id page_id", "concat('http://h', id % 97, '.org/') url").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    out = urls.filter_urls(pages, spark.range(0, 97, 2).selectExpr("concat('h', id, '.org') h"), max_bits=64)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"Relation [page_id") <= 1 and out.where("listed").count() == sum(i % 97 % 2 == 0 for i in range(400))


def test_unquoted_attributes_with_apostrophes():
    assert html.extract("<p title=it's>Hello world, it's me and more text here.</p><p>Second paragraph.</p>") == "Hello world, it's me and more text here.\nSecond paragraph."
    assert html.extract("<p class=\"a>b\" x = 'c>d'>Some words</p><p \"odd>More of it</p>") == "Some words\nMore of it"


def test_marked_elements_are_not_needed(spark):
    """With article and main turned into div, the texts of given pages stay the same."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    plain = lambda h: re.sub(r"(</?)(?:article|main)\b", r"\1div", h or "", flags=re.I)
    assert all(html.extract(r.html or "") == html.extract(plain(r.html)) for r in rows)


def test_overlapping_sources_of_a_table(spark, tmp_path):
    rows = [(i, f"word number {i} " * (1 + i % 4), ("a", "b", "c")[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1], ("b", "c", None)[i % 3]) for i in range(0, 40, 2)] + [(200, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.source_mix_overlap(spark, str(tmp_path)).collect()
    texts = {}
    for d, t, s in rows:
        texts.setdefault(t or "", []).append((d, s or "(none)"))
    assert {(r.doc_id, r.sources) for r in out} == {(min(d for d, _ in m), "|".join(sorted({s for _, s in m}))) for m in texts.values()}
    patterns = Counter()
    for t, m in texts.items():
        patterns[tuple(sorted({s for _, s in m}))] += len(t.split())
    names = sorted({s for p in patterns for s in p})
    sizes = {n: sum(v for p, v in patterns.items() if n in p) for n in names}
    goal = mixing.targets(sizes, dict(zip(names, itertools.cycle((3, 1, 2)))), 1.5 * sum(patterns.values()), 2)
    given, taken = mixing.route(patterns, goal, 2), Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[tuple(r.sources.split("|"))] += r.taken
    longest = max(len(t.split()) for t in texts)
    assert len([p for p in patterns if len(p) > 1]) == 3 and all(abs(taken[p] - given[p]) <= longest for p in patterns)
