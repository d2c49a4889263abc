import random
from collections import defaultdict

import numpy as np
import pytest

from rostrum.llm import components, licenses, neardup, neighbours, repeats
from rostrum.llm._spark import Scratch


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = {}
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            low = min(ids, default=None)
            out[i] = (rows[i][0], len(sets[i]), low, rows[i][0] == low)
    return sorted(out.values(), key=str)


def corpus(seed, copies=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    rows = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(1, 90)))) for k in range(120)]
    base = rnd.choices(vocab, k=120)
    for c in range(copies):  # a chain of near copies around the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((1000 + c, " ".join(w)))
    rows += [(2000 + c, rows[3][1].upper().replace("É", "é")) for c in range(20)]
    rows += [(2500, long := " ".join(rnd.choices(vocab, k=30_000))), (2501, long + " more")]
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "one"), (3004, "ONE"), (None, "one"), (None, None), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_dups_equal_brute_force(spark, k):
    rows = corpus(k)
    docs = spark.createDataFrame([(*r, 1, 7) for r in rows], "doc_id long, text string, n int, row_key int")
    for leaf, block in ((16, 64), (2, 8)):
        got = neardup.near_dups(docs, k=k, leaf=leaf, block=block).drop("row_key").collect()
        assert sorted(map(tuple, got), key=str) == brute_groups(rows, k)
    kept = neardup.drop_near_dups(docs, k=k)
    assert kept.schema == docs.schema
    want = {(i, t) for (i, t), (_, _, _, keep) in zip(rows, sorted_rows(rows, k)) if keep}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want and kept.count() == len(want)
    assert neardup.near_dups(docs.limit(0)).count() == 0


def sorted_rows(rows, k):
    by = {}
    for r in brute_groups(rows, k):
        by.setdefault(r[0], []).append(r)
    out = []
    for i, t in rows:
        n = len(shingles(t, k))
        out.append(next(r for r in by[i] if r[1] == n))
    return out


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if root(a) != root(b):
            top[max(root(a), root(b))] = min(root(a), root(b))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for per_task in (1 << 20, 25):
        got = components.components(Scratch(spark), df, per_task=per_task).collect()
        assert {r.node: r.root for r in got} == {x: root(x) for x in nodes} and len(got) == len(nodes)


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(50)]
    make = lambda n: rnd.choices(vocab, k=n)
    shared = [make(n) for n in (50, 51, 60, 120, 49, 35)]
    rows = []
    for k in range(80):
        w = make(rnd.randint(0, 60))
        for s in rnd.sample(shared, rnd.randint(0, 2)):
            a = rnd.randint(0, 6)
            w += s[a:] if rnd.random() < 0.3 else s
            w += make(rnd.randint(0, 30))
        rows.append((k, " ".join(w)))
    base = make(200)
    for k in range(30):  # near copies: matches of all lengths around the limit
        w = list(base)
        for at in range(rnd.randint(5, 40), 200, rnd.randint(36, 70)):
            w[at] = "x%d" % k
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k, " ".join(base[:70])) for k in range(5)] + [(400 + k, "short copy") for k in range(3)]
    once = make(55)
    rows += [(500, " ".join(once + make(5) + once)), (501, None), (502, ""), (None, " ".join(base[60:]))]
    texts, cover = defaultdict(set), {}
    words = [(t or "").split() for _, t in rows]
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            texts[tuple(w[k : k + 50])].add(i)
    for i, w in enumerate(words):
        own = {k + d for k in range(len(w) - 49) if len(texts[tuple(w[k : k + 50])]) > 1 for d in range(50)}
        if own:
            cover.setdefault(rows[i][0], set()).update(own)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, cls int")
    got = defaultdict(set)
    for r in repeats.repeated_passages(docs).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(got) == cover
    assert repeats.repeated_passages(docs.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 12))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)]  # a query's own copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0, None]), (2004, [float("nan")] * 12), (2020, [float("inf")]), (None, rows[1][1]), (3, rows[3][1]), (2100, [2.0, -1.0])]
    vectors = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = np.pad(np.array(v), (0, 12 - len(v)))
    ids = np.array(sorted(good))
    m = np.array([good[i] for i in ids])
    hit = total = 0
    got = defaultdict(list)
    for r in neighbours.search(vectors).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        s = m @ good[q]
        order = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != q][:20]
        assert all(abs(f[2] - good[f[1]] @ good[q]) < 1e-9 for f in found)
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        hit += len(set(order) & {f[1] for f in found})
        total += 20
    assert hit / total >= 0.9
    few = neighbours.search(vectors.where("vec_id in (0, 1, 2, 20)")).collect()
    assert len(few) == 6
    assert neighbours.search(vectors.limit(0)).count() == 0


def recall(spark, x, **settings):
    """Share of the true 20 nearest, over all queries, of rows whose ids are their places in ``x``."""
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.search(vectors, **settings).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    return sum(hits) / len(hits)


def test_search_goes_on_until_its_beam_is_opened_and_has_other_entries(spark):
    rng = np.random.default_rng(1)
    # Queries lie among short vectors that are linked to each other only; their nearest are the long ones.
    x = rng.standard_normal((1200, 12)) * 0.3
    long = np.arange(1200) % 20 >= 10
    x[~long, 0] += 1
    x[long, 0] += 1.5
    x[long, 1] += 2.6
    assert recall(spark, x, degree=16, beam=60, wide=8, rounds=4) >= 0.9


@pytest.mark.parametrize("spread", ["few long", "orders of magnitude"])
def test_recall_when_lengths_differ_widely(spark, spread):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((800, 12))
    if spread == "few long":
        x[[7, 333, 501]] *= 1000
    else:
        x *= 10 ** rng.uniform(-3, 3, (800, 1))
    assert recall(spark, x, degree=16, beam=60, wide=30, rounds=4) >= 0.9


def test_licenses(spark):
    grant = licenses.TEMPLATES["mit-grant"]
    noise = " ".join(f"n{i}" for i in range(40))
    rows = [
        (1, f"{noise} LICENSED!! under### the APACHE license,*** version 2.0 {noise}"),
        (2, f"{noise} {grant} {noise}"),
        (3, "This work is licensed under the GNU General Public License, version 3. " * 3),
        (4, noise), (5, None), (6, ""), (7, "one"), (None, "Released under the MIT License."), (None, "Released under the MIT License."),
        (8, f"{noise} released under the license of {noise}"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): (r.containment, r.chunk_share) for r in licenses.scan(docs).collect()}
    assert got == {(1, "apache-2.0"): (1.0, 1.0), (2, "mit-grant"): (1.0, 1.0), (3, "gpl-3.0"): (1.0, 1.0), (None, "mit"): (1.0, 1.0)}
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"x": "word"})


def test_very_long_texts_are_read_to_their_end(spark):
    noise = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    passage = noise("p", 60)
    rows = [(1, noise("a", 40_000) + " " + passage + " Released under the MIT License."), (2, noise("b", 30_000) + " " + passage + " " + noise("c", 9)), (3, noise("d", 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(1, "mit")}
    found = {(r.doc_id, r.start_word, r.end_word) for r in repeats.repeated_passages(docs).collect()}
    assert found == {(1, 40_000, 40_060), (2, 30_000, 30_060)}


def test_components_leave_out_null_ends_and_loops(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (5, 4)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(Scratch(spark), df).collect()} == {(4, 4), (5, 4)}
    assert components.components(Scratch(spark), df.limit(0)).count() == 0
