import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from rostrum.llm import lexical, pieces, resampling

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def ranked(docs, items, k=10):
    """All scores of all documents, in plain Python."""
    held = [(i, d, terms(t)) for i, (d, t) in enumerate(docs)]
    held = [(i, d, ts) for i, d, ts in held if ts]
    n, total = len(held), sum(len(ts) for *_, ts in held)
    out = []
    for item, text in items:
        scores = []
        for i, d, ts in held:
            score = 0
            for t in set(terms(text)):
                df = sum(t in x for *_, x in held)
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                tf = ts.count(t)
                score += w * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * len(ts) * n // total)))
            if score > 0:
                scores.append((-score, d if d is not None else 1 << 62, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some_docs(rnd, n):
    words = ["ab", "Ab", "cd", "é", "x1", "中文", "the", "THE", "zz", "q"]
    docs = [(i, " ".join(rnd.choices(words, weights=range(10, 0, -1), k=rnd.randint(0, 25)))) for i in range(n)]
    docs += [(3, "the rare one"), (3, "the rare one"), (None, "rare rare"), (None, None), (n, None), (n + 1, ""), (n + 2, "--- !"), (n + 3, "the " * 30_000 + "rare")]
    docs += [(n + 10 + i, "same same text, ab") for i in range(40)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("shard, block", [(40, 3), (10**6, 10**6)])
def test_search_equals_all_scores(spark, shard, block):
    rnd = random.Random(8)
    docs = some_docs(rnd, 60)
    items = [(1, "The rare, ONE"), (2, "ab cd the"), (3, None), (4, "nowhere to-be found"), (4, "q zz Q"), (None, "é x1"), (6, "same text")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(3)
    got = lexical.top_documents(d, spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, rank int"), shard=shard, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items)


def test_search_of_empty_tables(spark):
    none, some = (spark.createDataFrame(r, "doc_id long, item_id long, text string") for r in ([], [(1, 1, "a")]))
    assert lexical.top_documents(none, some).collect() == lexical.top_documents(some, none).collect() == lexical.top_documents(none, none).collect() == []
    assert [tuple(r) for r in lexical.top_documents(some, some).collect()][0][:3] == (1, 1, 1)


def test_best_positions_stop_before_the_lists_end(monkeypatch):
    rnd = np.random.default_rng(3)
    docs, vocabulary = 20_000, 6
    has = rnd.random((docs, vocabulary)) < 0.5
    counts, (doc, term) = has.sum(1), np.nonzero(has)
    tf = rnd.integers(1, 50, len(doc))
    s = lexical.Shard(np.arange(docs), rnd.integers(5, 500, docs), counts, term, tf, docs, 250 * docs, vocabulary)
    met = []
    merged = lexical.Shard._merged
    monkeypatch.setattr(lexical.Shard, "_merged", staticmethod(lambda best, score, ids, k: met.append(len(score)) or merged(best, score, ids, k)))
    weight = np.array([900, 700, 500, 300, 200, 0])
    score, ids = s.search(np.arange(vocabulary), weight, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    total = np.zeros(docs, np.int64)
    np.add.at(total, s.doc, weight[np.repeat(np.arange(vocabulary), np.diff(s.at))] * s.impact)
    first = np.lexsort((np.arange(docs), -total))[:10]
    assert ids.tolist() == first.tolist() and score.tolist() == total[first].tolist()
    assert sum(met) < docs / 2


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_draw_equals_the_contract_in_plain_python(spark):
    rnd = random.Random(4)
    docs = some_docs(rnd, 300) + [(500 + i, "x" * 70 + " é" * i + " 1 2 3 " + "word " * (15 + i)) for i in range(12)]
    target = [("the rare one, " * 9,), (None,), ("é x1 " + "y" * 60,)]
    facts = [(d, *features(t)) for d, t in docs]
    s, t = ([0] * 10_000 for _ in range(2))
    for counts, every in ((s, (f for *_, f in facts)), (t, (features(x)[1] for (x,) in target))):
        for f in every:
            for b in f:
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for d, n, f in facts:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] if r[0] is not None else 1 << 62))
    df = spark.createDataFrame([(d, x, 5, "k") for d, x in docs], "doc_id long, text string, score int, row string").repartition(3)
    goal = spark.createDataFrame(target, "text string")
    for percent in (5, 50, 100, 0):
        drawn = [(r[0], r[2], r[3], r[4], i + 1) for i, r in enumerate(may[: percent * len(may) // 100])]
        got = [tuple(r) for r in resampling.drawn(df, goal, percent=percent).collect()]
        assert sorted((r for r in got if r[4] is not None), key=lambda r: r[4]) == drawn
        assert sorted([r[:4] for r in got], key=str) == sorted([(d, n, w, x) for d, _, n, w, x in rows], key=str)
    assert resampling.drawn(df.limit(0), goal).collect() == [] and resampling.drawn(df, goal.limit(0)).count() == len(docs)


def test_first_rows_of_ties(spark):
    rnd = random.Random(5)
    data = [(rnd.choice([-5, 0, 0, 0, 7]), rnd.randint(0, 3), i) for i in range(200)]
    df = spark.createDataFrame(data, "a long, b long, c long")
    keys = [F.col(c) for c in "abc"]
    for k in (1, 37, 50, 100, 199, 200, 500):
        assert sorted(tuple(r) for r in df.where(resampling.first_rows(df, keys, k)).collect()) == sorted(data)[:k]
    assert resampling.first_rows(df, keys, 0) is None
    far = spark.createDataFrame([(-(1 << 62),), (0,), ((1 << 62),)], "a long")
    assert [r.a for r in far.where(resampling.first_rows(far, [F.col("a")], 1)).collect()] == [-(1 << 62)]


def test_pieces_equal_the_library(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    lib, p, rnd = SentencePieceProcessor(model_proto=data), pieces.Pieces(data, room=50), random.Random(6)
    wide = list("abthe  ▁\n\t\0é中🙂ǅ٣²Ⅷ�'1<0x>s/unk")
    for short in (pieces.SHORT, 0):  # the list and the heap
        monkeypatch.setattr(pieces, "SHORT", short)
        p.known.clear()
        for alphabet in (wide, [chr(i) for i in range(256)], list("the an of ")):
            for _ in range(1500):
                t = "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))
                ids = lib.encode(t)
                assert p.encode(t) == ids, repr(t)
                assert p.decode(ids) == lib.decode(ids), repr(t)
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(262), rnd.randrange(32_000), 29_871]) for _ in range(rnd.randint(0, 8))]
        assert p.decode(ids) == lib.decode(ids), ids
    for long in ("ab" * 40_000, "a b  c\n" * 20_000, " " * 5000, "é" * 30_000):
        assert p.encode(long) == lib.encode(long) and p.decode(p.encode(long)) == long


def test_pieces_of_many_texts_at_once(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    lib, rnd = SentencePieceProcessor(model_proto=data), random.Random(12)
    alone, merge = [], pieces.Pieces.merge
    monkeypatch.setattr(pieces.Pieces, "merge", lambda self, segment: alone.append(segment) or merge(self, segment))
    words = ["the", "The,", "of.\nThen", "  x", "|", "ünder", "中文ab", "🙂🙂", "a▁b", "\t", "1234", "é", "e\u0301", "\0", "</s>", "ding" * 5, ""]
    for room in (1_000_000, 30):  # everything is remembered, or forgotten again and again
        p = pieces.Pieces(data, room)
        for n in (0, 1, 2, 50, 300):
            texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "  ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
            texts += ["", " ", "  ", "▁", ""] * (n == 50)
            ids, bounds = p.encode_all(texts)
            assert bounds.tolist()[0] == 0 and bounds[-1] == len(ids) and len(bounds) == len(texts) + 1
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == lib.encode(texts)
    p, prose = pieces.Pieces(data), " ".join("".join(rnd.choices(["th", "er", "on", "an", "re", "he", "in"], k=rnd.randint(1, 6))) for _ in range(5000))
    alone.clear()
    assert p.encode(prose) == lib.encode(prose) and not alone  # short segments are merged together, none by itself
    long = "thion" * 500
    assert p.encode(f"{long} a {long}") == lib.encode(f"{long} a {long}") and alone == ["▁" + long]  # met twice, merged once


def test_pieces_of_tables(spark):
    lib = SentencePieceProcessor(model_file=pieces.MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.createDataFrame([(1, "Hello  world", 5), (1, "Hello  world", 5), (None, None, None), (2, "", 0), (3, "a▁b", 1)], "doc_id long, text string, ids int")
    out = sorted([tuple(r) for r in pieces.round_trip(docs).collect()], key=str)
    row = lambda d, t: (d, len(lib.encode(t)), sha(",".join(map(str, lib.encode(t)))), sha(t.replace("▁", " ")), True)
    assert out == sorted([row(1, "Hello  world")] * 2 + [row(None, ""), row(2, ""), row(3, "a▁b")], key=str)
    assert sorted(r.text for r in pieces.decode(pieces.encode(docs)).collect()) == sorted(["Hello  world"] * 2 + ["", "", "a b"])
    odd = spark.createDataFrame([(1, [0, 1 << 20]), (2, None), (3, [1, 259])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(odd).collect()} == {1: None, 2: "", 3: lib.decode([1, 259])}
    assert pieces.round_trip(docs.limit(0)).collect() == []


def test_other_models_are_refused(spark, tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    with open(pieces.MODEL, "rb") as f:
        model = ModelProto.FromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.encode(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "m"))


def test_real_notices_are_found(spark):
    from rostrum.llm import licenses

    header = (
        "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n"
        " * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n"
        " * GNU General Public License for more details.\n *\n * You should have received a copy of the GNU General Public License\n * along with this program.  If not, see <http://www.gnu.org/licenses/>.\n */"
    )
    docs = [(1, "some words before " * 20 + header + " and after" * 30), (2, licenses.TEMPLATES["bsd-3-clause-text"]), (3, "x " + licenses.TEMPLATES["mit-grant"] + " " + licenses.TEMPLATES["mit-warranty"]), (4, "free software " * 50), (5, None)]
    got = {(r.doc_id, r.license): r.chunk_share for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1, "gpl-3.0-header"] == got[2, "bsd-3-clause-text"] == got[3, "mit-grant"] == got[3, "mit-warranty"] == 1.0
    assert all(share < 1 for (d, name), share in got.items() if (d, name) in ((1, "gpl-2.0-header"), (1, "agpl-3.0-header"), (2, "bsd-2-clause-text")))
    assert {d for d, _ in got} == {1, 2, 3}


def test_bitmap_knows_its_hashes(spark):
    from rostrum.llm import licenses

    rnd = random.Random(9)
    mine = [rnd.getrandbits(64) - (1 << 63) for _ in range(3000)]
    others = [rnd.getrandbits(64) - (1 << 63) for _ in range(3000)]
    may = licenses._bitmap(set(mine), licenses.BITS)
    df = spark.createDataFrame([(mine, others)], "a array<long>, b array<long>")
    a, b = df.select(F.size(F.filter("a", lambda h: may(h))), F.size(F.filter("b", lambda h: may(h)))).first()
    assert a == 3000 and b < 3000 * 2 / licenses.BITS


def test_groups_close_their_own_threads_tables(spark):
    import threading

    from rostrum.llm._spark import Scratch

    outer = Scratch(spark)
    kept = outer.save(spark.range(3))
    others = []
    opened, closed = threading.Event(), threading.Event()

    def another():
        others.append(Scratch(spark).save(spark.range(5)))
        opened.set()
        closed.wait(60)
        others.append(others[0].count())

    with Scratch.group():
        mine = Scratch(spark).save(spark.range(4))
        with Scratch.group():
            inner = Scratch(spark).save(spark.range(2))
        t = threading.Thread(target=another)
        t.start()
        assert opened.wait(60) and mine.count() == 4
    closed.set()
    t.join(60)
    assert others[1] == 5 and kept.count() == 3
    for gone in (mine, inner):
        with pytest.raises(Exception):
            spark.read.parquet(gone.scratch_path).count()


def test_small_tables_are_spread(spark):
    from rostrum.llm._spark import spread

    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(cores + 3)
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 100
    assert spread(many) is many


def test_trees_for_a_recall():
    from rostrum.llm.neardup import trees_for

    assert trees_for(80, 7, 1e-3) == 12 and trees_for(80, 7, 1e-6) == 24 and trees_for(90, 7, 1e-3) < 12
    assert [trees_for(80, d, 1e-3) for d in (3, 5, 7)] == sorted(trees_for(80, d, 1e-3) for d in (3, 5, 7))
