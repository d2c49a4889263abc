import pytest
from pyspark.sql import functions as F

from rostrum.operators import scoring
from rostrum.sources import io
from rostrum.sources.cache import embed_key, embedded_through
from rostrum.sources.external import HashEmbedder
from rostrum.sources.versions import Conflict, Versions, clear_outputs
from rostrum.streaming.incremental import add_scores, scale_new_records


def numbers(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "n long")


def values(df):
    return sorted(r[0] for r in df.collect())


def test_a_write_that_ends_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    store = Versions(spark, str(tmp_path / "s"))
    assert store.read("a", "n long").count() == 0 and store.versions() == []
    assert store.replace(a=numbers(spark, 1), b=numbers(spark, 5)) == 1
    pinned = store.read("a")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.replace(a=numbers(spark, 2), b=numbers(spark, 6))
    assert values(store.read("a")) == [1] and values(store.read("b")) == [5]
    assert store.replace(a=store.read("a").unionAll(numbers(spark, 3)), b=numbers(spark, 7)) == 2  # made from itself
    assert values(store.read("a")) == [1, 3] and values(pinned) == [1] and values(store.read("b", version=1)) == [5]
    store.append(a=numbers(spark, 4))
    assert values(store.read("a")) == [1, 3, 4] and values(store.read("b")) == [7]
    assert store.clear(older_than=1e9) == 0 and store.versions() == [3]
    assert store.clear(older_than=0) >= 2  # both tables of the write that was killed, at least
    assert values(store.read("a")) == [1, 3, 4] and values(store.read("b")) == [7]


def test_two_writers_conflict_and_appends_add_up(spark, tmp_path):
    one, two = (Versions(spark, str(tmp_path / "s")) for _ in range(2))
    part, _ = one.stage("a", numbers(spark, 1))
    two.replace(a=numbers(spark, 2))
    with pytest.raises(Conflict):
        one.commit(replace={"a": part}, expect=0)
    with pytest.raises(Conflict):
        one._publish(1, "{}")
    assert one.commit(append={"a": part}) == 2 and values(two.read("a")) == [1, 2]


def test_scores_split_and_clear(spark, tmp_path):
    at = str(tmp_path / "scores")
    assert io.read_scores(spark, at, "n long").count() == 0
    io.write_scores(numbers(spark, 1, 2), at)
    io.write_scores(io.read_scores(spark, at, "n long").where("n > 1"), at)
    assert values(io.read_scores(spark, at, "n long")) == [2]
    split = str(tmp_path / "split")
    assert io.write_split(numbers(spark, 1), numbers(spark, 2), split) == 1
    assert values(Versions(spark, split).read("filtered")) == [2]
    (tmp_path / "out").mkdir()
    for name in ("ranking", "skipped"):
        (tmp_path / "out" / name).mkdir()
        (tmp_path / "out" / name / "x").write_text("1")
    assert clear_outputs(spark, str(tmp_path / "out"), ["ranking", "skipped", "none", "../scores", ""]) == ["ranking"]
    assert (tmp_path / "out" / "skipped" / "x").exists() and not (tmp_path / "out" / "ranking").exists()


class Counting(HashEmbedder):
    def __init__(self, calls):
        super().__init__(8)
        self.calls = calls

    def embed(self, texts):
        self.calls.add(len(texts))
        return super().embed(texts)


def test_each_text_is_embedded_once(spark, tmp_path, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    cache, embedder = Versions(spark, str(tmp_path / "c")), Counting(calls)
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c"), (5, "c")], "id int, text string")
    got = {(r.id, r.vec and tuple(r.vec)) for r in embedded_through(rows, embedder, cache, "m").collect()}
    want = {i: None if t is None else tuple(HashEmbedder(8).embed([t])[0]) for i, t in ((1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c"))}
    assert {(i, v and tuple(round(x, 5) for x in v)) for i, v in got} == {(i, v and tuple(round(x, 5) for x in v)) for i, v in want.items()}
    assert calls.value == 3
    assert embedded_through(rows, embedder, cache, "m").count() == 6 and calls.value == 3
    more = rows.unionAll(spark.createDataFrame([(6, "new")], "id int, text string"))
    with monkeypatch.context() as m:  # ends before the vectors count
        m.setattr(Versions, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            embedded_through(more, embedder, cache, "m")
    assert cache.read("embeddings").count() == 3
    assert embedded_through(more, embedder, cache, "m").where("vec is null").count() == 1 and cache.read("embeddings").count() == 4
    before = calls.value
    assert embedded_through(rows, embedder, cache, "other").count() == 6 and calls.value == before + 3


def test_another_writer_makes_the_same_vectors_first(spark, tmp_path, monkeypatch):
    cache, rows = Versions(spark, str(tmp_path / "c")), spark.createDataFrame([("a",), ("b",)], "text string")
    real, done = Versions.commit, []

    def late(self, *args, **kw):
        if not done:  # in between, someone else embeds a text
            done.append(1)
            embedded_through(rows.limit(1), HashEmbedder(8), Versions(spark, str(tmp_path / "c")), "m")
        return real(self, *args, **kw)

    monkeypatch.setattr(Versions, "commit", late)
    assert embedded_through(rows, HashEmbedder(8), cache, "m").where("vec is not null").count() == 2
    keys = [r.key for r in cache.read("embeddings").collect()]
    assert sorted(keys) == sorted(r[0] for r in rows.select(embed_key("m", F.col("text"))).collect())


def test_bounds_that_merge_equal_the_batch(spark, tmp_path, monkeypatch):
    store = Versions(spark, str(tmp_path / "s"))
    frame = lambda *rows: spark.createDataFrame(rows, "id long, raw double")
    batches = [frame((1, 0.2), (2, 0.4)), frame((3, 0.3), (1, 9.9)), frame((4, 0.8), (5, None)), frame((4, 1.0)), frame()]
    assert add_scores(store, batches[0], 0, "id", "raw", "score") == "rescaled"
    assert add_scores(store, batches[1], 1, "id", "raw", "score") == "added"  # within the bounds; id 1 is there already
    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            add_scores(store, batches[2], 2, "id", "raw", "score")
    assert store.read("scaled").count() == 3 and store.state()["facts"]["batch"] == 1
    assert add_scores(store, batches[2], 2, "id", "raw", "score") == "rescaled"
    assert [add_scores(store, b, n, "id", "raw", "score") for n, b in ((2, batches[2]), (3, batches[3]), (4, batches[4]))] == ["skipped"] * 3
    every = frame((1, 0.2), (2, 0.4), (3, 0.3), (4, 0.8), (5, None))
    want = {(r.id, r.score) for r in scoring.min_max(every, "raw", "score").collect()}
    assert {(r.id, r.score) for r in store.read("scaled").collect()} == want
    flat = Versions(spark, str(tmp_path / "f"))
    assert add_scores(flat, frame((1, 0.4), (2, 0.4)), 0, "id", "raw", "score", F.lit(0.5)) == "rescaled" and {r.score for r in flat.read("scaled").collect()} == {0.5}


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    run = lambda work=lambda df: df: scale_new_records(spark, at("in"), "id long, raw double", at("store"), at("cp"), work, "id", "raw", "score")
    rows = [[(1, 0.1), (2, 0.5)], [(3, 0.9)], [(4, 0.0), (5, 0.3)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "id long, raw double").coalesce(1).write.mode("append").parquet(at("in"))
        if k == 1:
            def broken(df):
                raise ValueError("ends here")

            with pytest.raises(Exception):
                run(broken).awaitTermination()
        run().awaitTermination()
    every = spark.read.parquet(at("in"))
    want = {(r.id, r.score) for r in scoring.min_max(every, "raw", "score").collect()}
    assert {(r.id, r.score) for r in Versions(spark, at("store")).read("scaled").collect()} == want and len(want) == 5
