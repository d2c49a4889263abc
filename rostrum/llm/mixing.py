"""Mixing sources to target weights: min-cost flow over membership patterns.

Documents are summed by pattern, the set of sources they belong to. A flow network on the driver, whose size depends on
the patterns and sources and not on the documents, routes each pattern's words to the quotas of its sources: one arc a
repetition, the e-th repetition at cost e - 1, so that a first use always comes before a second (convex costs). As only
the arcs out of the network's source have costs, the cheapest largest flow is found cost by cost: the arcs of each cost are opened in turn and the
flow is made the largest there is; a path that adds flow never takes back what a pattern gives. The
flow gives each pattern a number of words; whole passes over the pattern and a seeded choice of its documents fill it.

The seeded choice needs no global sort: documents get a seeded place in [0, 1), a histogram of places finds the bucket in
which a pattern's rest runs out, everything before it is taken, everything after it is not, and only that bucket's
documents (about ``bucket_docs``) are walked one by one, each taken where it still fits. Texts are read twice, once for the
sums and once for the result.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; rows alike in id, source and
text stand or fall together; ids may repeat or be null; texts of any length are read whole; an empty table gives an empty table; other
columns are kept, but for those named like the mix's own (size, source_size, target, taken), which it replaces; ``repeated`` keeps those too.
Patterns beyond ``max_patterns`` raise an error, since the network would no longer fit the driver.
"""
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch

WORD = r"[^\x20\x09-\x0D]+"


class Flow:
    """Largest flow by level graphs and blocking flows; ``run`` adds to the flow there is."""

    def __init__(self, n: int):
        self.to, self.room, self.out = [], [], [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        todo = deque([source])
        while todo:
            x = todo.popleft()
            for e in self.out[x]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    todo.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> None:
        while (level := self._levels(source))[sink] >= 0:
            tried = [0] * len(self.out)
            path: list[int] = []
            while True:
                x = self.to[path[-1]] if path else source
                if x == sink:
                    step = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= step
                        self.room[e ^ 1] += step
                    # Go on from before the first arc that is now full.
                    del path[next(i for i, e in enumerate(path) if not self.room[e]) :]
                elif tried[x] < len(self.out[x]):
                    e = self.out[x][tried[x]]
                    if self.room[e] and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                    else:
                        tried[x] += 1
                elif path:
                    tried[self.to[path.pop() ^ 1]] += 1
                else:
                    break


def by_code_point(source: str | None) -> tuple:
    return source is None, [ord(c) for c in source or ""]


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight; what exceeds ``most`` times a source's size goes to the others by weight.

    Sources are taken in ``sizes``'s order, so that sums of doubles come out alike in every run."""
    out, open_, left = {}, list(sizes), float(total)
    while open_:
        whole = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / whole for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, int]:
    """Words that each pattern gives, by the cheapest largest flow; at most ``most`` times its size.

    Of several such flows the one found depends on the patterns and quotas only, not on their order."""
    names, keys = sorted(quotas, key=by_code_point), sorted(patterns, key=lambda p: [by_code_point(s) for s in p])
    flow = Flow(2 + len(keys) + len(names))
    place = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    for i, p in enumerate(keys):
        for s in sorted(set(p), key=by_code_point):
            flow.arc(2 + i, place[s], most * patterns[p])
    for s in names:
        flow.arc(place[s], 1, int(quotas[s]))
    arcs: dict = {p: [] for p in keys}
    for _ in range(most):
        for i, p in enumerate(keys):
            arcs[p].append(flow.arc(0, 2 + i, patterns[p]))
        flow.run(0, 1)
    return {p: sum(flow.room[a ^ 1] for a in own) for p, own in arcs.items()}


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cut bucket of one pattern, in seeded order: the places taken, each document where it still fits."""
    pdf = pdf.sort_values(["place", "size"], kind="stable").reset_index(drop=True)
    room, taken = int(pdf["room"].iloc[0]), []
    for place, size, n in pdf[["place", "size", "n"]].itertuples(index=False):
        if size * n <= room:
            room -= size * n
            taken.append((place, size))
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "walked": [[{"place": p, "size": s} for p, s in taken]]})


def mix(docs: DataFrame, members: str = "array(source)", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11, bucket_docs: int = 500, max_patterns: int = 20_000) -> DataFrame:
    """``docs`` with size, source_size, target (both of its first source) and taken, the words the mix takes of the document.

    ``members`` is an SQL expression for the array of a document's sources. ``weights`` repeat over the sources in
    code-point order, null last. Targets share ``share`` times the total size, at most ``most`` times a source's size."""
    mixed = _mixed(docs, members, weights, share, most, seed, bucket_docs, max_patterns)
    own = ("size", "source_size", "target", "taken")
    return mixed.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in own], *own)


def _mixed(docs, members="array(source)", weights=(3, 1, 2), share=1.5, most=2, seed=11, bucket_docs=500, max_patterns=20_000) -> DataFrame:
    """``docs`` as a struct, whose column names cannot clash, beside size, source_size, target and taken."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sources = F.expr(f"transform(array_sort(array_distinct({members})), x -> cast(x as string))")
    place = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), size.alias("size"), F.to_json(sources).alias("key"), place.alias("place"))
    facts = Scratch(spark).save(rows.select("key", "size", "place"))

    found = facts.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    found = found.withColumn("sources", F.from_json("key", "array<string>")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r.sources): r["size"] for r in found}
    order = sorted({s for p in patterns for s in p}, key=by_code_point)
    sizes = dict.fromkeys(order, 0)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal = targets(sizes, weight, share * sum(patterns.values()), most)
    given = route(patterns, goal, most)

    info = []
    for r in found:
        p, n = tuple(r.sources), r["size"]
        first = p[0] if p else None
        wide = min(1024, max(1, r["docs"] // bucket_docs))
        info.append((r["key"], sizes.get(first, 0), float(goal.get(first, 0.0)), given[p] // n if n else 0, given[p] % n if n else 0, wide, min(1024, max(1, r["docs"] // (bucket_docs * wide)))))
    # One row a pattern, at most max_patterns: small enough to broadcast.
    table = spark.createDataFrame(info, "key string, source_size long, target double, full long, rest long, wide long, fine long")

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("b1", F.floor(F.col("place") * F.col("wide")))
        return df.withColumn("b2", F.floor((F.col("place") * F.col("wide") - F.col("b1")) * F.col("fine")))

    def cut(hist: DataFrame, bucket: str, room: str) -> DataFrame:
        """Each pattern's first bucket with which its room is exceeded, and the room left before it."""
        before = f"sum(size) over (partition by key order by {bucket}) - size"
        at = hist.withColumn("before", F.expr(before)).where(f"before <= {room} and before + size > {room}")
        return at.selectExpr("key", f"{bucket} as cut_{bucket}", f"{room} - before as left_{bucket}")

    slim = placed(facts.select("key", "size", "place").join(F.broadcast(table), "key"))
    # At most 1,024 histogram rows a pattern and level; one row a pattern comes back.
    c1 = cut(slim.groupBy("key", "b1", "rest").agg(F.sum("size").alias("size")), "b1", "rest")
    c1 = spark.createDataFrame(c1.collect(), c1.schema)
    slim = slim.join(F.broadcast(c1), "key").where("b1 = cut_b1")
    c2 = cut(slim.groupBy("key", "b2", "left_b1").agg(F.sum("size").alias("size")), "b2", "left_b1")
    c2 = spark.createDataFrame(c2.collect(), c2.schema)
    slim = slim.join(F.broadcast(c2), "key").where("b2 = cut_b2")
    bucket = slim.groupBy("key", "place", "size", F.col("left_b2").alias("room")).agg(F.count(F.lit(1)).alias("n"))
    walked = bucket.groupBy("key").applyInPandas(_walk, "key string, walked array<struct<place: double, size: long>>")

    # A pattern's row has the documents taken of one bucket, about bucket_docs of them.
    cuts = table.join(c1, "key", "left").join(c2, "key", "left").join(walked, "key", "left")
    rows = placed(rows.join(F.broadcast(cuts), "key"))
    # Where nothing is exceeded the rest is 0 or the pattern is empty; then no document is taken once more.
    more = F.expr("""case when cut_b1 is null or b1 > cut_b1 then 0 when b1 < cut_b1 then 1 when cut_b2 is null or b2 < cut_b2 then 1
        when b2 > cut_b2 then 0 else cast(array_contains(walked, struct(place, size)) as int) end""")
    return rows.select("doc", "size", "source_size", "target", (F.col("size") * (F.col("full") + more)).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document in as many rows as it is used, none if it is not."""
    mixed = _mixed(docs, **options).where("taken > 0")
    return mixed.select("doc", F.explode(F.expr("sequence(1, cast(taken div size as int))")).alias("use")).select("doc.*")


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def source_mix_overlap(spark, sf_dir: str) -> DataFrame:
    """The mix over texts that stand under several sources: equal texts are one document, the one with the smallest id, which is
    a member of all their sources, and the flow says which of these it serves. doc_id, sources, size, target and taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    alike = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.collect_set(F.coalesce("source", F.lit("(none)"))).alias("sources"))
    texts = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).join(alike, "doc_id").select("doc_id", "text", "sources")
    return mix(texts, members="sources").select("doc_id", F.array_join(F.array_sort("sources"), "|").alias("sources"), "size", "target", "taken")
