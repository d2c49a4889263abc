"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, and greedy search on it.

Equal vectors are one node. The largest inner product becomes the nearest angle by one added component that brings
every vector to the same length, that of the longest but a hundredth; the longer ones get none. Nodes carry two bytes a component for
the graph and the search, each vector under its own scale; the results are scored in double precision on the original vectors.

- Start: a few random partitions of space by hyperplane signs, their cells split into blocks of bounded size, and
  within each block every node's nearest.
- Rounds: each node's neighbours and reverse neighbours (the nearest ``degree`` of each) are joined with their vectors and
  compared with each other at the node, as neighbours of neighbours; each keeps its ``degree`` nearest so far. Rounds
  end when under ``settled`` of the edges are new.
- Search: a query starts at its own node and at entry nodes, the longest and a seeded choice of the others. It repeatedly opens its
  nearest unopened nodes along both directions of the edges, keeping the ``beam`` nearest, until none of these is unopened.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; a
row repeated in full is one row; a query's own id is never its neighbour; shorter vectors are as if
filled up with zeros; ties go to the smaller id; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch

EDGE = "u long, v long, sim float"


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _binary(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


def _encode(dim: int, unit: float, cells: list, planes: int):
    """Rows (node, vector) to (node, code, one cell a partition).

    A code is a scale and what the added component lacks to 1, in lengths of ``unit``, and the components in 2 ** 15 steps of the largest."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _dense(batch.column(1), dim)
            most = np.abs(x).max(1)
            x = x / most[:, None]
            # Beyond a ratio of 1e15 to the unit, lengths count as alike; directions stay.
            scale = np.exp(np.clip(np.log(most) - math.log(unit), -34.5, 34.5))
            square = np.minimum((x * x).sum(1) * scale * scale, 1)
            lack = square / (1 + np.sqrt(1 - square))
            head = np.column_stack([scale / 32767, lack]).astype(np.float32).view(np.uint8)
            code = np.hstack([head, np.rint(x * 32767).astype(np.int16).view(np.uint8)])
            keys = []
            for c in cells:
                h = np.random.default_rng(c).standard_normal((dim, planes))
                keys.append(((x @ h) > 0) @ (1 << np.arange(planes)))
            keys = np.array(keys, np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(code), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "code", "cells"])

    return run


def _decode(codes: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in units, and what their added components lack to 1."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    head = raw[:, :8].copy().view(np.float32)
    return raw[:, 8:].copy().view(np.int16) * head[:, :1], head[:, 1]


def _nearest_within(keep: int):
    """Blocks of (node, code, floor) to each member's ``keep`` nearest others above its floor, as edges."""

    def run(batches):
        for batch in batches:
            us, vs, sims = [], [], []
            for members in batch.column(0):
                m = members.values
                if len(m) < 2:
                    continue
                ids = m.field("node").to_numpy()
                x, lack = _decode(m.field("code").to_pylist())
                # The inner product with the added component, less 1: exact for short vectors too.
                s = x @ x.T + np.outer(lack, lack) - lack[:, None] - lack
                np.fill_diagonal(s, -np.inf)
                k = min(keep, len(ids) - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(s, best, 1)
                ok = got > m.field("floor").to_numpy()[:, None]
                us.append(np.repeat(ids, ok.sum(1)))
                vs.append(ids[best[ok]])
                sims.append(got[ok])
            join = lambda a, t: pa.array(np.concatenate(a) if a else [], t)
            yield pa.RecordBatch.from_arrays([join(us, pa.int64()), join(vs, pa.int64()), join(sims, pa.float32())], ["u", "v", "sim"])

    return run


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """(u, v, sim): each u's nearest; at most ``degree`` from each of a few partitions of space come in."""
    best = edges.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "v")), False), 1, degree).alias("n"))
    return best.select("u", F.explode("n").alias("e")).select("u", "e.v", "e.sim")


def _most(edges: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` edges of each key, by nearness; a hub's surplus is dropped before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc("sim"), "u", "v")
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


class Graph:
    def __init__(self, scratch: Scratch, nodes: DataFrame, count: int, degree: int, partitions: int, block: int, rounds: int, settled: float):
        self.scratch, self.nodes = scratch, nodes
        cells = nodes.select("node", "code", F.posexplode("cells").alias("part", "cell"))
        sizes = cells.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("split"))
        cells = cells.join(sizes, ["part", "cell"]).withColumn("sub", F.pmod(F.xxhash64("node", "part"), F.col("split")))
        low = F.lit(float("-inf")).cast("float")
        blocks = cells.groupBy("part", "cell", "sub").agg(F.collect_list(F.struct("node", "code", low.alias("floor"))).alias("m")).select("m")
        edges = scratch.save(_nearest(blocks.mapInArrow(_nearest_within(degree), EDGE), degree))
        for _ in range(rounds):
            floor = edges.groupBy("u").agg(F.min("sim").alias("floor"), F.count(F.lit(1)).alias("n"))
            floor = floor.select("u", F.when(F.col("n") >= degree, F.col("floor")).otherwise(low).alias("floor"))
            known = nodes.select("node", "code").join(floor, nodes.node == floor.u, "left").select("node", "code", F.coalesce("floor", low).alias("floor"))
            back = _most(edges, "v", degree)
            around = edges.select(F.col("u").alias("at"), F.col("v").alias("node")).unionAll(back.select(F.col("v").alias("at"), F.col("u").alias("node")))
            around = around.unionAll(nodes.select(F.col("node").alias("at"), "node")).distinct()
            # At most 2 * degree + 1 members a node.
            local = around.join(known, "node").groupBy("at").agg(F.collect_list(F.struct("node", "code", "floor")).alias("m")).select("m")
            found = local.mapInArrow(_nearest_within(12), EDGE)
            both = edges.withColumn("new", F.lit(0)).unionAll(found.withColumn("new", F.lit(1)))
            merged = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
            # Each task's nearest of a node come before the shuffle, so that a hub's many finds are never gathered.
            best = merged.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
            nxt = scratch.save(best.where(F.col("_r") <= degree).select("u", "v", "sim", "new"))
            fresh = nxt.agg(F.avg("new")).first()[0]
            scratch.drop(edges)
            del floor, known, back, around, local, found, both, merged, best
            scratch.release()
            edges = nxt.drop("new")
            edges.scratch_path = nxt.scratch_path
            if not fresh or fresh < settled:
                break
        both_ways = edges.select("u", "v", "sim").unionAll(_most(edges, "v", degree).select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).distinct()
        self.links = scratch.save(both_ways)


def _step(beam: int, wide: int, entries: list):
    """Rows (query, code, seen, met): scores what was met, keeps the nearest, and names what to open next.

    A query without ``seen`` begins: its own node counts as opened, the ``entries`` (node, code) as met.
    A node that fell out of the beam cannot return, as the beam only gets nearer; so every node is opened once at most."""
    entry_ids = [n for n, _ in entries]
    entry_vectors, _ = _decode([c for _, c in entries])

    def run(batches):
        for batch in batches:
            ids, out, ahead = [], [], []
            for q, code, seen, met in zip(*(c for c in batch.columns)):
                own = _decode([code.as_py()])[0][0]
                x = own / np.abs(own).max()  # a query's length changes no order
                if seen.is_valid:
                    have = {r["node"]: (r["sim"], r["open"]) for r in seen.as_py()}
                else:
                    have = {n: (s, False) for n, s in zip(entry_ids, np.einsum("ij,j->i", entry_vectors, x).tolist())}
                    have[q.as_py()] = (float(own @ x), True)
                m = met.values
                if m is not None and len(m):
                    near, _ = _decode(m.field("code").to_pylist())
                    # einsum scores a node alike in every batch, so that one that fell out stays out.
                    for node, s in zip(m.field("node").to_pylist(), np.einsum("ij,j->i", near, x).tolist()):
                        have.setdefault(node, (s, False))
                best = sorted(((s, n, o) for n, (s, o) in have.items()), key=lambda r: (-r[0], r[1]))[:beam]
                go = {n for _, n, o in [r for r in best if not r[2]][:wide]}
                ids.append(q.as_py())
                out.append([{"node": n, "sim": s, "open": o or n in go} for s, n, o in best])
                ahead.append(sorted(go))
            kind = pa.list_(pa.struct([("node", pa.int64()), ("sim", pa.float32()), ("open", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind), pa.array(ahead, pa.list_(pa.int64()))], ["query", "seen", "ahead"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, degree: int = 44, partitions: int = 3, block: int = 96, rounds: int = 8, settled: float = 0.01, beam: int = 160, wide: int = 32, entries: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id ``every`` divides, its ``k`` nearest by inner product."""
    scratch = Scratch(vectors.sparkSession)
    bad = "exists(e, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<double>) e").where(f"vec_id is not null and e is not null and not {bad} and exists(e, x -> x <> 0)")
    # -0.0 and 0.0 are one value.
    rows = rows.select("vec_id", F.expr("transform(e, x -> x + 0D)").alias("e"))
    firsts = rows.groupBy("e").agg(F.min("vec_id").alias("low"), F.xxhash64("e").alias("h"))
    # A node's number is unique: vectors that share their smallest id get numbers from their hash.
    lows = firsts.groupBy("low").agg(F.count(F.lit(1)).alias("same"))
    nodes = scratch.save(firsts.join(lows, "low").select(F.when(F.col("same") == 1, F.col("low")).otherwise(F.col("h")).alias("node"), "e"))
    most = "array_max(transform(e, x -> abs(x)))"
    length = f"{most} * sqrt(aggregate(zip_with(e, array_repeat({most}, size(e)), (x, m) -> x / m), 0D, (a, x) -> a + x * x))"
    dim, unit, count = nodes.selectExpr("max(size(e))", f"percentile_approx({length}, 0.99D, 10000)", "count(*)").first()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    planes = max(0, math.ceil(math.log2(max(1, count / block))))
    coded = scratch.save(nodes.mapInArrow(_encode(dim, unit, list(range(partitions)), planes), "node long, code binary, cells array<long>"))
    graph = Graph(scratch, coded, count, degree, partitions, block, rounds, settled)

    member = rows.join(nodes, "e").select("node", "vec_id").distinct()
    # The k + 1 smallest ids of a node are all that any query can need of it.
    member = member.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(f"r <= {k + 1}").drop("r")
    query = scratch.save(rows.where(f"vec_id % {every} = 0").join(nodes, "e").select("node", F.col("vec_id").alias("query_id")).distinct())
    # Queries of one vector are one search.
    asks = query.select("node").distinct()
    q_code = coded.select("node", "code").join(asks, "node").select(F.col("node").alias("query"), "code")
    q_code = scratch.save(q_code)
    longest_first = nodes.orderBy(F.expr(length).desc(), "node").limit(entries).select("node")
    seeded = nodes.orderBy(F.xxhash64("node"), "node").limit(entries).select("node")
    starts = [(r.node, bytes(r.code)) for r in coded.join(F.broadcast(longest_first.union(seeded).distinct()), "node").select("node", "code").collect()]
    kind = "array<struct<node: bigint, sim: float, open: boolean>>"
    state, ahead, found = None, asks.select(F.col("node").alias("query"), F.col("node").alias("u")), []
    while True:
        met = ahead.join(graph.links.select("u", "v"), "u").select("query", F.col("v").alias("node")).distinct()
        met = met.join(coded.select("node", "code"), "node").groupBy("query").agg(F.collect_list(F.struct("node", "code")).alias("met"))
        if state is None:
            step = q_code.join(met, "query", "left").withColumn("seen", F.expr(f"cast(null as {kind})"))
        else:
            step = q_code.join(state.where("size(ahead) > 0").select("query", "seen"), "query").join(met, "query", "left")
        last = state
        state = scratch.save(step.select("query", "code", "seen", "met").mapInArrow(_step(beam, wide, starts), f"query long, seen {kind}, ahead array<long>"))
        del met, step
        if last is not None:
            scratch.drop(last)
        scratch.release()
        at_end, going = state.selectExpr("count_if(size(ahead) = 0)", "count_if(size(ahead) > 0)").first()
        if at_end:
            found.append(scratch.save(state.where("size(ahead) = 0").select("query", F.explode("seen.node").alias("node"))))
        if not going:
            break
        ahead = state.select("query", F.explode("ahead").alias("u"))

    pairs = asks.select(F.col("node").alias("query"), "node")
    for f in found:
        pairs = pairs.unionAll(f)
    pairs = pairs.distinct()
    scored = pairs.join(nodes, "node").join(nodes.select(F.col("node").alias("query"), F.col("e").alias("q")), "query")
    dot = F.expr("aggregate(zip_with(e, q, (x, y) -> coalesce(x, 0D) * coalesce(y, 0D)), 0D, (a, x) -> a + x)")
    scored = scored.select("query", "node", dot.alias("score")).join(member, "node")
    named = scored.join(query.withColumnRenamed("node", "query"), "query").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
