"""MinHash near-duplicates: a chosen-path set similarity join.

A text's set is its distinct k-word shingles, as 64-bit hashes. Texts with equal sets form a class; everything below
works on classes. A class has ``COORDS`` minwise tokens. In each of ``trees`` independent trees a node picks one of the
coordinates, or two in one case of four (1 / threshold on average), by a hash of its path, and its members branch by
the tokens they have there. Two sets of similarity s stay together along a branch with probability s, so that
similar ones share some node deep down in some tree while the others part within a few levels.

The number of trees follows from the share of pairs that may be missed (``trees_for``).

- A node of at most ``leaf`` members is compared exhaustively.
- A larger one is branched further; rows stay in proportion to the documents.
- A node that is still large at the last depth holds sets that are much alike. Its members are compared with one of
  them, another in each node; then, once components are known, members outside the node's largest component are compared with all others in
  blocks, where only pairs of different components are looked at and only one link of two components is written.

Candidates must agree in enough coordinates (far below the threshold's expectation) and every link is confirmed on the
full sets, recomputed from the texts. Candidates within one component need no confirmation, so each class's likeliest
candidate is confirmed first, and then those that still lie across components.

Trees share the 128 coordinates and are not quite independent: with 12 trees a pair at 0.8 exactly that shares no other path
to its component is missed with probability 2e-5 where it meets in nodes of the first depth and 3e-3 at the last; at 0.9 with 3e-8 and 6e-6.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer than k words
has its whole word sequence as its only shingle; a component's id is its smallest non-null doc_id, null if it has none;
repeated rows are members of one class; texts of any length are read whole; an empty table gives an empty table; other columns,
whatever their names, are ignored by ``near_dups`` and kept by ``drop_near_dups``.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch, free_names, spread, text_slices
from rostrum.llm._words import LOWER, U, Words, mix, run_sums, runs
from rostrum.llm.components import components

COORDS = 128
#: Blocks of outside members that one task compares with a node's others.
TOGETHER = 8
_MUL = mix(np.arange(1, COORDS + 1, dtype=U)) | U(1)
_ADD = mix(np.arange(1001, COORDS + 1001, dtype=U))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and each text's range among them."""
    words = Words(LOWER[data], offsets)
    n = np.maximum(words.counts - k + 1, (words.counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    at = words.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    h = runs(run_sums(words.hashes()), at, np.minimum(at + k, words.first[1:][text]))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    raw = np.ascontiguousarray(rows).tobytes()
    width = len(raw) // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _facts(k: int, seed: int):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                h, first = shingle_sets(data, offsets, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                least = np.zeros((len(n), COORDS), np.uint32)
                if len(h):
                    for i in range(COORDS):
                        least[full, i] = np.minimum.reduceat(((h * _MUL[i] + _ADD[i]) >> U(32)).astype(np.uint32), first[:-1][full])
                a, b = (_sums(mix(h + U(s)), first).view(np.int64) for s in (2 * seed + 1, 2 * seed + 2))
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(n, pa.int64()), pa.array(a), pa.array(b), _binary(least)], ["row_key", "doc_id", "n", "cls", "check", "least"])

    return run


def trees_for(pct: int, depth: int, miss: float) -> int:
    """How many trees it takes until a pair of that similarity shares no node at ``depth`` with probability ``miss`` at most.

    A pair stays together along a branch with its similarity s, and one node in four has two branches, so the probability of having
    parted in a tree follows level by level. Trees count as independent; that they share coordinates makes misses about three times as many."""
    s, apart = pct / 100, 0.0
    for _ in range(depth):
        one = 1 - s + s * apart
        apart = 0.75 * one + 0.25 * one * one
    return math.ceil(math.log(miss) / math.log(apart))


def grow(least: np.ndarray, member: np.ndarray, path: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes ``levels`` below the given ones: (member, path)."""
    for _ in range(levels):
        pick = mix(path ^ U(0x51ED270B))
        one = (pick % U(COORDS)).astype(np.int64)
        two = (one + 1 + ((pick >> U(16)) % U(COORDS - 1)).astype(np.int64)) % COORDS
        fork = (pick >> U(40)) & U(3) == 0
        member = np.concatenate([member, member[fork]])
        path = np.concatenate([path, path[fork]])
        coord = np.concatenate([one, two[fork]])
        path = mix(path ^ mix(least[member, coord].astype(U) | coord.astype(U) << U(32)))
    return member, path


def _nodes(levels: int, trees: int):
    """Rows (cls, n, least[, paths]) to rows (node, cls, n)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rows = batch.slice(i, 2000)
                least = _matrix(rows.column(2), np.uint32)
                if rows.num_columns > 3:
                    paths = rows.column(3)
                    member = np.repeat(np.arange(len(least)), np.diff(paths.offsets.to_numpy()))
                    path = paths.flatten().to_numpy().view(U)
                else:
                    member = np.repeat(np.arange(len(least)), trees)
                    path = np.tile(mix(np.arange(1, trees + 1, dtype=U)), len(least))
                member, path = grow(least, member, path, levels)
                take = pa.array(member)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), rows.column(0).take(take), rows.column(1).take(take)], ["node", "cls", "n"])

    return run


def _alike(agree: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2), np.uint8) == _matrix(batch.column(3), np.uint8)).sum(1)
                keep = pa.array(same >= agree)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(same[same >= agree], pa.int32())], ["a", "b", "same"])

    return run


def linked(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= pct * (len(x) + len(y) - both)


def _confirm(pct: int):
    def run(batches):
        for batch in batches:
            sets = [[np.frombuffer(v, U) for v in batch.column(c).to_pylist()] for c in (2, 3)]
            keep = pa.array([linked(x, y, pct) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def shared_tokens(x: list, y: list, width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of the sets of two blocks, as a matrix product over the tokens that both blocks have."""
    sizes = [np.array([len(s) for s in side]) for side in (x, y)]
    flat = [np.concatenate(side) for side in (x, y)]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    tokens = np.intersect1d(*flat)
    place = []
    for f, o in zip(flat, owner):
        at = np.minimum(np.searchsorted(tokens, f), len(tokens) - 1) if len(tokens) else np.zeros(0, np.int64)
        ok = tokens[at] == f if len(tokens) else np.zeros(0, bool)
        place.append((at[ok], o[: len(ok)][ok] if len(ok) else o[:0]))
    out = np.zeros((len(x), len(y)))
    for lo in range(0, len(tokens), width):
        sides = []
        for (at, o), n in zip(place, (len(x), len(y))):
            m = np.zeros((n, min(width, len(tokens) - lo)), np.float32)
            own = (at >= lo) & (at < lo + width)
            m[o[own], at[own] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _across(pct: int):
    """Pairs of blocks to links of different components, one for each two components of a pair of blocks."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values for c in (0, 1))
                sets = [[np.frombuffer(h, U) for h in m.field("hashes").to_pylist()] for m in (x, y)]
                both = shared_tokens(*sets)
                n = [np.array([len(h) for h in side]) for side in sets]
                root = [m.field("root").to_numpy() for m in (x, y)]
                hit = (100 * both >= pct * (n[0][:, None] + n[1][None, :] - both)) & (root[0][:, None] != root[1][None, :])
                r, c = np.nonzero(hit)
                _, first = np.unique(np.stack([root[0][r], root[1][c]]), axis=1, return_index=True)
                a.append(x.field("cls").to_numpy()[r[first]])
                b.append(y.field("cls").to_numpy()[c[first]])
            flat = [pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (a, b)]
            yield pa.RecordBatch.from_arrays(flat, ["a", "b"])

    return run


def near_dups(docs: DataFrame, k: int = 5, pct: int = 80, miss: float = 1e-3, depths: tuple = (3, 5, 7), leaf: int = 16, block: int = 64) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id, kept (doc_id is the component's) of every row of ``docs`` (doc_id, text).

    Sets of k-word shingles are linked where their Jaccard similarity is ``pct`` percent at least; of pairs at ``pct`` exactly
    that meet at the last depth only, the share ``miss`` may be missed, see ``trees_for``."""
    scratch, trees = Scratch(docs.sparkSession), trees_for(pct, depths[-1], miss)
    rows = docs.selectExpr("xxhash64(doc_id is null, doc_id, text) row_key", "cast(doc_id as bigint) doc_id", "cast(text as string) text")
    seed = 0
    while True:
        facts = scratch.save(spread(rows).mapInArrow(_facts(k, seed), "row_key long, doc_id long, n long, cls long, check long, least binary"))
        per = facts.where("n > 0").groupBy("cls").agg(F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n"), F.min("row_key").alias("row_key"))
        per = scratch.save(per)
        if not per.where("c0 <> c1").limit(1).count():
            break
        seed += 1  # two different sets of one class id: other ids
        scratch.drop(facts, per)
    # One row a class has the class's tokens: the one with its smallest row key.
    firsts = facts.where("n > 0").select("cls", "row_key", "least").join(per.select("cls", "row_key", "n"), ["cls", "row_key"]).dropDuplicates(["cls"])
    classes = scratch.save(firsts.select("cls", "n", "least").mapInArrow(_with_sketch, "cls long, n long, least binary, sketch binary"))

    n = per.count()  # of classes; what follows has a few rows for each
    # A class's sets may differ in size by the threshold at most.
    fits = f"100 * least(x.n, y.n) >= {pct} * greatest(x.n, y.n)"
    found, dense, above = [], None, None
    for i, depth in enumerate(depths):
        if i:
            paths = above.groupBy("cls").agg(F.collect_list("node").alias("paths"))  # at most trees * 2 ** depth
            start = classes.join(paths, "cls").select("cls", "n", "least", "paths")
        else:
            start = classes.select("cls", "n", "least")
        nodes = scratch.save(start.mapInArrow(_nodes(depth - (depths[i - 1] if i else 0), trees), "node long, cls long, n long"), 25 * n)
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min_by("cls", F.xxhash64("node", "cls")).alias("first")).where("size > 1")
        shared = scratch.save(nodes.join(sizes, "node"), 10 * n)
        small = shared.where(F.col("size") <= leaf).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("m"))
        pairs = small.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {leaf}), y -> {fits}), y -> struct(x.cls as a, y.cls as b))))")).alias("p")).select("p.a", "p.b")
        found.append(scratch.save(pairs.where("a <> b").distinct(), 4 * n))
        above = shared.where(F.col("size") > leaf)
        scratch.drop(nodes)
    dense = above.select("node", "cls", "first", "size")
    found.append(dense.where("cls <> first").selectExpr("least(cls, first) a", "greatest(cls, first) b"))

    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionAll(f)
    # Agreements of a pair at the threshold: their mean less 4.5 deviations.
    s = pct / 100
    agree = int(COORDS * s - 4.5 * (COORDS * s * (1 - s)) ** 0.5)
    sketch = classes.select("cls", "sketch")
    sides = pairs.distinct().join(sketch.selectExpr("cls as a", "sketch as sa"), "a").join(sketch.selectExpr("cls as b", "sketch as sb"), "b")
    likely = scratch.save(sides.select("a", "b", "sa", "sb").mapInArrow(_alike(agree), "a long, b long, same int"), 4 * n)

    needed = likely.selectExpr("a as cls").unionAll(likely.selectExpr("b as cls")).unionAll(dense.select("cls")).distinct()
    needed = scratch.save(per.join(needed, "cls").select("row_key", "cls"), n)
    # Merged at every size, so that small tables are read by the plan of large ones.
    sets = rows.select("row_key", "text").join(needed.hint("merge"), "row_key").select("cls", "text").mapInArrow(_sets(k), "cls long, hashes binary")
    sets = scratch.save(sets.groupBy("cls").agg(F.first("hashes").alias("hashes")), 4 * n)

    def confirm(pairs: DataFrame) -> DataFrame:
        full = pairs.select("a", "b").join(sets.selectExpr("cls as a", "hashes as ha"), "a").join(sets.selectExpr("cls as b", "hashes as hb"), "b")
        return scratch.save(full.select("a", "b", "ha", "hb").mapInArrow(_confirm(pct), "a long, b long"), 4 * n)

    both = likely.unionAll(likely.selectExpr("b as a", "a as b", "same"))
    best = both.groupBy("a").agg(F.max(F.struct("same", "b")).alias("m")).selectExpr("least(a, m.b) a", "greatest(a, m.b) b").distinct()
    best = scratch.save(best, n)
    links = confirm(best)
    roots = scratch.save(components(scratch, links, rows=4 * n), n)

    def rooted(pairs: DataFrame, col: str) -> DataFrame:
        return pairs.join(roots.selectExpr(f"node as {col}", f"root as root_{col}"), col, "left").withColumn(f"root_{col}", F.coalesce(f"root_{col}", col))

    rest = rooted(rooted(likely.join(best, ["a", "b"], "left_anti"), "a"), "b").where("root_a <> root_b")
    more = confirm(rest)
    links = links.unionAll(more)
    if more.limit(1).count():
        roots = scratch.save(components(scratch, links, rows=4 * n), n)

    # Large last nodes of several components: members outside the largest one against all members, in blocks.
    inside = scratch.save(rooted(dense.selectExpr("node", "cls as a", "size"), "a").selectExpr("node", "a as cls", "root_a as root", "size"), 10 * n)
    per_root = inside.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = per_root.groupBy("node").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    largest = scratch.save(largest, n)
    if largest.limit(1).count():
        mixed = inside.join(largest, "node").join(sets, "cls")
        mixed = mixed.withColumn("blk", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / block)))

        def blocks(part: DataFrame, name: str) -> DataFrame:
            return part.groupBy("node", "blk").agg(F.collect_list(F.struct("cls", "root", "hashes")).alias(name))

        mixed = scratch.save(mixed.select("node", "cls", "root", "main", "hashes", "blk"), 10 * n)
        # A node's outside blocks are dealt to groups, each a key of its own, and its blocks go to every group.
        outside = blocks(mixed.where("root <> main"), "x").withColumn("g", F.expr(f"blk div {TOGETHER}"))
        every = blocks(mixed, "y").drop("blk").join(outside.select("node", "g").distinct(), "node")
        across = outside.join(every, ["node", "g"]).select("x", "y")
        last = scratch.save(across.mapInArrow(_across(pct), "a long, b long"))
        if last.limit(1).count():
            roots = scratch.save(components(scratch, links.unionAll(last), rows=4 * n), n)

    ids = facts.select("row_key", "doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("a"))
    own = rooted(per.selectExpr("cls as a"), "a")
    least = facts.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    of_root = own.join(least, own.a == least.cls).groupBy("root_a").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.save(own.join(of_root, "root_a").select("a", "component_id"), n)
    out = ids.join(of_class, "a", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("row_key", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_sketch(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(_matrix(batch.column(2), np.uint32).astype(np.uint8))], ["cls", "n", "least", "sketch"])


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                h, first = shingle_sets(data, offsets, k)
                out = [h[first[i] : first[i + 1]].tobytes() for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.binary())], ["cls", "hashes"])

    return run


def drop_near_dups(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates: one with the component's id; texts without words all stay."""
    (key,) = free_names(docs, "row_key")
    keep = near_dups(docs, **options).where("kept").select(F.col("row_key").alias(key)).distinct()
    kept = docs.withColumn(key, F.expr("xxhash64(doc_id is null, doc_id, text)")).join(keep, key, "left_semi")
    # Rows alike in id and text are copies of each other.
    return kept.dropDuplicates([key]).select(*docs.columns)


def op7_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2).drop("row_key")


OP7_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM base WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM pos),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
  FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM base
  UNION
  SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.a)
SELECT b.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id, b.doc_id = min(r) AS kept
FROM base b LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = b.doc_id GROUP BY b.doc_id, n.n
"""
