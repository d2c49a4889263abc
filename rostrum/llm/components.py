"""Connected components: each task contracts the edges it holds, large-star and small-star rounds do the rest.

A task contracts at most about ``PER_TASK`` edges by union-find, so that their number grows with the graph; a graph of one
task's size needs no shuffle, a larger one a round after each contraction until nothing changes.

Defined cases: edges with a null end and loops are left out; repeated edges and edges in both directions count once; an empty table
gives an empty table; other columns are ignored."""
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch

PER_TASK = 1 << 20


def _contract(batches):
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in list(parent) if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def components(scratch: Scratch, edges: DataFrame, per_task: int = PER_TASK, rows: int | None = None) -> DataFrame:
    """Of edges (a, b) of longs: node and root, the smallest node reachable; nodes without an edge are not listed.

    ``rows`` is about how many edges there are, if known. Neighbourhoods are only ever reduced to a minimum, never gathered, so hubs stay small."""
    e = scratch.save(edges.where("a <> b").selectExpr("a as u", "b as v"), rows)
    n, mark = e.count(), None
    while True:
        tasks = max(1, -(-n // per_task))
        own = scratch.save(e.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
        scratch.drop(e)
        if tasks == 1:
            e = own
            break
        both = own.unionAll(own.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("greatest(v, m) as u", "least(v, m) as v").where("u <> v").unionAll(low.selectExpr("u", "m as v"))
        e = scratch.save(small.distinct())
        scratch.drop(own)
        row = e.selectExpr("count(*) n", "bit_xor(xxhash64(u, v)) h").first()
        n = row.n
        if mark == (n, row.h):
            break
        mark = (n, row.h)
    return e.selectExpr("u as node", "v as root").unionAll(e.selectExpr("v as node", "v as root").distinct())
