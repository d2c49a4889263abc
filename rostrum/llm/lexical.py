"""Ranked lexical search with the Best Position Algorithm.

Two passes. The first reads the texts and keeps, of every document with a term, its number of terms and how often it holds each
term that some query asks for: one narrow row a document. From these come the corpus's counts. The second searches those rows in
shards, each within one task and of bounded size: a shard has for each term the documents by falling impact, read from the top in
growing blocks, and an index of the same entries by document. Each document met is looked up at once in all lists of the
query, which marks its positions there as seen; a list's best position is the last one up to which all are seen.
What no document has been seen at comes after the best positions, so the sum of impacts there bounds all documents unseen; the search stops
when that bound is strictly below the k-th score. A task carries each query's k best documents, and so its threshold, from shard to
shard. The tasks' best are merged by one ranking of k rows a task and query.

Query terms are known to the tasks by two 64-bit hashes. Queries are taken in blocks of about ``BLOCK_TERMS`` terms, each a pass of
its own, so that what is broadcast is bounded whatever their number.

Defined cases: null texts have no terms and find nothing; rows alike in document id are documents of their own, and so are rows alike in
item id searches; a null id comes last among equal scores; texts are read whole; empty tables give an empty table; other columns,
whatever their names, are ignored.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch, text_slices
from rostrum.llm._words import BETWEEN, LOWER, Words, mix, stretch, sums

#: Fixed values of the score: documents a query, and the weight of a document's length in hundredths.
BEST, BY_LENGTH = 10, 90
#: Terms of the queries of one pass; entries of a shard; positions of a list in the first block.
BLOCK_TERMS, SHARD, FIRST = 1 << 20, 2_000_000, 32
_R, _S = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25
LAST_ID = (1 << 63) - 1


class Terms:
    """Terms of a slice of texts, in lower case, with a first hash each; a second is for terms that a first one finds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.words = Words(self.data, offsets, BETWEEN)
        self.first = self._hash(_R, slice(None))

    def _hash(self, base: int, which) -> np.ndarray:
        return stretch(sums(mix(self.data.astype(np.uint64) + np.uint64(base & 0xFFFF)), base), base, self.words.start[which], self.words.end[which])

    def second(self, which) -> np.ndarray:
        return self._hash(_S, which)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and the two hashes of each distinct term, as arrays."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                t = Terms(data, offsets)
                both = np.stack([t.first, t.second(slice(None))]).view(np.int64)
                ends = t.words.first
                parts = [np.unique(both[:, a:b], axis=1) for a, b in zip(ends, ends[1:])]
                columns = [rows.column(0), *(pa.array([p[i] for p in parts], pa.list_(pa.int64())) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "first", "second"])

    return items.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").mapInArrow(run, "item_id long, first array<long>, second array<long>")


class Queries:
    """Queries of one block: ids, distinct terms by rising first hash, and each query's terms by their numbers."""

    def __init__(self, rows: list):
        self.ids = [r.item_id for r in rows]
        pairs = sorted({(a, b) for r in rows for a, b in zip(r["first"], r["second"])}, key=lambda p: (p[0] % (1 << 64), p[1]))
        number = {p: i for i, p in enumerate(pairs)}
        self.first, self.second = (np.array([p[i] for p in pairs], np.int64).view(np.uint64) for i in (0, 1))
        self.terms = [np.array(sorted(number[p] for p in zip(r["first"], r["second"])), np.int64) for r in rows]

    def find(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that some query asks for, and the terms' numbers."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.first, t.first)
        at[at == len(self.first)] = 0
        place = np.flatnonzero(self.first[at] == t.first)
        at, second = at[place], t.second(place)
        # Terms alike in the first hash stand side by side; nearly always there is one.
        while True:
            other = (self.second[at] != second) & (at + 1 < len(self.first))
            other[other] = self.first[at[other] + 1] == self.first[at[other]]
            if not other.any():
                break
            at[other] += 1
        same = self.second[at] == second
        return place[same], at[same]


def entries(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n (terms of the document), and the queries' terms in it with their counts, of every document with a term."""

    def run(batches):
        queries = shared.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                t = Terms(data, offsets)
                place, term = queries.find(t)
                key, tf = np.unique(t.words.text[place] * max(len(queries.first), 1) + term, return_counts=True)
                doc, term = np.divmod(key, max(len(queries.first), 1))
                ends = np.searchsorted(doc, np.arange(len(rows) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind)) for x, kind in ((term, pa.int32()), (tf, pa.int64()))]
                out = pa.RecordBatch.from_arrays([rows.column(0), pa.array(t.words.counts, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(t.words.counts > 0))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weights(terms: int, df: dict, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(terms)], np.int64)


class Shard:
    """Impact lists of the documents of one shard. ``best[q]`` is a query's best so far, of earlier shards of the task too."""

    def __init__(self, ids, lengths, counts, term, tf, n_docs: int, n_terms: int, vocabulary: int):
        doc = np.repeat(np.arange(len(ids)), counts)
        m = 100 - BY_LENGTH + (BY_LENGTH * lengths * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.ids, self.docs = ids, len(ids)
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, sorted_term = doc[order], impact[order], term[order]
        self.at = np.searchsorted(sorted_term, np.arange(vocabulary + 1))
        key = sorted_term * self.docs + self.doc
        by_doc = np.argsort(key)
        self.key, self.place = key[by_doc], by_doc

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, best: tuple) -> tuple:
        """The k best (scores, ids) of ``best`` and this shard: falling scores, rising ids among equals."""
        terms = terms[(self.at[terms + 1] > self.at[terms]) & (weight[terms] > 0)]
        if not len(terms):
            return best
        begin, end, weight = self.at[terms], self.at[terms + 1], weight[terms]
        met = np.zeros(self.docs, bool)
        seen = [np.zeros(e - b, bool) for b, e in zip(begin, end)]
        position = np.zeros(len(terms), np.int64)  # positions before it are all seen
        depth, step = 0, FIRST
        while True:
            block = np.concatenate([self.doc[b + depth : min(b + depth + step, e)] for b, e in zip(begin, end) if b + depth < e] or [self.doc[:0]])
            new = np.unique(block[~met[block]])
            met[new] = True
            score = np.zeros(len(new), np.int64)
            for i, t in enumerate(terms):  # direct access
                at = np.searchsorted(self.key, t * self.docs + new)
                hit = at < len(self.key)
                hit[hit] = self.key[at[hit]] == t * self.docs + new[hit]
                place = self.place[at[hit]]
                score[hit] += weight[i] * self.impact[place]
                seen[i][place - begin[i]] = True
                left = ~seen[i][position[i] :]
                step_on = int(left.argmax()) if len(left) else 0
                position[i] += step_on if len(left) and left[step_on] else len(left)
            best = self._merged(best, score, self.ids[new], k)
            depth, step = depth + step, step * 2
            open_ = position < end - begin
            bound = int((weight[open_] * self.impact[(begin + position)[open_]]).sum())
            if not open_.any() or len(best[0]) == k and bound < best[0][-1]:
                return best

    @staticmethod
    def _merged(best: tuple, score, ids, k: int) -> tuple:
        good = score > 0
        if len(best[0]) == k:
            good &= score >= best[0][-1]
        if not good.any():
            return best
        score, ids = np.concatenate([best[0], score[good]]), np.concatenate([best[1], ids[good]])
        first = np.lexsort((ids, -score))[:k]
        return score[first], ids[first]


def _best_of_tasks(rows: DataFrame, shared, k: int, shard: int) -> DataFrame:
    """query, doc_id and score: each task's k best of each query."""

    def run(batches):
        queries, weight, n_docs, n_terms = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        held, size = [], 0

        def flush():
            ids, lengths, counts, term, tf = (np.concatenate(x) for x in zip(*held))
            s = Shard(ids, lengths, counts, term, tf, n_docs, n_terms, len(weight))
            for q, terms in enumerate(queries.terms):
                best[q] = s.search(terms, weight, k, best[q])

        for batch in batches:
            terms, tfs = batch.column(2), batch.column(3)
            ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            counts = terms.value_lengths().to_numpy(zero_copy_only=False)
            held.append((ids, batch.column(1).to_numpy(zero_copy_only=False), counts, terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False)))
            size += len(held[-1][3])
            if size >= shard:
                flush()
                held, size = [], 0
        if held:
            flush()
        q = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        score, ids = (np.concatenate([b[i] for b in best]) if best else np.zeros(0, np.int64) for i in (0, 1))
        ids = pa.array(ids, pa.int64(), mask=ids == LAST_ID)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids, pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query long, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents of every item with a score above 0."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = scratch.save(query_terms(items).withColumn("place", F.xxhash64("item_id", "first")))
    blocks = -(-(asked.agg(F.sum(F.size("first"))).first()[0] or 0) // block_terms) or 1
    out = None
    for b in range(blocks):
        queries = Queries(asked.where(F.pmod("place", F.lit(blocks)) == b).orderBy("item_id", "place").collect())
        found = scratch.save(entries(docs, spark.sparkContext.broadcast(queries)))
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # At most a row a term of the block.
        df = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        shared = spark.sparkContext.broadcast((queries, weights(len(queries.first), df, n_docs), n_docs, n_terms))
        best = _best_of_tasks(found.where(F.size("terms") > 0), shared, k, shard)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), "query long, item_id long")
        part = ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    return out


OP11_SQL = """with d as (select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents),
i as (select item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) as term from benchmark),
c as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as (select d, term, count(*) as tf from (select d, unnest(ts) as term from d) where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * any_value(c.n) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, c group by term),
s as (select item_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * c.n) // c.l))))::bigint as score
  from i join p using (term) join w using (term) join d using (d), c group by item_id, d)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s join d using (d) where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"""


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return top_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
