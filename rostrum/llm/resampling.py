"""Target-distribution importance resampling: hashed n-gram features, array-scored weights, and a cut-off by numeric bisection.

Features are runs of one to three consecutive words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. Bucket counts of
corpus and target are arrays of fixed length, and so are the gains made of them; a document's weight is a sum of gains,
read from that array in Arrow batches. The draw is by weight plus seeded Gumbel noise. Scores are persisted once in a
narrow table; the place where the draw ends is found by count jobs over it, each of which halves the range of the score four times over,
then of the document's id among those tied at the score, then of the row's own number among rows alike in both. Only
drawn rows are range-partitioned by rank; the others are never sorted or joined.

Defined cases: a null text has no words; a null document id draws the noise of an empty id and comes last among ties; rows alike in
id are rows of their own; without target or documents all gains follow from empty counts; texts of any length are read whole; an
empty table gives an empty table; other columns, whatever their names, are ignored.
"""
import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch, text_slices
from rostrum.llm._words import BETWEEN, LOWER, Words

#: Buckets, longest run, words of a document that may be drawn, seed of the noise, and the share drawn in hundredths.
BUCKETS, LONGEST, LEAST_WORDS, SEED, PERCENT = 10_000, 3, 20, 42, 5
#: Thresholds that one count job tries: 15 halve a range four times.
TRIES = 15
FULL = np.uint32(0xFFFFFFFF)
#: Bytes of a word beyond which zlib reads it alone.
SHORT = 48
LAST_ID = (1 << 63) - 1


def _table() -> np.ndarray:
    """Registers of single bytes, by the rule of CRC-32 (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _table()


class Features:
    """CRC-32 values of all runs of words of a slice of texts; ``crc[k][i]`` is that of the k + 1 words up to word i, where ``there[k][i]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.words = w = Words(self.data, offsets, BETWEEN)
        size = w.end - w.start
        order = np.argsort(-size, kind="stable")
        self.long = order[: np.searchsorted(-size[order], -SHORT)]
        self.order = order[len(self.long) :]
        sizes = size[self.order]
        # How many of the short ones, longest first, have an i-th byte.
        self.live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0))
        state = self._extend(np.full(len(size), FULL))
        there = np.ones(len(size), bool)
        self.crc, self.there = [state ^ FULL], [there]
        for _ in range(LONGEST - 1):
            before = np.full(len(size), FULL)
            before[1:] = state[:-1]
            state = self._extend(_CRC[(before ^ np.uint32(32)) & np.uint32(255)] ^ (before >> np.uint32(8)))
            run = np.zeros(len(size), bool)
            run[1:] = there[:-1] & (w.text[1:] == w.text[:-1])
            there = run
            self.crc.append(state ^ FULL)
            self.there.append(there)

    def _extend(self, state: np.ndarray) -> np.ndarray:
        """Each word's register after its bytes, from the register before it."""
        w, state = self.words, state.copy()
        at, own = w.start[self.order], state[self.order]
        for i, n in enumerate(self.live):
            s = own[:n]
            own[:n] = _CRC[(s ^ self.data[at[:n] + i]) & np.uint32(255)] ^ (s >> np.uint32(8))
        state[self.order] = own
        for i in self.long:
            state[i] = zlib.crc32(self.data[w.start[i] : w.end[i]].tobytes(), int(state[i] ^ FULL)) ^ 0xFFFFFFFF
        return state

    def buckets(self, buckets: int) -> list[np.ndarray]:
        return [(c % np.uint32(buckets)).astype(np.int64) for c in self.crc]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts (column text): an array of fixed length, whatever the size of the table."""
    Scratch(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                f = Features(data, offsets)
                for b, there in zip(f.buckets(buckets), f.there):
                    total += np.bincount(b[there], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = texts.selectExpr("cast(text as string) text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log odds of each bucket in the target against the corpus, one added to each count, rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(corpus, target)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    Scratch(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                f = Features(data, offsets)
                w = f.words
                each = np.zeros(len(w.start), np.int64)
                for b, there in zip(f.buckets(len(gain)), f.there):
                    each += np.where(there, gain[b], 0)
                total = np.concatenate([[0], np.cumsum(each)])[w.first]
                n = w.counts
                features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, pa.int64()) for x in (n, features, np.diff(total)))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times seeded Gumbel noise, rounded down: of the first 32 bits of the SHA-256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def first_rows(rows: DataFrame, keys: list[Column], k: int) -> Column | None:
    """The predicate of the ``k`` first of ``rows`` in ascending order of the long ``keys``, which together tell rows apart; None for none.

    Each key's threshold is found by count jobs; no row is sorted."""
    if k <= 0:
        return None
    found, tied = F.lit(False), F.lit(True)
    for key in keys:
        low, high, n = rows.where(tied).agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n <= k:  # all that are tied so far
            return found | tied
        below = 0  # tied rows whose key is under low
        while low < high:
            tries = sorted({low + (high - low) * i // (TRIES + 1) for i in range(1, TRIES + 1)})
            counts = rows.where(tied & (key >= low)).agg(*[F.count_if(key <= t) for t in tries]).first()
            enough = next((i for i, c in enumerate(counts) if below + c >= k), len(tries))
            if enough < len(tries):
                high = tries[enough]
            if enough:
                low, below = tries[enough - 1] + 1, below + counts[enough - 1]
        found, tied, k = found | (tied & (key < low)), tied & (key == low), k - below
    return found | tied


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document, towards the texts of ``target``."""
    scratch = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = weighted(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    may = rows.where(F.col("n_words") >= least)
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(LAST_ID)), F.col("row")]
    chosen = first_rows(may, keys, percent * may.count() // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    if chosen is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    chosen = (F.col("n_words") >= least) & chosen
    rest = rows.where(~chosen).select(*out, F.lit(None).cast("long").alias("rank"))
    ordered = rows.where(chosen).withColumns({f"k{i}": k for i, k in enumerate(keys)}).repartitionByRange("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2")
    # The number that Spark gives counts rows within a partition, beside the partition's own number in its upper bits.
    ordered = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()).select(*out, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())  # a row a partition
    before = docs.sparkSession.createDataFrame([(p, b) for (p, n), b in zip(sizes, accumulate((n for _, n in sizes), initial=0))], "part long, before long")
    ranked = ordered.join(F.broadcast(before), "part").select(*out, (F.col("before") + F.col("place") + 1).alias("rank"))
    return rest.unionByName(ranked)


def op12_importance_draw(spark, sf_dir: str) -> DataFrame:
    return drawn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    """CRC-32 goes by half bytes, the lower one first, over each distinct feature."""
    nibbles = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ 0xEDB88320 if i & 1 else i >> 1
        nibbles.append(i)
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "(select {0}, array_to_string(ws[i:i + n - 1], ' ') as g from {1}, (values (1), (2), (3)) t(n), unnest(range(1, len(ws) - n + 2)) u(i))"
    half = "strpos('0123456789ABCDEF', substr(hex(encode(g)), 2 * k + {}, 1)) - 1"
    return f"""with d as (select row_number() over () as d, doc_id, {words} as ws from documents), b as (select {words} as ws from benchmark),
df as {runs.format('d', 'd')}, bf as {runs.format('1 as one', 'b')},
c as (select g, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(0, length(hex(encode(g))) // 2), lambda k: [{half.format(2)}, {half.format(1)}]))), lambda s, x: xor(s >> 4, {nibbles}[(xor(s, x) & 15) + 1])), 4294967295) % {BUCKETS} as bucket
  from (select g from df union select g from bf)),
s as (select bucket, count(*) as n from df join c using (g) group by bucket), t as (select bucket, count(*) as n from bf join c using (g) group by bucket),
gain as (select bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((select count(*) from df) + {BUCKETS}))::double / ((coalesce(s.n, 0) + 1) * ((select count(*) from bf) + {BUCKETS}))))::bigint as gain from (select distinct bucket from c) left join s using (bucket) left join t using (bucket)),
w as (select d, sum(gain)::bigint as weight, count(*) as n_features from df join c using (g) join gain using (bucket) group by d),
x as (select doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, list_reduce(list_transform(range(1, 9), lambda k: strpos('0123456789abcdef', substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), k, 1)) - 1), lambda a, n: a * 16 + n)::bigint as h from d left join w using (d)),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from x),
z as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id) as r, (select {PERCENT} * count(*) // 100 from y where n_words >= {LEAST_WORDS}) as k from y)
select doc_id, n_features, weight, score, case when n_words >= {LEAST_WORDS} and r <= k then r end as rank from z"""


OP12_SQL = _sql()
