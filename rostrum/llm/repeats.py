"""Repeated passages by sparse suffix arrays.

Of each text's suffixes only those at content-selected positions are kept: in every ``GAP`` neighbouring positions the one
whose next five words hash lowest. A passage of ``least`` words that two texts share has such a position among its
first ``GAP``, the same in both, with ``least - GAP + 1`` words (the stem) of the passage from there on.

1. Suffixes are reduced to their stem's hash; only stems of two different texts go on.
2. Those suffixes are sorted twice, by stem and the words that follow, and by stem and the words before, and neighbours are
   compared. A match is extended right and left word by word. Up to ``GAP - 1`` words each way are enough: a longer match
   has another kept suffix within that, whose match continues it.
3. A suffix that no neighbour confirms, or confirms less far than shorter matches reach, could agree partly left and partly
   right with a text further off in both orders. For the stems of such suffixes all windows of ``least`` words around the stem are counted exactly.

Texts with equal words form a class of copies; a class is handled once, and all of a copied text is a repeated passage.
Confirmed matches that overlap or touch are joined to spans.

Defined cases: a null text, or one of fewer than ``least`` words, has none; words are compared as written; rows alike in id and
text are copies of each other; a passage that occurs twice in one text only is not reported; texts of any length are read whole; an
empty table gives an empty table; other columns, whatever their names, are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch, text_slices
from rostrum.llm._words import U, Words, run_sums, runs

GAP = 16
#: A stem or window that many texts share is dealt to so many tasks.
SALTS = 16


def selected(words: Words, total: np.ndarray, least: int) -> np.ndarray:
    """Kept positions of all texts that have at least ``least`` words."""
    n, first = len(words.start), words.first[:-1]
    last = words.first[1:][words.text] if n else np.zeros(0, np.int64)
    at = np.arange(n)
    low = runs(total, at, np.minimum(at + 5, n))
    low[at + 5 > last] = ~U(0)
    if n < GAP:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(low, GAP)
    pick = view.argmin(1) + np.arange(len(view))
    begin = np.arange(len(view))
    ok = begin + least <= last[: len(view)]  # windows that start a passage within their text
    pick = np.unique(pick[ok])
    return pick[pick + least - GAP + 1 <= last[pick]]


def _suffixes(least: int):
    stem = least - GAP + 1

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                words = Words(data, offsets)
                total = run_sums(words.hashes())
                cls = runs(total, words.first[:-1], words.first[1:]).view(np.int64)
                at = selected(words, total, least)
                text = words.text[at] if len(at) else at
                begin = np.searchsorted(text, np.arange(rows.num_rows + 1)).astype(np.int32)
                stems = runs(total, at, at + stem).view(np.int64)
                pos = (at - words.first[:-1][text]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(v)) for v in (stems, pos)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(words.counts, pa.int64()), pa.array(cls, pa.int64()), *lists], ["row_key", "doc_id", "n", "cls", "stem", "pos"])

    return run


def _contexts(least: int):
    """Rows (cls, text, pos list) to suffixes with the hashes of the words after and before the stem, nearest first."""
    stem, side = least - GAP + 1, GAP - 1

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                words = Words(data, offsets)
                hashes = words.hashes()
                total = run_sums(hashes)
                short = np.append((hashes >> U(32)).astype(">u4"), np.zeros(1, ">u4"))
                lists = rows.column(2)
                text = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
                at = lists.flatten().to_numpy() + words.first[:-1][text]
                if not len(at):
                    continue
                after = at[:, None] + stem + np.arange(side)
                before = at[:, None] - 1 - np.arange(side)
                # Past a text's end stands 0, which no comparison takes as equal.
                right = np.where(after < words.first[1:][text][:, None], short[np.minimum(after, len(hashes))], 0).astype(">u4")
                left = np.where(before >= words.first[:-1][text][:, None], short[np.maximum(before, 0)], 0).astype(">u4")
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text)), pa.array(at - words.first[:-1][text], pa.int32()), pa.array(runs(total, at, at + stem).view(np.int64)), raw(right), raw(left)], ["cls", "pos", "stem", "right", "left"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal words of each row; 0 stands for none."""
    return np.cumprod((a == b) & (a != 0), axis=1).sum(1)


def _neighbours(batches):
    """Sorted suffixes to what each shares with the one before and after it: (cls, pos, l, r, other)."""
    side = GAP - 1
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, pos, stem = (batch.column(i).to_numpy() for i in range(3))
        right, left = (np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u4").reshape(-1, side) for i in (3, 4))
        own = (cls, pos, stem, right, left)
        if kept is not None:
            own = tuple(np.concatenate([k, v]) for k, v in zip(kept, own))
        kept = tuple(v[-1:] for v in own)
        cls, pos, stem, right, left = own
        i = np.flatnonzero((stem[1:] == stem[:-1]) & (cls[1:] != cls[:-1]))
        l, r = _common(left[i], left[i + 1]), _common(right[i], right[i + 1])
        both = [np.concatenate(v) for v in ((cls[i], cls[i + 1]), (pos[i], pos[i + 1]), (l, l), (r, r), (cls[i + 1], cls[i]))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(both, kinds)], ["cls", "pos", "l", "r", "other"])


def _windows(batches):
    """Suffixes to one row for each split of the words around the stem: (cls, pos, l, key)."""
    side = GAP - 1
    for batch in batches:
        for k in range(0, batch.num_rows, 5000):
            part = batch.slice(k, 5000)
            cls, pos, stem = (part.column(i).to_numpy() for i in range(3))
            right, left = (np.frombuffer(b"".join(part.column(i).to_pylist()), ">u4").reshape(-1, side).astype(U) for i in (3, 4))
            out = []
            for l in range(side + 1):
                words = np.hstack([left[:, :l], right[:, : side - l]])
                full = (words != 0).all(1)
                key = stem.view(U) + U(l)
                for c in range(side):
                    key = (key ^ words[:, c]) * U(0x9E3779B97F4A7C15)
                    key ^= key >> U(29)
                out.append((cls[full], pos[full], np.full(full.sum(), l), key.view(np.int64)[full]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), kinds[i]) for i in range(4)], ["cls", "pos", "l", "key"])


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls", "pos"), F.lit(SALTS)))


def _of_several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` two classes have at least, with c0 and c1, the smallest and largest of them, and salt.

    Rows of one key are first summed up by salt, and only these sums, at most ``SALTS`` a key, meet in one task."""
    rows = _salted(rows)
    sums = rows.groupBy(key, "salt").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1"))
    w = Window.partitionBy(key)
    sums = sums.select(key, "salt", F.min("c0").over(w).alias("c0"), F.max("c1").over(w).alias("c1")).where("c0 <> c1")
    return rows.join(sums, [key, "salt"])


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) of each span of ``docs`` covered by passages of at least ``least`` words
    that another row has too, n_words, and with_doc_id, the smallest id of a text that shares some of it."""
    if least < 2 * GAP:
        raise ValueError(f"passages of fewer than {2 * GAP} words")
    spark, scratch, stem, side = docs.sparkSession, Scratch(docs.sparkSession), least - GAP + 1, GAP - 1
    rows = docs.selectExpr("xxhash64(doc_id is null, doc_id, text) row_key", "cast(doc_id as bigint) doc_id", "cast(text as string) text")
    facts = scratch.save(rows.mapInArrow(_suffixes(least), "row_key long, doc_id long, n long, cls long, stem array<long>, pos array<int>"))
    facts = facts.where(F.col("n") >= least)
    classes = facts.groupBy("cls").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    classes = scratch.save(classes)

    each = facts.select("cls", F.explode(F.arrays_zip("stem", "pos")).alias("s")).select("cls", F.col("s.stem").alias("stem"), F.col("s.pos").alias("pos"))
    want = _of_several(each, "stem").groupBy("cls").agg(F.collect_set("pos").alias("pos"))
    want = scratch.save(want.join(classes.select("cls", "row_key"), "cls").select("row_key", "cls", "pos"))
    suffixes = rows.select("row_key", "text").join(want, "row_key").select("cls", "text", "pos").dropDuplicates(["cls"])
    suffixes = scratch.save(suffixes.mapInArrow(_contexts(least), "cls long, pos int, stem long, right binary, left binary"))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    match = "cls long, pos int, l int, r int, other long"
    orders = (("stem", "right", "left", "cls", "pos"), ("stem", "left", "right", "cls", "pos"))
    sorted_ = [suffixes.repartitionByRange(parts, *o).sortWithinPartitions(*o).mapInArrow(_neighbours, match) for o in orders]
    shares = scratch.save(sorted_[0].unionAll(sorted_[1]))
    long = f"l + r >= {side}"
    matches = shares.where(long)
    # Settled: some match is long enough, and none of the shorter ones reaches further than those do.
    reach = shares.groupBy("cls", "pos").agg(*[F.max(c).alias(c) for c in "lr"], *[F.max(F.when(F.expr(long), F.col(c))).alias(f"{c}_long") for c in "lr"])
    settled = reach.where("l = l_long and r = r_long").select("cls", "pos")
    salted = _salted(suffixes)
    states = salted.select("cls", "pos", "stem", "salt").join(settled.withColumn("done", F.lit(True)), ["cls", "pos"], "left")
    states = states.groupBy("stem", "salt").agg(F.max(F.col("done").isNull()).alias("open"))
    open_ = states.select("stem", "salt", F.max("open").over(Window.partitionBy("stem")).alias("open")).where("open")
    windows = salted.join(open_, ["stem", "salt"], "left_semi").select(*suffixes.columns).mapInArrow(_windows, "cls long, pos int, l int, key long")
    windows = scratch.save(windows)
    exact = _of_several(windows, "key").select("cls", "pos", "l", (side - F.col("l")).alias("r"), F.when(F.col("cls") == F.col("c0"), F.col("c1")).otherwise(F.col("c0")).alias("other"))

    found = matches.unionAll(exact).select("cls", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + stem + F.col("r")).alias("b"), "other")
    found = found.groupBy("cls", "a", "b").agg(F.min("other").alias("other"))
    copied = classes.where("copies > 1").select("cls", F.lit(0).alias("a"), F.col("n").cast("int").alias("b"), F.col("cls").alias("other"))
    lows = classes.select(F.col("cls").alias("other"), "low")
    found = found.unionAll(copied).join(lows, "other").drop("other")
    # Spans of one text: a row starts a new one where it begins past all ends so far.
    before = Window.partitionBy("cls").orderBy("a", "b")
    found = found.withColumn("top", F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("span", F.sum(F.when(F.col("top") >= F.col("a"), 0).otherwise(1)).over(before))
    spans = found.groupBy("cls", "span").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("low").alias("with_doc_id"))
    out = facts.select("cls", "doc_id").join(spans, "cls")
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "with_doc_id")


def op6_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
