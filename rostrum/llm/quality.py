"""Quality rules: cross-document line frequency, after per-text base counts.

Lines are normalised (A-Z lower-cased, digits as 0, white space as one space) and hashed to 64 bits. For each
host, the distinct documents that hold a line are counted; a line above both limits is boilerplate and is removed;
a document that keeps too little is rejected as depleted.

A document is known by the hash of its whole text: exact copies count once, so that copying alone makes no line
boilerplate, and texts that differ anywhere are two documents, whatever line they share.

Defined cases: a null text has no words and counts as the empty text; a null host is a host of its own; a null or repeated
``doc_id`` is kept as it is, every input row gives one output row of ``quality_rules``; an empty table gives an empty table; texts of
any length are read whole; other columns, whatever their names, are ignored by ``quality_rules`` and kept by ``keep_good``.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch, free_names, text_slices
from rostrum.llm._words import LOWER, Words, mix, run_sums, runs, stretch, sums

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PLAIN = LOWER.copy()
PLAIN[48:58] = 48
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RAW = 0x9E3779B97F4A7C15


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which are one of several, and which follow an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    several = later.copy()
    several[order[:-1][same]] = True
    return several, later


def line_facts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict:
    """Base counts of each text, and its normalised lines' hashes and word counts; lines without a word are left out."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    out = {"n_words": words.counts, "n_symbols": _per_text(SYMBOLS[data], offsets)}
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=solid[1:])
    chars = np.zeros(len(words.start) + 1, np.int64)
    np.cumsum(solid[words.end] - solid[words.start], out=chars[1:])
    out["word_chars"] = np.diff(chars[words.first])

    hashes = words.hashes()
    total = run_sums(hashes)
    at = np.flatnonzero(words.text[: len(hashes) - window + 1] == words.text[window - 1 :]) if len(hashes) >= window else np.zeros(0, np.int64)
    several, _ = _repeated(runs(total, at, at + window) ^ salt[words.text[at]])
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[several], 1)
    np.add.at(cover, at[several] + window, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover[:-1]) > 0, words.first)

    # A line runs from a text's start or past a \n to the next \n or the text's end; only lines with a word count.
    cuts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    cuts = cuts[cuts < len(data)]
    ends = np.append(cuts[1:], len(data))
    ends = np.where(data[ends - 1] == 10, ends - 1, ends) if len(ends) else ends
    first, last = np.searchsorted(words.start, cuts), np.searchsorted(words.start, ends)
    full = last > first
    cuts, ends, first, last = cuts[full], ends[full], first[full], last[full]
    text = words.text[first] if len(first) else np.zeros(0, np.int64)
    raw = stretch(sums(data.astype(np.uint64) + np.uint64(1), RAW), RAW, cuts, ends)
    _, later = _repeated(raw ^ salt[text])
    out["n_dup_lines"] = np.bincount(text[later], minlength=n)

    plain = Words(PLAIN[data], offsets)
    lines = runs(run_sums(plain.hashes()), first, last)
    begin = np.searchsorted(text, np.arange(n + 1))
    return out | {"line_hash": lines.view(np.int64), "line_words": last - first, "line_from": begin}


def _facts(batches):
    for batch in batches:
        for rows, data, offsets in text_slices(batch, "text"):
            f = line_facts(data, offsets)
            begin = pa.array(f["line_from"], pa.int32())
            cols = rows.columns[:4]
            cols += [pa.array(f[c], pa.int64()) for c in COUNTS]
            cols += [pa.ListArray.from_arrays(begin, pa.array(f["line_hash"], pa.int64())), pa.ListArray.from_arrays(begin, pa.array(f["line_words"], pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row_key", "text_id", "doc_id", "host", *COUNTS, "line_hash", "line_words"])


def _row_key(host: str):
    return F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", F.col(host).isNull(), host, F.col("text").isNull(), "text")


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 10, host_share: float = 0.1, min_left: float = 0.3, min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """Verdicts on the rows of ``docs`` (doc_id, text and the host column).

    A line is boilerplate where at least ``min_docs`` distinct documents of its host hold it, and more than
    ``host_share`` of the host's distinct documents. A document is depleted where removing those lines leaves
    fewer than ``min_words`` words or less than ``min_left`` of its words.

    Returns row_key (hash of doc_id, host and text), doc_id, the counts, base_failed, kept, n_cut_words, and cut_lines, the
    hashes of the text's boilerplate lines (null for none)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(_row_key(host).alias("row_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    schema = "row_key long, text_id long, doc_id long, host string, " + "".join(f"{c} long, " for c in COUNTS) + "line_hash array<long>, line_words array<long>"
    facts = scratch.save(rows.mapInArrow(_facts, schema))

    host_id = F.xxhash64(F.col("host").isNull(), "host")
    lines = facts.select(host_id.alias("host_id"), "text_id", F.explode("line_hash").alias("line"))
    hosts = facts.select(host_id.alias("host_id"), "text_id").groupBy("host_id").agg(F.count_distinct("text_id").alias("host_docs"))
    counts = lines.groupBy("host_id", "line").agg(F.count_distinct("text_id").alias("n")).where(F.col("n") >= min_docs)
    # A line in more than a share s of a host's documents: at most (lines a document) / s of them a host.
    common = scratch.save(counts.join(hosts, "host_id").where(F.col("n") > host_share * F.col("host_docs")).select("host_id", "line"))

    pairs = facts.select("row_key", host_id.alias("host_id"), F.explode(F.arrays_zip("line_hash", "line_words")).alias("l"))
    pairs = pairs.select("row_key", "host_id", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("w"))
    # Rows alike in id, host and text share a key and a verdict: the sum is divided by how many they are. A list holds one text's lines.
    cut = pairs.join(common, ["host_id", "line"], "left_semi").groupBy("row_key").agg(F.sum("w").alias("cut_all"), F.collect_set("line").alias("cut_lines"))
    alike = facts.groupBy("row_key").agg(F.count(F.lit(1)).alias("alike"))
    cut = cut.join(alike, "row_key").select("row_key", F.expr("cut_all div alike").alias("n_cut_words"), "cut_lines")
    out = facts.select("row_key", "doc_id", *COUNTS).join(cut, "row_key", "left").withColumn("n_cut_words", F.coalesce("n_cut_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_cut_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    depleted = (left < min_words) | (left < min_left * F.col("n_words"))
    return out.select("row_key", "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_cut_words", "cut_lines")


def without_lines(text: str, hashes, cut: set) -> str:
    """``text`` less its lines whose hash is in ``cut``; ``hashes`` are those of its lines that have a word, in order."""
    own = iter(hashes)
    return "\n".join(x for x in text.split("\n") if not x.strip(" \t\v\f\r") or next(own) not in cut)


def _cut(names: list, at: int):
    """Rows of a document's columns and cut_lines to the same rows without those lines."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, names[at]):
                texts, gone = rows.column(at).to_pylist(), rows.column(len(names)).to_pylist()
                if any(gone):
                    f = line_facts(data, offsets)
                    for i, own in enumerate(gone):
                        if own:
                            texts[i] = without_lines(texts[i], f["line_hash"][f["line_from"][i] : f["line_from"][i + 1]].tolist(), set(own))
                cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(rows.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their texts without boilerplate lines; other columns stay as they are."""
    key, gone = free_names(docs, "row_key", "cut_lines")
    verdict = quality_rules(docs, **limits).where("kept").select(F.col("row_key").alias(key), F.col("cut_lines").alias(gone)).dropDuplicates([key])
    kept = docs.withColumn(key, _row_key(limits.get("host", "source"))).join(verdict, key).select(*docs.columns, gone)
    return kept.mapInArrow(_cut(docs.columns, docs.columns.index("text")), docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("row_key", "cut_lines")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM base),
norm AS (
  SELECT doc_id, source, raw, line_no, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS w,
         regexp_replace(translate(array_to_string(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), ' '),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS line
  FROM lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS host_docs FROM base GROUP BY source),
held AS (
  SELECT n.source, n.line, count(DISTINCT md5(b.text)) AS n_docs FROM norm n JOIN base b USING (doc_id) GROUP BY n.source, n.line),
common AS (
  SELECT t.source, t.line FROM held t JOIN hosts h ON h.source IS NOT DISTINCT FROM t.source
  WHERE n_docs >= 10 AND n_docs > 0.1 * host_docs),
cut AS (
  SELECT n.doc_id, sum(w) AS cut FROM norm n JOIN common c ON c.line = n.line AND c.source IS NOT DISTINCT FROM n.source GROUP BY n.doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM norm GROUP BY doc_id),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM base WHERE len(words) >= 5),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS g FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(5) t(k) GROUP BY doc_id),
facts AS (
  SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(cut, 0) AS BIGINT) AS n_cut_words
  FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_words - n_cut_words >= 10 AND n_words - n_cut_words >= 0.3 * n_words AS kept,
       n_cut_words
FROM facts
"""
