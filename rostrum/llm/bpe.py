"""Byte-level BPE encoding and decoding with a two-tier look-up.

Text is cut by the pre-token pattern. A minimal perfect hash over the vocabulary resolves pre-tokens that are
whole entries; the others are merged by a heap of ranks over a linked list of their bytes, n log n in their
length. The ranks are read on the driver (a vocabulary, bounded by its file) and broadcast.

Defined cases: a null text is the empty text: no tokens; texts are never cut or capped; every input row gives one
output row, repeated or null ids included; an empty table gives an empty table; other columns are ignored.
"""
import base64
import hashlib
import heapq
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from rostrum.llm._spark import Scratch, spread, text_slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """Keys to 0..n-1 without gaps: a first hash picks a bucket, whose displacement sends its keys to free slots.

    A bucket of one key holds its slot itself, as -slot - 1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 1):
        self.n, self.r = len(keys), max(1, len(keys) // per_bucket)
        self.shift = np.zeros(self.r, np.int64)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.r)]
        for i, h in enumerate(hashes):
            buckets[h % self.r].append(i)
        slots = [-1] * self.n
        order = sorted(range(self.r), key=lambda b: (-len(buckets[b]), b))
        free = None
        for b in order:
            own = buckets[b]
            if len(own) > 1:
                d = 0
                while True:
                    at = [self._slot(hashes[i], d) for i in own]
                    if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for i, s in zip(own, at):
                    slots[s] = i
            elif own:
                if free is None:
                    free = iter([s for s in range(self.n) if slots[s] < 0])
                s = next(free)
                slots[s], self.shift[b] = own[0], -s - 1
        self.keys = [keys[i] for i in slots]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
        return (x >> 20) % self.n

    def find(self, key: bytes) -> int:
        """The slot of ``key``, or -1 where it is none of the keys."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.r]
        s = -d - 1 if d < 0 else self._slot(h, int(d))
        return s if self.keys[s] == key else -1


def narrowed(pattern: str) -> str:
    """The pattern for texts of code points below 256, its Unicode classes written out, for the faster ``re``."""
    chars = [chr(i) for i in range(256)]
    sets = {c: "".join("\\x%02x" % ord(x) for x in chars if regex.fullmatch(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in regex.findall(r"\\p\{[LN]\}|\\.|.", pattern, regex.S):
        inside = part == "[" or inside and part != "]"
        if part in sets:
            part = sets[part] if inside else f"[{sets[part]}]"
        elif part == r"\S":
            if inside:
                raise ValueError("a negated class inside a class")
            part = f"[^{sets[r'\s']}]"
        elif part[0] == "\\" and part[1].isalnum():
            raise ValueError(f"{part} has no narrow form here")
        out.append(part)
    return "".join(out)


class Encoder:
    """Built once a task from the broadcast ranks. ``known`` remembers pre-tokens; it is emptied at ``room`` entries."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pattern: str, room: int = 500_000):
        self.ranks, self.table, self.room = ranks, table, room
        self.slot_rank = [ranks[k] for k in table.keys]
        self.bytes_of = {r: k for k, r in ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.wide = regex.compile(pattern).findall
        try:
            self.narrow = re.compile(narrowed(pattern)).findall
        except ValueError:
            self.narrow = self.wide
        self.known: dict[str, tuple[int, ...]] = {}

    def cut(self, text: str) -> list[str]:
        """Pre-tokens; most texts have Latin letters only and take the faster engine, with the same cuts."""
        return (self.narrow if text.isascii() or max(text) < "\u0100" else self.wide)(text)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equals, until no neighbours form an entry."""
        n, get = len(piece), self.ranks.get
        end_of, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts at i
        rank_at = [get(piece[i : i + 2]) for i in range(n - 1)]  # of that part with the next one; None: no entry
        rank_at.append(None)
        heap = [r * n + i for i, r in enumerate(rank_at) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank_at[i] != r:
                continue  # either part has been merged since
            j = end_of[i]
            end_of[i] = end = end_of[j]
            rank_at[i] = rank_at[j] = None
            if end < n:
                before[end] = i
                if (r := get(piece[i : end_of[end]])) is not None:
                    rank_at[i] = r
                    heapq.heappush(heap, r * n + i)
            if (k := before[i]) >= 0:
                rank_at[k] = r = get(piece[k:end])
                if r is not None:
                    heapq.heappush(heap, r * n + k)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end_of[i]]])
            i = end_of[i]
        return tuple(out)

    def pre_token(self, token: str) -> tuple[int, ...]:
        piece = token.encode()
        slot = self.table.find(piece)
        ids = (self.slot_rank[slot],) if slot >= 0 else self.merge(piece)
        if len(self.known) >= self.room:
            self.known.clear()
        self.known[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        tokens = self.cut(text)
        try:
            return list(chain.from_iterable(map(self.known.__getitem__, tokens)))
        except KeyError:
            known = self.known
            # Filled token by token: emptying ``known`` on the way loses nothing.
            return list(chain.from_iterable([known.get(t) or self.pre_token(t) for t in tokens]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def joined(self, ids) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


@cache
def _vocabulary(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    """Ranks and perfect hash of a file, made once a driver."""
    ranks = read_ranks(path)
    return ranks, PerfectHash(list(ranks))


def _share(spark, path: str, pattern: str):
    return spark.sparkContext.broadcast((*_vocabulary(path), pattern))


def _mapped(docs: DataFrame, work, schema: str, path: str, pattern: str, text: str) -> DataFrame:
    Scratch(docs.sparkSession)  # bounds Arrow batches
    shared = _share(docs.sparkSession, path, pattern)

    def run(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            for rows, _, _ in text_slices(batch, text):
                yield work(encoder, rows)

    return spread(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids, the text's token ids in order."""

    def work(encoder, rows):
        ids = [encoder.encode(t or "") for t in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), work, "doc_id long, ids array<int>", path, pattern, "text")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and bytes, of a table of doc_id and ids; null ids give empty bytes, ids that the vocabulary has not give null."""
    shared = _share(tokens.sparkSession, path, public_tokenizers.PATTERN)

    def run(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            known = encoder.bytes_of.keys()
            out = [encoder.decode(x or ()) if known >= set(x or ()) else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes and decodes in one pass and returns digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def work(encoder, rows):
        sizes, ids_sha, text_sha = [], [], []
        for text in rows.column(1).to_pylist():
            ids = encoder.encode(text or "")
            sizes.append(len(ids))
            ids_sha.append(hashlib.sha256(encoder.joined(ids).encode()).hexdigest())
            text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, "text")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
