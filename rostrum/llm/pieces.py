"""SentencePiece encoding and decoding with a score-ordered agenda, for merge-type vocabularies.

A text, with a space mark in front and for each space, is a sequence of symbols, at first its characters. An agenda holds every pair
of neighbours that the vocabulary joins, best score first and leftmost among equals; the pair taken is joined and its new
neighbours are entered, until the agenda is empty. Symbols that are no piece become pieces of their bytes. Where no piece holds the two
characters that stand side by side, no pair across such a place is ever joined, and the text is cut there (if one of the two is ASCII or a
mark). A slice's distinct segments that were not met before are merged together: short ones as rows of arrays, each with its own agenda; long
ones by a heap. Segments met before are remembered. Each slice is also given to the sentencepiece library, and ``agrees`` says whether its
ids are the same and the decoded text is the text that went in (or what the library makes of the ids).

Models of merges with an identical normaliser, a leading space, escaped spaces, byte pieces and neither unused nor user-defined pieces are
read; others raise an error. The vocabulary is bounded by its file and broadcast.

Defined cases: a null text is the empty text: no tokens; texts are never cut or capped; every input row gives one output row,
repeated or null ids included; an empty table gives an empty table; other columns are ignored; a space mark in a text is decoded as a space.
"""
import hashlib
import heapq
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from rostrum.llm._spark import Scratch, spread, text_slices

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Fixed values of the model format: kinds of pieces, and the kind of vocabulary.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
MERGES = 2
BROKEN = "�"
#: Symbols of a segment up to which its agenda is a row of ranks; segments merged together at most; a rank behind all others.
SHORT, TOGETHER, NEVER = 40, 1 << 16, (1 << 31) - 1
#: Low bits of a remembered place: how many ids are there.
MANY = (1 << 32) - 1


def read_model(data: bytes) -> ModelProto:
    model = ModelProto()
    model.ParseFromString(data)
    how, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    plain = how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap
    if model.trainer_spec.model_type != MERGES or model.trainer_spec.treat_whitespace_as_suffix or not plain or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
        raise ValueError("not a model of merges with byte pieces and plain spaces")
    return model


def whole_characters(data: bytes) -> str:
    """UTF-8 bytes as text; each byte that begins no character is one replacement character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append(BROKEN)
            at += 1
    return "".join(out)


class Pieces:
    """Built once a worker from the model's bytes. ``known`` remembers segments, each with where its ids are in ``pool`` and how many; both
    are emptied before texts that find ``room`` of them, or 16 times as many ids."""

    made: dict = {}

    @classmethod
    def of(cls, data: bytes) -> "Pieces":
        """The one of this process, which later tasks of a worker find with the segments that earlier ones met."""
        if data not in cls.made:
            cls.made.clear()
            cls.made[data] = cls(data)
        return cls.made[data]

    def __init__(self, data: bytes, room: int = 1_000_000):
        model = read_model(data)
        self.library = SentencePieceProcessor(model_proto=data)
        self.room, self.known, self.pool, self.used = room, {}, np.empty(1 << 16, np.int32), 0
        pieces = list(model.pieces)
        places = {s: i for i, s in enumerate(sorted({-p.score for p in pieces if p.type == NORMAL}))}
        self.id_of = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.rank_of = {p.piece: places[-p.score] for p in pieces if p.type == NORMAL}  # equal scores share a rank
        self.byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(pieces) if p.type == BYTE}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.text_of = {i: p.piece.replace(MARK, " ") for i, p in enumerate(pieces) if p.type == NORMAL}
        self.text_of |= {i: "" for i, p in enumerate(pieces) if p.type == CONTROL} | {i: model.trainer_spec.unk_surface for i, p in enumerate(pieces) if p.type == UNKNOWN}
        self.text_of |= {i: chr(b) for i, b in self.byte_of.items() if b < 128}  # never part of a longer character
        self.silent = {i for i, p in enumerate(pieces) if p.type == CONTROL}
        self.size = len(pieces)
        self.digits = pa.array([b"%d" % i for i in range(self.size)], pa.large_binary())
        self.bytes_of = pa.array([self.text_of[i].encode() if i in self.text_of else bytes((self.byte_of[i],)) for i in range(self.size)], pa.large_binary())
        self._tables()

    def _tables(self) -> None:
        """What the agenda of many segments reads: symbols are ids, or ``size`` plus the code point of a character that is no piece."""
        self.symbol_of = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        singles = {s: i for s, i in self.id_of.items() if len(s) == 1}
        self.symbol_of[[ord(c) for c in singles]] = list(singles.values())
        self.symbol_of[32] = self.symbol_of[ord(MARK)]  # texts keep their spaces
        number = {c: int(self.symbol_of[ord(c)]) for c in set(chain.from_iterable(self.id_of))} | self.id_of
        pairs, met = {}, set()
        for s, i in self.id_of.items():
            met.update(zip(s, s[1:]))
            for k in range(1, len(s)):
                if (left := number.get(s[:k])) is not None and (right := number.get(s[k:])) is not None:
                    pairs[left << 21 | right] = (self.rank_of[s], i)
        self.pairs = np.array(sorted(pairs) + [1 << 62])
        self.pair_rank, self.pair_id = np.array([pairs[k] for k in sorted(pairs)] + [(NEVER, 0)]).T.astype(np.int32)
        kind = lambda c: 32 if c == MARK else min(ord(c), 128)
        near = np.zeros((129, 129), bool)  # kinds of characters that stand side by side in a piece
        for one, other in met:
            near[kind(one), kind(other)] = True
        near[128, 128] = True  # bytes of one character, perhaps
        of = np.minimum(np.arange(256), 128)
        self.apart = ~near[of[:, None], of].ravel()  # of two bytes side by side

    def merge(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment by an agenda that is a heap: n log n in its length."""
        out = []
        for s in self._by_heap(segment):
            one = self.id_of.get(s)
            out += (one,) if one is not None else [self.id_of_byte[b] for b in s.encode()]
        return tuple(out)

    def _pair(self, left, right):
        """Rank and id of what two symbols make; the rank is ``NEVER`` if that is no piece."""
        key = left << 21 | right
        at = np.searchsorted(self.pairs, key)
        found = self.pairs[at] == key
        return np.where(found, self.pair_rank[at], NEVER), self.pair_id[at]

    def _by_rows(self, symbols, begin, sizes):
        """Symbols left of many short segments, and how many of each, rows of equal length together: each row has an agenda of its
        pairs' ranks, and each round joins every row's first best pair. A row is then one symbol shorter."""
        rows, now = np.empty(0, np.int64), np.empty((0, int(sizes.max(initial=0))), np.int64)
        rank = made = np.empty((0, max(0, now.shape[1] - 1)), np.int32)
        done = []
        for n in range(now.shape[1], 0, -1):
            new = np.flatnonzero(sizes == n)
            fresh = symbols[begin[new, None] + np.arange(n)]
            more = self._pair(fresh[:, :-1], fresh[:, 1:])
            rows, now, rank, made = np.concatenate([rows, new]), np.concatenate([now, fresh]), np.concatenate([rank, more[0]]), np.concatenate([made, more[1]])
            if n == 1:
                done.append((rows, now))
                break
            i = rank.argmin(1)
            some = rank[np.arange(len(rows)), i] < NEVER
            done.append((rows[~some], now[~some]))
            rows, now, rank, made, i = rows[some], now[some], rank[some], made[some], i[some]
            each = np.arange(len(rows))
            now[each, i] = made[each, i]
            stays = np.ones(now.shape, bool)
            stays[each, i + 1] = False
            now = now[stays].reshape(len(rows), n - 1)
            stays = np.ones(rank.shape, bool)
            stays[each, i] = False
            rank, made = rank[stays].reshape(len(rows), n - 2), made[stays].reshape(len(rows), n - 2)
            for side, at in ((i < n - 2, i), (i > 0, i - 1)):
                r, c = each[side], at[side]
                rank[r, c], made[r, c] = self._pair(now[r, c], now[r, c + 1])
        left = np.empty(len(sizes), np.int64)
        for rows, now in done:
            left[rows] = now.shape[1]
        first, out = np.cumsum(left) - left, np.empty(left.sum(), np.int64)
        for rows, now in done:
            out[first[rows, None] + np.arange(now.shape[1])] = now
        return out, left

    def _merged(self, segments: pa.Array):
        """Ids of all the segments, one array, where each one's begin in it, and how many they are."""
        sizes = pc.utf8_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
        short = sizes <= SHORT
        points = np.frombuffer(b"".join(flat_bytes(segments.filter(pa.array(short)))).decode().encode("utf-32-le"), np.uint32)
        ids, left = self._by_rows(self.symbol_of[points], np.cumsum(sizes[short]) - sizes[short], sizes[short])
        odd = ids >= self.size
        if odd.any():  # these become pieces of their bytes
            chars = ids[odd] - self.size
            width = np.ones(len(ids), np.int64)
            width[odd] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            known = np.fromiter(map(self.id_of_byte.__getitem__, "".join(map(chr, chars.tolist())).encode()), np.int64)
            odd, ids = np.repeat(odd, width), np.repeat(ids, width)
            ids[odd] = known
            left = np.add.reduceat(width, np.cumsum(left) - left)
        long = [self.merge(s.replace(" ", MARK)) for s in segments.filter(pa.array(~short)).to_pylist()]
        count = np.empty(len(sizes), np.int64)
        count[short], count[~short] = left, list(map(len, long))
        begin = np.empty(len(sizes), np.int64)
        begin[short] = np.cumsum(left) - left
        begin[~short] = len(ids) + np.cumsum(count[~short]) - count[~short]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(long), np.int64)]).astype(np.int32), begin, count

    def _by_heap(self, segment: str) -> list[str]:
        n, get = len(segment), self.rank_of.get
        end_of, before = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that starts at i
        rank_at = [get(segment[i : i + 2]) for i in range(n - 1)]  # of that symbol joined with the next; None: no piece
        rank_at.append(None)
        agenda = [r * n + i for i, r in enumerate(rank_at) if r is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i = divmod(heapq.heappop(agenda), n)
            if rank_at[i] != r:
                continue  # either symbol has been joined since
            j = end_of[i]
            end_of[i] = end = end_of[j]
            rank_at[i] = rank_at[j] = None
            if end < n:
                before[end] = i
                if (r := get(segment[i : end_of[end]])) is not None:
                    rank_at[i] = r
                    heapq.heappush(agenda, r * n + i)
            if (k := before[i]) >= 0:
                rank_at[k] = r = get(segment[k:end])
                if r is not None:
                    heapq.heappush(agenda, r * n + k)
        out, i = [], 0
        while i < n:
            out.append(segment[i : end_of[i]])
            i = end_of[i]
        return out

    def _places(self, segments: pa.Array):
        """Where the segments' ids are in ``pool``, times ``MANY`` + 1, plus how many they are; those not met before are merged together."""
        if len(self.known) >= self.room or self.used >= 16 * self.room:
            self.known.clear()
            self.used = 0
        names = flat_bytes(segments)
        places = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(places < 0)
        for new in np.split(missing, range(TOGETHER, len(missing), TOGETHER)) if len(missing) else ():
            ids, begin, count = self._merged(segments.take(pa.array(new)))
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(ids), np.int32)])
            self.pool[self.used : self.used + len(ids)] = ids
            places[new] = (begin + self.used) << 32 | count
            self.used += len(ids)
            self.known.update(zip(map(names.__getitem__, new.tolist()), places[new].tolist()))
        return places

    def encode_all(self, texts: list[str]):
        """Ids of all the texts, one array, and where each text's begin in it, with the end behind."""
        plain = [spaced(t) for t in texts]
        ends = np.cumsum([0, *map(len, plain)])
        data = b"".join(plain)
        if not data:
            return np.empty(0, np.int32), ends
        flat = np.frombuffer(data, np.uint8)
        cut = np.ones(len(flat) + 1, bool)
        cut[1:-1] = self.apart[flat[:-1].astype(np.uint16) << 8 | flat[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy()]
        many = places & MANY
        upto = np.cumsum(many)
        ids = self.pool[np.repeat((places >> 32) - upto + many, many) + np.arange(upto[-1])]
        return ids, np.concatenate([[0], upto])[np.searchsorted(at, ends)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def joined(self, of: pa.Array, ids, bounds, between: bytes) -> list[bytes]:
        """What ``of`` has for the ids of each text, joined."""
        return pc.binary_join(pa.LargeListArray.from_arrays(bounds, of.take(pa.array(ids))), pa.scalar(between, of.type)).to_pylist()

    def decode(self, ids) -> str:
        """The ids' text without the space in front; runs of byte pieces are read as UTF-8."""
        try:
            text = "".join(map(self.text_of.__getitem__, ids))
        except KeyError:
            parts, run = [], bytearray()
            for i in ids:
                if i not in self.text_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(whole_characters(bytes(run)))
                    run.clear()
                parts.append(self.text_of[i])
            text = "".join(parts) + whole_characters(bytes(run))
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.library.id_to_piece(int(first)).startswith(MARK) else text


def flat_bytes(texts: pa.LargeStringArray) -> list[bytes]:
    """The texts' UTF-8; much faster than ``to_pylist``."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def spaced(text: str) -> bytes:
    """A text as it is cut: a space in front and for each mark; nothing for an empty one."""
    return (" " + text.replace(MARK, " ")).encode() if text else b""


def _mapped(rows: DataFrame, work, schema: str, model: str, column: str) -> DataFrame:
    Scratch(rows.sparkSession)  # bounds Arrow batches
    with open(model, "rb") as f:
        data = f.read()
    read_model(data)  # a wrong one is an error of the driver's
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        pieces = Pieces.of(shared.value)
        for batch in batches:
            for part in text_slices(batch, column) if column == "text" else [(batch,)]:
                yield work(pieces, part[0])

    return spread(rows).mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids, the text's piece ids in order."""

    def work(pieces, rows):
        ids, bounds = pieces.encode_all([t or "" for t in rows.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return _mapped(_texts(docs), work, "doc_id long, ids array<int>", model, "text")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text, of a table of doc_id and ids; null ids give the empty text, ids that the vocabulary has not give null."""

    def work(pieces, rows):
        there = range(pieces.size)
        out = [pieces.decode(x or ()) if all(i in there for i in x or ()) else None for x in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return _mapped(tokens.selectExpr("cast(doc_id as bigint) doc_id", "ids"), work, "doc_id long, text string", model, "ids")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, digests of ids and of the decoded text, and whether the library agrees."""

    def work(pieces, rows):
        texts = [t or "" for t in rows.column(1).to_pylist()]
        flat, bounds = pieces.encode_all(texts)
        names, found = pieces.joined(pieces.digits, flat, bounds, b","), pieces.joined(pieces.bytes_of, flat, bounds, b"")
        theirs = pieces.library.encode(texts, num_threads=1, return_type="numpy")
        text_sha, agrees = [], []
        for text, back, ids, other in zip(texts, found, np.split(flat, bounds[1:-1]), theirs):
            wanted = spaced(text)
            back = back[1:] if back == wanted else pieces.decode(ids.tolist()).encode()
            text_sha.append(hashlib.sha256(back).hexdigest())
            agrees.append(np.array_equal(ids, other) and (back == wanted[1:] or back == pieces.library.decode(other.tolist()).encode()))
        ids_sha = [hashlib.sha256(x).hexdigest() for x in names]
        columns = [rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(agrees, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return _mapped(_texts(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean", model, "text")


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
