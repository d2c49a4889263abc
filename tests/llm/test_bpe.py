import hashlib
import random

import public_tokenizers
import tiktoken

from rostrum.llm import bpe


def test_equals_the_library_and_round_trips(spark):
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    table = bpe.PerfectHash(list(ranks))
    assert sorted(table.keys) == sorted(ranks) and all(table.keys[table.find(k)] == k for k in list(ranks)[::7])
    e = bpe.Encoder(ranks, table, public_tokenizers.PATTERN, room=50)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    wide = list("ab '\n\t\x0b\x1c\x1f\x85\xa0 　é中🙂ǅ٣²Ⅷ'sltrevmd1!?.-_#\r")
    narrow = [chr(i) for i in range(256)]
    for alphabet in (wide, narrow):
        for _ in range(3000):
            t = "".join(rnd.choices(alphabet, k=rnd.randint(0, 30)))
            ids = e.encode(t)
            assert ids == lib.encode_ordinary(t), repr(t)
            assert e.decode(ids) == t.encode()
    long = "ab" * 40_000
    assert e.decode(e.encode(long)) == long.encode()

    rows = [(1, "Hello  world", 5), (1, "Hello  world", 5), (None, None, None), (2, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = lib.encode_ordinary("Hello  world")
    assert out == {(1, len(ids), sha(" ".join(map(str, ids))), sha("Hello  world")), (None, 0, sha(""), sha("")), (2, 0, sha(""), sha(""))}
    back = bpe.decode(bpe.encode(docs)).collect()
    assert len(back) == 4 and {bytes(r.bytes) for r in back} == {b"Hello  world", b""}
    assert bpe.round_trip(docs.limit(0)).collect() == []


def test_unknown_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, [0, 1 << 40]), (2, None), (3, [0])], "doc_id long, ids array<long>")
    got = {r.doc_id: r.bytes for r in bpe.decode(rows).collect()}
    assert got[1] is None and got[2] == b"" and len(got[3]) == 1
